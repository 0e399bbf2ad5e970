"""Repair of conversation structure: the cheapest edits that make roles alternate, and their audit.

A row is a symbol of role and fault, and each symbol a min-plus transition among the four states of the
grammar ``(s?(ua)+)?``. Equal consecutive symbols are one run; the transition of a run comes from cached
binary powers. Costs to the end flow backwards over runs; the choices are unrolled forwards, least letter first.

Turns are dealt by ranges of (conversation, turn), so that one conversation may span any number of tasks. A
task finishes the conversations that lie inside it. Those at its edges, and long ones, leave it as chunks;
their pieces are solved apart as transitions and joined as matrices, one per range partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_through

BLANKS = " \t\n\x0b\x0c\r"
#: Rows and bytes of text that one chunk of a long conversation holds.
CHUNK_ROWS = 1024
CHUNK_BYTES = 1 << 20
#: A conversation with more rows or bytes in a task leaves it in chunks.
OPEN_ROWS = 8192
OPEN_BYTES = 4 << 20

# states: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn
USER_NEXT = {0: 2, 1: 2, 3: 2}
ASSISTANT_NEXT = {2: 3}
KEEP = {"s": {0: 1}, "u": USER_NEXT, "a": ASSISTANT_NEXT, "x": {}}
FITTING = USER_NEXT | ASSISTANT_NEXT  # the state after an inserted or re-roled turn
COSTS = {"D": 4, "I": 3, "K": 0, "R": 3}
TRUNCATED_COST = 3
END = (0, 6, 3, 0)  # from each state: an empty or even ending costs nothing, else turns are inserted
FAR = 1 << 40
REMEMBERED = 1 << 14


def remembered(fn):
    """Keeps up to ``REMEMBERED`` results; a plain closure, so that it travels to executors by value."""
    known = {}

    def found(*key):
        if key not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[key] = fn(*key)
        return known[key]

    return found


def symbol(role: str, fault: str) -> str:
    """``d`` for rows that must go, else the role's initial (``x`` for others), upper case if truncated."""
    if fault in "bd":
        return "d"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return kind.upper() if fault == "t" else kind


@remembered
def edits(mark: str) -> tuple[tuple[str, int, int, int], ...]:
    """All (letter, state, next state, cost) that use up one row."""
    out = [("D", q, q, COSTS["D"]) for q in range(4)]
    if mark != "d":
        extra = TRUNCATED_COST if mark.isupper() else 0
        out += [("K", q, r, extra) for q, r in KEEP[mark.lower()].items()]
        out += [("R", q, r, COSTS["R"] + extra) for q, r in FITTING.items()]
    return tuple(out)


def times(a: tuple, b: tuple) -> tuple:
    """The min-plus product of two 4 x 4 matrices."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def apply(a: tuple, v: tuple) -> tuple:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


@remembered
def power(mark: str, k: int) -> tuple:
    """The transition of ``2**k`` equal rows, turns inserted before any of them included."""
    if k:
        return times(power(mark, k - 1), power(mark, k - 1))
    inserts = [[0 if i == j else FAR for j in range(4)] for i in range(4)]
    for q in range(4):
        r = FITTING[q]
        inserts[q][r] = min(inserts[q][r], COSTS["I"])
        inserts[q][FITTING[r]] = min(inserts[q][FITTING[r]], 2 * COSTS["I"])
    row = [[FAR] * 4 for _ in range(4)]
    for _, q, r, cost in edits(mark):
        row[q][r] = min(row[q][r], cost)
    return times(tuple(map(tuple, inserts)), tuple(map(tuple, row)))


def runs(marks: str) -> list[tuple[str, int]]:
    """Equal consecutive symbols as (symbol, length)."""
    codes = np.frombuffer(marks.encode(), dtype=np.uint8)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.array([], int)
    return [(marks[a], int(n)) for a, n in zip(first, np.diff(np.append(first, len(codes))))]


def before_run(mark: str, n: int, v: tuple) -> tuple:
    """Costs to the end before a run, from those after it."""
    k = 0
    while n:
        if n & 1:
            v = apply(power(mark, k), v)
        n, k = n >> 1, k + 1
    return v


def matrix(marks: str) -> tuple:
    """The transition of a whole piece."""
    out = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for mark, n in runs(marks):
        k = 0
        while n:
            if n & 1:
                out = times(out, power(mark, k))
            n, k = n >> 1, k + 1
    return out


@remembered
def one_back(mark: str, v: tuple) -> tuple[tuple, int]:
    """Costs before one row, lessened so that the least is zero, and by how much."""
    w = apply(power(mark, 0), v)
    least = min(w)
    return tuple(x - least for x in w), least


@remembered
def choice(mark: str, q: int, after: tuple) -> tuple[str, int]:
    """Letters spent at one row from state ``q``, insertions before it included, and the state after it.

    Among the cheapest ways it is the ASCII-least: at each step the least letter that still leads to the least cost.
    """
    here = apply(power(mark, 0), after)
    letters = ""
    while True:
        found = [(letter, r) for letter, a, r, cost in edits(mark) if a == q and cost + after[r] == here[q]]
        if here[FITTING[q]] + COSTS["I"] == here[q]:
            found.append(("I", None))
        letter, r = min(found, key=lambda f: f[0])
        letters += letter
        if letter != "I":
            return letters, r
        q = FITTING[q]


def _least_zero(v: tuple) -> tuple:
    least = min(v)
    return tuple(x - least for x in v)


def walk(marks: str, q: int, after: tuple) -> tuple[list[str], int]:
    """Letters for each row of a piece entered in state ``q``, and the state at its end."""
    found = runs(marks)
    ends, v = [], _least_zero(after)
    for mark, n in reversed(found):
        ends.append(v)
        v = _least_zero(before_run(mark, n, v))
    out = []
    for (mark, n), v in zip(found, reversed(ends)):
        behind = [v]
        for _ in range(n - 1):
            behind.append(one_back(mark, behind[-1])[0])
        for v in reversed(behind):
            letters, q = choice(mark, q, v)
            out.append(letters)
    return out, q


def closing(q: int) -> str:
    """Turns inserted behind the last row."""
    return "I" * (END[q] // COSTS["I"])


def solve(marks: str) -> tuple[tuple[str, ...], str]:
    """Letters of every row of a whole conversation, and those behind the last."""
    letters, q = walk(marks, 0, END)
    return tuple(letters), closing(q)


solve_short = remembered(solve)


def cost_of(letters: list[str], marks: str) -> int:
    return sum(COSTS[c] for part in letters for c in part) + TRUNCATED_COST * sum(p[-1] != "D" and m.isupper() for p, m in zip(letters, marks))


def rewritten(letters, roles, texts, q: int) -> list[tuple[str, str]]:
    """The turns that edits make of rows, from state ``q``; behind the rows, further letters insert."""
    out, rows = [], zip(roles, texts)
    for part in letters:
        for c in part:
            if c == "I":
                q = FITTING[q]
                out.append(("user" if q == 2 else "assistant", ""))
                continue
            role, text = next(rows)
            if c == "K":
                q = KEEP[role[:1]][q]
                out.append((role, text))
            elif c == "R":
                q = FITTING[q]
                out.append(("user" if q == 2 else "assistant", text))
    return out


def initials(roles: list[str]) -> str:
    return "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r in roles)


def illegal_pairs(kinds: str) -> int:
    """Neighbours that are not su, ua or au."""
    return max(len(kinds) - 1, 0) - sum(kinds[i : i + 2] in ("su", "ua", "au") for i in range(len(kinds) - 1))


def turn_stats(turns: np.ndarray) -> tuple[int | None, int | None, int]:
    """First, last and number of distinct turns of sorted turns without nulls."""
    if not len(turns):
        return None, None, 0
    return int(turns[0]), int(turns[-1]), 1 + int((turns[1:] != turns[:-1]).sum())


def damage(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, gone`` after the damage that crc32 of ``conv_id:turn`` modulo 20 tells.

    0 drops a row (it stays with ``gone`` set, so that its conversation is known), 1 empties the text,
    2 removes ``.``, ``!`` and ``?``, 3 repeats the row, 4 makes it a user turn. Nulls are one space in role, text and
    the hashed text; a null conversation or turn stays null otherwise.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    text = F.when(F.col("hit").isin(0, 1), "").when(F.col("hit") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        rows.select("conv_id", "turn", "role", "text", hit.alias("hit"))
        .select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.when(F.col("hit") == 4, "user").otherwise(space("role")).alias("role"),
            text.alias("text"),
            (F.col("hit") == 0).alias("gone"),
            F.explode(copies).alias("copy"),
        )
        .drop("copy")
    )


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns in the order of (conversation, turn, role, text), dealt by ranges, with fault and print of each."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(F.col("gone"), "g").when(F.col("body") == "", "b").when(F.right("body", F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    held = F.concat_ws(":", F.isnull("conv_id").cast("string"), F.length(conv), conv, F.length("role"), "role", "text")
    rows = turns.withColumn("body", body).select(
        "conv_id", "turn", "role", "text", fault.alias("fault"), F.unhex(F.md5(held)).alias("print"),
        # equal rows may be parted anywhere
        F.monotonically_increasing_id().alias("salt"),
    )
    keys = ["conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 64), "print", "salt"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")


LONG, TEXT = T.LongType(), T.StringType()
DIGEST = [("gaps", LONG), ("blank", LONG), ("duplicate", LONG), ("truncated", LONG), ("illegal", LONG), ("cost", LONG), ("audit", TEXT), ("repaired_sha256", TEXT)]
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", TEXT), T.StructField("text", TEXT)]))
CHUNK = [
    ("piece", LONG), ("blk", LONG), ("turns", T.ArrayType(LONG)), ("roles", T.ArrayType(TEXT)), ("texts", T.ArrayType(TEXT)),
    ("faults", TEXT), ("prints", T.ArrayType(T.BinaryType())),
]


def _schema(conv: T.StructField, fields: list) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv.dataType), *[T.StructField(n, t) for n, t in fields]])


class _Rows:
    """Rows of one conversation in one task, in order; dropped rows leave only the conversation's name."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.faults, self.prints = [], [], [], [], []

    def add(self, columns: list, a: int, b: int) -> None:
        for held, column in zip((self.turns, self.roles, self.texts, self.faults, self.prints), columns):
            held += column[a:b]

    def present(self) -> "_Rows":
        if "g" not in self.faults:
            return self
        out = _Rows()
        at = [i for i, f in enumerate(self.faults) if f != "g"]
        out.turns, out.roles, out.texts, out.faults, out.prints = ([c[i] for i in at] for c in (self.turns, self.roles, self.texts, self.faults, self.prints))
        return out

    def closed(self) -> tuple:
        """The digest and the repaired turns of a whole conversation."""
        rows = self.present()
        seen, faults = set(), []
        for fault, mark in zip(rows.faults, rows.prints):
            faults.append("d" if fault != "b" and mark in seen else fault)
            seen.add(mark)
        marks = "".join(map(symbol, rows.roles, faults))
        letters, tail = (solve_short if len(marks) <= 64 else solve)(marks)
        letters = [*letters, tail]
        made = rewritten(letters, rows.roles, rows.texts, 0)
        low, high, distinct = turn_stats(np.array([t for t in rows.turns if t is not None], dtype=np.int64))
        body = "\n".join(f"{r}:{t}" for r, t in made).encode()
        gaps = high - low + 1 - distinct if distinct else 0
        cost = cost_of(letters[:-1], marks) + COSTS["I"] * len(tail)
        digest = gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal_pairs(initials(rows.roles)), cost, "".join(letters), hashlib.sha256(body).hexdigest()
        return digest, [{"role": r, "text": t} for r, t in made]

    def chunks(self, piece: int, blk: int, last: bool):
        """Finished chunks, and the rows that are left for the next one."""
        rows, at = self.present(), 0
        sizes = np.cumsum([len(t) for t in rows.texts]) if rows.texts else np.array([], dtype=int)
        while at < len(rows.turns):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, min(at + CHUNK_ROWS, int(np.searchsorted(sizes, done + CHUNK_BYTES, side="right"))))
            if end >= len(rows.turns) and not last:
                break
            yield piece, blk, rows.turns[at:end], rows.roles[at:end], rows.texts[at:end], "".join(rows.faults[at:end]), rows.prints[at:end]
            at, blk = end, blk + 1
        if last and not blk:
            yield piece, 0, [], [], [], "", []
        for name in ("turns", "roles", "texts", "faults", "prints"):
            setattr(self, name, getattr(rows, name)[at:])


def _split(turns: DataFrame, open_rows: int, open_bytes: int) -> DataFrame:
    """One written table: finished conversations (``open`` false) and chunks of the others."""
    ordered = _ordered(turns)
    schema = _schema(ordered.schema["conv_id"], [("open", T.BooleanType()), *DIGEST, ("messages", MESSAGES), *CHUNK])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        out, weight = [], 0
        base, piece, blk, size = TaskContext.get().partitionId() << 32, -1, 0, 0
        name, rows, is_open = None, None, False

        def flush():
            nonlocal out, weight
            columns = list(zip(*out)) if out else [[]] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, arrow)], names=names)
            out, weight = [], 0
            return batch

        def give_chunks(last):
            nonlocal blk, weight
            for chunk in rows.chunks(base + piece, blk, last):
                out.append((name, True, *[None] * (len(DIGEST) + 1), *chunk))
                weight += sum(map(len, chunk[4]))
                blk = chunk[1] + 1

        for batch in batches:
            if arrow is None:
                arrow = [batch.schema.field("conv_id").type, *[_arrow(f.dataType) for f in schema.fields[1:]]]
            conv = batch.column("conv_id")
            ends = pc.run_end_encode(conv).run_ends.to_pylist()
            names_here = pc.run_end_encode(conv).values.to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("turn", "role", "text", "fault", "print")]
            lengths = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))])
            a = 0
            for this, b in zip(names_here, ends):
                if rows is None or this != name:
                    if rows is not None:
                        if is_open or piece == 0:
                            give_chunks(True)
                        else:
                            digest, made = rows.closed()
                            out.append((name, False, *digest, made, *[None] * len(CHUNK)))
                            weight += size
                    name, rows, is_open, blk, size, piece = this, _Rows(), False, 0, 0, piece + 1
                rows.add(columns, a, b)
                size += int(lengths[b] - lengths[a])
                is_open = is_open or len(rows.turns) > open_rows or size > open_bytes
                if is_open:
                    give_chunks(False)
                if weight > OPEN_BYTES or len(out) >= 4096:
                    yield flush()
                a = b
        if rows is not None:
            give_chunks(True)
            yield flush()

    return write_through(ordered.mapInArrow(run, schema), "conversations")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _marked(chunks: DataFrame) -> DataFrame:
    """Chunks with ``faults`` after duplicates are known: rows whose print an earlier row has."""
    place = F.struct("piece", "blk", "pos")
    rows = chunks.select("piece", "blk", F.posexplode("prints").alias("pos", "print"))
    firsts = rows.groupBy("print").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("print").alias("held"))
    repeats = (
        rows.join(firsts.where("n > 1").select("held", "first"), F.col("print") == F.col("held"))
        .where(place != F.col("first"))
        .groupBy("piece", "blk")
        .agg(F.collect_list("pos").alias("repeats"), F.first("piece").alias("p"), F.first("blk").alias("b"))
        .drop("piece", "blk")
    )
    joined = chunks.join(repeats, (F.col("piece") == F.col("p")) & (F.col("blk") == F.col("b")), "left").drop("p", "b")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("faults")
            said = []
            for faults, repeats in zip(batch.column("faults").to_pylist(), batch.column("repeats").to_pylist()):
                codes = list(faults)
                for i in repeats or []:
                    codes[i] = codes[i] if codes[i] == "b" else "d"
                said.append("".join(codes))
            yield batch.set_column(at, "faults", pa.array(said, pa.string())).drop_columns(["repeats"])

    return joined.mapInArrow(mark, chunks.schema)


def _solved(chunks: DataFrame) -> DataFrame:
    """``piece, blk, entry, letters, tail`` of every chunk of the open conversations."""
    conv = chunks.schema["conv_id"]

    def to_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = ["".join(map(symbol, r, f)) for r, f in zip(batch.column("roles").to_pylist(), batch.column("faults").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("conv_id", "piece", "blk")] + [pa.array(said, pa.string())], names=["conv_id", "piece", "blk", "marks"])

    fields = [("piece", LONG), ("blk", LONG), ("marks", TEXT)]
    symbols = write_through(chunks.select("conv_id", "piece", "blk", "roles", "faults").mapInArrow(to_marks, _schema(conv, fields)), "symbols")

    def in_order(table: pa.Table) -> pa.Table:
        return table.sort_by([("piece", "ascending"), ("blk", "ascending")] if "blk" in table.column_names else "piece")

    def to_matrix(table: pa.Table) -> pa.Table:
        table = in_order(table)
        flat = [x for row in matrix("".join(table.column("marks").to_pylist())) for x in row]
        return pa.table({"conv_id": table.column("conv_id").slice(0, 1), "piece": table.column("piece").slice(0, 1), "flat": pa.array([flat], pa.list_(pa.int64()))})

    def to_ends(table: pa.Table) -> pa.Table:
        table = in_order(table)
        v, ends = END, []
        for flat in reversed(table.column("flat").to_pylist()):
            ends.append(list(v))
            v = apply(tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4)), v)
        last = [False] * (table.num_rows - 1) + [True]
        return pa.table({"conv_id": table.column("conv_id"), "piece": table.column("piece"), "after": pa.array(ends[::-1], pa.list_(pa.int64())), "last": pa.array(last)})

    vector = T.ArrayType(LONG)
    pieces = symbols.groupBy("piece").applyInArrow(to_matrix, _schema(conv, [("piece", LONG), ("flat", vector)]))
    ends = write_through(pieces.groupBy("conv_id").applyInArrow(to_ends, _schema(conv, [("piece", LONG), ("after", vector), ("last", T.BooleanType())])), "ends")

    def to_exits(left: pa.Table, right: pa.Table) -> pa.Table:
        after, text = tuple(right.column("after")[0].as_py()), "".join(in_order(left).column("marks").to_pylist())
        exits = [walk(text, q, after)[1] for q in range(4)]
        return right.append_column("exits", pa.array([exits], pa.list_(pa.int64())))

    def to_entries(table: pa.Table) -> pa.Table:
        table = in_order(table)
        q, entries = 0, []
        for exits in table.column("exits").to_pylist():
            entries.append(q)
            q = exits[q]
        return pa.table({"piece": table.column("piece"), "after": table.column("after"), "last": table.column("last"), "entry": pa.array(entries, pa.int64())})

    met = symbols.groupBy("piece").cogroup(ends.groupBy("piece"))
    exits = met.applyInArrow(to_exits, _schema(conv, [("piece", LONG), ("after", vector), ("last", T.BooleanType()), ("exits", vector)]))
    entries = write_through(exits.groupBy("conv_id").applyInArrow(to_entries, "piece long, after array<long>, last boolean, entry long"), "entries")

    def to_letters(left: pa.Table, right: pa.Table) -> pa.Table:
        left = in_order(left)
        q, after, last = right.column("entry")[0].as_py(), tuple(right.column("after")[0].as_py()), right.column("last")[0].as_py()
        texts = left.column("marks").to_pylist()
        letters, end = walk("".join(texts), q, after)
        entry, out, costs, at = [], [], [], 0
        for text in texts:
            part = letters[at : at + len(text)]
            entry.append(q)
            for p, mark in zip(part, text):
                for c in p:
                    q = FITTING[q] if c in "IR" else KEEP[mark.lower()][q] if c == "K" else q
            out.append(part)
            costs.append(cost_of(part, text))
            at += len(text)
        tail = [""] * len(texts)
        if last:
            tail[-1] = closing(end)
            costs[-1] += COSTS["I"] * len(tail[-1])
        return pa.table({"p": left.column("piece"), "b": left.column("blk"), "entry": pa.array(entry, pa.int64()), "letters": pa.array(out, pa.list_(pa.string())), "tail": pa.array(tail), "cost": pa.array(costs, pa.int64())})

    return symbols.groupBy("piece").cogroup(entries.groupBy("piece")).applyInArrow(to_letters, "p long, b long, entry long, letters array<string>, tail string, cost long")


def _bodies(chunks: DataFrame) -> DataFrame:
    """Chunks with their repaired turns and counts."""
    joined = chunks.join(_solved(chunks), (F.col("piece") == F.col("p")) & (F.col("blk") == F.col("b")))
    schema = _schema(
        chunks.schema["conv_id"],
        [("piece", LONG), ("blk", LONG), ("low", LONG), ("high", LONG), ("distinct", LONG), ("kinds", TEXT), ("faults", TEXT), ("cost", LONG), ("audit", TEXT), ("messages", MESSAGES)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                letters = [*r["letters"], r["tail"]]
                made = [{"role": a, "text": b} for a, b in rewritten(letters, r["roles"], r["texts"], r["entry"])]
                stats = turn_stats(np.array([t for t in r["turns"] if t is not None], dtype=np.int64))
                out.append((r["conv_id"], r["piece"], r["blk"], *stats, initials(r["roles"]), r["faults"], r["cost"], "".join(letters), made))
            kinds = [batch.schema.field("conv_id").type, *[_arrow(f.dataType) for f in schema.fields[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=schema.names)

    return joined.drop("p", "b").mapInArrow(run, schema)


def _streamed(bodies: DataFrame) -> DataFrame:
    """Digests of open conversations: chunks pass in order, and one chunk is in memory at a time.

    SHA-256 runs over a conversation from its start to its end, so one conversation's repaired text passes one task, as a stream.
    """
    schema = _schema(bodies.schema["conv_id"], DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        state = None

        def result():
            s = state
            gaps = s["high"] - s["low"] + 1 - s["distinct"] if s["distinct"] else 0
            return s["name"], gaps, *s["faults"], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            kinds = kinds or [batch.schema.field("conv_id").type, *[_arrow(f.dataType) for f in schema.fields[1:]]]
            done = []
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if state is None or state["name"] != r["conv_id"]:
                    if state is not None:
                        done.append(result())
                    state = {"name": r["conv_id"], "low": None, "high": None, "distinct": 0, "faults": [0, 0, 0], "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "kind": ""}
                s = state
                if r["distinct"]:
                    s["distinct"] += r["distinct"] - (s["distinct"] > 0 and s["high"] == r["low"])
                    s["low"], s["high"] = (r["low"] if s["low"] is None else s["low"]), r["high"]
                s["faults"] = [n + r["faults"].count(c) for n, c in zip(s["faults"], "bdt")]
                if r["kinds"]:
                    s["illegal"] += illegal_pairs(s["kind"] + r["kinds"])
                    s["kind"] = r["kinds"][-1]
                s["cost"] += r["cost"]
                s["audit"].append(r["audit"])
                if r["messages"]:
                    body = "\n".join(f"{m['role']}:{m['text']}" for m in r["messages"])
                    s["sha"].update((("\n" if s["any"] else "") + body).encode())
                    s["any"] = True
            yield batch_of(done)
        if state is not None:
            yield batch_of([result()])

    return bodies.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "blk").mapInArrow(run, schema)


def _solve_all(turns: DataFrame, open_rows: int, open_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Finished conversations, and the chunks of the open ones with their repaired turns."""
    if "gone" not in turns.columns:
        turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("gone"))
    table = _split(turns.select("conv_id", "turn", "role", "text", "gone"), open_rows, open_bytes)
    chunks = write_through(_marked(table.where("open").select("conv_id", *[n for n, _ in CHUNK])), "chunks")
    return table.where("NOT open"), write_through(_bodies(chunks), "bodies")


def repair_digest(turns: DataFrame, open_rows: int = OPEN_ROWS, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text`` rows: faults, least cost, audit and hash of the repair.

    A row's first fault counts: blank, duplicate (role and text seen earlier), truncated. Rows are taken by turn,
    nulls first; rows of one turn by role and text (their first 32 and 64 code points, then a hash), so any input order gives the
    same result. Null role or text is one space; a null ``conv_id`` is a conversation of its own. A role counts by its first letter; an empty role and
    other letters fit nowhere. Rows marked ``gone`` (optional column) only name their conversation. An empty table
    gives an empty one; other columns are not read.
    """
    closed, bodies = _solve_all(turns, open_rows, open_bytes)
    names = ["conv_id", *[n for n, _ in DIGEST]]
    return closed.select(*names).unionByName(_streamed(bodies).select(*names))


def repaired_turns(turns: DataFrame, open_rows: int = OPEN_ROWS, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """``conv_id, piece, blk, place, role, text``: the turns after repair, in the order of the three numbers.

    Rules for faults, nulls, ties and empty tables are those of ``repair_digest``.
    """
    closed, bodies = _solve_all(turns, open_rows, open_bytes)
    zero = F.lit(0).cast("long")
    parts = closed.select("conv_id", zero.alias("piece"), zero.alias("blk"), "messages").unionByName(bodies.select("conv_id", "piece", "blk", "messages"))
    return parts.select("conv_id", "piece", "blk", F.posexplode("messages").alias("place", "turn")).select("conv_id", "piece", "blk", "place", "turn.role", "turn.text")
