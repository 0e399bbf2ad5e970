"""Record files in byte ranges, with good records and rejects.

A file is cut into ranges, and a range is a task that reads the records which begin in it. The scanner needs
nothing but a position: from there it reads one record, or finds the start of the next one behind text that is none. A
range begins at the first record start it sees. Where the range before it ends at another place, because
that start lay inside a record, the range is read again from the right place. So the rows are those of one scan from
start to end, whatever the ranges.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_through

#: Bytes of a range, and of the longest record; a longer one is a reject.
RANGE_BYTES = 64 << 20
RECORD_BYTES = 64 << 20
#: Ranges smaller than this share tasks.
TASK_BYTES = 16 << 20
WINDOW = 1 << 20
BATCH_BYTES = 4 << 20

SCANNED = "file string, start long, round int, kind string, offset long, length long, record binary, reason string"
_DECODER = json.JSONDecoder()
_BLANKS = re.compile(r"[ \t\r\n,\]]*")
_EDGE = 64


class _Bytes:
    """Part of a file in memory, one character a byte, which grows forwards and forgets what is behind."""

    def __init__(self, source, size: int):
        self.source, self.size, self.begin, self.text = source, size, 0, ""

    @property
    def end(self) -> int:
        return self.begin + len(self.text)

    def seek(self, at: int) -> None:
        """Forgets what lies before a place."""
        if self.begin <= at <= self.end:
            if at - self.begin >= WINDOW:
                self.text, self.begin = self.text[at - self.begin :], at
        else:
            self.text, self.begin = "", at

    def grow(self, upto: int) -> bool:
        """Reads on to a place at least; false at the end of the file."""
        if self.end >= self.size:
            return False
        length = min(max(upto - self.end, WINDOW), self.size - self.end)
        self.text += self.source.read_at(length, self.end).decode("latin-1")
        return True


def record_start(fields: list[str] | None) -> re.Pattern:
    """Where a record can begin: an object behind a bracket, comma, brace or line end whose first key is known.

    Inside a sound JSON string every quote is escaped, so text in strings does not look like this.
    """
    key = "|".join(re.escape(f.encode().decode("latin-1")) for f in fields) if fields else r'[^"\\]*'
    return re.compile(r"[\[,}\n][ \t\r\n]*(?=\{[ \t\r\n]*\"(?:" + key + r")\"[ \t\r\n]*:)")


class RecordScanner:
    """Records of one open file from any position on; ``lines`` says that every line is a record of its own."""

    def __init__(self, source, size: int, lines: bool, fields: list[str] | None = None, limit: int = RECORD_BYTES):
        self.bytes, self.lines, self.limit = _Bytes(source, size), lines, limit
        self.size, self.pattern = size, record_start(fields)

    def _find(self, pattern: re.Pattern, at: int, upto: int) -> int | None:
        """The end of the first match that ends behind ``at`` and not behind ``upto``."""
        held = self.bytes
        held.seek(max(at - _EDGE, 0))
        look = max(at - _EDGE, 0)
        while True:
            for match in pattern.finditer(held.text, max(look - held.begin, 0)):
                place = held.begin + match.end()
                if place > upto:
                    return None
                if place > at:
                    return place
            if held.end > upto + _EDGE or not held.grow(held.end + WINDOW):
                return None
            # a match may begin just before what is new; long stretches of blanks are looked at again once
            look = max(look, held.end - 2 * WINDOW)

    def first(self, start: int, end: int) -> int | None:
        """The first place in [start, end) where a record seems to begin; the start of a file is one."""
        if start == 0:
            return 0
        place = self._find(re.compile("\n") if self.lines else self.pattern, start - 1, end - 1)
        return place

    def scan(self, at: int, end: int) -> Iterator[tuple]:
        """(kind, offset, length, bytes, reason) of all that begins in [at, end), and last the place behind it."""
        step = self._line if self.lines else self._record
        while at < end:
            found, at = step(at)
            if found:
                yield found
        yield "exit", at, None, None, None

    def _cut(self, a: int, b: int) -> bytes:
        return self.bytes.text[a - self.bytes.begin : b - self.bytes.begin].encode("latin-1")

    def _line(self, at: int) -> tuple[tuple | None, int]:
        held = self.bytes
        held.seek(at)
        while (stop := held.text.find("\n", at - held.begin)) < 0 and held.end - at <= self.limit:
            if not held.grow(held.end + WINDOW):
                break
        if stop < 0 and held.end - at > self.limit:
            after = self._find(re.compile("\n"), at, self.size) or self.size
            return ("reject", at, after - at, None, f"longer than {self.limit} bytes"), after
        stop = held.end if stop < 0 else held.begin + stop
        body, behind = self._cut(at, stop), min(stop + 1, self.size)
        text = body.removeprefix(b"\xef\xbb\xbf") if at == 0 else body
        if not text.strip():
            return None, behind
        reason = self._fault(text)
        return (("reject", at, len(body), body, reason) if reason else ("good", at, len(body), text, None)), behind

    def _fault(self, body: bytes) -> str | None:
        try:
            value = json.loads(body.decode())
        except UnicodeDecodeError:
            return "not UTF-8"
        except json.JSONDecodeError as error:
            return error.msg
        except RecursionError:
            return "nested too deeply"
        return None if isinstance(value, dict) else "not an object"

    def _record(self, at: int) -> tuple[tuple | None, int]:
        held = self.bytes
        held.seek(at)
        skip = _BLANKS
        while True:
            if at == 0 and not held.text and not held.grow(WINDOW):
                return None, self.size
            if at == 0:
                opened = re.match("(?:\xef\xbb\xbf)?[ \t\r\n]*\\[?", held.text)
                begin = skip.match(held.text, opened.end()).end() + held.begin
            else:
                begin = skip.match(held.text, at - held.begin).end() + held.begin
            if begin < held.end or not held.grow(held.end + WINDOW):
                break
        if begin >= self.size:
            return None, self.size
        if begin != at and at:
            # the record's own place is where it begins: the next range may own it
            return None, begin
        while True:
            try:
                value, stop = _DECODER.raw_decode(held.text, begin - held.begin)
                stop += held.begin
                # a number at the edge of what is read could go on
                if stop < held.end or not held.grow(held.end + WINDOW):
                    break
                continue
            except json.JSONDecodeError as error:
                cut = error.msg.startswith("Unterminated") or held.begin + error.pos >= held.end - _EDGE
                if cut and held.end - begin <= self.limit and held.grow(held.end + max(WINDOW, held.end - begin)):
                    continue
                value, stop, reason = None, None, error.msg
                break
            except RecursionError:
                value, stop, reason = None, None, "nested too deeply"
                break
        if stop is not None:
            body = self._cut(begin, stop)
            if stop - begin > self.limit:
                return ("reject", begin, stop - begin, None, f"longer than {self.limit} bytes"), stop
            fault = "not an object" if not isinstance(value, dict) else None
            if not fault:
                try:
                    body.decode()
                except UnicodeDecodeError:
                    fault = "not UTF-8"
            return (("reject", begin, len(body), body, fault) if fault else ("good", begin, len(body), body, None)), stop
        after = self._find(self.pattern, begin, self.size) or self.size
        whole = self._cut(begin, after) if after - begin <= self.limit and begin >= held.begin else None
        body = whole.rstrip(b" \t\r\n,") if whole else whole
        return ("reject", begin, len(body) if body is not None else after - begin, body, reason), after


def _open(uri: str):
    from ..sinks.files import _open_file_system

    system, path = _open_file_system(uri)
    return system.open_input_file(path)


def is_lines(source, size: int) -> bool:
    """Whether a file holds a record a line: it does not begin with a bracket, and its first line is a value or no object goes on behind it."""
    head = source.read_at(min(size, WINDOW), 0).removeprefix(b"\xef\xbb\xbf").lstrip()
    if head.startswith(b"["):
        return False
    line, more, _ = head.partition(b"\n")
    return bool(line.strip(b" \t\r{")) or not more


def _scan_ranges(ranges: DataFrame, fields: list[str] | None, layout: str | None, limit: int) -> DataFrame:
    """All that each range finds; ``entry`` says where to begin, null lets the range look for itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                rows, weight = [], 0
                with _open(r.file) as source:
                    lines = is_lines(source, r.size) if layout is None else layout == "lines"
                    scanner = RecordScanner(source, r.size, lines, fields, limit)
                    entry = scanner.first(r.start, r.end) if pd.isna(r.entry) else int(r.entry)
                    rows.append(("first", -1 if entry is None else entry, None, None, None))
                    for found in scanner.scan(entry, r.end) if entry is not None else ():
                        rows.append(found)
                        weight += len(found[3] or b"")
                        if weight > BATCH_BYTES:
                            yield _frame(r, rows)
                            rows, weight = [], 0
                yield _frame(r, rows)

    return ranges.mapInPandas(run, SCANNED)


def _frame(r, rows: list) -> pd.DataFrame:
    kinds, offsets, lengths, records, reasons = zip(*rows) if rows else ((),) * 5
    number = lambda values: pd.array(values, dtype="Int64")
    return pd.DataFrame({
        "file": [r.file] * len(rows), "start": [r.start] * len(rows), "round": [r.round] * len(rows), "kind": kinds,
        "offset": number(offsets), "length": number(lengths), "record": records, "reason": reasons,
    })


def _stitch(table: pa.Table) -> pa.Table:
    """Where each range of one file has to begin; one row for each range, so as many rows as the file has ranges."""
    rows = sorted(table.to_pylist(), key=lambda r: r["start"])
    at, out = 0, []
    for r in rows:
        right = None if at >= r["end"] else at
        held = r["first"] if r["first"] >= 0 else None
        out.append({**{k: r[k] for k in ("file", "start", "end", "size")}, "entry": right, "same": held == right})
        # a range that starts elsewhere most often meets the right records before its end
        if right is not None:
            at = max(r["exit"], r["end"]) if r["exit"] is not None else r["end"]
    return pa.Table.from_pylist(out, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("size", pa.int64()), ("entry", pa.int64()), ("same", pa.bool_())]))


def scan_record_bytes(
    spark: SparkSession, path: str, fields: list[str] | None = None, layout: str | None = None, range_bytes: int = RANGE_BYTES, limit: int = RECORD_BYTES
) -> DataFrame:
    """``file, offset, length, record, reason`` of everything in JSON files; ``reason`` is null for good records.

    ``path`` is a file or folder of arrays, single objects or lines, not compressed. ``fields`` are keys that a record can begin with; they tell where the
    next record starts behind a broken one. A record longer than ``limit`` bytes is a reject without its bytes. Empty files give
    nothing. Files are read by ranges of ``range_bytes``; the result does not depend on them.
    """
    if layout not in (None, "document", "lines"):
        raise ValueError(f"layout must be document or lines, not {layout!r}")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0")
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = (
        listed.select(F.col("path").alias("file"), F.col("length").alias("size"), cuts.alias("start"))
        .withColumn("end", F.least("size", F.col("start") + range_bytes))
        .withColumn("entry", F.lit(None).cast("long"))
    )
    ranges = write_through(ranges.withColumn("round", F.lit(0)), "ranges")
    n, total = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    # a task for each range, but no swarm of tasks for tiny ones
    parts = max(1, min(n, max(spark.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))))
    found = write_through(_scan_ranges(ranges.repartition(parts, "file", "start"), fields, layout, limit), "scanned")
    bounds, number = ranges.select("file", "start", "end", "size"), 0
    while True:
        at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("offset")))
        ends = found.where("kind IN ('first', 'exit')").groupBy("file", "start").agg(at("first").alias("first"), at("exit").alias("exit"))
        joined = bounds.join(ends, ["file", "start"])
        placed = joined.groupBy("file").applyInArrow(_stitch, "file string, start long, end long, size long, entry long, same boolean")
        wrong = write_through(placed.where("NOT same"), "wrong")
        again = wrong.where("entry IS NOT NULL")
        if wrong.isEmpty():
            break
        number += 1
        kept = found.join(wrong.select("file", "start"), ["file", "start"], "left_anti").select(*found.columns)
        empty = wrong.where("entry IS NULL").select(
            "file", "start", F.lit(number).alias("round"), F.lit("first").alias("kind"), F.lit(-1).cast("long").alias("offset"),
            F.lit(None).cast("long").alias("length"), F.lit(None).cast("binary").alias("record"), F.lit(None).cast("string").alias("reason"),
        )
        read = _scan_ranges(again.select("file", "size", "start", "end", "entry", F.lit(number).alias("round")).repartition(parts, "file", "start"), fields, layout, limit)
        found = write_through(kept.unionByName(empty).unionByName(read), "scanned")
    return found.where("kind IN ('good', 'reject')").select("file", "offset", "length", "record", "reason")


def scan_records(
    spark: SparkSession, path: str, schema: T.StructType, layout: str | None = None, range_bytes: int = RANGE_BYTES, limit: int = RECORD_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Good rows with their ``schema``, and rejects as ``file, offset, length, reason, record``.

    A record that is sound JSON but does not fit the schema is a reject as well. Every byte that is not white space, a comma or a
    bracket between records belongs to a row of one of the two. Both come from one scan, which is written.
    """
    found = scan_record_bytes(spark, path, schema.names, layout, range_bytes, limit)
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(F.decode("record", "UTF-8"), marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    read = found.where("reason IS NULL").withColumn("row", parsed)
    misfit = F.col("row").isNull() | F.col("row._corrupt_record").isNotNull()
    good = read.where(~misfit).select(*[F.col(f"row.{n}").alias(n) for n in schema.names])
    columns = ["file", "offset", "length", "reason", "record"]
    rejects = found.where("reason IS NOT NULL").select(*columns)
    return good, rejects.unionByName(read.where(misfit).withColumn("reason", F.lit("does not fit the schema")).select(*columns))


def scan_array_ranges(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of files that each hold one JSON array; a file of any size is read by many tasks. A reject is an error that names it."""
    good, rejects = scan_records(spark, path, schema, "document", range_bytes)
    first = rejects.agg(F.min(F.struct("file", "offset", "reason"))).first()[0]
    if first:
        raise ValueError(f"{first['file']} at byte {first['offset']}: {first['reason']}")
    return good
