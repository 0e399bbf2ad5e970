"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, whole

#: Kinds in the order in which spans of one start are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel")
BASE = KINDS[:4]

# Patterns are possessive and start only where a run starts (or where the last match ended), which
# changes no match but keeps the work in proportion to the text, whatever it holds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: What a text must hold for the pattern to be tried at all.
HINTS = {"email": "@", "phone": "+", "ssn": "-"}
#: Score of a confirmed proposal, and what a context word nearby adds.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "tel": 0.4}
CONTEXT_ADDS = 0.1
CONTEXT_LIFTS = 0.4
CONTEXT_CHARS = 40
#: Code points of the chunks in which context is looked up.
CHUNK = 256
#: Spans of the added kinds count from this score on; base spans always count.
MIN_SCORE = 0.7
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "tax id"),
    "tel": ("phone", "call", "tel", "mobile", "fax"),
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """The remainder of the rearranged account number by 97, letters counting from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    number = F.transform(F.split(moved, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(number, F.lit(0), lambda acc, d: F.pmod(acc * F.when(d > 9, 100).otherwise(10) + d, F.lit(97)))


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        n = F.length(_digits(value))
        return n.between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(value) == 1
    if kind == "ssn":
        return ~value.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _blocks(values: Column) -> Column:
    """The values in pieces of the square root of their number."""
    width = F.ceil(F.sqrt(F.greatest(F.size(values), F.lit(1)))).cast("int")
    last = F.greatest(F.ceil(F.size(values) / width).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * width + 1, width))


def _sums(steps: Column) -> Column:
    """The sum of all steps, and for each the sum of those before it."""
    zero = F.struct(F.lit(0).alias("total"), F.expr("CAST(array() AS array<int>)").alias("before"))
    return F.aggregate(
        steps, zero, lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before"))
    )


def sums_before(steps: Column) -> Column:
    """For each step the sum of those before it. An array grows by copies, so it grows piece by piece: n steps cost n times their root."""
    pieces = _with(steps, lambda s: F.transform(_blocks(s), _sums))
    return _with(
        pieces,
        lambda p: F.flatten(F.zip_with(p, _sums(F.transform(p, lambda x: x["total"]))["before"], lambda x, at: F.transform(x["before"], lambda y: y + at))),
    )


def _located(kind: str, text: Column, found: Column) -> Column:
    """Confirmed matches with their code-point places: the texts between matches come from splitting at them."""
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda g: F.length(g))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))

    def places(all_pairs: Column) -> Column:
        before = sums_before(F.transform(all_pairs, lambda x: x["gap"] + F.length(x["value"])))
        starts = F.zip_with(all_pairs, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), x["value"].alias("value")))
        good = F.filter(starts, lambda x: _confirmed(kind, x["value"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end")))

    return _with(pairs, places)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _piece(chunks: Column, start: Column, length: Column) -> Column:
    """Up to ``CHUNK`` code points of the text from its chunks, without a walk from the text's start."""
    at = F.floor(start / CHUNK).cast("int")
    near = F.concat(F.coalesce(F.get(chunks, at), F.lit("")), F.coalesce(F.get(chunks, at + 1), F.lit("")))
    return near.substr(F.pmod(start, F.lit(CHUNK)) + 1, length)


def _scored(kind: str, chunks: Column, span: Column) -> Column:
    """The proposal as a finding with a score."""
    left = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    near = F.lower(F.concat(_piece(chunks, left, span["start"] - left), F.lit(" "), _piece(chunks, span["end"], F.lit(CONTEXT_CHARS))))
    has = near.rlike(r"\b(" + "|".join(CONTEXT[kind]) + ")")
    lift = CONTEXT_ADDS if SCORES[kind] >= MIN_SCORE else CONTEXT_LIFTS
    return F.struct(
        span["start"].alias("start"),
        F.lit(KINDS.index(kind)).alias("order"),
        span["end"].alias("end"),
        F.lit(kind).alias("kind"),
        (F.lit(SCORES[kind]) + F.when(has, lift).otherwise(0.0)).alias("score"),
    )


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _blocks_of_spans(spans: Column) -> Column:
    """Sorted spans in pieces, each with the range it lies in."""
    return F.transform(
        _with(spans, _blocks),
        lambda p: F.struct(
            F.array_min(F.transform(p, lambda x: x["start"])).alias("start"), F.array_max(F.transform(p, lambda x: x["end"])).alias("end"), p.alias("spans")
        ),
    )


FINDING = "array<struct<start:int,`order`:int,end:int,kind:string,score:double>>"


def find_personal_data(docs: DataFrame, text_col: str = "text", spans_col: str = "findings") -> DataFrame:
    """Adds an array of findings (start, order, end, kind, score), sorted by start and kind.

    Places count code points, the end is exclusive. Base kinds are the leftmost matches that do not
    overlap, less those that fail their test: parts of addresses up to 255, 14 to 19 digits with a
    Luhn sum, 10 to 15 digits. Added kinds are bank accounts with remainder 1 by 97, and social
    security and unprefixed telephone numbers beside a word that names them; they never overlap a
    base span. A null text counts as empty; every row and column stays (a column of the result's name is
    replaced). The patterns run within the JVM on whole texts and no row moves; n matches in a text cost n times
    the root of n at most.
    """
    steps = docs
    names = free(docs, "whole_text", *[f"found_{k}" for k in KINDS], *[f"spans_{k}" for k in KINDS])
    text, found, spans = names[0], dict(zip(KINDS, names[1:])), dict(zip(KINDS, names[1 + len(KINDS) :]))
    empty = F.expr("CAST(array() AS array<string>)")
    steps = steps.withColumn(text, whole(text_col))
    body = F.col(text)

    def proposals(kind: str) -> Column:
        every = F.regexp_extract_all(body, F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(F.contains(body, F.lit(HINTS[kind])), every).otherwise(empty) if kind in HINTS else every

    steps = steps.withColumns({found[k]: proposals(k) for k in KINDS})

    def findings(kind: str) -> Column:
        some = F.exists(F.col(found[kind]), lambda v: _confirmed(kind, v))
        good = _located(kind, body, F.col(found[kind]))
        scored = _with(_chunks(body), lambda chunks: F.transform(good, lambda s: _scored(kind, chunks, s)))
        return F.when(some, scored).otherwise(F.expr(f"CAST(array() AS {FINDING})"))

    steps = steps.withColumns({spans[k]: findings(k) for k in KINDS})
    base, extra = free(steps, "base_spans", "extra_spans")
    added = F.concat(*[F.filter(spans[k], lambda s: s["score"] >= MIN_SCORE) for k in KINDS[4:]])
    steps = steps.withColumns({base: F.concat(*[F.col(spans[k]) for k in BASE]), extra: added})
    apart = _with(_blocks_of_spans(F.array_sort(F.col(base))), lambda blocks: F.filter(extra, lambda a: ~F.exists(blocks, lambda b: _meets(a, b) & F.exists(b["spans"], lambda x: _meets(a, x)))))
    own = [F.col(c) for c in docs.columns if c.lower() != spans_col.lower()]
    return steps.select(*own, F.array_sort(F.concat(F.col(base), F.when(F.size(extra) > 0, apart).otherwise(F.expr(f"CAST(array() AS {FINDING})")))).alias(spans_col))


def joined(spans: Column) -> Column:
    """kind:start:end of each finding, with commas between."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def personal_data_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, the digest of base spans, and all spans.

    A null or empty text has counts of zero, no spans and the digest of the empty string; repeated rows get a row each, and an
    empty table gives an empty table.
    """
    found = find_personal_data(docs.select(F.col(id_col), F.col(text_col).alias("text")))
    base = F.filter("findings", lambda s: s["order"] < len(BASE))
    counts = [F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts[:4], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), *counts[4:])
