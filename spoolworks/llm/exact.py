"""Exact duplicates: two passes over a Bloom filter, and only possibly repeated rows shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .common import free, whole

PROBES = 2
#: Most cells of one filter, as a power of two. The broadcast has at most
#: ``PROBES * 2**MAX_BITS / 64`` rows of 16 bytes (half a million), whatever the corpus.
MAX_BITS = 24
CELLS_PER_ROW = 16


def fingerprint(text: str | Column) -> Column:
    """SHA-256 of the text in UTF-8, null as empty."""
    return F.sha2(whole(text), 256)


def _cells(key: str, bits: int) -> list[Column]:
    """One cell for each probe; every probe has cells of its own."""
    return [F.lit(i << bits) + F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(1 << bits)) for i in range(PROBES)]


def flag_repeats(keys: DataFrame, key: str):
    """A function that adds to any frame with column ``key`` whether the key may repeat in ``keys``.

    Pass one counts rows by cell, combined before the shuffle of bare cell numbers, and packs the
    cells hit twice into 64-bit words. Pass two looks the words up by broadcast. A key that repeats
    is always flagged; a lone key seldom is. Past ``2**MAX_BITS / CELLS_PER_ROW`` rows more lone keys
    are flagged and travel as well; results stay exact.
    """
    rows = keys.count()
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(CELLS_PER_ROW * max(rows, 1)))))
    words = (
        keys.select(F.explode(F.array(*_cells(key, bits))).alias("cell"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("hits"))
        .where("hits > 1")
        .groupBy(F.shiftright("cell", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 AS int))")).alias("marks"))
    )

    def flagged(df: DataFrame, name: str) -> DataFrame:
        out, tests = df, []
        for i, cell in enumerate(_cells(key, bits)):
            at, word, marks = free(out, f"cell{i}", f"word{i}", f"marks{i}")
            # the same words for every probe, so they are counted and sent once
            out = out.withColumn(at, cell).join(F.broadcast(words.toDF(word, marks)), F.shiftright(at, 6) == F.col(word), "left")
            bit = F.expr(f"shiftright(`{marks}`, cast(`{at}` & 63 AS int))").bitwiseAND(1)
            tests.append(F.coalesce(bit == 1, F.lit(False)))
        hit = tests[0]
        for test in tests[1:]:
            hit = hit & test
        return out.select(*df.columns, hit.alias(name))

    return flagged


def mark_duplicates(rows: DataFrame, key: str, id_col: str = "doc_id", largest: bool = True) -> DataFrame:
    """Adds ``keep_id``, ``group_size`` and ``kept`` to rows; rows of one ``key`` are one group.

    The row with the largest id stays (``largest=False``: the smallest); null ids come below all
    others and win only if no id is known. Rows that repeat both id and key are one document and
    get the same answer. An empty table gives an empty table. ``rows`` is read three times: pass a
    written table. A group of any size is summed before the shuffle, and the join back has both
    sides dealt by Spark alone, so that a hot group is split at run time.
    """
    flagged = flag_repeats(rows.select(key), key)
    maybe, other, keep, size = free(rows, "maybe", "group_key", "group_keep", "group_rows")
    marked = flagged(rows, maybe)
    best = F.max(id_col) if largest else F.min(id_col)
    groups = (
        flagged(rows.select(id_col, key), maybe)
        .where(maybe)
        .groupBy(key)
        # the join is on a copy of the key: the groups are dealt anew, and a hot key can be split
        .agg(best.alias(keep), F.count(F.lit(1)).alias(size), F.first(key).alias(other))
        .drop(key)
    )
    own = [F.col(c) for c in rows.columns]
    alone = marked.where(~F.col(maybe)).select(*own, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    shared = (
        marked.where(maybe)
        .join(groups, F.col(key) == F.col(other))
        .select(*own, F.col(keep).alias("keep_id"), F.col(size).alias("group_size"), F.col(id_col).eqNullSafe(F.col(keep)).alias("kept"))
    )
    return alone.unionByName(shared)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Null text counts as empty."""
    keys = write_through(docs.select(F.col(id_col), fingerprint(text_col).alias("text_sha256")), "fingerprints")
    return mark_duplicates(keys, "text_sha256", id_col)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The documents with one row of each text, that of the largest (or smallest) id; all columns stay.

    Rows that cannot be repeats pass straight through. Possible repeats meet the winners of their
    groups on text and id together, so a large group is spread over its ids. Of rows that repeat id
    and text, one stays.
    """
    (sha,) = free(docs, "sha")
    keyed = docs.withColumn(sha, fingerprint(text_col))
    keys = write_through(keyed.select(id_col, sha), "fingerprints")
    flagged = flag_repeats(keys.select(sha), sha)
    maybe, other, keep = free(keyed, "maybe", "group_key", "group_keep")
    marked = flagged(keyed, maybe)
    best = F.max(id_col) if largest else F.min(id_col)
    winners = (
        flagged(keys, maybe).where(maybe).groupBy(sha).agg(best.alias(keep)).select(F.col(sha).alias(other), keep)
    )
    alone = marked.where(~F.col(maybe)).select(*docs.columns)
    shared = (
        marked.where(maybe)
        .join(winners, (F.col(sha) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(keep)), "left_semi")
        .dropDuplicates([sha])
        .select(*docs.columns)
    )
    return alone.unionByName(shared)
