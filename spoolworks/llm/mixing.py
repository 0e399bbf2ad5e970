"""Mixing of sources to target weights: Sainte-Laguë quotas of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .common import WORD, free, whole

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SHARDS = 16
#: The smallest target is cut into about so many blocks.
BLOCKS = 200
#: No source is cut into more blocks, so that products of two block numbers stay exact.
MAX_BLOCKS = 1 << 30
BUCKET_ROWS = 50_000
#: Up to so many sources their table is broadcast (about 10 MB); beyond, the join is dealt by source.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source: rank, weight, words and target, from rows of (source, size).

    Sources in code-point order, null last, take the weights in turn. Together they get ``share`` times
    all words. A target stops at ``epochs`` times its source's words and the excess goes to the others
    by weight. Sorted by words over weight, the stopped sources come first, so one pass finds the
    level: it is the largest that any number of stopped sources gives. One row per source
    meets in one task here, never rows of documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    full = Window.orderBy(F.col("words") / F.col("weight"), "rank")
    every = Window.partitionBy()
    level = (
        share * F.sum("words").over(every) - epochs * F.coalesce(F.sum("words").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ) / F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return ranked.withColumn("level", level).select(
        "source",
        "rank",
        "weight",
        "words",
        F.least((epochs * F.col("words")).cast("double"), F.col("weight") * F.max("level").over(every)).alias("target"),
    )


def block_quotas(targets: DataFrame, block: int, shards: int = SHARDS) -> DataFrame:
    """Blocks per source and shard: the seats of a Sainte-Laguë apportionment, dealt in order.

    The seat ``j`` of a source has quotient target / (2j - 1); the highest quotients get seats, ties
    go to the source of lower rank. All seats above a quotient that surely does not use up the house
    are given at once, and only the few next seats of each source are ranked, so the work is in
    proportion to the sources and not to the blocks. Seats come in one order whatever
    the house, so shard k gets the seats between the houses of k and k + 1 shards.
    """
    # one row for each source and shard
    total, n = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    seats = round(total / block)
    houses = targets.select("source", "rank", "target", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("upto")).withColumn(
        "house", F.expr(f"({seats}L * upto) div {shards}")
    )
    scale = max(total, 1.0)
    sure = F.greatest(F.lit(0.0), F.floor(F.col("target") * (F.col("house") - n / 2) / scale + 0.5)).cast("long")
    most = (F.floor(F.col("target") * (F.col("house") + n / 2) / scale + 0.5) + 1).cast("long")
    based = houses.withColumns({"sure": sure, "most": most})
    left = based.groupBy("upto").agg((F.first("house") - F.sum("sure")).alias("open"))
    next_up = Window.partitionBy("upto").orderBy(F.desc("quotient"), "rank")
    won = (
        based.where("target > 0")
        .select("upto", "rank", "target", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("seat"))
        .withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1))
        .withColumn("turn", F.row_number().over(next_up))
        .join(left, "upto")
        .where("turn <= open")
        .groupBy("upto", "rank")
        .agg(F.count(F.lit(1)).alias("extra"))
    )
    held = based.join(won, ["upto", "rank"], "left").withColumn("held", F.col("sure") + F.coalesce("extra", F.lit(0)))
    before = F.lag("held", 1, 0).over(Window.partitionBy("rank").orderBy("upto"))
    return held.select("source", "rank", (F.col("upto") - 1).alias("shard"), (F.col("held") - before).alias("quota"))


def _mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 1,
    shards: int = SHARDS,
    size_col: str | None = None,
    order_col: str | None = None,
) -> tuple[DataFrame, str]:
    """The documents with a struct of what the mix says of each, and that column's name."""
    size, order, name, bucket = free(docs, "word_count", "seeded", "source_key", "bucket")
    count = F.col(size_col) if size_col else F.regexp_count(whole(text_col), F.lit(WORD)).cast("long")
    seeded = F.col(order_col) if order_col else seeded_order(seed, id_col, text_col)
    rows = docs.withColumns({size: count, order: seeded, name: F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), source_col))})

    sources = rows.groupBy(name).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("docs"), F.first(source_col).alias("source"))
    sources = write_through(sources, "sources")
    targets = write_through(source_targets(sources), "targets")
    n, least, most = targets.agg(F.count(F.lit(1)), F.min(F.when(F.col("target") > 0, F.col("target"))), F.max("words")).first()
    total_docs = sources.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    block = max(1, int((least or 1) // BLOCKS), -(-(most or 0) // MAX_BLOCKS))
    buckets = max(16, math.ceil(total_docs / BUCKET_ROWS))
    rows = rows.withColumn(bucket, F.pmod(F.col(order), F.lit(buckets)).cast("int"))

    quotas = (
        block_quotas(targets, block, shards)
        .withColumn("upto", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard")))
        .groupBy("rank")
        .agg(F.array_sort(F.collect_list("upto")).alias("upto"))  # one entry for each shard
    )
    blocks = F.expr(f"(words + {block} - 1) div {block}")
    plan = (
        targets.join(quotas, "rank")
        .withColumn("blocks", blocks)
        .withColumn("quota", F.least(F.element_at("upto", -1), EPOCHS * F.col("blocks")))
        .select(
            F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("plan_key"),
            F.col("words").alias("source_size"),
            "target",
            "blocks",
            "upto",
            F.expr("if(blocks = 0, 0, quota div greatest(blocks, 1))").alias("rounds"),
            F.expr("if(blocks = 0, 0, quota % greatest(blocks, 1))").alias("some"),
            F.expr(f"if(blocks = 0, 0, pmod(xxhash64({seed}, source), greatest(blocks, 1)))").alias("phase"),
        )
    )
    plan = F.broadcast(plan) if n <= BROADCAST_SOURCES else plan
    before = Window.partitionBy(name).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(name, bucket)
        .agg(F.sum(size).alias("bucket_words"))
        .withColumn("offset", F.coalesce(F.sum("bucket_words").over(before), F.lit(0)))
        .join(plan, F.col(name) == F.col("plan_key"))
        .select(F.struct("offset", "source_size", "target", "blocks", "upto", "rounds", "some", "phase").alias("plan_"), name, bucket)
    )
    (facts,) = free(rows, "mix_facts")
    offsets = offsets.withColumnRenamed("plan_", facts)
    inside = Window.partitionBy(name, bucket).orderBy(order, id_col, size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lo, hi = free(rows, "first_word", "last_word")
    placed = rows.join(offsets, [name, bucket]).withColumn(hi, F.col(f"{facts}.offset") + F.sum(size).over(inside)).withColumn(lo, F.col(hi) - F.col(size))

    f = f"`{facts}`"
    chosen = lambda i: f"((({i}) + {f}.phase) * {f}.some) div greatest({f}.blocks, 1)"  # noqa: E731  blocks chosen before block i, plus a constant

    def taken_before(x: str) -> str:
        i = f"(`{x}` div {block})"
        return f"({chosen(i)}) * {block} + (({chosen(f'{i} + 1')}) - ({chosen(i)})) * (`{x}` % {block})"

    taken = F.expr(f"{f}.rounds * `{size}` + ({taken_before(hi)}) - ({taken_before(lo)})").cast("long")
    at = f"(`{lo}` div {block})"
    turn = F.expr(f"if({f}.rounds > 0, {at}, ({chosen(at)}) - ({chosen('0')})) + 1")
    shard = F.least(F.lit(shards - 1), F.size(F.filter(F.col(f"{facts}.upto"), lambda c: c < turn)))
    # one seeded word of the document stands for it, so its chance of a further copy is its share of chosen words
    word = f"(`{lo}` + pmod(xxhash64({seed}, `{order}`, `{id_col}`), greatest(`{size}`, 1)))"
    at = f"({word} div {block})"
    copies = F.expr(f"if(`{size}` = 0, 0, {f}.rounds + ({chosen(f'{at} + 1')}) - ({chosen(at)}))")
    (answer,) = free(placed, "mix")
    made = F.struct(
        F.col(size).cast("long").alias("size"),
        F.col(f"{facts}.source_size").cast("long").alias("source_size"),
        F.col(f"{facts}.target").alias("target"),
        taken.alias("taken"),
        F.when(taken > 0, shard).cast("int").alias("mix_shard"),
        copies.cast("int").alias("copies"),
    )
    return placed.select(*docs.columns, made.alias(answer)), answer


def mix(docs: DataFrame, **options) -> DataFrame:
    """Adds size, source_size, target, taken and mix_shard to documents; every row stays, and every
    column but those of these names.

    A source's documents lie in a seeded order, and their words are cut into equal blocks. Its quota
    of blocks is taken as whole rounds over all blocks plus a seeded, evenly spaced choice of the
    rest; ``taken`` is the number of the document's words in chosen blocks, so it is at most twice the
    size, and a source's sum is within about a block of its quota. ``mix_shard`` is the shard of the
    first block taken from the document, null if none is. A null text has no words; a null source
    is a source; repeated rows are rows of their own. Places come from sums per hash bucket, so a hot source is many buckets.
    ``size_col`` and ``order_col`` name columns that hold words and seeded order already.
    """
    mixed, answer = _mixed(docs, **options)
    names = ["size", "source_size", "target", "taken", "mix_shard"]
    own = [c for c in docs.columns if c.lower() not in names]
    return mixed.select(*own, *[F.col(f"{answer}.{c}").alias(c) for c in names])


def seeded_order(seed: int, id_col: str, text_col: str):
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents (0 to 2 of each): one for each whole round of its source, and one more
    if a seeded word of the document lies in a chosen block.

    So a document's expected copies are its taken words over its size, whatever the length of blocks, and a source's words
    stray from its quota only as a draw of its documents does. Documents without words are not part of any mix. All columns stay.
    """
    mixed, answer = _mixed(docs, **options)
    (copies,) = free(mixed, "copies")
    kept = mixed.withColumn(copies, F.col(f"`{answer}`.copies")).where(F.col(copies) > 0)
    return kept.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
