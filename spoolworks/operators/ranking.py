"""Exact positions, samples and splits without a one-task sort.

A plain ``row_number() over (order by ...)`` moves every row to one task. Two exact ways
around it are used here:

* ``exact_rank`` cuts the order into segments that are a function of the row alone, counts
  per segment, and adds the running count of earlier segments to the position inside the
  segment. The rows shuffle once, on the segment, and no group is larger than a segment.
* ``order_thresholds`` finds the keys that sit at given ranks. A split or sample is then a
  comparison with those keys, so the rows do not shuffle at all.

Both need the order key to be unique, as a list position is.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPK_LIMIT = 100_000  # largest n that is left to a top-k sort unless the method is named
HOT_ROWS = 1_000_000  # groups up to this size are ranked in one piece
PIECE_ROWS = 250_000  # rows of one piece of an order, whatever the number of rows
MAX_CUTS = 4096  # quantiles that come to the driver; more pieces come from dividing their ranges
IMAGE_BYTES = 6  # bytes of a key, after what a quantile's range shares, that place it within
CUT_SAMPLE = 64  # sampled keys for each cut
CUT_BYTES = 4096  # leading bytes of a sampled key that come to the driver


def seeded_hash(key: Column, seed: int = 42) -> Column:
    """Reproducible shuffle order: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_head(hashed: Column) -> Column:
    """First 15 hex digits of an md5 as a number: the same order, and far cheaper to sort."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def hash_segment(hashed: Column, digits: int | Column = 4) -> Column:
    """Leading hex digits: equal-sized, order-preserving pieces of an md5 order, 65,536 of them at four."""
    return F.substr(hashed, F.lit(1), digits if isinstance(digits, Column) else F.lit(digits))


def sized_digits(df: DataFrame) -> Column:
    """Hex digits that make pieces of about ``PIECE_ROWS`` rows, four at least; a scalar of the plan."""
    pieces = F.count(F.lit(1)) / PIECE_ROWS
    return df.agg(F.greatest(F.lit(4), F.ceil(F.log(F.greatest(pieces, F.lit(1.0))) / F.log(F.lit(16.0)))).cast("int")).scalar()


def order_image(df: DataFrame, column: str) -> Column:
    """A double that never decreases along the order of a number, time or boolean column."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.datediff(value, F.lit("1970-01-01").cast("date")) * 86400.0 + F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
    raise ValueError(f"no order is kept for keys of type {kind.simpleString()}")


def order_bytes(df: DataFrame, column: str) -> Column | None:
    """Bytes in the order of a text, binary, long or decimal column, exactly; null for types that a double places exactly.

    Decimals of more than 18 digits are placed by doubles.
    """
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return value.cast("binary")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        value = (value * F.lit(10**kind.scale).cast(f"decimal({kind.scale + 1},0)")).cast("long")
    elif not isinstance(kind, T.LongType):
        return None
    return F.unhex(F.lpad(F.hex(value.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def _shared(x: bytes, y: bytes) -> int:
    return next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def _range_of_bytes(df: DataFrame, raw: Column, cuts: int, each: int) -> Column:
    """The piece of each key: keys of a sample are the cuts, found by binary search; ranges between them are divided evenly.

    Cuts are as short as tells neighbours of the sample apart, so long common beginnings do no harm. Beyond ``MAX_CUTS`` pieces a range
    that holds an outlier may stay undivided: one in ``MAX_CUTS`` of the rows.
    """
    keys = df.select(raw.alias("raw")).where("raw IS NOT NULL")
    n, low, high = keys.agg(F.count(F.lit(1)), F.substring(F.min("raw"), 1, CUT_BYTES), F.substring(F.max("raw"), 1, CUT_BYTES)).first()
    if not n:
        return F.lit(0).cast("long")
    sampled = keys.sample(min(1.0, 1.2 * cuts * CUT_SAMPLE / n), seed=42)
    in_order = Window.orderBy("raw")  # a bounded sample
    tiles = sampled.select("raw", F.ntile(cuts).over(in_order).alias("tile"), F.lag("raw").over(in_order).alias("before"))
    first = [F.substring(x, 1, CUT_BYTES) for x in (F.min("raw"), F.min_by("before", "raw"))]
    starts = tiles.groupBy("tile").agg(first[0].alias("start"), first[1].alias("before")).collect()
    inner = {bytes(r.start[: _shared(r.before, r.start) + 1]) for r in starts if r.before is not None}
    inner = sorted(inner - {bytes(low)})
    if not inner:
        return F.lit(0).cast("long")
    table = F.array(*[F.lit(x) for x in inner])
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(len(inner).bit_length()))])

    def search(key: Column) -> Column:
        return F.aggregate(strides, F.lit(0), lambda at, by: F.when(F.get(table, at + by - 1) <= key, at + by).otherwise(at))

    def within(key: Column, piece: Column) -> Column:
        ends = list(zip([bytes(low), *inner], [*inner, bytes(high)]))
        shared = [_shared(x, y) for x, y in ends]
        place = [[int.from_bytes(e[i][k : k + IMAGE_BYTES].ljust(IMAGE_BYTES, b"\0")) for e, k in zip(ends, shared)] for i in (0, 1)]
        skip, first, last = (F.get(F.array(*map(F.lit, x)), piece) for x in (shared, *place))
        head = F.rpad(F.hex(F.substr(key, skip + 1, F.lit(IMAGE_BYTES))), 2 * IMAGE_BYTES, "0")
        part = (F.conv(head, 16, 10).cast("double") - first) / (last - first) * each
        return F.when(last > first, F.least(F.greatest(F.floor(part), F.lit(0)), F.lit(each - 1))).otherwise(F.lit(0)).cast("long")

    def place_of(key: Column) -> Column:
        if each == 1:
            return search(key).cast("long")
        return F.transform(F.array(search(key)), lambda piece: piece.cast("long") * each + within(key, piece))[0]

    return F.transform(F.array(raw), place_of)[0]


def with_range_segment(df: DataFrame, column: str, pieces: int | None = None, name: str = "__seg") -> DataFrame:
    """Order-preserving pieces of a plain column, by quantiles of its ``order_image``, or by sampled keys where it has ``order_bytes``.

    Pieces are sized by a count unless their number is given. At most ``MAX_CUTS`` quantiles come
    to the driver; if more pieces are needed, each quantile's range is divided evenly. The cuts
    only balance the pieces, so their error never reaches a result.
    """
    if pieces is None:
        pieces = df.count() // PIECE_ROWS + 1
    if pieces == 1:
        return df.withColumn(name, F.lit(0).cast("long"))
    image, each = f"{name}_image", -(-pieces // MAX_CUTS)
    cuts = min(pieces, MAX_CUTS)
    raw = order_bytes(df, column)
    if raw is not None:
        return df.withColumn(name, F.when(F.col(column).isNull(), F.lit(-1)).otherwise(_range_of_bytes(df, raw, cuts, each)).cast("long"))
    tagged = df.withColumn(image, order_image(df, column))
    found = tagged.select(F.percentile_approx(image, [i / cuts for i in range(cuts + 1)], 4 * cuts)).first()[0]
    inner = sorted({x for x in found or [] if math.isfinite(x)}) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    tagged = Bucketizer(splits=splits, inputCol=image, outputCol=name, handleInvalid="keep").transform(tagged)
    piece = F.col(name).cast("long")
    if each > 1:
        starts = F.array(*[F.lit(x) for x in [inner[0], *inner]])
        ends = F.array(*[F.lit(x) for x in [*inner, inner[-1]]])
        low, high = F.get(starts, piece.cast("int")), F.get(ends, piece.cast("int"))
        part = F.when(high > low, F.floor((F.col(image) - low) / (high - low) * each)).otherwise(F.lit(0))
        piece = piece * each + F.greatest(F.lit(0), F.least(part, F.lit(each - 1)))
    return tagged.withColumn(name, F.when(F.col(column).isNull(), F.lit(-1)).otherwise(piece).cast("long")).drop(image)


def exact_rank(
    df: DataFrame,
    order_by: list[Column],
    segment: Column,
    partition_by: tuple[str, ...] = (),
    name: str = "rank",
) -> DataFrame:
    """0-based position of each row in the order, over all rows or inside ``partition_by``.

    ``segment`` must not decrease along the order, nulls first. All rows, or a group that
    holds much of them, are spread over the segments; ordinary groups are one piece each.
    """
    tagged, groups = _plain_keys(df, {f"__g{i}": F.col(c) for i, c in enumerate(partition_by)})
    if partition_by:
        # no more than one group for every HOT_ROWS rows
        tagged = tagged.join(F.broadcast(_hot_groups(tagged, groups)), groups, "left")
        segment = F.when(F.col("__hot"), segment)
    tagged, cut = _plain_keys(tagged, {"__seg": segment})
    keys = [*groups, *cut]

    in_order = [F.col("__seg_null").desc(), F.col("__seg")]
    earlier = Window.partitionBy(*groups).orderBy(*in_order).rowsBetween(Window.unboundedPreceding, -1)
    counted = tagged.where("__hot") if partition_by else tagged
    offsets = (
        counted.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, F.sum("__n").over(earlier).alias("__before"))
    )
    # the window and the join have the same keys, so the rows shuffle and sort once
    inside = Window.partitionBy(*keys).orderBy(*order_by)
    return (
        tagged.withColumn("__pos", F.row_number().over(inside))
        .join(offsets, keys, "left")
        .withColumn(name, F.coalesce("__before", F.lit(0)) + F.col("__pos") - 1)
        .drop(*keys, "__hot", "__pos", "__before")
    )


def _hot_groups(df: DataFrame, groups: list[str]) -> DataFrame:
    """Groups of more than ``HOT_ROWS`` rows: they are split into segments."""
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > HOT_ROWS).select(*groups, F.lit(True).alias("__hot"))


def _plain_keys(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """Adds columns as key pairs, a value and a null mark, that join even when null."""
    raw = df.withColumns(columns) if columns else df
    made = {}
    for name in columns:
        kind = raw.schema[name].dataType
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError("ranks are kept per plain columns only")
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            stand_in = F.lit("1970-01-01").cast(kind)
        elif isinstance(kind, T.BooleanType):
            stand_in = F.lit(False)
        else:
            stand_in = F.lit("0").cast(kind)
        made |= {f"{name}_null": F.col(name).isNull(), name: F.coalesce(F.col(name), stand_in)}
    return (raw.withColumns(made) if made else raw), list(made)


def _rank_by_hash(df: DataFrame, key: str, seed: int, partition_by: tuple[str, ...], name: str) -> DataFrame:
    hashed = df.withColumn("__h", seeded_hash(F.col(key), seed)).withColumn("__head", hash_head(F.col("__h")))
    # the head decides all but a few ties, the whole hash and the key decide those
    order = [F.col("__head"), F.col("__h"), F.col(key)]
    return exact_rank(hashed, order, hash_segment(F.col("__h"), sized_digits(df)), partition_by, name).drop("__h", "__head")


def shuffle_rank(df: DataFrame, key: str, seed: int = 42, name: str = "rank") -> DataFrame:
    """Position of each row in the seeded shuffle."""
    return _rank_by_hash(df, key, seed, (), name)


def input_rank(df: DataFrame, key: str, pieces: int | None = None, name: str = "rank", then: tuple[str, ...] = ()) -> DataFrame:
    """Position of each row by a number, time or text column, nulls first; key and ``then`` together are unique."""
    tagged = with_range_segment(df, key, pieces, "__piece")
    return exact_rank(tagged, [F.col(key), *map(F.col, then)], F.col("__piece"), name=name).drop("__piece")


def order_thresholds(df: DataFrame, key: str, seed: int, ranks) -> DataFrame:
    """Order keys found at the given ranks of the seeded shuffle, as one row.

    ``ranks`` maps the total count column to ``{name: rank column}``. Each name becomes a
    struct column ``(hash, key)``, null when the rank is past the end. Narrow passes over the key:
    counts by three hash digits, counts by four more inside the segments that hold a wanted rank, and
    then the rows of one piece in 268 million for each rank, few enough to sort in one task at any size.
    """
    keyed = df.select(seeded_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    wanted: list[str] = []

    def targets_of(total: Column) -> Column:
        named = ranks(total)
        wanted[:] = list(named)
        return F.array(*[F.struct(F.lit(n).alias("name"), r.cast("long").alias("at")) for n, r in named.items()])

    def hit(counts: DataFrame, within: list[str]) -> DataFrame:
        """The segment of each wanted rank, and the rank inside it; one row for each name."""
        upto = Window.partitionBy(*within).orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        return placed.where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n"))).select(
            "name", "seg", (F.col("at") - F.col("before")).alias("at")
        )

    tagged = keyed.withColumn("seg", hash_segment(F.col("h"), 3))
    counts = tagged.groupBy("seg").agg(F.count(F.lit(1)).alias("n"))  # 4,096 rows at most
    total = F.sum("n").over(Window.partitionBy())
    rated = counts.withColumn("total", total).select("seg", "n", F.explode(targets_of(F.col("total"))).alias("w"))
    coarse = hit(rated.select("seg", "n", "w.name", "w.at"), ["name"])

    finer = keyed.withColumn("seg", hash_segment(F.col("h"), 7)).withColumn("lead", hash_segment(F.col("h"), 3))
    inside = finer.join(F.broadcast(coarse.select("name", "at", F.col("seg").alias("lead"))), "lead")
    fine = hit(inside.groupBy("name", "at", "seg").agg(F.count(F.lit(1)).alias("n")), ["name"])

    order = Window.partitionBy("name").orderBy("h", "k")
    hits = (
        finer.join(F.broadcast(fine), "seg").withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") == F.col("at"))
    )
    return hits.agg(*[F.max(F.when(F.col("name") == n, F.struct("h", "k"))).alias(n) for n in wanted])


def split_sizes(total: Column, val: float, test: float) -> tuple[Column, Column, Column]:
    """Train, validation and test counts; fractions truncate and train takes the rest."""
    n_val = F.floor(total * F.lit(float(val)))
    n_test = F.floor(total * F.lit(float(test)))
    return total - n_val - n_test, n_val, n_test


def split_exact(
    df: DataFrame, key: str, val: float = 0.1, test: float = 0.1, seed: int = 42,
    names: tuple[str, str, str] = ("train", "val", "test"),
) -> DataFrame:
    """Adds ``split``: exact counts, first to last in the seeded shuffle, without moving a row."""

    def starts(total: Column) -> dict[str, Column]:
        n_train, n_val, _ = split_sizes(total, val, test)
        return {"val": n_train, "test": n_train + n_val}

    # one scalar subquery with two keys
    at = order_thresholds(df, key, seed, starts).select(F.struct("val", "test")).scalar()
    own = F.struct(seeded_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    in_train = F.col("__at.val").isNull() | (F.col("__own") < F.col("__at.val"))
    in_val = F.col("__at.test").isNull() | (F.col("__own") < F.col("__at.test"))
    return (
        df.withColumns({"__at": at, "__own": own})
        .withColumn("split", F.when(in_train, names[0]).when(in_val, names[1]).otherwise(names[2]))
        .drop("__at", "__own")
    )


def split_exact_ranked(
    df: DataFrame, key: str, val: float = 0.1, test: float = 0.1, seed: int = 42,
    names: tuple[str, str, str] = ("train", "val", "test"),
) -> DataFrame:
    """The same split with ``rank`` (in the shuffle) and ``index`` (inside the split), for one shuffle."""
    n_train, n_val, _ = split_sizes(F.count(F.lit(1)), val, test)
    sizes = df.select(F.struct(n_train.alias("train"), n_val.alias("val"))).scalar()
    rank, train, upto_val = F.col("rank"), F.col("__n.train"), F.col("__n.train") + F.col("__n.val")
    return (
        shuffle_rank(df, key, seed)
        .withColumn("__n", sizes)
        .withColumn("split", F.when(rank < train, names[0]).when(rank < upto_val, names[1]).otherwise(names[2]))
        .withColumn(
            "index", F.when(rank < train, rank).when(rank < upto_val, rank - train).otherwise(rank - upto_val)
        )
        .drop("__n")
    )


def split_percent(df: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """Exactly ``percent`` in a hundred as validation, the fraction cut off; the first in the seeded shuffle train."""

    def start(total: Column) -> dict[str, Column]:
        return {"validation": total - F.floor(total * F.lit(percent) / 100)}

    at = order_thresholds(df, key, seed, start).select("validation").scalar()
    own = F.struct(seeded_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    return (
        df.withColumns({"__at": at, "__own": own})
        .withColumn("split", F.when(F.col("__at").isNull() | (F.col("__own") < F.col("__at")), "train").otherwise("validation"))
        .drop("__at", "__own")
    )


def split_percent_by_hash(df: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """Validation rows by hash bucket: about ``percent`` in a hundred, row by row, no count needed."""
    bucket = F.conv(F.substring(seeded_hash(F.col(key), seed), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(bucket < percent, "validation").otherwise("train"))


def _by_top_k(n: int, method: str | None) -> bool:
    if method not in (None, "sort", "rank"):
        raise ValueError(f"method must be sort or rank, not {method!r}")
    return n <= TOPK_LIMIT if method is None else method == "sort"


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42, method: str | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows of the seeded shuffle, in no order.

    ``method="sort"`` is a top-k, ``"rank"`` a comparison with the key at rank ``n``, for samples too
    large for one task. They give the same rows; unless one is named, ``n`` decides.
    """
    if _by_top_k(n, method):
        return df.orderBy(seeded_hash(F.col(key), seed), F.col(key)).limit(n)
    at = order_thresholds(df, key, seed, lambda total: {"end": F.lit(n)}).select("end").scalar()
    own = F.struct(seeded_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    # hex digits sort below "g": past the end every row is inside
    end = F.struct(F.lit("g").alias("h"), F.lit(None).cast(df.schema[key].dataType).alias("k"))
    return df.where(own < F.coalesce(at, end))


def shuffle_seeded(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in seeded order: a range-partitioned sort."""
    return df.orderBy(seeded_hash(F.col(key), seed), F.col(key))


def limit_first(df: DataFrame, n: int, order_key: str, method: str | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """First ``n`` rows in input order, in no order; ``then`` settles rows of one key, ``method`` is as for ``sample_exact``."""
    if _by_top_k(n, method):
        return df.orderBy(order_key, *then).limit(n)
    return input_rank(df, order_key, name="__rank", then=then).where(F.col("__rank") < n).drop("__rank")


def peek(df: DataFrame, order_key: str, n: int = 3) -> DataFrame:
    return df.orderBy(order_key).limit(n)


def running_index(df: DataFrame, key: str, partition_by: tuple[str, ...] = (), seed: int = 42, name: str = "index") -> DataFrame:
    """0-based position in the seeded order inside each group, a hot group included.

    Called before a filter it leaves gaps in the names; called after, it does not.
    """
    return _rank_by_hash(df, key, seed, partition_by, name)


def first_writer_wins(df: DataFrame, name: str, order_key: str) -> DataFrame:
    """One row per ``name``, the first by ``order_key``; combines before it shuffles."""
    rest = [c for c in df.columns if c != name]
    best = df.groupBy(name).agg(F.min_by(F.struct(*rest), F.col(order_key)).alias("__r"))
    return best.select(*[F.col(name) if c == name else F.col(f"__r.{c}").alias(c) for c in df.columns])


def latest_artifact(df: DataFrame, run: str, path: str) -> DataFrame:
    """Newest file of each run by name order."""
    return df.groupBy(run).agg(F.max(path).alias(path))


def keep_last_n(df: DataFrame, run: str, step: str, n: int) -> DataFrame:
    """The last ``n`` saved steps of each run; Spark applies the limit before the shuffle too."""
    w = Window.partitionBy(run).orderBy(F.col(step).desc())
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")

