"""Chats from turn rows: one record per chat, whatever its length.

The sorting and joining of a long chat is spread over bounded parts of its turns; only finished
parts meet in the record that the chat is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_SYSTEM_TEXT
from ..functions.chat import chatml_turn, with_generation_prompt

PART_TURNS = 1024
#: Bytes of text that one record may hold; a longer chat is an error that names it.
RECORD_BYTES = 1 << 30


def with_part(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    return turns.withColumn("part", F.floor(F.col("turn") / part_turns))


def require_record_size(turns: DataFrame, limit: int = RECORD_BYTES) -> DataFrame:
    """The turns, or an error that names a chat whose text does not fit one record."""
    sizes = turns.groupBy("conv_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    largest = sizes.agg(F.max(F.struct("bytes", F.col("conv_id").cast("string").alias("chat")))).scalar()
    message = F.concat(F.lit("chat "), largest["chat"], F.lit(" has "), largest["bytes"].cast("string"), F.lit(f" bytes of text, more than {limit}"))
    return turns.where(F.when(largest["bytes"] > limit, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def min_turns(turns: DataFrame, n: int = 2) -> DataFrame:
    """``conv_id, n_messages`` of chats with at least ``n`` turns; counts combine before the shuffle."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages")).where(F.col("n_messages") >= n)


def first_two_turns(turns: DataFrame) -> DataFrame:
    """First two turns of each chat as instruction and output; shorter chats are left out.

    Spark keeps two turns of each chat on either side of the shuffle.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    leading = turns.select("conv_id", "turn", "text").withColumn("place", F.row_number().over(order)).where("place <= 2")

    def at(place: int) -> Column:
        return F.max(F.when(F.col("place") == place, F.struct("text")))

    return (
        leading.groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("n"), at(1).alias("first"), at(2).alias("second"))
        .where("n = 2")
        .select("conv_id", F.col("first.text").alias("instruction"), F.lit("").alias("input"), F.col("second.text").alias("output"))
    )


def turns_to_messages(turns: DataFrame, part_turns: int = PART_TURNS, limit: int = RECORD_BYTES) -> DataFrame:
    """``conv_id, messages`` with the messages of a chat in turn order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    parts = with_part(require_record_size(turns, limit), part_turns).groupBy("conv_id", "part").agg(ordered.alias("ts"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ts"))), lambda p: p["ts"]))
    return parts.groupBy("conv_id").agg(whole.alias("ts")).select(
        "conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")
    )


def render_turns(turns: DataFrame, part_turns: int = PART_TURNS, generation_prompt: bool = False, limit: int = RECORD_BYTES) -> DataFrame:
    """``conv_id, text``: the ChatML text of every chat.

    Every turn is rendered where it lies, before the shuffle. Pieces are joined per part, and the
    texts of the parts per chat.
    """
    shown = F.col("role").isin("user", "assistant", "system")
    piece = F.when(shown, chatml_turn(F.col("role"), F.col("text"))).otherwise(F.lit(""))
    pieces = with_part(require_record_size(turns, limit), part_turns).select("conv_id", "part", "turn", "role", piece.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda p: p["piece"]), "")
    parts = pieces.groupBy("conv_id", "part").agg(F.min_by(F.coalesce("role", F.lit("")), "turn").alias("role"), joined.alias("text"))
    whole = parts.groupBy("conv_id").agg(
        F.min_by("role", "part").alias("opens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("body"),
    )
    # a system turn that comes first is the header already
    header = F.when(F.col("opens") == "system", F.lit("")).otherwise(chatml_turn(F.lit("system"), F.lit(DEFAULT_SYSTEM_TEXT)))
    text = F.concat(header, F.col("body"))
    return whole.select("conv_id", (with_generation_prompt(text) if generation_prompt else text).alias("text"))


def question_answer_pairs(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """User turns directly followed by an assistant turn, with the chat's system text as input.

    The next turn is looked up inside a part. Only the last turn of a part needs the first
    turn of a later one, and only chats longer than a part have any; those few rows and the
    system texts are joined by part, on the partitioning the window already made.
    """
    parted = with_part(turns.select("conv_id", "turn", "role", "text"), part_turns)
    inside = Window.partitionBy("conv_id", "part").orderBy("turn")
    following = parted.withColumn("__next", F.lead(F.struct("role", "text")).over(inside))

    # first turn of every later part, keyed by the part before it
    heads = (
        parted.where(F.col("turn") >= part_turns)
        .groupBy("conv_id", "part")
        .agg(F.min_by(F.struct("role", "text"), "turn").alias("__head"))
        .withColumn("before", F.coalesce(F.lag("part").over(Window.partitionBy("conv_id").orderBy("part")), F.lit(0)))
    )
    system = turns.where(F.col("role") == "system").groupBy("conv_id").agg(F.max("text").alias("__system"))
    no_head = F.lit(None).cast("struct<role:string,text:string>")
    no_text = F.lit(None).cast("string")
    edges = (
        heads.select("conv_id", F.col("before").alias("part"), "__head", no_text.alias("__system"))
        .unionByName(system.select("conv_id", F.lit(0).cast("long").alias("part"), no_head.alias("__head"), "__system"))
        .unionByName(heads.join(system, "conv_id").select("conv_id", "part", no_head.alias("__head"), "__system"))
        .groupBy("conv_id", "part")
        .agg(F.first("__head", ignorenulls=True).alias("__head"), F.max("__system").alias("__system"))
    )
    joined = following.join(edges, ["conv_id", "part"], "left").withColumn(
        "__next", F.coalesce("__next", "__head")
    )
    return joined.where((F.col("role") == "user") & (F.col("__next.role") == "assistant")).select(
        "conv_id", "turn",
        F.col("text").alias("instruction"),
        F.coalesce("__system", F.lit("")).alias("input"),
        F.col("__next.text").alias("output"),
    )
