"""Queries over order, samples, splits and step planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import preview, round_half_up
from ..operators import epochs as E
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import steps as S
from ..session import spread
from .catalog import query
from .standins import V_TRAIN_LOG

ORDER = "md5(concat('42:', doc_id)), doc_id"
V_RANKED = f"""v_ranked AS (
  SELECT doc_id, lang, source, ROW_NUMBER() OVER (ORDER BY {ORDER}) - 1 AS rank, COUNT(*) OVER () AS n FROM documents)"""
V_SPLIT = """v_split AS (
  SELECT *, CASE WHEN rank < n - floor(n * 0.1::DOUBLE) - floor(n * 0.1::DOUBLE) THEN 'train'
                 WHEN rank < n - floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM v_ranked)"""


@query("sample_exact", f"SELECT doc_id, lang FROM documents ORDER BY {ORDER} LIMIT 250")
def _(t):
    return R.sample_exact(t.documents.select("doc_id", "lang"), 250, "doc_id")


@query("shuffle_seeded", "SELECT doc_id, rank FROM v_ranked", (V_RANKED,))
def _(t):
    return R.shuffle_rank(t.documents.select("doc_id"), "doc_id")


@query("split_exact", "SELECT doc_id, split FROM v_split", (V_RANKED, V_SPLIT))
def _(t):
    return R.split_exact(t.documents.select("doc_id"), "doc_id")


@query(
    "split_exact_ranked",
    """SELECT doc_id, split, rank, row_number() OVER (PARTITION BY split ORDER BY rank) - 1 AS index FROM v_split""",
    (V_RANKED, V_SPLIT),
)
def _(t):
    return R.split_exact_ranked(t.documents.select("doc_id"), "doc_id")


@query("sample_exact_ranked", f"SELECT doc_id, lang FROM documents ORDER BY {ORDER} LIMIT 250")
def _(t):
    return R.sample_exact(t.documents.select("doc_id", "lang"), 250, "doc_id", method="rank")


@query(
    "split_percent",
    "SELECT doc_id, CASE WHEN rank < n - floor(n * 5 / 100) THEN 'train' ELSE 'validation' END AS split FROM v_ranked",
    (V_RANKED,),
)
def _(t):
    return R.split_percent(t.documents.select("doc_id"), "doc_id", 5)


@query(
    "split_percent_by_hash",
    """SELECT doc_id, CASE WHEN ('0x' || substr(md5(concat('42:', doc_id)), 1, 8))::BIGINT % 100 < 5
         THEN 'validation' ELSE 'train' END AS split FROM documents""",
)
def _(t):
    return R.split_percent_by_hash(t.documents.select("doc_id"), "doc_id", 5)


@query("limit_first", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def _(t):
    return R.limit_first(t.documents.select("doc_id", "lang", "n_chars"), 100, "doc_id")


@query("limit_first_ranked", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def _(t):
    return R.limit_first(t.documents.select("doc_id", "lang", "n_chars"), 100, "doc_id", method="rank")


TEXT_KEY = "concat('item_', lpad(CAST(doc_id AS VARCHAR), 9, '0'))"


@query("limit_first_text_key", f"SELECT {TEXT_KEY} AS name, lang FROM documents ORDER BY name LIMIT 100")
def _(t):
    named = t.documents.select(F.concat(F.lit("item_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), "lang")
    return R.limit_first(named, 100, "name", method="rank")


@query(
    "peek",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '...') ELSE text END AS shown
       FROM documents ORDER BY doc_id LIMIT 3""",
)
def _(t):
    rows = R.peek(t.documents.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", preview(F.col("text"), 100).alias("shown"))


@query(
    "latest_artifact",
    """SELECT run, max(concat('checkpoint-', lpad(CAST(step AS VARCHAR), 8, '0'))) AS path FROM v_train_log GROUP BY run""",
    (V_TRAIN_LOG,),
)
def _(t):
    named = t.train_log.select("run", F.concat(F.lit("checkpoint-"), F.lpad(F.col("step").cast("string"), 8, "0")).alias("path"))
    return R.latest_artifact(named, "run", "path")


@query(
    "running_index",
    f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ORDER}) - 1 AS index FROM documents",
)
def _(t):
    return R.running_index(t.documents.select("doc_id", "lang"), "doc_id", ("lang",))


@query("input_rank", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents")
def _(t):
    return R.input_rank(t.documents.select("doc_id"), "doc_id")


@query(
    "first_writer_wins",
    """SELECT n_chars, lang, doc_id FROM (SELECT n_chars, lang, doc_id,
         row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS rn FROM documents) q WHERE rn = 1""",
)
def _(t):
    return R.first_writer_wins(t.documents.select("n_chars", "lang", "doc_id"), "n_chars", "doc_id")


@query(
    "keep_last_n",
    """SELECT run, step FROM (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn
         FROM v_train_log) q WHERE rn <= 3""",
    (V_TRAIN_LOG,),
)
def _(t):
    return R.keep_last_n(t.train_log.select("run", "step"), "run", "step", 3)


@query(
    "assign_steps",
    """SELECT doc_id, rank, rank // 6 AS micro, (rank // 6) // 4 AS step, ((rank // 6) + 1) % 4 = 0 AS should_step,
              ((rank // 6) + 1) % 4 = 1 AS should_zero_grad, 0.25::DOUBLE AS scale FROM v_ranked""",
    (V_RANKED,),
)
def _(t):
    ranked = R.shuffle_rank(t.documents.select("doc_id"), "doc_id")
    return S.assign_steps(ranked, batch_size=2, accumulation=4, world=3)


@query(
    "epoch_progress",
    """SELECT run, step, floor(step * 12::DOUBLE / max(step) OVER (PARTITION BY run) * 1000000 + 0.5) / 1000000 AS epoch
       FROM v_train_log""",
    (V_TRAIN_LOG,),
)
def _(t):
    log = t.train_log.select("run", "step")
    rows = t.events.groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("rows"))
    progress = S.epoch_progress(F.col("step"), 1, 4, 3, F.col("rows"))
    return log.join(rows, "run").select("run", "step", round_half_up(progress, 6).alias("epoch"))


@query("split_counts", "SELECT split, COUNT(*) AS rows FROM v_split GROUP BY ROLLUP (split)", (V_RANKED, V_SPLIT))
def _(t):
    return M.split_counts(R.split_exact(t.documents.select("doc_id"), "doc_id"))


def _feistel(source: str) -> str:
    """One walk of the positions ``x`` of a table, as SQL."""
    out = f"SELECT *, x // b AS l, x % b AS r FROM ({source})"
    for i in range(E.ROUNDS):
        own, other, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        change = f"CAST(concat('0x', substr(md5(concat('42:', epoch, ':{i}:', {other})), 1, 15)) AS BIGINT)"
        out = f"SELECT * REPLACE (({own} + {change} % {side}) % {side} AS {own}) FROM ({out})"
    return f"SELECT doc_id, epoch, n, a, b, l * b + r AS x FROM ({out})"


SIDES = """SELECT *, CAST(ceil(n / a) AS BIGINT) AS b FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a FROM documents)"""


@query(
    "epoch_reshuffle",
    f"""WITH RECURSIVE start AS (SELECT doc_id, epoch, n, a, b, x FROM ({SIDES}), (SELECT unnest([0, 1, 2]) AS epoch)),
        walk AS ({_feistel("SELECT * FROM start")} UNION ALL {_feistel("SELECT doc_id, epoch, n, a, b, x FROM walk WHERE x >= n")})
        SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, x AS rank, x // 32 AS step FROM walk WHERE x < n AND (epoch > 0 OR x >= 64)""",
)
def _(t):
    """Three epochs in their own orders, resumed behind the second step of 32 rows."""
    placed = R.input_rank(t.documents.select("doc_id"), "doc_id", name="position")
    rows = t.documents.count()
    # the ranks are computed per row, so small rows are worth a task each core
    placed = spread(placed, max(t.spark.sparkContext.defaultParallelism, rows // R.PIECE_ROWS))
    ranked = E.reshuffled(placed, "position", rows, epochs=3, resume=(0, 64))
    return S.assign_steps(ranked, batch_size=32).select("doc_id", "epoch", "rank", "step")
