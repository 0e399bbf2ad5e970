"""Queries that write what Spark derives from the tables and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import metrics as M
from ..operators.ranking import split_exact
from ..session import scratch_path
from ..sinks import files as K
from ..sources import files as S
from ..sources.records import scan_array_ranges, scan_records
from .catalog import query
from .queries_metrics import LONG, r, settled
from .queries_sampling import V_RANKED, V_SPLIT
from .standins import V_TRAIN_LOG

DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@query("scan_json_array", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    path = scratch_path(t.spark, "array") + ".json"
    K.write_json(t.conversations, path, layout="array")
    return S.scan_json_array(t.spark, path, t.conversations.schema)


@query("scan_array_ranges", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    """Arrays on one line, each read by many tasks in byte ranges."""
    path = scratch_path(t.spark, "arrays")
    K.write_json(t.conversations, path, layout="array", line_end=" ")
    return scan_array_ranges(t.spark, path, t.conversations.schema, range_bytes=8 << 10)


def broken_files(t):
    """Arrays of odd and lines of even documents; of every 11 documents, four are broken in different ways."""
    text = F.to_json(F.struct("doc_id", "text", "lang"))
    kind = F.col("doc_id") % 11
    hurt = (
        F.when(kind == 3, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")))
        .when(kind == 5, F.regexp_replace(text, '"text":"', '"text":'))
        .when(kind == 7, F.regexp_replace(text, '"text":', '"text"'))
        .when(kind == 9, F.expr("left(j, length(j) - 1)"))
    )
    rows = t.documents.withColumn("j", text).select("doc_id", F.coalesce(hurt, F.col("j")).alias("value"))
    path = scratch_path(t.spark, "broken")
    K.write_text_records(rows.where("doc_id % 2 = 1").select("value"), f"{path}/arrays", layout="array")
    K.write_text_records(rows.where("doc_id % 2 = 0").select("value"), f"{path}/lines")
    return path


@query(
    "quarantine_file_rows",
    """SELECT doc_id, CASE WHEN doc_id % 11 IN (3, 5, 7, 9) THEN 'reject' ELSE 'good' END AS kind,
              CASE WHEN doc_id % 11 IN (3, 5, 7, 9) THEN NULL ELSE text END AS text FROM documents""",
)
def _(t):
    schema = T.StructType([t.documents.schema[n] for n in ("doc_id", "text", "lang")])
    good, rejects = scan_records(t.spark, broken_files(t), schema, range_bytes=64 << 10)
    named = F.regexp_extract(F.decode("record", "UTF-8"), '"doc_id":([0-9]+)', 1).cast("long")
    return good.select("doc_id", F.lit("good").alias("kind"), "text").unionByName(
        rejects.select(named.alias("doc_id"), F.lit("reject").alias("kind"), F.lit(None).cast("string").alias("text"))
    )


@query("scan_mixed_layouts", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    """A folder that holds arrays and lines gives all rows of both."""
    path = scratch_path(t.spark, "mixed") + ".json"
    K.write_json(t.conversations.where("turn = 0"), f"{path}/arrays", layout="array")
    K.write_json(t.conversations.where("turn > 0"), f"{path}/lines")
    return S.scan_json_or_jsonl(t.spark, path, t.conversations.schema)


@query("scan_json_or_jsonl", DOCUMENTS)
def _(t):
    path = scratch_path(t.spark, "lines") + ".jsonl"
    K.write_json(t.documents, path)
    return S.scan_json_or_jsonl(t.spark, path, t.documents.schema)


@query("write_json", DOCUMENTS)
def _(t):
    path = scratch_path(t.spark, "ascii") + ".json"
    K.write_json(t.documents, path, ascii_only=True)
    return S.scan_json_or_jsonl(t.spark, path, t.documents.schema)


@query("scan_named", "SELECT doc_id, split FROM v_split WHERE split = 'train'", (V_RANKED, V_SPLIT))
def _(t):
    split_exact(t.documents.select("doc_id"), "doc_id").createOrReplaceTempView("named_documents")
    # no such split, so the training rows come back
    return S.scan_named(t.spark, "named_documents", "dev")


@query("scan_first_available", "SELECT doc_id, lang FROM documents")
def _(t):
    found = S.scan_first_available(t.spark, ["no_such_table", f"{t.folder}/nothing.parquet", f"{t.folder}/documents.parquet"])
    return found.select("doc_id", "lang")


@query("scan_split_file", "SELECT doc_id, lang FROM v_split WHERE split = 'val'", (V_RANKED, V_SPLIT))
def _(t):
    folder = scratch_path(t.spark, "splits")
    rows = split_exact(t.documents.select("doc_id", "lang"), "doc_id")
    K.write_split_files(rows, folder, "captions")
    return S.scan_split_file(t.spark, f"{folder}/captions_train.json", "val", "captions", rows.drop("split").schema)


@query("write_splits", "SELECT doc_id, lang, split FROM v_split", (V_RANKED, V_SPLIT))
def _(t):
    path = scratch_path(t.spark, "by-split")
    K.write_splits(split_exact(t.documents.select("doc_id", "lang"), "doc_id"), path)
    return t.spark.read.parquet(path).select("doc_id", "lang", F.col("split").cast("string").alias("split"))


@query("scan_metrics_csv", "SELECT run, step, tag, value FROM v_long", (V_TRAIN_LOG, LONG))
def _(t):
    path = scratch_path(t.spark, "metrics")
    log = t.train_log
    log.write.option("header", True).csv(path)
    return M.unpivot_metrics(S.scan_metrics_csv(t.spark, path, log.schema), ["run"])


STATE_STEPS = 1000


@query("scan_run_logs", "SELECT CAST(run AS VARCHAR) AS run, step, tag, value FROM v_long", (V_TRAIN_LOG, LONG))
def _(t):
    """Trainer states of at most 1,000 steps each, written as JSON and read as series."""
    path = scratch_path(t.spark, "states")
    entry = F.struct("step", "loss", "learning_rate")
    states = (
        t.train_log.groupBy("run", F.floor((F.col("step") - 1) / STATE_STEPS).alias("piece"))
        .agg(F.array_sort(F.collect_list(entry)).alias("log_history"), F.max("step").alias("global_step"))
    )
    states.select(F.col("run").cast("string").alias("run"), "global_step", "log_history").write.json(path)
    schema = T.StructType([T.StructField("run", T.StringType()), *S.TRAINER_STATE.fields])
    return S.scan_run_logs(t.spark.read.schema(schema).json(path)).select("run", "step", "tag", "value")


def trainer_states(t):
    """Two states of each run, in pieces of at most 1,000 steps, so that no record grows with its run."""
    path = scratch_path(t.spark, "trainer-states")
    log = t.train_log
    half = log.groupBy("run").agg(F.ceil(F.max("step") / 2).alias("upto"))
    early = log.join(half, "run").where("step <= upto").drop("upto")
    for name, rows in (("checkpoint-00000001", early), ("checkpoint-00000002", log)):
        states = rows.groupBy("run", F.floor((F.col("step") - 1) / STATE_STEPS).alias("piece")).agg(
            F.array_sort(F.collect_list(F.struct("step", "loss", "learning_rate"))).alias("log_history"), F.max("step").alias("global_step")
        )
        states.select(F.col("run").cast("string").alias("run"), "global_step", "log_history").write.json(f"{path}/{name}")
    schema = T.StructType([T.StructField("run", T.StringType()), *S.TRAINER_STATE.fields])
    return S.read_trainer_states(t.spark, f"{path}/*", multi_line=False, schema=schema)


@query(
    "scan_trainer_states",
    """SELECT run, max(step) AS step, CAST(count(*) AS BIGINT) AS entries FROM (
         SELECT CAST(run AS VARCHAR) AS run, step, unnest(['loss', 'learning_rate']) AS tag FROM v_train_log) q GROUP BY run""",
    (V_TRAIN_LOG,),
)
def _(t):
    """Two states of each run, the newer one holding the whole history; only that counts."""
    newest = trainer_states(t).withColumn("path", F.regexp_extract("path", "checkpoint-[0-9]+", 0))
    series = S.scan_run_logs(newest, path="path")
    return series.groupBy("run").agg(F.max("step").alias("step"), F.count(F.lit(1)).alias("entries"))


@query("scan_image_files", "SELECT concat('doc_', doc_id, '.txt') AS name, octet_length(encode(text)) AS length FROM documents")
def _(t):
    """Every text as a file, a folder for every thousand ids."""
    path = scratch_path(t.spark, "blobs")
    name = F.concat(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    K.copy_images(t.documents.select(name.alias("dest"), "doc_id", F.encode("text", "UTF-8").alias("body")), path, src="doc_id", content="body")
    return S.scan_image_files(t.spark, path).select(F.substring_index("path", "/", -1).alias("name"), "length")


@query(
    "from_records",
    """SELECT coalesce(l.name, d.lang) AS name, count(*) AS docs FROM documents d
       LEFT JOIN (VALUES ('en', 'English'), ('fr', 'French'), ('de', 'German'), ('es', 'Spanish')) l(lang, name) ON d.lang = l.lang
       GROUP BY 1""",
)
def _(t):
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("name", T.StringType())])
    names = S.from_records(t.spark, [
        {"lang": "en", "name": "English"}, {"name": "French", "lang": "fr"}, ("de", "German"), ("es", "Spanish"),
    ], schema)
    named = t.documents.join(names, "lang", "left")
    return named.groupBy(F.coalesce("name", "lang").alias("name")).agg(F.count(F.lit(1)).alias("docs"))


@query(
    "write_run_info",
    f"""SELECT CAST(run AS VARCHAR) AS run, 'base' AS model, {r('avg(loss)')} AS train_loss,
               CAST(max(step) AS DOUBLE) AS steps FROM v_train_log GROUP BY run""",
    (V_TRAIN_LOG,),
)
def _(t):
    path = scratch_path(t.spark, "registry")
    summary = M.run_summary(t.train_log)
    info = summary.select(
        F.col("run").cast("string").alias("run"),
        F.lit('{"name": "base"}').alias("model_args"),
        F.to_json(F.struct(F.col("logged").alias("rows"))).alias("data_args"),
        F.to_json(F.struct(F.col("steps").alias("max_steps"))).alias("training_args"),
        F.create_map(
            F.lit("train_loss"), settled(F.col("train_loss")), F.lit("steps"), F.col("steps").cast("double")
        ).alias("final_metrics"),
    )
    # a first version of every run, which the second one replaces
    K.write_run_info(info.withColumn("final_metrics", F.create_map(F.lit("train_loss"), F.lit(0.0))), path)
    K.write_run_info(info, path)
    return K.read_run_info(t.spark, path).select(
        "run", F.get_json_object("model_args", "$.name").alias("model"),
        F.col("final_metrics")["train_loss"].alias("train_loss"), F.col("final_metrics")["steps"].alias("steps"),
    )
