"""Record files: JSON arrays, JSON lines, split files, metric tables, run logs and images."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEFAULT_DATA_FILE, SPLIT_FILE_PATTERN
from ..functions.text import clean_tag
from ..operators.ranking import latest_artifact
from ..schemas import TRAINER_STATE
from ..session import write_through


def scan_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold one JSON array of records.

    Such a file cannot be split, so one file is one task: write many files, or rewrite once
    as JSON lines or parquet.
    """
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_json_or_jsonl(
    spark: SparkSession, path: str, schema: T.StructType | None = None, layout: str | None = None
) -> DataFrame:
    """Records of ``.json`` files (each one array, one object, or lines) or of ``.jsonl`` files (lines).

    ``path`` is a file, a folder or a glob. Every ``.json`` file is read by what it holds itself: the files are
    sorted into whole documents and lines by their first record, and both kinds are read together.
    ``layout`` ("document" or "lines") says it for all files. A record that does not parse
    is an error.
    """
    if layout not in (None, "document", "lines"):
        raise ValueError(f"layout must be document or lines, not {layout!r}")
    clean = path.rstrip("/")
    if not clean.endswith((".json", ".jsonl")):
        raise ValueError(f"unsupported file format: {path}")
    if layout is None and clean.endswith(".jsonl"):
        layout = "lines"
    reader = spark.read.option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema else reader

    def read(paths: str | list[str], whole: bool) -> DataFrame:
        return reader.option("multiLine", whole).json(paths)

    if layout:
        return read(clean, layout == "document")
    kinds: dict[bool, list[str]] = {True: [], False: []}
    for name, status in _data_files(spark, clean):
        kinds[_is_document(spark, status)].append(name)
    frames = [read(names, whole) for whole, names in kinds.items() if names]
    if not frames:
        return read(clean, False)
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = _hadoop_path(spark, path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = _hadoop_path(spark, path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def _data_files(spark: SparkSession, path: str) -> list[tuple[str, object]]:
    """Names and listing entries of the files that a file, folder or glob stands for, empty ones left out."""
    target = _hadoop_path(spark, path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    if not found:
        raise FileNotFoundError(f"no file at {path}")
    out, open_ = [], list(found)
    while open_:
        status = open_.pop()
        if status.isDirectory():
            open_ += [s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
        elif status.getLen() > 0:
            out.append((status.getPath().toString(), status))
    return sorted(out, key=lambda x: x[0])


def _is_document(spark: SparkSession, status, block: int = 1 << 16) -> bool:
    """Whether a file is one JSON document: an array, or an object that does not end on its first line."""
    fs = status.getPath().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.open(status.getPath())
    try:
        head = bytearray()
        while len(head) < status.getLen():
            piece = bytes(stream.readNBytes(block))
            if not piece:
                break
            head += piece
            text = bytes(head).removeprefix(b"\xef\xbb\xbf").lstrip()
            if text.startswith(b"["):
                return True
            line, end, _ = text.partition(b"\n")
            if end:
                break
        text = bytes(head).removeprefix(b"\xef\xbb\xbf").lstrip()
        try:
            json.loads(text.partition(b"\n")[0])
        except ValueError:
            return bool(text)
        return False
    finally:
        stream.close()


def split_file_path(path: str, split: str, base: str) -> str:
    """``<folder>/<base>_<split>.json`` beside the given path, or the path when it is that file."""
    name = SPLIT_FILE_PATTERN.format(base=base, split=split)
    if path.endswith(name):
        return path
    folder = path.rpartition("/")[0]
    return f"{folder}/{name}" if folder else name


def scan_split_file(spark: SparkSession, path: str, split: str, base: str, schema: T.StructType) -> DataFrame:
    """The file of one split; an error when it is absent."""
    target = split_file_path(path, split, base)
    if not path_exists(spark, target):
        raise FileNotFoundError(f"{base} {split} split not found at {target}")
    return scan_json_or_jsonl(spark, target, schema)


def dataset_paths(spark: SparkSession, path: str) -> tuple[str, str]:
    """Data file and image folder of a dataset path: a ``.json`` file, or a folder that holds both."""
    if path.endswith(".json"):
        beside = f"{path.rpartition('/')[0]}/images"
        return path, beside if path_exists(spark, beside) else f"{path}/images"
    folder = path.rstrip("/")
    return f"{folder}/{DEFAULT_DATA_FILE}", f"{folder}/images"


def scan_metrics_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


#: What a listing says of a file or folder; a folder's rows are those of the level below.
LISTED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("folder", T.BooleanType()),
])
#: Tasks for each core that list folders, and rows of one batch of them.
LIST_TASKS = 4
LIST_ROWS = 10_000


def scan_image_files(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Files of a folder and everything below it; bytes are read only when asked for.

    A folder on a shared mount is listed by tasks, level by level, and the listing is a written table, so neither the driver
    nor a task holds the names; one folder is listed by one task, so many files belong in many folders. Files with
    content, globs, single files and other stores go through Spark's own file index, which passes over empty files. Names that
    Spark takes as hidden are left out.
    """
    wanted = ["path", "modificationTime", "length"] + (["content"] if with_content else [])
    if not with_content and (folder := _mounted_folder(spark, path)):
        return _list_files(spark, folder).select(*wanted)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(*wanted)


def _mounted_folder(spark: SparkSession, path: str) -> str | None:
    """The full path of a folder that tasks can list themselves; null for any other path."""
    if re.search(r"[*?\[{]", path):
        return None
    target = _hadoop_path(spark, path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() != "file" or not fs.exists(target) or not fs.getFileStatus(target).isDirectory():
        return None
    return fs.makeQualified(target).toString()


def _hidden(name: str) -> bool:
    """Whether Spark's file index passes over the name."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _entries(folder: str) -> Iterator[tuple[str, int, int, bool]]:
    """Path, time in microseconds, length and kind of what lies in a folder; what vanishes meanwhile is left out."""
    with os.scandir(folder.partition(":")[2]) as found:
        for entry in found:
            if _hidden(entry.name):
                continue
            try:
                status = entry.stat()
            except FileNotFoundError:
                continue
            # file systems of Spark tell milliseconds
            yield f"{folder.rstrip('/')}/{entry.name}", status.st_mtime_ns // 1_000_000 * 1000, status.st_size, stat.S_ISDIR(status.st_mode)


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.bool_()]
    for batch in batches:
        entries = itertools.chain.from_iterable(_entries(folder) for folder in batch.column("path").to_pylist())
        while rows := list(itertools.islice(entries, LIST_ROWS)):
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=LISTED.names)


def _list_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files below a folder, by one pass over the folders of each depth."""
    cores = spark.sparkContext.defaultParallelism
    folders, n, levels = spark.createDataFrame([(folder,)], "path string"), 1, []
    while n:
        listed = folders.repartition(min(n, LIST_TASKS * cores)).mapInArrow(_list_folders, LISTED)
        levels.append(write_through(listed, "listing"))
        folders = levels[-1].where("folder").select("path")
        n = folders.count()
    return functools.reduce(DataFrame.union, levels).where("NOT folder")


def read_trainer_states(spark: SparkSession, path: str, multi_line: bool = True, schema: T.StructType = TRAINER_STATE) -> DataFrame:
    """Trainer state documents with the file each came from."""
    return (
        spark.read.schema(schema).option("multiLine", multi_line).json(path)
        .withColumn("path", F.input_file_name())
    )


def scan_run_logs(states: DataFrame, run: str = "run", path: str | None = None) -> DataFrame:
    """Log history of trainer states as ``run, tag, step, value``.

    With ``path`` only the newest state of each run, by name order, is kept: a state file
    repeats the history of the ones before it.
    """
    if path:
        newest = latest_artifact(states.select(run, path), run, path)
        states = states.join(newest, [run, path], "left_semi")
    entries = states.select(run, F.explode("log_history").alias("e")).select(run, "e.*")
    tags = [c for c in entries.columns if c not in (run, "step", "epoch")]
    series = entries.select(run, "step", *[F.col(t).cast("double").alias(t) for t in tags])
    return (
        series.unpivot([run, "step"], tags, "tag", "value")
        .where(F.col("value").isNotNull())
        .select(run, clean_tag(F.col("tag")).alias("tag"), "step", "value")
    )


def from_records(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A handful of driver-side records under a fixed schema, absent keys being null."""
    tuples = [tuple(r.get(name) for name in schema.names) if isinstance(r, dict) else tuple(r) for r in rows]
    return spark.createDataFrame(tuples, schema)


def scan_first_available(spark: SparkSession, sources: list[str | Callable[[], DataFrame]]) -> DataFrame:
    """First of an ordered list of tables, paths or functions that loads; an error with the last reason."""
    last: Exception | None = None
    for source in sources:
        try:
            df = source() if callable(source) else _open(spark, source)
            df.schema  # noqa: B018 - forces analysis
            return df
        except Exception as reason:  # noqa: BLE001 - any failure moves on to the next source
            last = reason
    raise ValueError(f"no source could be loaded; last error: {last}") from last


def _open(spark: SparkSession, source: str) -> DataFrame:
    if source.endswith((".json", ".jsonl")):
        return scan_json_or_jsonl(spark, source)
    if "/" in source:
        return spark.read.parquet(source)
    return spark.table(source)


def scan_named(
    spark: SparkSession, name: str, split: str = "train", split_column: str = "split"
) -> DataFrame:
    """Rows of one split of a catalog table: the asked one if present, else ``train``, else the first."""
    table = spark.table(name)
    if split_column not in table.columns:
        return table
    for name in (split, "train"):
        rows = table.where(F.col(split_column) == name)
        if not rows.isEmpty():
            return rows
    first = table.agg(F.min(split_column)).first()[0]
    return table.where(F.col(split_column) == first)


def scan_eval_split(
    spark: SparkSession, name: str, split: str | None, split_column: str = "split"
) -> DataFrame | None:
    """Evaluation rows, only when a split is named and present."""
    if not split:
        return None
    table = spark.table(name).where(F.col(split_column) == split)
    return None if table.isEmpty() else table

