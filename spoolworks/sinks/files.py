"""Record files, split folders, image copies and the run registry."""

from __future__ import annotations

import dataclasses
import itertools
import json
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.image_structure import Bytes, image_fault
from ..operators.ranking import first_writer_wins
from ..session import write_through

BLOCK = 1 << 20
#: Folder beside the targets where task attempts write before they are committed.
ATTEMPTS = "_attempts"


def write_json(df: DataFrame, path: str, layout: str = "lines", ascii_only: bool = False, mode: str = "errorifexists", line_end: str = "\n") -> None:
    """UTF-8 JSON, as lines, or as one array per file for readers that want an array.

    Each task writes its own file. ``ascii_only`` escapes every other character. ``line_end`` stands between the records of an array.
    """
    options = {"writeNonAsciiCharacterAsCodePoint": str(ascii_only).lower()}
    if layout == "lines":
        df.write.mode(mode).options(**options).json(path)
    else:
        write_text_records(df.select(F.to_json(F.struct(*df.columns), options).alias("value")), path, layout, mode, line_end)


def write_text_records(rows: DataFrame, path: str, layout: str = "lines", mode: str = "errorifexists", line_end: str = "\n") -> None:
    """Records that are text already (``value``), as lines or as one array per file."""
    if layout not in ("lines", "array"):
        raise ValueError(f"layout must be lines or array, not {layout!r}")
    if layout == "array":
        rows = rows.mapInPandas(_add_brackets, "value string")
    rows.write.mode(mode).option("lineSep", line_end).text(path)


def _add_brackets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of one task to the lines of one JSON array."""
    opening = "["
    for batch in batches:
        if batch.empty:
            continue
        lines = "," + batch["value"]
        lines.iloc[0] = opening + batch["value"].iloc[0]
        opening = ","
        yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": ["]" if opening == "," else "[]"]})


def write_splits(
    df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists", rebalance: bool = False
) -> None:
    """One folder per split, so that reading a split prunes the others.

    Tasks write the splits they hold. ``rebalance`` shuffles first, which costs one pass and
    gives evenly sized files; a large split is cut over many tasks.
    """
    if rebalance:
        df = df.hint("rebalance", split)
    df.write.mode(mode).partitionBy(split).parquet(path)


def write_split_files(df: DataFrame, folder: str, base: str, split: str = "split") -> list[str]:
    """``<base>_<split>.json`` for every split name of the rows, in one pass; returns the names written.

    The rows are written once, by split, beside their place; the folders then get their names. A null
    split is an error: it has no file.
    """
    spark = df.sparkSession
    staged = f"{folder.rstrip('/')}/_{base}-{uuid.uuid4().hex}"
    named = F.when(F.col(split).isNull(), F.raise_error(F.lit("a row has no split"))).otherwise(F.col(split).cast("string"))
    df.withColumn(split, named).write.partitionBy(split).json(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for status in fs.listStatus(path(staged)):
        name = status.getPath().getName()
        if name.startswith(f"{split}="):
            value = urllib.parse.unquote(name.partition("=")[2])
            if not fs.rename(status.getPath(), path(f"{folder.rstrip('/')}/{base}_{value}.json")):
                raise FileExistsError(f"{base}_{value}.json is there already or could not be written")
            names.append(value)
    fs.delete(path(staged), True)
    return sorted(names)


#: Schemes of file listings and the name under which the copying library knows them (fixed values).
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def plain_uri(uri: str) -> str:
    """The URI as the copying library reads it; an error for a scheme that it does not know."""
    scheme = uri.partition(":")[0] if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else ""
    if scheme.lower() not in SCHEMES:
        raise ValueError(f"files under {scheme}: cannot be copied; use one of {sorted(filter(None, SCHEMES))}")
    rest = uri[len(scheme) + 1 :] if scheme else uri
    # file listings say file:/path, which is not a full URI
    return f"{SCHEMES[scheme.lower()]}://{rest[2:] if rest.startswith('//') else rest}"


def copy_images(
    manifest: DataFrame, dest_dir: str, src: str = "src", dest: str = "dest", content: str | None = None, order_key: str | None = None
) -> DataFrame:
    """Writes every image of the manifest once; returns the status of each row: written, kept, missing or failed.

    The image is a file named by ``src``, or bytes in the column ``content``. Of rows with one ``dest``
    the first by ``order_key`` (``src`` unless given) is written. Tasks read and write the files
    themselves, a block at a time, so bytes of files never shuffle. A target that exists is left alone.

    Copies are committed in two phases. Every task attempt first writes into a folder of its own, and the table of what
    was written, which Spark keeps of successful attempts alone, is the commit manifest. A second
    pass then moves those files to their names. A repeated task of either pass gives the same statuses, and the
    attempt folders, those of lost tasks too, are removed at the end. The statuses are a written table: reading it again copies nothing.
    """
    plain_uri(dest_dir)
    spark = manifest.sparkSession
    first = first_writer_wins(manifest.select(*{src, dest, order_key or src}), dest, order_key or src).select(dest, src)
    rows = manifest.join(first, [dest, src], "left_semi") if content else first
    wanted = rows.select(F.col(src).cast("string").alias("src"), F.col(dest).alias("dest"), *([F.col(content).alias("content")] if content else []))
    attempts = f"{ATTEMPTS}-{uuid.uuid4().hex}"

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = f"{attempts}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        folder, numbers = _Folder(dest_dir), itertools.count()
        for batch in batches:
            bodies = batch["content"] if content else [None] * len(batch)
            done = [
                _stage_one(s, folder, d, b, content is not None, f"{own}/{next(numbers)}") for s, d, b in zip(batch["src"], batch["dest"], bodies)
            ]
            yield pd.DataFrame({"src": batch["src"], "dest": batch["dest"], "status": [x for x, _ in done], "part": [p for _, p in done]})

    def publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = _Folder(dest_dir)
        for batch in batches:
            status = [_publish_one(folder, d, p) if s == "staged" else s for d, s, p in zip(batch["dest"], batch["status"], batch["part"])]
            yield pd.DataFrame({"src": batch["src"], "dest": batch["dest"], "status": status})

    try:
        staged = write_through(wanted.mapInPandas(stage, "src string, dest string, status string, part string"), "staged")
        return write_through(staged.mapInPandas(publish, "src string, dest string, status string"), "copied")
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{dest_dir.rstrip('/')}/{attempts}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_failed_copies(rows: DataFrame, copied: DataFrame, src: str = "src", dest: str = "dest") -> DataFrame:
    """The rows whose image is at its target."""
    good = copied.where(F.col("status").isin("written", "kept")).select(F.col("dest").alias("__dest"), F.col("src").alias("__src"))
    return rows.join(good, (F.col(dest) == F.col("__dest")) & (F.col(src).cast("string") == F.col("__src")), "left_semi")


def _open_file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(plain_uri(uri))


class _Folder:
    """The target folder as one task sees it: opened once, and each of its subfolders made once."""

    def __init__(self, uri: str):
        self.uri, self.opened, self.made = uri, None, set()

    def find(self, name: str):
        """The file system, the path of a name, and whether it is there."""
        from pyarrow import fs

        if not self.opened:
            files, root = _open_file_system(self.uri)
            self.opened = files, root.rstrip("/")
        files, root = self.opened
        path = f"{root}/{name}"
        return files, path, files.get_file_info(path).type != fs.FileType.NotFound

    def make_parent(self, path: str) -> None:
        parent = path.rpartition("/")[0]
        if parent not in self.made:
            self.opened[0].create_dir(parent, recursive=True)
            self.made.add(parent)


def _stage_one(src: str | None, folder: _Folder, name: str, body: bytes | None, from_bytes: bool, part: str) -> tuple[str, str | None]:
    """Copies one image into the attempt's folder; the status so far, and where the copy lies below the target folder."""
    from pyarrow import fs

    try:
        if folder.find(name)[2]:
            return "kept", None
        if from_bytes:
            if body is None:
                return "missing", None
            read = pa.BufferReader(body)
        else:
            if src is None:
                return "missing", None
            source, origin = _open_file_system(src)
            if source.get_file_info(origin).type != fs.FileType.File:
                return "missing", None
            read = source.open_input_stream(origin)
        target, path, _ = folder.find(part)
        folder.make_parent(path)
        with read, target.open_output_stream(path) as write:
            while block := read.read(BLOCK):
                write.write(block)
        return "staged", part
    except (OSError, ValueError):
        return "failed", None


def _publish_one(folder: _Folder, name: str, part: str) -> str:
    """Moves a committed copy to its name; a copy that is gone while its target is there was moved by an earlier attempt."""
    try:
        target, path, there = folder.find(name)
        _, staged, left = folder.find(part)
        if not left:
            return "written" if there else "failed"
        if there:
            return "kept"
        folder.make_parent(path)
        target.move(staged, path)
        return "written"
    except (OSError, ValueError):
        return "failed"


def image_faults(files: DataFrame, path: str = "path", content: str | None = None) -> DataFrame:
    """``path, fault`` of each distinct file named: why it is no whole image, null if it is one.

    Files are opened in the tasks and read a window at a time, to the end; bytes in the column ``content``, if named, are read instead. A file
    that cannot be read has the fault ``unreadable``; null content ``missing``.
    """

    def from_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "fault": [_file_fault(p) for p in batch["path"]]})

    def from_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults = []
            for body in batch.column("content"):
                data = body.as_buffer() if body.is_valid else None
                faults.append("missing" if data is None else image_fault(Bytes(memoryview(data)), data.size))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(faults, pa.string())], names=["path", "fault"])

    if content:
        return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(from_content, "path string, fault string")
    return files.select(F.col(path).alias("path")).distinct().mapInPandas(from_files, "path string, fault string")


def _file_fault(uri: str) -> str | None:
    try:
        source, origin = _open_file_system(uri)
        with source.open_input_file(origin) as stream:
            return image_fault(stream, stream.size())
    except (OSError, ValueError):
        return "unreadable"


def read_heads(paths: DataFrame, path: str = "path", size: int = 32) -> DataFrame:
    """``path, head``: the leading bytes of each distinct file named, null if it cannot be read.

    Only files that are asked for are opened, and only so many bytes of each are read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(head=[_head(p, size) for p in batch["path"]])

    return paths.select(F.col(path).alias("path")).distinct().mapInPandas(read, "path string, head binary")


def _head(uri: str, size: int) -> bytes | None:
    try:
        source, origin = _open_file_system(uri)
        with source.open_input_stream(origin) as stream:
            return stream.read(size)
    except (OSError, ValueError):
        return None


RUN_INFO = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("model_args", T.StringType()),
    T.StructField("data_args", T.StringType()),
    T.StructField("training_args", T.StringType()),
    T.StructField("final_metrics", T.MapType(T.StringType(), T.DoubleType())),
])


def _as_json(settings) -> str:
    if dataclasses.is_dataclass(settings):
        settings = dataclasses.asdict(settings)
    elif hasattr(settings, "__dict__"):
        settings = vars(settings)
    elif not isinstance(settings, dict):
        settings = str(settings)
    return json.dumps(settings, default=str)


def run_info(spark: SparkSession, run: str, model_args, data_args, training_args, metrics: dict[str, float] | None = None) -> DataFrame:
    """One registry row of a run's settings and final metrics."""
    row = (run, _as_json(model_args), _as_json(data_args), _as_json(training_args),
           {k: float(v) for k, v in metrics.items()} if metrics else None)
    return spark.createDataFrame([row], RUN_INFO)


def write_run_info(info: DataFrame, path: str) -> None:
    """Adds a version of the registry that replaces its runs; earlier versions and other runs stay.

    A version is a folder of its own, so writers at the same time never touch each other's files, and a version is there as a whole once
    its job has committed. Its number is one above those that were there when it began; versions of one number, by writers at the
    same time, are in the order of a random suffix, the same for every reader.
    """
    spark = info.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(root, "version=*"))
    numbers = [int(f.getPath().getName().removeprefix("version=").partition("-")[0]) for f in found or []]
    info.select(*RUN_INFO.names).write.parquet(f"{path}/version={max(numbers, default=-1) + 1:012d}-{uuid.uuid4().hex}")


def read_run_info(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every run; a run that one version names twice has the row of the greater settings, taken as texts.

    A null run is a run.
    """
    rows = run_versions(spark, path)
    settings = [c for c in RUN_INFO.names[1:] if c != "final_metrics"]
    metrics = F.array_sort(F.map_entries("final_metrics"))
    newest = F.max_by(F.struct(*RUN_INFO.names[1:]), F.struct("version", *settings, metrics))
    return rows.groupBy("run").agg(newest.alias("newest")).select("run", "newest.*")


def run_versions(spark: SparkSession, path: str) -> DataFrame:
    """All rows ever written, with their version."""
    return spark.read.schema(T.StructType([*RUN_INFO.fields, T.StructField("version", T.StringType())])).parquet(path)
