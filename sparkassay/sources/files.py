"""Readers and writers for the engine's text formats, and resolution of run folders."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.schema import EXTERNAL_PROJECTS


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="assay-")
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    fs, where = _fs(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.getFileStatus(where).isDirectory()


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds; none if it isn't there."""
    fs, where = _fs(spark, path)
    return [str(x.getPath()) for x in fs.listStatus(where)] if fs.exists(where) else []


def drop(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first of the paths that is there; raises if none is."""
    paths = list(paths)
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of these exists: {paths}")


def stage_path(spark: SparkSession, root: str, stage: str, run_id: str, legacy: str | None = None) -> str:
    """``root/stage/run_id``, or the legacy file of the stage where no run folder exists."""
    return first_existing(spark, [f"{root}/{stage}/{run_id}", *([f"{root}/{legacy}"] if legacy else [])])


def per_run_path(spark: SparkSession, root: str, run_id: str, name: str = "percandidate.csv") -> str | None:
    """A run's file; run ids are spelt with or without underscores."""
    return next((p for r in dict.fromkeys((run_id, run_id.replace("_", ""))) if exists(spark, p := f"{root}/{r}/{name}")), None)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False, missing_ok: bool = False) -> DataFrame:
    """JSON lines (plain or ``.gz``), blank lines skipped. ``strict`` fails on the first bad line; else it is dropped.

    ``missing_ok`` gives an empty table for a missing path.
    """
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document: an array gives a row for each element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def with_record_index(df: DataFrame, name: str = "raw_record_index", start: int = 1) -> DataFrame:
    """The position of each row in its source, from ``start``, for a frame that comes straight from files.

    Places within a task come from Spark's increasing ids; what the tasks before it hold is one small row each, joined to them.
    """
    low = F.lit((1 << 33) - 1)
    marked = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33))
    counts = marked.groupBy("_task").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the scan
    first = counts.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return marked.join(F.broadcast(first), "_task").select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(low) + start).alias(name))


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``line_no, line`` of the lines of a file that aren't blank and aren't records of the schema."""
    lines = with_record_index(spark.read.text(path), "line_no")
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.filter((F.trim("value") != "") & parsed["_bad"].isNotNull()).select("line_no", F.col("value").alias("line"))


def require_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that are all records of the schema; raises with the number of the first line that isn't."""
    first = bad_lines(spark, path, schema).orderBy("line_no").first()
    if first:
        raise ValueError(f"{path}, line {first['line_no']}: {first['line'][:200]}")
    return read_jsonl(spark, path, schema, strict=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and quoted line breaks. Without a schema all columns are text; ``columns`` prunes the scan."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*columns) if columns else df


def read_summaries(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a file for all files of a glob, with the folder as ``run_folder``."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("run_folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def record_count(df: DataFrame) -> int:
    """Records, not lines: quoted line breaks don't count."""
    return df.count()


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """A row for each preferred target of each external project."""
    projects = read_json_array(spark, path, EXTERNAL_PROJECTS).select(F.explode("projects").alias("p"))
    return projects.select("p.project", "p.repo_url", "p.ref", "p.max_functions", F.explode_outer("p.preferred_targets").alias("t")).select("project", "repo_url", "ref", "max_functions", "t.module", "t.rel_path", "t.function")


def read_zip(spark: SparkSession, path: str, max_files: int = 200, max_file: int = 1 << 20, max_total: int = 20 << 20, max_ratio: float = 100.0) -> DataFrame:
    """``archive, name, text`` of the files in zip archives; an archive beyond a limit gives one row with an ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        files = [x for x in z.infolist() if not x.is_dir()]
                        if len(files) > max_files:
                            raise ValueError("too many files")
                        if sum(x.file_size for x in files) > max_total:
                            raise ValueError("too large in total")
                        for x in files:
                            if x.file_size > max_file or x.file_size > max_ratio * max(1, x.compress_size):
                                raise ValueError(f"too large: {x.filename}")
                        rows = [(archive, x.filename, z.read(x).decode("utf-8", "replace"), None) for x in files]
                except (ValueError, zipfile.BadZipFile) as e:
                    rows = [(archive, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "name", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, text string, error string")


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines with nulls kept and NaN written as null; refuses to replace a path unless told to."""
    clean = df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})
    clean.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, overwrite: bool = False) -> None:
    """CSV with a header; arrays, maps and structs as JSON text; ``fields`` fixes the columns, absent ones stay out."""
    df = df.select(*[c for c in fields if c in df.columns]) if fields else df
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.col(f.name) for f in df.schema])
    flat.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def export_csv(spark: SparkSession, source: str, target: str, schema: T.StructType | str, fields: list[str]) -> None:
    """JSON lines to CSV, projected to those of the fields that exist."""
    write_csv(read_jsonl(spark, source, schema), target, fields)


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """A small file from the driver, on any file system."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_report(spark: SparkSession, report: dict | list, path: str) -> None:
    """A small driver-side report as one JSON file, on any file system."""
    write_bytes(spark, json.dumps(report, ensure_ascii=False, indent=2, default=str).encode(), path)
