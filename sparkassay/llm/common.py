"""Shared plumbing of the corpus operators: scratch tables, texts and column checks."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.sources.files import shared_dir


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables, written as Parquet under the shared folder.

    A written table cuts lineage: a lost executor costs a re-read, not a recomputation. ``drop`` removes the
    tables that the result no longer reads; what is left goes when the driver's session ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _drop(self.spark, self.path(name))

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _drop(self.spark, self.root)
        except Exception:  # the gateway may be gone when the interpreter ends
            pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle that the operator sizes itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
