"""Shared plumbing of the training-data operators: reading, scratch tables, held-out rows."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import CHUNK_ROWS, ranked

__all__ = ["CHUNK_ROWS", "dropped", "fresh", "held_out", "listed", "pieces", "ranked", "scratch", "small_batches", "table", "text_of", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    Only a local master, where driver and executors are one process, may go without that setting.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file:///tmp/checkpoints/docloom-{os.getuid()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.docloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing will read again, through Hadoop's file system."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.docloom_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def listed(spark: SparkSession, **columns: list[int | None]) -> DataFrame:
    """A small table of whole numbers as a plan of the JVM alone: the lists are literals, indexed by a range."""
    at = F.col("id").cast("int") + 1
    values = {n: F.element_at(F.split(F.lit(",".join("" if x is None else str(x) for x in xs)), ","), at) for n, xs in columns.items()}
    return spark.range(0, len(next(iter(columns.values()))), 1, 1).select(*[F.nullif(c, F.lit("")).cast("long").alias(n) for n, c in values.items()])


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand whole texts to Python workers a few at a time, so that their memory doesn't follow the default of 10,000 rows.

    The setting holds for the session from then on: plans are carried out after the caller has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows don't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str | Column = "text") -> Column:
    """Null texts are empty texts."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3 = 1: never learnt from. A null id counts as the empty text."""
    return (F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8")) % 3) == 1


def pieces(count: int) -> int:
    """How many chunks of about CHUNK_ROWS rows so many rows make."""
    return max(1, math.ceil(count / CHUNK_ROWS))
