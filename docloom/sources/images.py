"""Image files and archives of images as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab as v

FILES = "seq long, path string, content binary"


def is_image(path, suffixes: list[str] = v.IMAGE_SUFFIXES):
    """Whether a path's extension is one of an image, in either case."""
    return F.lower(t.suffix(path)).isin(suffixes)


def kind(path):
    """folder, zip, image or unsupported; a folder's path ends with a slash."""
    s = F.lower(t.suffix(path))
    return F.when(F.endswith(path, F.lit("/")), "folder").when(s == ".zip", "zip").when(s.isin(v.IMAGE_SUFFIXES), "image").otherwise("unsupported")


def scanned(spark: SparkSession, path: str, suffixes: list[str] = v.IMAGE_SUFFIXES, content: bool = False) -> DataFrame:
    """path (and content) of all images below a folder, or of the one file; nothing where nothing is.

    Spark's listing leaves out files and folders whose names begin with _ or a dot.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "path string, content binary" if content else "path string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where(is_image(F.col("path"), suffixes)).select("path", *["content"] * content)


def members(archives: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """path, member, content of every file in the archives (path, content), unpacked in memory member by member."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pa.RecordBatch.from_pydict({"path": [path], "member": [name], "content": [z.read(name)]})

    out = archives.select("path", "content").mapInArrow(opened, "path string, member string, content binary")
    return out if suffixes is None else out.where(is_image(F.col("member"), suffixes))


def loaded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """load_seq, path, member, content of folders, archives and images in the order given; a bag union that ignores all else."""
    out = None
    for i, p in enumerate(paths):
        if p.lower().endswith(".zip"):
            files = members(spark.read.format("binaryFile").load(p), v.IMAGE_SUFFIXES)
        else:
            files = scanned(spark, p, content=True).withColumn("member", F.lit("")).select("path", "member", "content")
        files = files.withColumn("load_seq", F.lit(i)).select("load_seq", "path", "member", "content")
        out = files if out is None else out.unionByName(files)
    return out if out is not None else spark.createDataFrame([], "load_seq int, path string, member string, content binary")
