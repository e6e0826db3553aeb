"""Status reports, listing sheets and error records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab as v


def status_report(results: DataFrame) -> DataFrame:
    """One row: how many succeeded; whatever isn't `success`, null too, failed."""
    ok = F.col("status").eqNullSafe(F.lit("success"))
    return results.agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))


def result_sheet(results: DataFrame, file_too: bool = True) -> DataFrame:
    """seq and the sheet's five columns; the first is the source, else (if `file_too`) the file."""
    source = F.coalesce("source", "file", F.lit("")) if file_too else t.some("source")
    cells = [source, t.some("project_name"), t.some("project_code"), t.some("target"), t.some("status")]
    return results.select("seq", *[c.alias(h) for c, h in zip(cells, v.SHEET_HEADINGS, strict=True)])


def error_records(results: DataFrame, reason: str = v.UNKNOWN_REASON) -> DataFrame:
    """file, reason of what didn't succeed."""
    bad = results.where(~F.col("status").eqNullSafe(F.lit("success")))
    return bad.select(F.coalesce("file", "source", F.lit("")).alias("file"), F.coalesce(F.nullif("message", F.lit("")), F.lit(reason)).alias("reason"))


def waiting(files: DataFrame) -> DataFrame:
    """Every file with the status of the stubbed executor."""
    return files.withColumn("status", F.lit(v.WAITING))


def error(file, reason) -> Column:
    """An error record as a struct."""
    return F.struct(t.some(file).alias("file"), t.some(reason).alias("reason"))
