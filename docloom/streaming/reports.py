"""Report texts as a stream: stateless extraction, and running status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as t


def extracted(texts: DataFrame, fixed: bool = False) -> DataFrame:
    """The stream's columns with project_name, project_code, report_type, status and filename of each text."""
    rows = texts.select("*", F.inline(F.array(rules.report_fields(F.col("text"), fixed))))
    status = F.when(F.col("project_name") != "", "success").otherwise("failed")
    rows = rows.withColumn("report_type", rules.report_type(F.col("project_code"), F.col("text"))).withColumn("status", status)
    return rows.withColumn("filename", F.when(F.col("status") == "success", t.name_then_code(F.col("project_name"), F.col("project_code"), F.lit(".jpg"))))


def status_counts(results: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Results by window of event time, report type and status; windows close once events are later than `late`."""
    return results.withWatermark(time, late).groupBy(F.window(time, window), "report_type", "status").agg(F.count(F.lit(1)).alias("n"))
