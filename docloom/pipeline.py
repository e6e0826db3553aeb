"""Whole runs: images to tokens to fields to names and a listing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sinks
from .functions import rules
from .operators import merge, naming, ranks, report
from .sources import tokens as token_source

#: Paths that a listing's ranges are chosen from, and ranges at most.
SAMPLED_PATHS, PATH_RANGES = 4096, 256


def from_images(images: DataFrame, backend: Callable, fixed: bool = False, prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """seq, path and the fields of each image (seq, path, content), prepared first if wanted; a failed image keeps its message."""
    found = token_source.recognised(images, backend, prepare)
    failed = found.where("error <> ''").groupBy("path").agg(F.first("error").alias("why"))
    rows = found.where("error = ''").withColumnRenamed("path", "doc_id")
    fields = merge.extracted(rows, fixed).drop("error")
    out = images.select("seq", "path").join(fields, F.col("path") == F.col("doc_id"), "left").drop("doc_id").join(failed, "path", "left")
    empty = {"project_name": "", "project_code": "", "report_type": "", "source": ""}
    return out.fillna(empty).withColumn("valid", F.coalesce("valid", F.lit(False))).withColumn("error", F.coalesce("why", F.lit(""))).drop("why")


def from_texts(texts: DataFrame, fixed: bool = False) -> DataFrame:
    """seq, path and the fields of each text (seq, path, text)."""
    rows = texts.select("seq", "path", F.inline(F.array(rules.report_fields(F.col("text"), fixed))), F.lit("").alias("error"))
    return rows


def rename_plan(fields: DataFrame, output: str, existing: DataFrame | None = None) -> DataFrame:
    """Results with source and target: names are unique among each other and what exists; failures have no target."""
    rows = merge.rename_results(fields)
    done = naming.planned(rows.where("status = 'success'"))
    names = naming.deduplicated(done.select("seq", "filename"), existing).select(F.col("seq").alias("_s"), "target")
    rows = rows.join(names, F.col("seq") == F.col("_s"), "left").drop("_s")
    ok = F.col("status") == "success"
    return rows.withColumn("target", F.when(ok, F.concat(F.lit(output.rstrip("/") + "/"), "target"))).withColumn("source", F.when(ok, F.col("path"))).withColumn("file", F.col("path"))


def listed(plan: DataFrame, path: str) -> int:
    """Write the listing sheet of a run."""
    return sinks.write_xlsx(report.result_sheet(plan), path)


def numbered(files: DataFrame) -> DataFrame:
    """files with seq by path, for listings without an order of their own.

    Paths are cut into ranges by a sample of them and numbered range by range, so that no task holds all
    files; only there does their content move.
    """
    sample = sorted(r.path for r in files.select("path").orderBy(F.xxhash64("path")).limit(SAMPLED_PATHS).collect())
    bounds = sorted(set(sample[:: max(1, len(sample) // PATH_RANGES)]))
    rows = ranks.count_upto(files, bounds, F.col("path"), "_range").withColumn("_all", F.lit(0))
    return ranks.ranked(rows, "_all", F.col("_range"), [F.col("path")], "seq").drop("_all", "_range")
