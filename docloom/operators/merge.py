"""Competing candidates and the whole extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as s
from ..functions import text as t
from . import geometry


def merged_results(candidates: DataFrame) -> DataFrame:
    """doc_id with the longest name and, by itself, the longest code of its candidates; the first of equals."""
    best = lambda c: F.max_by(t.some(c), F.struct(F.length(t.some(c)), -F.col("seq")))
    return candidates.groupBy("doc_id").agg(t.merged_text(best("project_name")).alias("project_name"), t.merged_text(best("project_code")).alias("project_code"))


def chosen_name(candidates: DataFrame) -> DataFrame:
    """doc_id with the cleaned name of highest score; the first of equals."""
    rows = candidates.select("doc_id", "seq", t.region_name(t.some("project_name")).alias("name"))
    return rows.groupBy("doc_id").agg(F.max_by("name", F.struct(s.candidate_score(F.col("name")), -F.col("seq"))).alias("name"))


def extracted(tokens: DataFrame, fixed: bool = False) -> DataFrame:
    """doc_id, project_name, project_code, source, report_type, valid, error of tokenised documents.

    Fields found by position win over those found in the text, each by itself. Tokens are dealt by
    document once, for all parts.
    """
    found = geometry.region_fields(tokens).select("*", F.explode(F.array(rules.report_fields(F.col("raw_text"), fixed))).alias("parsed"))  # evaluated once
    name, code = t.filled(F.col("project_name"), F.col("parsed.project_name")), t.filled(F.col("project_code"), F.col("parsed.project_code"))
    out = found.select("doc_id", name.alias("project_name"), code.alias("project_code"), "source", "raw_text")
    return out.select("doc_id", "project_name", "project_code", "source", rules.report_type(F.col("project_code"), F.col("raw_text")).alias("report_type"), rules.has_result(F.col("project_name")).alias("valid"), F.lit("").alias("error"))


def rename_results(fields: DataFrame, *more: str) -> DataFrame:
    """seq, path, project_name, project_code, status, message (and columns named): one schema for successes and failures."""
    ok = rules.has_result(F.col("project_name"))
    return fields.select("seq", "path", *more, F.when(ok, F.col("project_name")).otherwise("").alias("project_name"), F.when(ok, t.some("project_code")).otherwise("").alias("project_code"), F.when(ok, "success").otherwise("failed").alias("status"), F.when(ok, "").otherwise(t.some("error")).alias("message"))
