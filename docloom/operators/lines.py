"""Operators over lines (doc_id, pos, line): neighbours, key and value on lines, last value of a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab as v


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line of every text."""
    return docs.select("doc_id", F.posexplode(F.split(t.some("text"), "\n")).alias("pos", "line"))


def _by_doc():
    return Window.partitionBy("doc_id").orderBy("pos")


def regions(lines: DataFrame, words: list[str] = v.REGION_WORDS, back: int = 1, ahead: int = 2) -> DataFrame:
    """doc_id, pos, key_rank, region: the lines around each (line, word) hit; overlaps are kept."""
    around = lines.withColumn("region", F.collect_list("line").over(_by_doc().rowsBetween(-back, ahead)))
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("key_rank"), F.lit(w).alias("word")) for i, w in enumerate(words)]), lambda k: F.contains(F.col("line"), k["word"]))
    return around.select("doc_id", "pos", "region", F.explode(found).alias("k")).select("doc_id", "pos", "k.key_rank", "region")


def region_text(found: DataFrame) -> DataFrame:
    """doc_id, text: all regions' lines in order, joined by line ends."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "key_rank", "region")))
    return found.groupBy("doc_id").agg(F.array_join(F.flatten(F.transform(rows, lambda r: r["region"])), "\n").alias("text"))


def _keyed(line: Column, key: str) -> Column:
    return t.strip(F.translate(F.replace(line, F.lit(key), F.lit("")), v.COLONS, ""))


def _hit(keys: list[str]) -> Column:
    """key_rank and value of the first key that stands in the line and has a value there or on the next line; null if none has."""
    hits = []
    for i, key in enumerate(keys):
        value = F.coalesce(F.nullif(_keyed(F.col("line"), key), F.lit("")), t.strip(F.col("_next")))
        hits.append(F.when(F.contains(F.col("line"), F.lit(key)) & value.isNotNull(), F.struct(F.lit(i).alias("key_rank"), value.alias("value"))))
    return F.coalesce(*hits)


def next_line_values(lines: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """doc_id and, of each field, the value of the first line with one of its keys: what is left of it, else the next line (which may be blank)."""
    rows = lines.withColumn("_next", F.lead("line").over(_by_doc()))
    rows = rows.select("doc_id", "pos", *[_hit(keys).alias(out) for out, keys in fields.items()])
    best = [F.min_by(F.col(out)["value"], F.when(F.col(out).isNotNull(), F.struct("pos", F.col(out)["key_rank"]))) for out in fields]
    return rows.groupBy("doc_id").agg(*[F.coalesce(b, F.lit("")).alias(out) for b, out in zip(best, fields, strict=True)])


def next_line_value(lines: DataFrame, keys: list[str], out: str) -> DataFrame:
    """doc_id, value of one field."""
    return next_line_values(lines, {out: keys})


def report_lines(lines: DataFrame) -> DataFrame:
    """doc_id, project_name, project_code by label lines."""
    found = next_line_values(lines, {"name": v.NAME_LABELS, "code": v.CODE_LABELS})
    code = t.longest(F.regexp_extract_all("code", F.lit(v.DASHED_CODE), F.lit(0)))
    return found.select("doc_id", t.strip(t.before(F.col("name"), v.LINE_STOPS)).alias("project_name"), t.stripped_code(code).alias("project_code"))


def merged_lines(lines: DataFrame, short: int = 25) -> DataFrame:
    """doc_id, pos, merged: a short line with the next one, unless that bears a label."""
    here, after = t.strip(F.col("line")), t.strip(F.lead("line").over(_by_doc()))
    rows = lines.select("doc_id", "pos", here.alias("a"), after.alias("b"))
    joined = (F.length("a") < short) & F.col("b").isNotNull() & ~t.has_any(F.col("b"), v.JOIN_STOPPERS)
    return rows.select("doc_id", "pos", F.when(joined, F.concat("a", "b")).otherwise(F.col("a")).alias("merged"))


def window_codes(lines: DataFrame, fixed: bool = False) -> DataFrame:
    """doc_id, pos, code: the longest code on a line and the two after it."""
    area = F.array_join(F.collect_list("line").over(_by_doc().rowsBetween(0, 2)), " ")
    rows = lines.select("doc_id", "pos", area.alias("area"))
    return rows.select("doc_id", "pos", t.power_code(t.longest(F.regexp_extract_all("area", F.lit(v.DASHED_CODE), F.lit(0))), fixed).alias("code"))


def table_fields(lines: DataFrame) -> DataFrame:
    """doc_id, project_name, project_code: of each field the last value that isn't blank."""
    last = []
    for field, keys in v.PAIR_KEYS.items():
        values = F.array(*[F.struct(F.lit(i).alias("r"), F.when(F.contains(F.col("line"), F.lit(k)), _keyed(F.col("line"), k)).otherwise("").alias("value")) for i, k in enumerate(keys)])
        best = F.array_max(F.filter(values, lambda x: x["value"] != ""))
        last.append(F.coalesce(F.max_by(best["value"], F.when(best.isNotNull(), F.struct("pos", best["r"]))), F.lit("")).alias(field))
    return lines.groupBy("doc_id").agg(*last)
