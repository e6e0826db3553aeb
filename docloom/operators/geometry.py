"""Operators over tokens with coordinates (doc_id, in_pos, x, y, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab as v

#: Bands around an anchor, in pixels.
SAME_LINE, NAME_LEFT, NAME_BELOW, CODE_LEFT, CODE_BELOW = 60, 50, 260, 30, 180


def kept_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with a text and a confidence other than the string -1."""
    return tokens.where((t.strip(t.some("text")) != "") & (t.some("conf") != "-1"))


def token_text(tokens: DataFrame, sep: str = "\n") -> DataFrame:
    """doc_id, raw_text: the tokens' texts in input order."""
    rows = F.array_sort(F.collect_list(F.struct("in_pos", "text")))
    return tokens.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), sep).alias("raw_text"))


#: Of each field: its labels, how far left of an anchor and how far below it a value may start, and its cleaning.
FIELDS = {"project_name": (v.NAME_LABELS, NAME_LEFT, NAME_BELOW, t.area_name), "project_code": (v.CODE_LABELS, CODE_LEFT, CODE_BELOW, t.area_code)}


def reading_order() -> WindowSpec:
    """Tokens of a document from top to bottom, then from left to right, then as they came."""
    return Window.partitionBy("doc_id").orderBy("y", "x", "in_pos")


def pages(tokens: DataFrame) -> DataFrame:
    """doc_id, tokens (pos, x, y, text, in_pos in reading order), stops (the positions of stop words) of each document.

    One aggregate deals the tokens by document; what follows looks at a page's own tokens alone.
    """
    token = F.struct(F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("x", F.lit(0)).alias("x"), "in_pos", t.some("text").alias("text"))
    rows = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    rows = rows.select("doc_id", F.transform("tokens", lambda k, i: F.struct((i + 1).alias("pos"), k["x"].alias("x"), k["y"].alias("y"), k["text"].alias("text"), k["in_pos"].alias("in_pos"))).alias("tokens"))
    return rows.withColumn("stops", F.transform(F.filter("tokens", lambda k: t.has_any(k["text"], v.AREA_STOPS)), lambda k: k["pos"]))


def areas(field: str) -> Column:
    """Of a page, the values (anchor, pos, value) of a field: for each anchor, every one right of or below it, up to the next stop word."""
    labels, left, below, clean = FIELDS[field]

    def near(a: Column, k: Column) -> Column:
        dx, dy = k["x"] - a["x"], k["y"] - a["y"]
        return (k["pos"] > a["pos"]) & (k["pos"] < a["stop"]) & (((dx > 0) & (F.abs(dy) <= SAME_LINE)) | ((dx >= -left) & (dy > 0) & (dy < below)))

    def anchor(k: Column) -> Column:
        stop = F.coalesce(F.get(F.filter("stops", lambda s: s > k["pos"]), F.lit(0)), F.lit((1 << 31) - 1))
        return F.struct(k["pos"].alias("pos"), k["x"].alias("x"), k["y"].alias("y"), stop.alias("stop"))

    def values(a: Column) -> Column:
        return F.transform(F.filter("tokens", lambda k: near(a, k)), lambda k: F.struct(a["pos"].alias("anchor"), k["pos"].alias("pos"), clean(k["text"]).alias("value")))

    anchors = F.transform(F.filter("tokens", lambda k: t.has_any(k["text"], labels)), anchor)
    return F.filter(F.flatten(F.transform(anchors, values)), lambda r: r["value"] != "")


def located(tokens: DataFrame, field: str) -> DataFrame:
    """doc_id, anchor, pos, value: a row for every value of a field."""
    return pages(tokens).select("doc_id", F.inline(areas(field)))


def glued(field: str) -> Column:
    """A page's values of a field one after the other, in order of anchors; empty if there are none."""
    return F.array_join(F.transform(areas(field), lambda r: r["value"]), "").alias(field)


def field_text(tokens: DataFrame, field: str) -> DataFrame:
    """doc_id and one field."""
    return pages(tokens).select("doc_id", glued(field))


def region_fields(tokens: DataFrame) -> DataFrame:
    """doc_id, project_name, project_code, source by position, and raw_text: the tokens' texts in input order."""
    text = F.array_sort(F.transform("tokens", lambda k: F.struct(k["in_pos"].alias("in_pos"), k["text"].alias("text"))))
    return pages(tokens).select("doc_id", *map(glued, FIELDS), F.lit("field_region").alias("source"), F.array_join(F.transform(text, lambda r: r["text"]), "\n").alias("raw_text"))


def nearby_value(tokens: DataFrame, keyword: str, reach: int = 300) -> DataFrame:
    """doc_id, value: on the line of the first token with the keyword, the rightmost other token nearer than `reach`; the last of equals."""
    w = Window.partitionBy("doc_id")
    key = F.when(F.contains(t.some("text"), F.lit(keyword)), F.struct("in_pos", "x", "y"))
    rows = tokens.withColumn("_k", F.min(key).over(w))
    other = (F.col("in_pos") != F.col("_k.in_pos")) & (F.col("y") == F.col("_k.y")) & (F.abs(F.col("x") - F.col("_k.x")) < reach)
    return rows.groupBy("doc_id").agg(F.coalesce(F.max_by("text", F.when(other, F.struct("x", "in_pos"))), F.lit("")).alias("value"))
