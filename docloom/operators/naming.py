"""Collision-free file names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .ranks import CHUNK_ROWS, plain_unions, ranked, shared, spread_join


def planned(results: DataFrame) -> DataFrame:
    """The rows with `filename`: name and code, with the source's own suffix."""
    return results.withColumn("filename", t.name_then_code(t.some("project_name"), t.some("project_code"), t.suffix(F.col("path"))))


def deduplicated(rows: DataFrame, existing: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """seq, filename, target: each row in order of seq takes the first free of a.x, a_2.x, a_3.x, ...

    Names can only collide within a family: stem without trailing _numbers, and extension. A family
    with one distinct name and nothing existing needs a rank alone, which is made in pieces of seq, so
    that a name that a third of all rows bear spreads over tasks. Only the other families are scanned
    in order, streamed batch by batch; there a task holds the family's distinct names.
    `existing` has a column filename; `whole` takes names as they are, without an extension.
    """
    plain_unions(rows.sparkSession)
    ext = F.lit("") if whole else t.suffix(F.col("filename"))
    named = rows.select("seq", t.some("filename").alias("filename")).withColumn("ext", ext)
    named = named.withColumn("stem", F.substring("filename", F.lit(1), F.length("filename") - F.length("ext")))
    named = named.withColumn("family", F.concat(F.regexp_replace("stem", r"(_[0-9]+)+$", ""), F.lit("/"), "ext"))
    named = shared(named, "seq")
    families = named.groupBy("family").agg((F.min("filename") == F.max("filename")).alias("single"))
    if existing is not None:
        has = existing.select("filename").withColumn("ext", ext)
        has = has.withColumn("stem", F.substring("filename", F.lit(1), F.length("filename") - F.length("ext")))
        has = has.select(F.lit(None).cast("long").alias("seq"), "filename", "ext", "stem", F.concat(F.regexp_replace("stem", r"(_[0-9]+)+$", ""), F.lit("/"), "ext").alias("family"))
        families = families.join(has.select("family").distinct().withColumn("met", F.lit(True)), "family", "left").select("family", (F.col("single") & F.col("met").isNull()).alias("single"))
    named = spread_join(named, families.withColumnRenamed("family", "_f"), "family", "_f", ["seq"])
    named = shared(named.withColumn("_piece", F.floor(F.col("seq") / CHUNK_ROWS)), "family", "_piece")
    easy = ranked(named, "family", F.col("_piece"), [F.col("seq")], "k").where("single")  # a filter before would go below the exchange
    easy = easy.select("seq", "filename", F.when(F.col("k") == 0, F.col("filename")).otherwise(F.concat("stem", F.lit("_"), (F.col("k") + 1).cast("string"), "ext")).alias("target"))
    hard = named.where("NOT single").select("family", "seq", "filename", "stem", "ext")
    if existing is not None:
        hard = hard.unionByName(has.join(named.where("NOT single").select("family").distinct(), "family", "left_semi").select("family", "seq", "filename", "stem", "ext"))

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, taken, following = None, set(), {}
        for batch in batches:
            out = []
            for f, seq, name, stem, ext in zip(batch["family"], batch["seq"], batch["filename"], batch["stem"], batch["ext"], strict=True):
                if f != family:
                    family, taken, following = f, set(), {}
                target = name
                if pd.isna(seq):
                    taken.add(name)
                    continue
                if target in taken:
                    k = following.get(name, 2)
                    while f"{stem}_{k}{ext}" in taken:
                        k += 1
                    target, following[name] = f"{stem}_{k}{ext}", k + 1
                taken.add(target)
                out.append((int(seq), name, target))
            yield pd.DataFrame(out, columns=["seq", "filename", "target"])

    hard = hard.repartition("family").sortWithinPartitions("family", F.col("seq").asc_nulls_first())
    return easy.unionByName(hard.mapInPandas(greedy, "seq long, filename string, target string"))
