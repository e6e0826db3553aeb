"""Ranks and running sums within keys, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a ranking task is meant to hold at a time, and pieces whose totals are summed up at a time.
CHUNK_ROWS = 1024


def plain_unions(spark: SparkSession) -> None:
    """Let unions claim no partitioning of their own.

    Spark 4.1 takes a union to be dealt by a key if both sides are. When adaptive execution has since turned a
    side's join into a broadcast one, that no longer holds, yet the exchange above the union is left out: rows
    of one key end up in several tasks. Callers that deal out a union by a key turn the claim off first.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ranked(df: DataFrame, key: str, chunk: Column, order: list[Column], out: str, size: Column | None = None) -> DataFrame:
    """Rank from 0 of each row within its key, or with `size` the sum of sizes before it, without one task per key.

    `chunk` (a whole number) cuts each key into pieces of bounded size, in the order wanted of the
    ranks. Rows are numbered inside (key, chunk); the pieces' totals are summed up in two levels of
    small windows, so that neither the rows nor the pieces of one hot key meet in one task. The
    totals are dealt as the rows already are, so the rows are shuffled once. Keys mustn't be null.
    """
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = df.withColumn("_chunk", chunk).withColumn("_size", size if size is not None else F.lit(1).cast("long"))
    rows = base.withColumn("_in", before("_size", Window.partitionBy(key, "_chunk").orderBy(*order)))
    counts = base.groupBy(key, "_chunk").agg(F.sum("_size").alias("_n")).withColumn("_group", F.floor(F.col("_chunk") / CHUNK_ROWS))
    groups = counts.groupBy(key, "_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select(F.col(key).alias("_gk"), F.col("_group").alias("_gg"), before("_n", Window.partitionBy(key).orderBy("_group")).alias("_far"))
    near = counts.select(key, "_chunk", "_group", before("_n", Window.partitionBy(key, "_group").orderBy("_chunk")).alias("_near"))
    offsets = near.join(groups, (F.col(key) == F.col("_gk")) & (F.col("_group") == F.col("_gg")))
    offsets = offsets.select(F.col(key).alias("_ok"), F.col("_chunk").alias("_oc"), (F.col("_near") + F.col("_far")).alias("_off"))
    joined = rows.join(offsets, (F.col(key) == F.col("_ok")) & (F.col("_chunk") == F.col("_oc")))
    return joined.withColumn(out, (F.col("_off") + F.col("_in")).cast("long")).drop("_chunk", "_size", "_in", "_ok", "_oc", "_off")


def count_upto(rows: DataFrame, bounds: list, value: Column, out: str) -> DataFrame:
    """The rows with the number of bounds (rising) that are at most the value, by halving."""
    known = F.array(*[F.lit(b) for b in bounds])
    rows = rows.withColumn(out, F.lit(0))
    for k in reversed(range(len(bounds).bit_length())):
        rows = rows.withColumn(out, F.col(out) + F.when(F.get(known, F.col(out) + ((1 << k) - 1)) <= value, 1 << k).otherwise(0))
    return rows


def shared(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows behind one exchange, which all branches of a plan that use them share.

    Rows travel whole, so that branches that need fewer columns don't get exchanges of their own: each is
    the only element of an array, as the optimiser prunes the fields of a struct also below an exchange.
    """
    row = F.element_at("_row", 1)
    packed = df.select(F.array(F.struct(*df.columns)).alias("_row"))
    return packed.repartition(*[row[k] for k in keys]).select(*[row[c].alias(c) for c in df.columns])


def spread_join(rows: DataFrame, keyed: DataFrame, left: str, right: str, by: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Join rows with a table of one row per key where one key may hold a large share of the rows.

    A table that was just aggregated by its key is dealt by it already, and adaptive execution can't
    split a join that rests on that. So rows also get a salt out of the columns `by`, and the table's
    rows go once to each salt: a hot key spreads over as many tasks at once, and both sides are dealt
    anew for this join alone, which adaptive execution may split further. The salt is never null, so that
    no filter for that is inferred, which would be evaluated again below every exchange.
    """
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"), F.lit(0)))
    keyed = keyed.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(keyed, (F.col(left) == F.col(right)) & (F.col("_salt") == F.col("_salted")), how).drop("_salt", "_salted", right)
