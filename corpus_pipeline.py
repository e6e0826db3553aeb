"""The corpus pipeline: documents go through the stages in order, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`docs`. Decisions: the quality classifier drops what it predicts as label 0; language ID drops what has
no letter or no clear language; of each group of near duplicates (five-word shingles, Jaccard 0.8) the
row of least id stays (null ids after all others, ties by a hash of the text); mixing puts rows into the order of the Pfair schedule, which the written files
keep; packing forms batches in that order. Nulls, empty texts and repeated rows are handled as each
operator's text says; deduplication decides by row, so ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import jaccard, language, mixing, packing, quality
from docloom.llm.common import fresh, table, written
from docloom.operators.ranks import CHUNK_ROWS, spread_join


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of the documents at hand; keep what is predicted as label 1."""
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents' own languages; keep rows of known and clear language."""
    return language.kept(docs, language.train(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the least id. Rows are told apart by a key of their own, written down first."""
    own, tie = fresh(docs, "_own"), fresh(docs, "_tie")
    keyed = docs.withColumn(own, F.col("doc_id")).withColumn(tie, F.xxhash64("text")).withColumn("doc_id", F.monotonically_increasing_id())
    keyed = written(keyed, "keyed")
    found = jaccard.join(keyed, links=False).select(F.col("doc_id").alias("_k"), "component_id")
    ids = keyed.select("doc_id", F.struct(F.col(own).isNull().alias("a"), F.col(own).alias("b"), F.col(tie).alias("c"), F.col("doc_id").alias("d")).alias("_o"))
    found = written(found.join(ids, F.col("_k") == F.col("doc_id")).select("component_id", "_o"), "components")
    groups = found.groupBy(F.col("component_id").alias("_c")).agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("_first")).where("n > 1").select("_c", F.col("_first.d").alias("_first"))
    copies = spread_join(found.select("component_id", F.col("_o.d").alias("id")), groups, "component_id", "_c", ["id"]).where("id <> _first").select("id")
    return jaccard.without(keyed, copies).withColumn("doc_id", F.col(own)).drop(own, tie)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the schedule."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the rows in the order in which the stage before has written them: by file, then by row.

    Writers number their files, so shorter names come first and equally long ones by their letters. The
    list of files is as long as that of the stage's tasks, which the driver holds anyway.
    """
    origin = docs.metadataColumn("_metadata")  # not a column of the rows, should they have one of that name
    path, row = origin["file_path"], origin["row_index"]
    files = sorted((r.path for r in docs.select(path.alias("path")).distinct().collect()), key=lambda x: (len(x), x))
    known = spark.createDataFrame([(x, i) for i, x in enumerate(files)], "_path string, _file long")
    rows = docs.select("doc_id", "text", path.alias("_at"), row.alias("_row")).join(F.broadcast(known), F.col("_at") == F.col("_path"))
    chunk = F.col("_file") * (1 << 24) + F.floor(F.col("_row") / CHUNK_ROWS)
    return packing.packed(rows, chunk=chunk, order=[F.col("_file"), F.col("_row")])


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Learned classifiers and the schedule aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; what goes between them is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
