"""The corpus pipeline: five stages, each on all that the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
are written and read again between calls. A row's key is its doc_id with a fingerprint of its columns, so rows that
repeat a doc_id with another text, and rows without doc_id, are decided each on their own; rows equal in every column are
one document to the stages that remove copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from alphaloom.llm.common import SharedTables

#: A generative label model, iterated components, balanced draws and packing are beyond SQL; the tests hold each stage and
#: the whole run against plain versions.
ORACLE_SQL = None

ROW = "_row_print"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the fingerprint of each row."""
    return docs.withColumn(ROW, F.xxhash64(*docs.columns))


def _emit(docs: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """Each marked row `copies` times. marks: doc_id, the fingerprint, copies, times (how many equal rows docs has)."""
    marks = SharedTables(docs.sparkSession, name).save(marks.select(F.col("doc_id").alias("_id"), F.col(ROW).alias("_print"), "copies", "times"))
    keyed = _keyed(docs)
    met = keyed.join(marks, keyed["doc_id"].eqNullSafe(marks["_id"]) & (keyed[ROW] == marks["_print"]))
    if not marks.filter("times > 1").isEmpty():  # equal rows become one, before the shuffle where they meet in a task
        met = met.filter("times = 1").unionByName(met.filter("times > 1").dropDuplicates(["doc_id", ROW]))
    if not marks.filter("copies > 1").isEmpty():
        met = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return met.select(docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose text is predicted to be toxic, by the labels of sf_dir; rows without doc_id are judged too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = _keyed(docs)
    scored = toxicity.score_toxicity(keyed, labels, keep=(ROW,))
    rejected = scored.filter("predicted = 1").select(F.col("doc_id").alias("_id"), F.col(ROW).alias("_print")).distinct()
    return keyed.join(rejected, keyed["doc_id"].eqNullSafe(rejected["_id"]) & (keyed[ROW] == rejected["_print"]), "left_anti").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for blanks: the one with the smallest doc_id."""
    groups = exact_dedup.exact_groups(_keyed(docs), keep=(ROW,))
    marks = groups.groupBy("doc_id", ROW).agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("times"))
    return _emit(docs, marks.filter("stays").withColumn("copies", F.lit(1)), "exact-stage")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest doc_id. Rows without doc_id are compared under a fingerprint."""
    keyed = docs.withColumn("_id", F.col("doc_id")).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no doc_id"), *docs.columns)))
    joined = ngram_join.near_duplicates(keyed).filter("NOT kept").select(F.col("doc_id").alias("_out"), F.col("print").alias("_print")).distinct()
    stay = keyed.join(joined, (keyed["doc_id"] == joined["_out"]) & F.xxhash64("text").eqNullSafe(joined["_print"]), "left_anti")
    stay = SharedTables(spark, "near-stage").save(stay.withColumn("doc_id", F.col("_id")).select(docs.columns))
    again = _keyed(stay).groupBy("doc_id", ROW).agg(F.count(F.lit(1)).alias("times"))
    if again.filter("times > 1").isEmpty():
        return stay
    return _emit(stay, again.withColumn("copies", F.lit(1)), "near-stage")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; equal rows share the copies drawn for them."""
    drawn = mixing.mix(_keyed(docs), keep=(ROW,))
    marks = drawn.groupBy("doc_id", ROW).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("times"))
    return _emit(docs, marks.filter("copies > 0"), "mix-stage")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 2048 tokens, with its place in a sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    tables = SharedTables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = tables.save(out)
    return out
