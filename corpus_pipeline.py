"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. Stages are pure functions of their input; between them the rows are
written as Parquet in the shared folder, so a lost executor costs a stage at
most its own tasks. Documents keep their columns up to the last stage, whatever
other columns they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import jaccard_join, line_dedup, mixing, pieces, quality
from sluice.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that many documents share, and n_chars follows; a text that loses all its lines stays, empty."""
    columns = docs.columns
    kept = line_dedup.dedup_lines(docs, out="__kept").withColumn("text", F.col("__kept"))
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least id stays, of rows with one id that with the least hash of its text; of equal rows, one."""
    groups = jaccard_join.jaccard_groups(docs)
    # A text without words is linked with nothing and stays.
    rest = groups.where("component IS NOT NULL").select("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("row"))
    first = rest.groupBy("component").agg(F.min("row").alias("first"))
    gone = rest.join(first, "component").where("row <> first").select(F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash"))
    # The same plan at every size: what goes may be as large as the documents.
    kept = docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__hash"]), "left_anti")
    repeated = groups.groupBy("doc_id", "text_hash").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each epoch that its source reads; none of it is cut."""
    plan = mixing.mixing_plan(mixing.units_of(docs))
    return mixing.select_epochs(mixing.with_leaf(docs), plan).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled encodings: rows of (doc_id, sample, n_pieces, log_prob, inclusion, ids_sha256, round_trip, ids)."""
    return pieces.sampled_encodings(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each),
    ("mixing", mix),
    ("sentencepiece", encode),
]
#: The learned list and the samples are not SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
