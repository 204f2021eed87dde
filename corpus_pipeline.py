"""From documents to training sequences: five stages, each written as Parquet and read again as the next one's documents.

A null or empty text passes the first four stages like any other document.  What goes is decided by row, by its number in the table that a stage
reads: a clean row with a null or repeated doc_id stays, and of rows equal in doc_id and text one stays.  Columns beyond those of ``documents`` are
dropped by the first stage.  Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import packing, privacy, simhash, tiling, toxicity
from opsloom.session import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``_n``, the number of the row.  A stage reads a written table, whose rows have the same numbers each time."""
    return docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_n"))


def _ordered(docs: DataFrame) -> DataFrame:
    """_row and text; _row sorts by doc_id (null last), then by the text's SHA-256, then by number."""
    sha = F.coalesce(F.sha2("text", 256), F.lit(""))
    return _numbered(docs).select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), sha.alias("sha"), "_n").alias("_row"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``gone`` has the numbers of rows that go; few as a rule, so that Spark sends them to the documents."""
    return _numbered(docs).join(gone.distinct(), "_n", "left_anti").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the classifier, trained on the labelled rows among ``docs``, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    return _without(docs, toxicity.score(_numbered(docs), model, key="_n").filter("predicted = 1").select("_n"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id, null last, then the smallest SHA-256 of its text."""
    groups = simhash.near_duplicates(_ordered(docs), key="_row")
    return _without(docs, groups.filter(F.col("_row") != F.col("component_id")).select("_row._n"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold most of a benchmark item, in whatever order."""
    found = tiling.contaminated(_numbered(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_n")
    return _without(docs, found.select(F.col("doc_id").alias("_n")))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, disclosing terms removed or generalised; ``n_chars`` follows the new text.  Every document stays."""
    # Texts are rewritten where they are found; the other columns are met again by the row's number.
    found = privacy.find(_numbered(docs), key="_n").filter((F.size("_base") > 0) | (F.size("_terms") > 0))
    met = _numbered(docs).join(found.select("_n", privacy.sanitised(found).alias("_new")), "_n", "left")
    changed = F.col("_new").isNotNull()
    return met.select("doc_id", F.coalesce("_new", "text").alias("text"), "lang", "source", F.when(changed, F.length("_new").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", privacy_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, the fingerprints, the tiling and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
