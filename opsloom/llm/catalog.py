"""Registered queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import centroids, dialogue, extraction, licences, packing, privacy, quality, repeats, simhash, sql, tiling, token_files, toxicity, warc
from opsloom.session import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.read(spark, folder, ids=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.features(table(spark, sf_dir, "documents")).drop("cleaned")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.resolved(warc.read(spark, folder))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find(table(spark, sf_dir, "documents"))
    every = F.concat("_base", F.transform("_terms", lambda t: F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"))))
    return found.select("doc_id", *(f"n_{k}" for k in privacy.KINDS), F.sha2(privacy.joined(F.col("_base")), 256).alias("base_sha256"), privacy.joined(every).alias("spans"))


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue.damaged(table(spark, sf_dir, "conversations"))
    return dialogue.digests(dialogue.repair(rows, copies="copies"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_simhash": (op1_simhash, None),
    "op2_licences": (op2_licences, sql.LICENCES),
    "op3_repeats": (op3_repeats, sql.REPEATS),
    "op4_token_files": (op4_token_files, None),
    "op5_decontamination": (op5_decontamination, None),
    "op6_quality": (op6_quality, sql.QUALITY),
    "op7_warc": (op7_warc, sql.WARC),
    "op8_packing": (op8_packing, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_privacy": (op10_privacy, sql.PRIVACY),
    "op11_dialogue": (op11_dialogue, sql.DIALOGUE),
    "op12_centroids": (op12_centroids, sql.CENTROIDS),
    "op13_extraction": (op13_extraction, sql.EXTRACTION),
}
