"""The pipeline's stages on a small table: decisions, columns, nulls and empty input."""

import os

import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "some words of mine", "en", "s", 18)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(cp.COLUMNS), name
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert None in kept and len(kept & {10**6, 10**6 + 1}) == 1 and before * 0.5 < len(kept) < before + 3
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_one_of_equal_rows_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs = docs.unionByName(spark.createDataFrame([(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1)], docs.schema))
    assert [r.doc_id for r in cp.simhash_stage(spark, docs, SF).collect()] == [1]


def test_rows_without_a_key_of_their_own(spark):
    """A row that goes takes no clean row with the same or no doc_id along, and one text of each group stays."""
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    table = lambda *rows: none.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], none.schema))
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) > 15)
    assert left(cp.decontamination_stage(spark, table((None, item), (None, "clean"), (None, None), (7, item), (7, "clean too")), SF)) == [(7, "clean too"), (None, "clean"), (None, None)]
    a, b = "one two three four five six seven", "ONE TWO three four five six seven"
    kept = left(cp.simhash_stage(spark, table((None, a), (None, b), (None, "another text of its own words")), SF))
    assert len(kept) == 2 and (None, "another text of its own words") in kept
    kept = left(cp.simhash_stage(spark, table((3, a), (3, b), (None, a), (3, "another text of its own words")), SF))
    assert len(kept) == 2 and (3, "another text of its own words") in kept and all(i == 3 for i, _ in kept)
