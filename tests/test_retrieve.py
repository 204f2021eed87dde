"""Retrieval operators on literal inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.functions import text as tx
from opsloom.operators import knn as nn
from opsloom.operators import ranking as ra
from opsloom.operators import retrieval as re_


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).collect()[0]["x"]


def test_query_terms(spark):
    assert one(spark, tx.query_terms, "Find /usr/bin/aa-exec a 7z find") == ["find", "usr", "bin", "aa", "exec", "usrbinaaexec", "7z"]
    assert len(one(spark, tx.query_terms, " ".join(f"word{i}" for i in range(30)))) == 12


def test_canonical_and_variants(spark):
    assert one(spark, tx.canonical_machine, " HackTheBox - Cap_2! ") == "cap 2"
    assert one(spark, re_.machine_variants, "lame box") == ["HackTheBox - Lame Box", "HackTheBox - LameBox", "Lame Box", "LameBox"]
    assert one(spark, re_.machine_variants, " ") == []


def test_lexical_prefix_and_rank(spark):
    docs = rows(spark, "doc_id int, index string, title string, content string", (1, "a", "nmap", "scan ports"), (2, "a", "x", "nmapping the scanner"), (3, "a", "y", "none"), (4, "b", "z", "superlongtokenvalue"))
    q = rows(spark, "query_id int, text string", (1, "nmap scan"), (2, "superlongtokenvalue extra"), (3, "supper"))
    got = {(r.query_id, r.doc_id): r.matched for r in re_.lexical_hits(q, docs, 5).collect()}
    assert got == {(1, 1): 2, (1, 2): 2, (2, 4): 1}


def test_target_postfilter_and_diversity(spark):
    hits = rows(spark, "query_id int, machine string, index string, rank int", (1, "monitor", "s", 1), (1, "HackTheBox - Cap", "s", 2), (1, "cap", "t", 3), (2, "x", "s", 1))
    t = rows(spark, "query_id int, target string", (1, "cap"), (2, "cap"))
    kept = re_.prefer_target(hits, t)
    assert {(r.query_id, r.machine) for r in kept.collect()} == {(1, "HackTheBox - Cap"), (1, "cap"), (2, "x")}
    many = rows(spark, "query_id int, index string, rank int", *[(1, "ab"[i > 3], i) for i in range(6)])
    assert [(r.rank, r.slot) for r in ra.diverse_topk(many, 3).orderBy("slot").collect()] == [(0, 1), (4, 2), (1, 3)]


def test_source_filter_alias(spark):
    assert one(spark, re_.source_filter_of, "find suid Only gtfobs") == "gtfobins"
    assert one(spark, re_.source_filter_of, "only nothing") is None


def test_similarity_and_budget(spark):
    h = rows(spark, "query_id int, distance double", (1, 0.5), (1, 0.1), (1, 0.3))
    s = ra.similarity_stats(h).collect()[0]
    assert s.best_similarity == 0.9 and s.top_similarity == [0.9, 0.7, 0.5] and s.confident
    b = lambda *costs: rows(spark, "query_id int, rank int, distance double, token_cost int, priority int", *[(1, i, 0.1 * i, c, 0) for i, c in enumerate(costs)])
    assert sorted(r.rank for r in ra.budget_trim(b(600, 900, 500, 200), 1500).collect()) == [0, 1]
    assert sorted(r.rank for r in ra.budget_trim(b(2000, 100), 1500).collect()) == [0]
    assert sorted(r.rank for r in ra.budget_trim(b(1000, 900, 500), 1500).collect()) == [0, 2]
    assert ra.budget_trim(b(2000, 100), 0).count() == 2


def test_tiers(spark):
    q = rows(spark, "query_id int", (1,), (2,), (3,))
    h = rows(spark, "query_id int, distance double, rank int, doc_id int", (1, 0.9, 1, 10), (2, 0.2, 1, 20))
    w = rows(spark, "query_id int, web_rank int, title string, url string, content string, snippet string", (1, 1, "t", "u1", "", "s" * 400), (1, 2, "t", "", "", ""), (2, 1, "t", "u2", "c", ""), (3, 1, "t", "u3", "", ""))
    web = ra.normalise_web(w)
    assert {r.url: len(r.snippet) for r in web.collect()} == {"u1": 300, "u2": 1, "u3": 0}
    tier = lambda **o: {(r.query_id, r.ref) for r in ra.tiered_fallback(q, h, web, **o).filter("tier = 'web'").collect()}
    assert tier(threshold=0.7) == {(1, "u1"), (3, "u3")}
    assert tier(threshold=0.9) == {(1, "u1"), (2, "u2"), (3, "u3")}
    assert tier(force=True) == {(1, "u1"), (2, "u2"), (3, "u3")} and tier(allow=False) == set()


def test_summary(spark):
    text = "phase: user\nline: - got shell\ntag: web\nvideo_id: v\ntimestamp_seconds: 5\nmachine: cap\nurl: http://x"
    got = one(spark, ra.snippet_summary, text)
    assert got == "- phase: user - line: - got shell - tag: web - video id: v - machine: cap"
    assert one(spark, ra.snippet_summary, "just prose\nmore") == "- note: just prose"
    assert one(spark, ra.snippet_summary, ":x") == "- note: :x"


def test_shown_and_cve(spark):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1, h)
    shown = rows(spark, "machine string, turn int, shown_at timestamp, source string, fingerprint string", ("m", 1, at(1), "a", "f1"), ("m", 2, at(2), "a", "f2"), ("m", 3, at(3), "b", "f3"), ("m", 4, at(4), "a", "f4"), ("n", 1, at(0), "a", "g"))
    now = F.lit(at(9))
    assert {(r.machine, r.fingerprint) for r in ra.recent_fingerprints(shown, now).collect()} == {("m", "f2"), ("m", "f3"), ("m", "f4")}
    assert one(spark, ra.cve_ids, "cve-2021-4444 x CVE-2021-44228, CVE-2021-4444 CVE-21-1") == ["CVE-2021-44228", "CVE-2021-4444"]


def test_knn_paths_agree(spark):
    rng = np.random.default_rng(3)
    data = [(i, "ab"[i % 2], rng.normal(size=8).tolist()) for i in range(300)] + [(900, "a", []), (901, "b", [0.0] * 8), (902, "a", [1.0])]
    c = rows(spark, "doc_id int, index string, embedding array<double>", *data)
    q = rows(spark, "query_id int, embedding array<double>", *[(i, data[i][2]) for i in range(7)])
    scan = {(r.query_id, r.doc_id, r.rank) for r in nn.knn(q, c, 4).collect()}
    blocks = {(r.query_id, r.doc_id, r.rank) for r in nn.knn(q, c, 4, pivots=5, block_queries=3, tile_bytes=900, first_look=1).collect()}
    assert scan == blocks and len(scan) == 7 * 2 * 4
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in data if len(v) == 8 and any(v)}
    want = sorted((round(1 - float(unit[0] @ unit[i]), 6), i) for i in unit if i % 2 == 0 and i < 900)[:4]
    assert [d for _, d in want] == [d for _, d in sorted((r, d) for q_, d, r in scan if q_ == 0 and d % 2 == 0 and d < 900)]


def test_recall(spark):
    q = rows(spark, "query_id int, text string, exclude_machine string", (1, "The exploit path traversal", "lame"))
    l = rows(spark, "learning_id int, machine string, explanation string", (1, "cap", "Used PATH traversal exploits"), (2, "lame", "exploit"), (3, "x", "an exploit"), (4, "x", "nope"))
    assert [(r.learning_id, r.score) for r in ra.recall_overlap(q, l).orderBy("rank").collect()] == [(1, 3), (3, 1)]


def test_knn_is_exact_on_near_ties_and_odd_vectors(spark):
    """Ranks unrounded distances; null, empty, zero and broken vectors, null indexes, repeated vectors; few tiles are looked at."""
    c = rows(spark, "doc_id int, index string, embedding array<double>", (1, "a", [1.0, 0.0005]), (2, "a", [1.0, 0.0]), (3, "a", None), (4, "a", []), (5, None, [0.0, 1.0]), (6, None, [0.0, 0.0]), (7, "a", [float("nan"), 1.0]), (0, "a", [2.0, 0.0]))
    q = rows(spark, "query_id int, embedding array<double>", (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]))
    got = {}
    for r in nn.knn(q, c, 3).orderBy("rank").collect():
        got.setdefault((r.query_id, r["index"]), []).append((r.doc_id, r.distance))
    assert got[(1, "a")] == [(0, 0.0), (2, 0.0), (1, 0.0)] and got[(1, None)] == [(5, 1.0), (6, 1.0)]
    assert got[(2, "a")] == got[(3, "a")] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    near = [(i, "x", (centres[i % 12] + rng.normal(size=16) * 0.02).tolist()) for i in range(1200)]
    visits: list = []
    out = nn.knn(rows(spark, "query_id int, embedding array<double>", *[(i, near[i][2]) for i in range(12)]), rows(spark, "doc_id int, index string, embedding array<double>", *near), 5, pivots=24, tile_bytes=4000, first_look=2, visits=visits).collect()
    unit = np.array([v for _, _, v in near]) / np.linalg.norm([v for _, _, v in near], axis=1)[:, None]
    for i in range(12):
        assert [r.doc_id for r in sorted((r for r in out if r.query_id == i), key=lambda r: r.rank)] == np.argsort(1 - unit @ unit[i], kind="stable")[:5].tolist()
    assert visits[0] < visits[1] / 3


def test_knn_predicate_per_query(spark):
    c = rows(spark, "doc_id int, index string, embedding array<double>, machine string", *[(i, "x", [1.0, i / 10], f"m{i % 3}") for i in range(30)])
    q = rows(spark, "query_id int, embedding array<double>, machine string", (1, [1.0, 0.0], None), (2, [1.0, 0.0], "m2"), (3, [1.0, 0.0], "none"))
    got = [(r.query_id, r.doc_id) for r in nn.knn(q, c, 3, machine="machine", only="machine", pivots=3, tile_bytes=200, first_look=1).orderBy("query_id", "rank").collect()]
    assert got == [(1, 0), (1, 1), (1, 2), (2, 2), (2, 5), (2, 8)]


def test_lexical_threshold_search(spark):
    """Against plain counting, with a word in every document, many queries, repeated and null keys, and small blocks."""
    import random

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, rng.choice(["a", "b", None]), "common", " ".join(rng.choices(vocabulary, k=4))) for i in range(200)]
    docs.append((3, docs[3][1], "again", "w1 zebra"))  # a repeated key is one document
    queries = [(j, " ".join(["common", *rng.choices(vocabulary, k=3)])) for j in range(60)] + [(100, "common"), (101, "zeb"), (102, "nothing-of-it"), (103, ""), (104, None)]
    want = {}
    for j, text in queries:
        terms = {t for tok in (text or "").split() if len(tok) >= 2 for t in [*tok.split("-"), tok.replace("-", "")] if len(t) >= 2}
        best = {}
        for i, index, title, content in docs:
            words = (title + " " + content).split()
            best.setdefault((index, i), set()).update(t for t in terms if any(w.startswith(t) for w in words))
        for index in ("a", "b", None):
            ranked = sorted((-len(m), i) for (x, i), m in best.items() if x == index and m)[:4]
            want |= {(j, index, r + 1): (i, -m) for r, (m, i) in enumerate(ranked)}
    d = rows(spark, "doc_id int, index string, title string, content string", *docs)
    q = rows(spark, "query_id int, text string", *queries)
    for size, first in ((7, 1), (2048, 4)):
        found = re_.search_index(q, *re_.build_index(d, block_docs=size), 4, first_look=first).collect()
        assert {(r.query_id, r["index"], r.rank): (r.doc_id, r.matched) for r in found} == want


def test_recall_reads_long_texts_once(spark):
    """Characters in words, null and excluded machines, several automata; eight texts of 20,000 characters in an instant."""
    import random
    import time

    import pyarrow as pa

    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(4, 9))) for _ in range(20_000)})
    texts = ["".join(rng.choices("abcdefgh ", k=20_000)) for _ in range(8)] + ["a" * 20_000]
    batch = pa.RecordBatch.from_pydict({"learning_id": list(range(9)), "machine": ["m"] * 9, "_low": texts})
    begin = time.perf_counter()
    got = {(r["learning_id"], r["_w"]) for b in ra._holds(words)(iter([batch])) for r in b.to_pylist()}
    assert time.perf_counter() - begin < 2
    assert got == {(i, w) for i, t in enumerate(texts) for w in words if w in t}
    q = rows(spark, "query_id int, text string, exclude_machine string", (1, "Alpha beta gamma abc", None), (2, "ALPHA delta", "m"), (3, "", ""), (4, None, ""))
    l = rows(spark, "learning_id int, machine string, explanation string", (1, "m", "xalphax BETAs"), (2, None, "delta alphabet"), (3, "n", "abc"), (4, "n", None))
    for most in (200_000, 1):
        assert sorted((r.query_id, r.learning_id, r.score) for r in ra.recall_overlap(q, l, block_words=most).collect()) == [(1, 1, 2), (1, 2, 1), (2, 2, 2)]


def test_index_is_written_word_by_word():
    """A block of many words: no row holds it whole, its bits are right, and bits of a term are joined over batches."""
    import random

    import pyarrow as pa

    rng = random.Random(6)
    texts = [sorted({f"w{rng.randrange(60_000)}" for _ in range(400)}) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 300), pa.array(range(300), pa.int64()), pa.array(texts)], names=["index", "doc_id", "words"])
    part = type("Context", (), {"partitionId": lambda self: 2})()
    was, re_.TaskContext.get = re_.TaskContext.get, staticmethod(lambda: part)
    try:
        made = list(re_._index_blocks(2048)(iter([batch.slice(0, 130), batch.slice(130)])))
    finally:
        re_.TaskContext.get = was
    assert max(b.nbytes / b.num_rows for b in made) < 20_000 and max(b.num_rows for b in made) <= 4_194_304 // 300
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["docs"] for r in rows if r["word"] is None] == [list(range(300))] and len({r["block"] for r in rows}) == 1
    got = {(r["word"], i) for r in rows if r["word"] is not None for i in range(300) if r["bits"][i // 8] >> i % 8 & 1}
    assert got == {(w, i) for i, t in enumerate(texts) for w in t}

    own = [(b, t, bytes([1 << n % 8] * (1 + b % 2))) for b in range(3) for t in "xy" for n in range(b + 3)]
    rows = pa.RecordBatch.from_pylist([dict(zip(("block", "term", "bits"), r)) for r in own])
    for size in (1, 4, 50):
        out = [tuple(r.values()) for b in re_._any_bits(rows.slice(k, size) for k in range(0, len(own), size)) for r in b.to_pylist()]
        assert sorted(out) == [(b, t, bytes([2 ** (b + 3) - 1] * (1 + b % 2))) for b in range(3) for t in "xy"]
    rng.shuffle(own)
    some = [r for b in re_._some_bits(iter([pa.RecordBatch.from_pylist([dict(zip(("block", "term", "bits"), r)) for r in own])])) for r in b.to_pylist()]
    assert len(some) == 6


def test_tiles_grow_with_the_index(spark):
    """Pairs of a query and a tile grow with the queries, not with queries times vectors; the hits are those of brute force."""
    import random

    rng = random.Random(8)
    looked = []
    for n in (400, 1600):
        c = [(i, "a", [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]
        q = rows(spark, "query_id int, embedding array<double>", *[(i, v) for i, _, v in c[::40]])
        visits: list = []
        got = {(r.query_id, r.rank): r.doc_id for r in nn.knn(q, rows(spark, "doc_id int, index string, embedding array<double>", *c), 3, pivots=2, tile_bytes=200, first_look=1, visits=visits).collect()}
        v = np.array([x for _, _, x in c])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        x = 1 - v[::40] @ v.T
        assert got == {(c[::40][j][0], r + 1): int(d) for j in range(len(x)) for r, d in enumerate(np.argsort(x[j], kind="stable")[:3])}
        looked.append(visits[1] / len(x))
    assert looked[1] <= nn.TILES + 4
    assert nn.tile_bytes_of(8_000, 2_000, 10, 64) == 8_000 and nn.tile_bytes_of(8_000, 10**9, 10, 64) == nn.TILE_BYTES


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """Ranges of documents are sampled before texts are cut into words, not after."""
    calls, cut = spark.sparkContext.accumulator(0), F.udf(lambda t: calls.add(1) or sorted(set(t.split())), "array<string>")
    monkeypatch.setattr(re_.tx, "index_tokens", lambda c: cut(c))
    docs = spark.createDataFrame([(n, "i", "t", f"word{n} all") for n in range(40)], "doc_id long, index string, title string, content string")
    postings, blocks = re_.build_index(docs.repartition(3), block_docs=16)
    assert calls.value == 40
    assert postings.count() == 40 + 2 * blocks.count()


def test_terms_are_looked_up_in_turns(spark, monkeypatch):
    """Few terms at a time give the same hits, also where a word begins with several terms and a term begins several words of a block."""
    docs = spark.createDataFrame([(n, "i", "", f"alpha{n} alp beta{n % 3} gam{n % 5} gamma") for n in range(50)], "doc_id long, index string, title string, content string")
    queries = spark.createDataFrame([(1, "al alp alpha1 beta gamma"), (2, "gam1 beta2 nothing"), (3, "zz")], "query_id long, text string")
    index = re_.build_index(docs, block_docs=8)
    whole = sorted(map(tuple, re_.search_index(queries, *index, 7).collect()))
    words = {n: [f"alpha{n}", "alp", f"beta{n % 3}", f"gam{n % 5}", "gamma"] for n in range(50)}
    want = []
    for q, terms in ((1, ["al", "alp", "alpha1", "beta", "gamma"]), (2, ["gam1", "beta2", "nothing"])):
        found = sorted((-sum(any(w.startswith(t) for w in own) for t in terms), n) for n, own in words.items())
        want += [(q, n, -m, r + 1) for r, (m, n) in enumerate([x for x in found if x[0]][:7])]
    assert sorted((q, n, m, r) for q, _, n, _, m, r in whole) == sorted(want)
    monkeypatch.setattr(re_, "TERMS_AT_ONCE", 2)
    assert sorted(map(tuple, re_.search_index(queries, *index, 7).collect())) == whole


def test_a_block_of_long_documents_is_short():
    """A block ends when it holds many words, so a task's memory does not grow with the length of documents; all words keep their places."""
    import pyarrow as pa

    texts = [[f"w{(i * 7 + j) % 9000}" for j in range(5000)] for i in range(500)]
    pieces = [(i, t[k : k + 64]) for i, t in enumerate(texts) for k in range(0, len(t), 64)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * len(pieces)), pa.array([i for i, _ in pieces], pa.int64()), pa.array([p for _, p in pieces])], names=["index", "doc_id", "words"])
    part = type("Context", (), {"partitionId": lambda self: 0})()
    was, re_.TaskContext.get = re_.TaskContext.get, staticmethod(lambda: part)
    try:
        made = list(re_._index_blocks(2048)(batch.slice(k, 10_000) for k in range(0, len(batch), 10_000)))
    finally:
        re_.TaskContext.get = was
    docs = {b["block"][0].as_py(): b["docs"][0].as_py() for b in made if b["docs"].null_count == 0}
    assert sum(docs.values(), []) == list(range(500)) and max(len(d) for d in docs.values()) * 5000 <= re_.BLOCK_WORDS + 5000
    bits = sum(int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for b in made for x in b["bits"].to_pylist() if x is not None)
    assert bits == sum(len(t) for t in texts)


def test_a_folder_of_many_files_is_not_dealt_anew(spark, tmp_path):
    """As many files as cores are read as they lie; fewer are spread over the cores."""
    from opsloom.session import spread

    cores = spark.sparkContext.defaultParallelism
    for n, more in ((cores, 0), (1, 1)):
        path = str(tmp_path / str(n))
        spark.range(10 * cores, numPartitions=n).write.parquet(path)
        got = spread(spark.read.parquet(path))
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == more and got.count() == 10 * cores


def test_hits_meet_documents_in_their_scan(spark, monkeypatch):
    """Texts of documents that no query hit are not exchanged, however small Spark's own limit for broadcasts is."""
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('s', id % 2) AS index", "'m' AS machine", "'t' AS title", "concat('nmap ', id) AS content", "concat('k', id) AS doc_key")
    hits = rows(spark, "query_id int, index string, doc_id long", (1, "s1", 3), (2, "s1", 3), (1, "s0", 8), (1, "s0", 9))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ra.hit_features(docs, hits, also=["doc_key"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        near = sorted((r.doc_id, r.doc_key, tuple(r.tokens)) for r in found.collect())
        assert near == [(3, "k3", ("t", "m", "nmap", "3")), (8, "k8", ("t", "m", "nmap", "8"))]
        monkeypatch.setattr(ra, "HIT_KEYS", 1)
        assert near == sorted((r.doc_id, r.doc_key, tuple(r.tokens)) for r in ra.hit_features(docs, hits, also=["doc_key"]).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_long_texts_reach_the_scorer_whole_and_few_at_a_time(spark):
    def picky():
        def score(queries, texts):
            if sum(len(t or "") for t in texts) > 20_000_000:
                raise MemoryError
            return [len(q) + len(t or "") for q, t in zip(queries, texts)]

        return score

    hits = spark.range(0, 3000, 1, 1).selectExpr("id", "concat('q', id) AS query", "CASE id WHEN 7 THEN '' ELSE repeat('aé\\n', 5000 + id) END AS content", "-1.0D AS lexical")
    short = ra.cross_score(hits, picky, whole=False)
    assert short.columns == ["id", "query", "lexical", "rerank_score"]
    assert {r.id: r.rerank_score for r in short.collect()} == {i: len(f"q{i}") + (0 if i == 7 else 3 * (5000 + i)) for i in range(3000)}
    some = hits.filter("id IN (0, 5, 7)").withColumn("content", F.when(F.col("id") != 5, F.col("content")))
    cut = ra.cross_score(some, picky, chars=10)
    assert cut.columns == ["id", "query", "content", "lexical", "rerank_score"]
    assert {r.id: (r.rerank_score, None if r.content is None else len(r.content)) for r in cut.collect()} == {0: (12.0, 15000), 5: (2.0, None), 7: (2.0, 0)}


def test_tiles_let_out_only_what_can_be_among_the_best():
    """A tile meets all queries of a block at once; nothing beyond a query's limit leaves it, ties go by document."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    units = rng.normal(size=(300, 8))
    units[7] = units[3] = units[250]
    units /= np.linalg.norm(units, axis=1)[:, None]
    docs = rng.permutation(300)
    machines = [f"m{i % 3}" for i in range(300)]
    tiles = pa.table({"tile": [5], "index": ["a"], "size": pa.array([8], pa.int32()), "docs": [docs.tolist()], "machines": [machines], "units": pa.array([units.tobytes()], pa.binary())})
    own = [units[3].tolist(), *rng.normal(size=(40, 8)).tolist(), [0.0] * 8, [1.0]]
    q = list(range(len(own)))
    limit = [None if i % 2 else 0.3 for i in q[:-2]] + [None, 0.5]
    machine = ["m1" if i % 5 == 4 else None for i in q]
    asked = pa.table({"q": q, "vector": pa.array(own, pa.list_(pa.float64())), "machine": pa.array(machine, pa.string()), "tiles": pa.array([[{"tile": 5, "limit": x}] for x in limit], pa.list_(pa.struct([("tile", pa.int64()), ("limit", pa.float64())])))})
    got = {}
    for r in nn._best(4)(tiles, asked).to_pylist():
        got.setdefault(r["q"], []).append((r["doc_id"], round(r["distance"], 9)))
    for i in q:
        v = np.array(own[i])
        odd = len(v) != 8 or not v.any()
        x = np.ones(300) if odd else 1 - units @ (v / np.linalg.norm(v))
        all_ = sorted((round(float(x[j]), 9), int(docs[j])) for j in range(300) if machine[i] in (None, machines[j]))[:4]
        want = [(d, e) for e, d in all_ if limit[i] is None or e <= limit[i]]
        assert sorted(got.get(i, [])) == sorted(want), i


@pytest.mark.parametrize("held", [0, nn.BLOCK_BYTES])
def test_knn_blocks_of_any_size_agree(spark, monkeypatch, held):
    """Blocks of three queries, and all queries as one block: as many equal vectors as never fit among the best."""
    monkeypatch.setattr(nn, "BLOCK_BYTES", held)
    assert nn.block_of(3, 20, 8) == (20 if held else 3) and nn.block_of(3, 10**9, 8) < 10**9
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 8))
    v[50:120] = v[50]
    v /= np.linalg.norm(v, axis=1)[:, None]
    c = rows(spark, "doc_id int, index string, embedding array<double>", *[(i, "ab"[i % 2], v[i].tolist()) for i in range(200)])
    q = rows(spark, "query_id int, embedding array<double>", *[(i, v[i * 10].tolist()) for i in range(20)])
    got = {}
    for r in nn.knn(q, c, 5, pivots=4, block_queries=3, tile_bytes=800, first_look=1).collect():
        got.setdefault((r.query_id, r["index"]), []).append((r.rank, r.doc_id))
    for i in range(20):
        for j, name in enumerate("ab"):
            x = 1 - (v * v[i * 10]).sum(axis=1)
            want = sorted(range(j, 200, 2), key=lambda d: (x[d], d))[:5]
            assert [d for _, d in sorted(got[(i, name)])] == want
