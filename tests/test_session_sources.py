"""Sessions, readers and writers."""

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from opsloom.operators import corpus as co
from opsloom.operators import embedding as em
from opsloom.operators import transcript as tr
from opsloom.session import shared_folder
from opsloom.sources import readers, sinks


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


# ---------------------------------------------------------------- sessions
def test_prune_limits():
    assert tr.prune_limits(262144) == (int(262144 * 3 * 0.80), int(262144 * 3 * 0.60))
    assert tr.prune_limits(262144)[0] == 629145


def test_dedupe(spark):
    m = rows(spark, "conv_id int, turn int, role string, content string, reasoning_content string", (1, 0, "system", "A", None), (1, 1, "system", "A", None), (1, 2, "assistant", "", "r"), (1, 3, "assistant", None, "r"), (1, 4, "user", "u", None))
    got = tr.dedupe_messages(tr.number_turns(m, block=2), block_rows=2).orderBy("turn").collect()
    assert [r.turn for r in got] == [0, 2, 4]


def test_condense_and_prune(spark):
    roles = ["system", "user", "assistant", "summary", "user", "assistant"]
    t = rows(spark, "conv_id int, turn int, role string, text string", *[(1, i, r, "x" * 10) for i, r in enumerate(roles)], (2, 0, "user", "x"))
    n = tr.number_turns(t, block=2)
    got = {(r.conv_id, r.turn): r.part for r in tr.condense_split(n, window=3, block_rows=2).collect()}
    assert [got[(1, i)] for i in range(6)] == ["head"] * 5 + ["tail"] and got[(2, 0)] == "tail"
    gone = {(r.conv_id, r.turn): r.dropped for r in tr.budget_prune(n, 50, 35, block_rows=2).collect()}
    assert [gone[(1, i)] for i in range(6)] == [True, True, True, False, False, False] and not gone[(2, 0)]


def test_context_tokens_blank_ends(spark):
    for texts in (["  ab ", "cd"], [" ", "x" * 9, " \n"], [" ", "  "], ["", "a" * 7, "", "b", ""]):
        t = rows(spark, "conv_id int, turn int, role string, text string", *[(1, i, "user", x) for i, x in enumerate(texts)])
        want = len("\n".join(texts).strip()) // 4
        assert tr.context_tokens(t).first().context_tokens == want, texts


def test_state_and_thoughts(spark):
    ts = lambda d: dt.datetime(2024, 1, d)
    st = rows(spark, "machine string, updated_at timestamp, history array<string>, meter int", ("lame", ts(1), ["a"], 1), ("lame", ts(3), ["b"], 4), ("old", ts(1), ["c"], 2))
    new = tr.latest_state(st, now=F.lit(ts(9)))
    assert [(r.machine, r.history, r.meter) for r in new.collect()] == [("lame", ["b"], 4)]
    full = tr.with_defaults(rows(spark, "machine string", ("lame",), ("none",)), new, ["machine"], {"history": F.array().cast("array<string>"), "meter": F.lit(0)})
    assert {r.machine: (r.history, r.meter) for r in full.collect()} == {"lame": (["b"], 4), "none": ([], 0)}
    th = rows(spark, "machine string, seq int, thought string", *[("m", i, f"t{i:03d}") for i in range(70)], ("m", 99, " "))
    r = tr.thought_tail(th, chars=10).first()
    assert r.n_thoughts == 60 and r.buffer == "t068\n\nt069"


def test_request_key(spark):
    df = rows(spark, "e string, t double", ('{"b": 1, "a": "x"}', 0.7), ('{"a": "x", "b": 1}', 0.7), ('{"a": "x", "b": 2}', 0.7), ('{"a": "x", "b": 1}', 0.8))
    keys = [r.k for r in df.select(tr.request_key(F.lit("s"), F.lit("u"), F.lit("m"), F.col("t"), F.col("e")).alias("k")).collect()]
    extra = hashlib.sha256(json.dumps({"a": "x", "b": 1}, sort_keys=True).encode()).hexdigest()[:16]
    assert keys[0] == keys[1] == hashlib.sha256(f"s\nu\nm\n0.7\n{extra}".encode()).hexdigest() and len(set(keys)) == 3


def test_exact_repetition(spark):
    import difflib

    texts = ["Try the /ip page with id", "Try the /ip page with whoami", "Try the /ip page with whoami!", "other"]
    t = rows(spark, "conv_id int, turn int, role string, text string", *[(1, i, "assistant", x) for i, x in enumerate(texts)])
    got = tr.repetition(tr.number_turns(t, block=2), exact=True, block_rows=2).orderBy("turn").collect()
    want = [None] + [round(difflib.SequenceMatcher(None, a, b).ratio(), 6) for a, b in zip(texts, texts[1:])]
    assert [r.similarity for r in got] == want and [r.repetitive for r in got] == [False] + [w >= 0.9 for w in want[1:]]


def test_matching_blocks_against_brute_force():
    """Random pairs, short and beyond 200 characters, against the standard library's matcher."""
    import difflib
    import random

    from opsloom.functions.matching import block_ratio

    rng = random.Random(5)
    for _ in range(1_500):
        letters = rng.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz é😀.,"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([8, 60, 300]))))
        b = list(a) if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randint(0, 260))]
        for _ in range(rng.randint(0, 6)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(letters + "XY")
        assert block_ratio(a, "".join(b)) == difflib.SequenceMatcher(None, a, "".join(b)).ratio()
    assert block_ratio("", "") == 1.0 and block_ratio("a" * 20_000 + "x", "a" * 20_001) > 0.99


def test_advisories_and_entries_from_text(spark):
    files = rows(spark, "path string, text string", ("/a/cve-2021-7.json", '{"description": "d"}'), ("/a/cve-2021-8.json", "{broken"), ("/a/x.json", None), ("/a/cve-1.json", "{}"))
    assert {tuple(r) for r in readers.advisory_rows(files).select("cve_id", "description").collect()} == {("CVE-2021-7", "d"), ("CVE-1", None)}
    texts = rows(spark, "k int, text string", (1, ' [{"machine": "a"}, {"machine": "b"}]'), (2, '{"videos": [{"machine": "c"}]}'), (3, "no"), (4, None), (5, ""))
    got = readers.walkthrough_entries(texts).select("k", "idx", "machine").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_context_written_by_a_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "ctx", "cp"))
    schema = "machine string, updated_at timestamp, meter int"
    for day, meter in ((1, 1), (2, 5)):
        rows(spark, schema, ("lame", dt.datetime(2024, 1, day), meter)).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.foreachBatch(sinks.context_writer(out)).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.machine, r.meter) for r in tr.latest_state(spark.read.parquet(out).drop("batch_id")).collect()] == [("lame", 5)]
    # A replayed batch replaces itself.
    first = spark.read.parquet(out).filter("meter = 1").first().batch_id
    sinks.context_writer(out)(rows(spark, schema, ("lame", dt.datetime(2024, 1, 1), 1)), first)
    assert spark.read.parquet(out).count() == 2


# ---------------------------------------------------------------- readers
def test_registry_defaults(spark):
    df = rows(spark, "name string, type string, clone_url string, local_path string", ("a", None, "u", "p"), ("b", "privesc", "u", "p"))
    got = {r.name: (r["index"], r.type, r.parse_mode, r.content_glob) for r in readers.source_registry(df).collect()}
    assert got == {"a": ("a", "general", "markdown", "**/*.md"), "b": ("b", "privesc", "markdown", "**/*.md")}


def test_files_and_lossy_text(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "top.md").write_bytes(b"t")
    (tmp_path / "src" / "a.md").write_bytes(b"ok \xff\xfe end \xc3\xa9")
    (tmp_path / "src" / "deep" / "b.yml").write_bytes(b"y")
    rel = lambda p: sorted(r.rel for r in readers.read_files(spark, str(tmp_path), p).select("rel").collect())
    assert rel("**/*.md") == ["src/a.md"] and rel("*.md") == ["src/a.md", "top.md"] and rel("src/*.{md,yml}") == ["src/a.md", "src/deep/b.yml"] and rel("?op.[m]d") == ["top.md"]
    assert readers.read_texts(spark, str(tmp_path)).first().text == b"ok \xff\xfe end \xc3\xa9".decode("utf-8", "ignore")


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b": 1, "a": {"d": 2, "c": 3}}')
    (tmp_path / "b.LOG").write_text("x" * 24_001)
    (tmp_path / "c.md").write_text("no")
    (tmp_path / "d.json").write_text("{broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.json", "b.LOG"} and got["a.json"].body == '{"a":{"c":3,"d":2},"b":1}'
    assert got["b.LOG"].truncated and got["b.LOG"].body.endswith("[...truncated for context budget...]") and len(got["b.LOG"].body) == 24_000 + 38
    assert got["b.LOG"].whole == "x" * 24_001 and got["a.json"].whole == got["a.json"].body


def test_walkthrough_and_advisories(spark, tmp_path):
    entry = {"machine": "HackTheBox - Cap", "videoId": "v", "timestamp": {"minutes": 1, "seconds": 30}, "line": "l", "tag": "web"}
    (tmp_path / "list.json").write_text(json.dumps([entry, entry]))
    (tmp_path / "obj.json").write_text(json.dumps({"videos": [entry]}))
    assert readers.read_walkthrough(spark, str(tmp_path / "list.json")).count() == 2
    assert readers.read_walkthrough(spark, str(tmp_path / "obj.json")).first().timestamp.minutes == 1
    adv = tmp_path / "adv"
    adv.mkdir()
    (adv / "cve-2021-1.json").write_text('{"description": "d", "x": [1]}')
    assert readers.read_advisories(spark, str(adv)).select("cve_id", "description").collect() == [("CVE-2021-1", "d")]


def test_trace_metrics(spark, tmp_path):
    recs = [
        {"trace_id": "1", "provider": "p", "payload": {"usage": {"tokens_cached": 5, "total_tokens": 9}, "timings": {"total_ms": 12}}},
        {"trace_id": "2", "provider": "", "payload": {"usage": {"prompt_tokens_details": {"cached_tokens": 0}}, "latency_ms": 7}},
        {"trace_id": "3", "provider": "p", "payload": {"tokens_cached": 2, "provider": "q"}},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(r) for r in recs))
    got = {r.trace_id: (r.provider, r.latency_ms, r.tokens_cached, r.cache_hit) for r in readers.completion_metrics(readers.read_traces(spark, str(tmp_path / "t.jsonl"))).collect()}
    assert got == {"1": ("p", 12, 5, True), "2": ("unknown", 7, 0, False), "3": ("q", 0, 2, True)}


# ---------------------------------------------------------------- writers
def chunks(spark, index, *texts):
    df = rows(spark, "content string, chunk_no int", *[(t, i) for i, t in enumerate(texts)]).withColumn("index", F.lit(index)).withColumn("url", F.concat(F.lit("http://X.example/"), "content"))
    return em.embed(co.with_doc_key(df, "index"), dims=4)


def test_full_refresh_replaces_one_index(spark, tmp_path):
    path = str(tmp_path / "chunks")
    sinks.refresh_partitions(chunks(spark, "a", "one", "two"), path)
    sinks.refresh_partitions(chunks(spark, "b", "keep"), path)
    bad = chunks(spark, "a", "three", "three", "lost").withColumn("embedding", F.when(F.col("content") != "lost", F.col("embedding")))
    stats = sinks.refresh_partitions(bad, path)
    assert stats == {"total": 3, "failed": 1}
    assert sorted((r["index"], r.content) for r in spark.read.parquet(path).collect()) == [("a", "three"), ("b", "keep")]


def test_purge(spark, tmp_path):
    shared_folder(spark)
    path = str(tmp_path / "chunks")
    sinks.refresh_partitions(chunks(spark, "webcrawl", "one", "two"), path)
    sinks.refresh_partitions(chunks(spark, "other", "one"), path)
    assert sinks.rewrite_purged(spark, path, "x.EXAMPLE/one") == 1
    assert sorted((r["index"], r.content) for r in spark.read.parquet(path).collect()) == [("other", "one"), ("webcrawl", "two")]
    assert sinks.rewrite_purged(spark, path, "example") == 1
    assert [r["index"] for r in spark.read.parquet(path).collect()] == ["other"]


def test_ttl_upsert(spark, tmp_path):
    path = str(tmp_path / "ttl")
    write = lambda day, *t: sinks.append_upsert(sinks.with_ttl(chunks(spark, "a", *t).withColumn("updated_at", F.lit(dt.datetime(2024, 1, day)))), path)
    assert write(1, "x", "y") == {"total_chunks": 2, "ingested": 2, "failed": 0, "batches": 1}
    write(20, "x")
    now = F.lit(dt.datetime(2024, 2, 5))
    assert [r.content for r in sinks.read_upserts(spark, path, now=now).collect()] == ["x"]


def test_status_learnings_snapshot(spark, tmp_path):
    p = str(tmp_path / "sync")
    sinks.write_sync_status(rows(spark, "source string, index string, last_sync string, count bigint, failed bigint", ("a", "a", "2024-01-01", 1, 0), ("a", "a", "2024-01-02", 2, 0)), p)
    got = sinks.sync_status(rows(spark, "source string", ("a",), ("b",)), spark.read.parquet(p))
    assert {r.source: r.status for r in got.collect()} == {"a": "2024-01-02", "b": "never"}
    lp = str(tmp_path / "learn")
    at = dt.datetime(2024, 1, 1)
    sinks.append_learnings(rows(spark, "machine string, explanation string, created_at timestamp", ("m", " too short ", at), ("m", " a text of at least twenty ", at)), lp)
    r = spark.read.parquet(lp).collect()
    assert [x.explanation for x in r] == ["a text of at least twenty"] and (r[0].expires_at - at).days == 365
    turns = tr.number_turns(rows(spark, "machine string, turn int, role string, text string", ("m", 0, "user", "hi"), ("m", 1, "assistant", "```\nls\n```")), ["machine"])
    phased = rows(spark, "machine string, pos bigint, command string, phase string", ("m", 0, "nmap", "[RECON]"))
    sp = str(tmp_path / "snap")
    sinks.write_snapshot(tr.session_snapshot(turns, phased, rows(spark, "machine string, meter int", ("m", 3)), "exit"), sp)
    snap = {x.kind: json.loads(x.payload) for x in spark.read.json(sp).collect()}
    assert snap["head"] == {"reason": "exit", "phase": "[RECON]", "meter": 3, "last_code_block": "ls"}
    assert [e["text"] for e in snap["chat"]][0] == "hi" and snap["history"] == [{"command": "nmap"}]


def test_redaction(spark, tmp_path):
    payload = {"Token": "s", "n": {"list": [{"API_KEY": {"deep": 1}, "img": "data:image/png;base64,xx", "t": "y" * 300}], "x-api-key": 5, "ok": 1}}
    p = str(tmp_path / "trace")
    sinks.write_traces(rows(spark, "ts string, event string, trace_id string, provider string, machine string, payload string", ("t", "e", "1", "p", "m", json.dumps(payload))), p, max_chars=10)
    got = json.loads(spark.read.json(p).first().payload)
    item = got["n"]["list"][0]
    assert got["Token"] == "<redacted>" and item["API_KEY"] == "<redacted>" and got["n"]["x-api-key"] == "<redacted>" and got["n"]["ok"] == 1
    assert item["img"] == "<image-data-uri length=24>" and item["t"] == "y" * 256 + "...<truncated 44 chars>"


def test_request_key_tells_commas_in_texts_apart(spark):
    df = spark.createDataFrame([('{"k":"a,1"}',), ('{"k":"a, 1"}',), ('{ "k" : "a,1" }',)], "e string")
    keys = [r.k for r in df.select(tr.request_key(F.lit("s"), F.lit("u"), F.lit("m"), F.lit(0.5), F.col("e")).alias("k")).collect()]
    assert keys[0] != keys[1] and keys[0] == keys[2]


def test_redaction_survives_broken_json(spark):
    from opsloom.sources import sinks

    df = spark.createDataFrame([('{"token": "x", "a": 1}',), ("{broken",), (None,)], "p string")
    assert [r[0] for r in df.select(sinks.redact_json("p")).collect()] == ['{"token": "<redacted>", "a": 1}', "{broken", None]


def test_redaction_by_schema(spark):
    """The walk over the schema gives what the walk over the values gives."""
    schema = "Token string, n struct<list: array<struct<API_KEY: struct<deep: int>, img: string, t: string>>, ok: int, tags: map<string, string>>"
    full = {"Token": "s", "n": {"list": [{"API_KEY": {"deep": 1}, "img": "data:image/png;base64,xx", "t": "y" * 300}, {"t": ""}], "ok": 1, "tags": {"Authorization": "x", "b": "z" * 260}}}
    texts = [json.dumps(full), '{"n": {"list": []}}', "{}", "{broken", "data:image/png;base64,q", "w" * 300, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    got = df.select("i", sinks.redact_typed("p", schema, 10).alias("a"), sinks.redact_json("p", 10).alias("b")).orderBy("i").collect()
    for r in got:
        if r.i < 3:
            assert json.loads(r.a) == json.loads(r.b)
        else:
            assert r.a == r.b
    assert got[5].a.endswith("chars>") and got[7].a is None
