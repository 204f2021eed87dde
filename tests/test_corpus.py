"""Corpus operators on literal inputs."""

import hashlib

from pyspark.sql import functions as F

from opsloom.functions import text as tx
from opsloom.functions import vectors as vx
from opsloom.operators import corpus as co
from opsloom.operators import embedding as em
from opsloom.operators.ordered import seconds_bucket


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).collect()[0]["x"]


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_clean_and_title(spark):
    assert one(spark, co.clean_text, "<!-- a\nb -->\n# T\n\n\n\nx<!-- c -->\n") == "# T\n\nx"
    df = rows(spark, "text string, path string", ("intro\n#  My Title \nx", "a/b.md"), ("no heading", "src/my-file_name.md"), ("x", "d/it's2go.tar.md"))
    got = [r.t for r in df.select(co.markdown_title("text", "path").alias("t")).collect()]
    assert got == ["My Title", "My File Name", "It'S2Go.Tar"]


def test_url_and_headers(spark):
    df = rows(spark, "p string", ("kb/src/network-services/SMB.md",), ("other/Read.Me.md",))
    assert [r.u for r in df.select(co.markdown_url("p").alias("u")).collect()] == ["https://book.hacktricks.xyz/network-services/smb", "https://book.hacktricks.xyz/read.me"]
    assert one(spark, co.markdown_headers, "# a\n## b \n### c\n#### d\n##e") == ["b", "c"]


def test_sections_edges(spark):
    body = lambda n: "x" * n
    text = f"intro {body(40)}\n## One\n{body(40)}\n### Two\n{body(29)}\n### Three\n{body(31)}"
    got = co.markdown_sections(rows(spark, "title string, text string", ("T", text))).orderBy("chunk_no").collect()
    # "### Two\n" + 29 is 37 characters and goes; "### Three\n" + 31 is 41 and stays.
    assert [r.title for r in got] == ["T", "T > One", "T > Three"]


def test_breadcrumbs_of_random_texts(spark):
    """Sections by headings, against a walk over the lines."""
    import random

    rng = random.Random(3)
    kinds = ["## A%d", "### B%d", "##   ", "###", "#### D%d", "text %d", "", "##x", "  ## no", "##\tC%d"]
    texts = ["\n".join(k % i if "%" in k else k for i, k in enumerate(rng.choice(kinds) for _ in range(rng.randint(0, 12)))) for _ in range(300)]

    def level(line):
        for marks in ("##", "###"):
            rest = line[len(marks) :]
            if line.startswith(marks) and rest[:1] in (" ", "\t") and rest.strip():
                return len(marks), rest.strip()
        return 0, ""

    def want(text):
        lines = text.split("\n")
        heads = [(i, *level(x)) for i, x in enumerate(lines) if level(x)[0]]
        while heads and heads[0][1] == 3:
            heads.pop(0)
        if not heads:
            return [("T", text)] if text.strip() else []
        starts = [h for k, h in enumerate(heads) if k == 0 or h[1] == 2 or heads[k - 1][1] == 3]
        out = []
        for k, (at, _, _) in enumerate(starts):
            stop = starts[k + 1][0] if k + 1 < len(starts) else len(lines)
            over = [h[2] for h in heads if h[0] <= at and h[1] == 2][-1]
            under = [h[2] for h in heads if at <= h[0] < stop and h[1] == 3]
            out.append((" > ".join(["T", over, *under]), "\n".join(lines[0 if k == 0 else at : stop])))
        return out

    df = spark.createDataFrame([(i, "T", t) for i, t in enumerate(texts)], "id int, title string, text string").repartition(4)
    got = {}
    for r in co.markdown_breadcrumbs(df, min_chars=1).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append((r.breadcrumb, r.content))
    for i, t in enumerate(texts):
        assert got.get(i, []) == want(t), t


def test_breadcrumbs_state(spark):
    pad = "y" * 60
    text = f"before {pad}\n## A\nintro {pad}\n### A1\none {pad}\n### A2\ntwo {pad}\n## B\n{pad}"
    got = co.markdown_breadcrumbs(rows(spark, "title string, text string", ("T", text))).orderBy("chunk_no").collect()
    assert [r.breadcrumb for r in got] == ["T > A > A1", "T > A > A2", "T > B"]
    assert got[0].content.startswith("before") and "intro" in got[0].content and "one" in got[0].content
    plain = co.markdown_breadcrumbs(rows(spark, "title string, text string", ("T", "### only h3\n" + pad), ("U", "short"))).collect()
    assert [(r.breadcrumb, r.content) for r in plain] == [("T", "### only h3\n" + pad)]
    h3_first = co.markdown_breadcrumbs(rows(spark, "title string, text string", ("T", f"### lost\n{pad}\n## A\n{pad}"))).collect()
    assert [r.breadcrumb for r in h3_first] == ["T > A"] and "lost" in h3_first[0].content


def test_chunk_sizes(spark):
    for n, want in ((0, []), (40, []), (41, [41]), (900, [900]), (1000, [1000, 100]), (1001, [1000, 101]), (2500, [1000, 1000, 700])):
        got = co.chunk_fixed(rows(spark, "text string", ("a" * n,))).orderBy("start").collect()
        assert [len(r.content) for r in got] == want, n
    small = co.chunk_fixed(rows(spark, "text string", ("".join(chr(97 + i % 26) for i in range(100)),)), size=30, overlap=20, min_chars=0).orderBy("start").collect()
    text = "".join(chr(97 + i % 26) for i in range(100))
    assert [(r.start, r.content) for r in small] == [(i, text[i : i + 30]) for i in range(0, 100, 10)]


def test_tags_and_key(spark):
    tags = one(spark, co.tag_map, "Web > HTTPS Reverse Shell")
    assert tags == {"service": "http", "category": "exploitation"}
    assert one(spark, co.tag_map, "Misc") == {"category": "general"}
    key = one(spark, lambda c: tx.content_key(F.lit("s"), F.lit(None).cast("string"), c), "body")
    assert key == hashlib.sha256(b"s||body").hexdigest()[:24]


def test_code_chunks(spark):
    df = rows(
        spark, "text string, path string",
        ("---\ntitle: Awk\n---\nx\n```sh\nrun\n```\n```\n\n```\nmore\n```\ntwo\n```", "a/awk.md"), ("no fence here", "a/tar.md"),
    )
    got = {(r.title, r.chunk_no): r for r in co.code_chunks(df).collect()}
    assert got[("Awk abuse", 0)].content == "Binary Name: Awk\nAbuse Code:\n```bash\nrun\n```"
    assert got[("Awk abuse", 1)].content.endswith("two\n```")
    assert got[("TAR abuse", 0)].content == "no fence here" and got[("TAR abuse", 0)].url.endswith("/tar/")


def test_field_chunks(spark):
    df = rows(spark, "payload string, path string", ('{"name":"Awk","code":[" a ","b"],"abuse":"c"}', "x/awk"), ('{"note":"n","list":["q"],"n2":"m"}', "x/tar.yml"))
    got = co.field_chunks(df).orderBy("title", "chunk_no").collect()
    assert [r.title for r in got] == ["AWK abuse"] * 3 + ["TAR abuse"]
    assert [r.content.split("```bash\n")[1][:1] for r in got[:3]] == ["c", "a", "b"]
    assert "note: n\nn2: m" in got[3].content


def test_walkthrough(spark):
    schema = "idx bigint, machine string, name string, videoId string, timestamp struct<minutes:int,seconds:int>, line string, tag string, academy string, title string, url string, link string"
    df = rows(spark, schema, (0, "HackTheBox - Cap", None, "abc123", (1, 30), "command injection in /ip", "web", None, None, None, None))
    r = co.normalise_walkthrough(df).collect()[0]
    assert (r.machine, r.phase, r.timestamp_seconds, r.title) == ("Cap", "user", 90, "walkthrough")
    assert r.url.endswith("watch?v=abc123&t=90s")
    w = co.row_windows(
        co.normalise_walkthrough(df), ["machine", "phase"], ["timestamp_seconds", "idx"], seconds_bucket("timestamp_seconds", 60), "line", "tag",
        first=["machine_raw", "title", "academy", "video_id", "url"],
    )
    doc = co.walkthrough_documents(w).collect()
    assert len(doc) == 1 and "phase: user" in doc[0].content and "line: - command injection in /ip" in doc[0].content


def test_row_window_stop_rule(spark):
    for n, starts in ((1, [0]), (4, [0]), (5, [0, 2]), (6, [0, 2]), (9, [0, 2, 4, 6])):
        df = rows(spark, "g int, timestamp_seconds bigint, idx int, line string, tag string", *[(1, i // 2, i, f"l{i}", f"t{i % 2}") for i in range(n)])
        got = co.row_windows(df, ["g"], ["timestamp_seconds", "idx"], seconds_bucket("timestamp_seconds", 2), "line", "tag").orderBy("window_start").collect()
        assert [r.window_start for r in got] == starts, n
        assert got[0].lines.split("\n") == [f"- l{i}" for i in range(min(n, 4))]


def test_image_and_code_helpers(spark):
    hits = rows(spark, "query_id int, rank int, url string, content string", (1, 1, "http://a/x", "none"), (1, 2, "https://a/P.PNG?z", ""), (1, 3, "", "(http://c/i.jpg)"), (2, 1, "", "see http://c/i.webp?a=1 x"))
    assert {(r.query_id, r.image_url) for r in co.image_url(hits).collect()} == {(1, "https://a/P.PNG?z"), (2, "http://c/i.webp?a=1")}
    assert one(spark, co.last_code_block, "```a\n1\n```\n```\n 2 \n```") == "2"
    assert one(spark, co.fence_commands, "do\n$ ls -la\nsudo nmap x\nend") == "do\n```bash\nls -la\nsudo nmap x\n```\nend"
    assert one(spark, co.fence_commands, " ") == "_No response yet._"


def test_page_text(spark):
    words = " ".join(f"w{i}" for i in range(200))
    html = f"<title>T &amp; U</title><nav>menu</nav><script>var a='</p>'</script><p>{words}</p><p>short one</p><footer>f</footer>"
    r = co.page_text(rows(spark, "url string, html string", ("u", html))).collect()[0]
    assert r.title == "T & U" and r.text == words and r.rag_source == "fit_markdown" and "menu" not in r.raw_text and "short one" in r.raw_text
    r = co.page_text(rows(spark, "url string, html string", ("u", "<p>tiny page</p>"))).collect()[0]
    assert (r.title, r.text, r.rag_source) == ("u", "tiny page", "raw_markdown")


def test_hash_embedding(spark):
    digest = hashlib.sha256(b"alpha").digest()
    got = one(spark, lambda c: vx.hash_embedding(c, 70), "alpha")
    assert len(got) == 70 and all(abs(g - (digest[i % 32] / 255 * 2 - 1)) < 1e-12 for i, g in enumerate(got))


def test_embedding_model_order_and_fallback(spark):
    def factory():
        def encode(texts):
            if len(texts) > 1:
                raise RuntimeError("no batches")
            if texts[0] == "bad":
                raise ValueError
            return [[3.0, 4.0]]

        return encode

    df = rows(spark, "i int, content string", (1, "alpha"), (2, "bad"), (3, "gamma"))
    got = {r.i: r.embedding for r in em.embed(df, dims=2, model_factory=factory).collect()}
    assert [round(x, 6) for x in got[1]] == [0.6, 0.8] and got[2] != got[1]
    stats = em.embedding_stats(em.try_embed(df.withColumn("source", F.lit("s")), factory)).collect()[0]
    assert (stats.total, stats.ingested, stats.failed) == (3, 2, 1)
    distinct = em.embed_distinct(df.union(df), dims=4)
    assert distinct.count() == 6
