"""Registered corpus queries: (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom import rules
from opsloom.functions import text as tx
from opsloom.functions import vectors as vx
from opsloom.operators import corpus as co
from opsloom.operators import embedding as em
from opsloom.plans import views as v
from opsloom.session import new_path
from opsloom.sources import readers, sinks, tables


# ---------------------------------------------------------------- text and chunks
def clean_text(spark, sf):
    # Each text gets a comment and a run of blank lines, so that the rule has work to do.
    raw = F.concat(F.lit("\n <!-- a\nb --> "), "text", F.lit("\n\n\n\nend <!--x-->\n"))
    d = v.table(spark, sf, "documents").select("doc_id", co.clean_text(raw).alias("c"))
    return d.select("doc_id", F.length("c").cast("long").alias("n_chars"), F.sha2("c", 256).alias("text_hash"))


SQL_CLEAN = f"""SELECT doc_id, length(c) AS n_chars, sha256(c) AS text_hash FROM (
 SELECT doc_id, {v.sql_strip("regexp_replace(regexp_replace(concat(chr(10), ' <!-- a', chr(10), 'b --> ', text, chr(10), chr(10), chr(10), chr(10), 'end <!--x-->', chr(10)), '(?s)<!--.*?-->', '', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS c FROM documents)"""


def chunk_fixed(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", "text")
    return co.chunk_fixed(d).select("doc_id", "start", F.sha2("content", 256).alias("content_hash"), F.length("content").cast("long").alias("n_chars"))


SQL_CHUNKS = f"""chunks AS (SELECT doc_id, start, c AS content FROM (
 SELECT doc_id, start, {v.sql_strip(f"substr(t, start + 1, {rules.CHUNK_SIZE})")} AS c FROM (
  SELECT doc_id, t, unnest(range(0, length(t), {rules.CHUNK_SIZE - rules.CHUNK_OVERLAP})) AS start FROM (SELECT doc_id, {v.sql_strip('text')} AS t FROM documents)))
 WHERE length(c) > {rules.CHUNK_MIN_CHARS})"""


def content_key(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat(F.lit("u/"), "doc_id").alias("url"), "text")
    keyed = co.with_doc_key(co.chunk_fixed(d), "source", "lang", "url")
    narrow = keyed.withColumn("short_key", tx.content_key("lang", "source", chars=16)).select("doc_id", "start", "doc_key", "short_key")
    return narrow


SQL_KEY = f"""WITH {SQL_CHUNKS} SELECT c.doc_id, start, left(sha256(concat(source, '|', lang, '|u/', c.doc_id, '|', content)), 24) AS doc_key,
 left(sha256(concat(lang, '|', source)), 16) AS short_key FROM chunks c JOIN documents d USING (doc_id)"""


def corpus_dedup(spark, sf):
    """Copies (same source and leading text) keep the latest write."""
    d = co.with_doc_key(v.table(spark, sf, "documents").withColumnRenamed("text", "content"), "source")
    return co.distinct_by_key(d.select("doc_key", "source", "doc_id"), "doc_key", ["doc_id"])


SQL_DEDUP = """SELECT left(sha256(concat(source, '|', text)), 24) AS doc_key, any_value(source) AS source, max(doc_id) AS doc_id FROM documents GROUP BY 1"""


def tag_rules(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", co.tag_map("text").alias("t"))
    return d.select("doc_id", F.coalesce(F.col("t")["service"], F.lit("")).alias("service"), F.col("t")["category"].alias("category"), co.flat_tags("t").alias("tags"))


_low = "lower(text)"
SQL_TAGS = f"""SELECT doc_id, service, category, concat('category:', category, CASE WHEN service <> '' THEN concat(',service:', service) ELSE '' END) AS tags FROM (
 SELECT doc_id, {v.sql_group(_low, [(s, (s,)) for s in rules.SERVICE_TAGS], '')} AS service,
 {v.sql_group(_low, rules.CATEGORY_TAGS, rules.CATEGORY_DEFAULT)} AS category FROM documents)"""


def page_text(spark, sf):
    p = co.page_text(v.table(spark, sf, "pages"))
    return p.select("page_id", "title", "rag_source", F.length("raw_text").cast("long").alias("raw_chars"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


def _sql_pages() -> str:
    c = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in (*rules.PAGE_DROP_TAGS, "title"):
        c = f"regexp_replace({c}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}>', ' ', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '(?i)</(?:p|div|li|h[1-6]|td|tr|section|article|title)>|<br\\s*/?>', chr(10), 'g')"
    def unescape(x):
        for e, p in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            x = f"replace({x}, {v.sq(e)}, {v.sq(p)})"
        return x
    bare = unescape(f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')")
    squeeze = lambda x: v.sql_strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")
    return f"""WITH b AS (SELECT page_id, url, html, list_filter(list_transform(string_split({bare}, chr(10)), lambda x: {squeeze('x')}), lambda x: x <> '') AS blocks FROM pages),
t AS (SELECT page_id, url, {squeeze(unescape("regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1)"))} AS ti, array_to_string(blocks, chr(10)) AS raw,
 coalesce(array_to_string(list_filter(blocks, lambda x: len(string_split(x, ' ')) >= {rules.PAGE_MIN_WORDS}), chr(10)), '') AS fit FROM b),
u AS (SELECT page_id, CASE WHEN ti <> '' THEN ti ELSE url END AS title, raw, fit, CASE WHEN length(fit) > {rules.PAGE_FIT_MIN_CHARS} THEN fit ELSE raw END AS text FROM t)
SELECT page_id, title, CASE WHEN text = fit THEN 'fit_markdown' ELSE 'raw_markdown' END AS rag_source, length(raw) AS raw_chars, length(text) AS n_chars, sha256(text) AS text_hash FROM u"""


def row_windows(spark, sf):
    ev = v.table(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr(f"CAST({v.SECONDS} AS BIGINT)").alias("timestamp_seconds"), F.concat(F.lit("k"), F.expr(v._K)).alias("tag"))
    ev = ev.withColumn("line", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")))
    w = co.row_windows(
        ev, ["user_id", "event_type"], ["timestamp_seconds", "event_id"], F.floor(F.col("timestamp_seconds") / 86400).cast("long"), "line", "tag", first=["event_id"]
    )
    return w.select("user_id", "event_type", "window_start", F.col("event_id").alias("first_event"), "min_ts", "max_ts", "n_rows", "tags", "lines")


SQL_WINDOWS = f"""WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) // 1000000 AS s, concat('k', {v._K}) AS tag, concat(event_type, ' ', event_id) AS line FROM events),
r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY s, event_id)),
x AS (SELECT user_id, event_type, n, unnest(range(0, n, {rules.ROW_STRIDE})) AS st FROM (SELECT DISTINCT user_id, event_type, n FROM r)),
k AS (SELECT user_id, event_type, st FROM x WHERE st = 0 OR st - {rules.ROW_STRIDE} + {rules.ROW_WINDOW} < n)
SELECT k.user_id, k.event_type, st AS window_start, arg_min(event_id, pos) AS first_event, min(s) AS min_ts, max(s) AS max_ts, count(*) AS n_rows,
 string_agg(DISTINCT tag, ', ' ORDER BY tag) AS tags, string_agg(concat('- ', line), chr(10) ORDER BY pos) AS lines
FROM k JOIN r ON r.user_id = k.user_id AND r.event_type = k.event_type AND pos >= st AND pos < st + {rules.ROW_WINDOW} GROUP BY 1, 2, 3"""


# ---------------------------------------------------------------- markdown
def _titled(spark, sf):
    m = v.markdown(spark, sf).withColumn("path", F.concat(F.lit("src/"), "source", F.lit("/Doc-"), F.col("doc_id").cast("string"), F.lit(".md")))
    return m.withColumn("title", co.markdown_title("text", "path"))


def md_title(spark, sf):
    m = _titled(spark, sf)
    stem = co.markdown_title(F.regexp_replace("text", "^# ", ""), F.col("path"))
    return m.select("doc_id", "title", stem.alias("stem_title"))


SQL_MD_TITLE = "SELECT doc_id, concat('Doc ', doc_id) AS title, concat('Doc ', doc_id) AS stem_title FROM documents"


def md_url(spark, sf):
    m = _titled(spark, sf)
    return m.select("doc_id", co.markdown_url("path").alias("url"))


SQL_MD_URL = "SELECT doc_id, concat('https://book.hacktricks.xyz/', lower(source), '/doc-', doc_id) AS url FROM documents"


def md_headers(spark, sf):
    m = v.markdown(spark, sf).select("doc_id", co.markdown_headers("text").alias("h"))
    return m.select("doc_id", F.size("h").cast("long").alias("n_headers"), F.sha2(F.array_join("h", "\n"), 256).alias("headers_hash"))


_MD_LINES = f"""{v.SQL_MARKDOWN},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM markdown)"""
SQL_MD_HEADERS = f"""WITH {_MD_LINES},
h AS (SELECT doc_id, n, {v.sql_strip("regexp_extract(line, '^#{2,3}\\s+(.+)$', 1)")} AS h FROM l WHERE regexp_matches(line, '^#{{2,3}}\\s+.+$'))
SELECT d.doc_id, count(h.n) AS n_headers, sha256(coalesce(string_agg(h, chr(10) ORDER BY n), '')) AS headers_hash FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1"""


def md_sections(spark, sf):
    s = co.markdown_sections(_titled(spark, sf).select("doc_id", "title", "text"))
    return s.select("doc_id", "chunk_no", "title", F.sha2("content", 256).alias("content_hash"))


SQL_MD_SECTIONS = f"""WITH {v.SQL_MARKDOWN}, c AS (SELECT doc_id, {v.sql_strip("regexp_replace(text, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM markdown),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM c),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{2,3}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM l),
s AS (SELECT doc_id, sec, {v.sql_strip("string_agg(line, chr(10) ORDER BY n)")} AS body FROM g GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS chunk_no,
 concat('Doc ', doc_id, CASE WHEN sec > 0 THEN concat(' > ', {v.sql_strip("regexp_extract(body, '^#{2,3}\\s+([^\\n]+)', 1)")}) ELSE '' END) AS title,
 sha256(body) AS content_hash FROM s WHERE length(body) >= {rules.SECTION_MIN_CHARS}"""


def md_breadcrumbs(spark, sf):
    s = co.markdown_breadcrumbs(_titled(spark, sf).select("doc_id", "title", co.clean_text("text").alias("text")))
    return s.select("doc_id", "chunk_no", "breadcrumb", F.sha2("content", 256).alias("content_hash"))


# A heading line starts a section when it is an H2 after the first H2, or an H3 after another H3 of the same H2.
SQL_MD_CRUMBS = f"""WITH {v.SQL_MARKDOWN}, c AS (SELECT doc_id, {v.sql_strip("regexp_replace(text, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM markdown),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM c),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^##\\s+.+$') THEN {v.sql_strip("substr(line, 3)")} END AS h2, CASE WHEN regexp_matches(line, '^###\\s+.+$') THEN {v.sql_strip("substr(line, 4)")} END AS h3 FROM l),
a AS (SELECT *, count(h2) OVER (PARTITION BY doc_id ORDER BY n) AS n2, max(CASE WHEN h2 IS NOT NULL THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS at2 FROM h),
b AS (SELECT *, count(h3) OVER (PARTITION BY doc_id, n2 ORDER BY n) AS n3 FROM a),
f AS (SELECT *, CASE WHEN (h2 IS NOT NULL AND n2 > 1) OR (h3 IS NOT NULL AND n2 > 0 AND n3 > 1) THEN 1 ELSE 0 END AS cut FROM b),
g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM f),
s AS (SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY n) AS body, arg_max(h2, n) FILTER (WHERE h2 IS NOT NULL) AS h2, max(n2) AS n2,
 arg_max(h3, n) FILTER (WHERE h3 IS NOT NULL AND n2 > 0) AS h3 FROM g GROUP BY 1, 2),
p AS (SELECT *, max(h2) OVER (PARTITION BY doc_id, n2) AS hh2 FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS chunk_no, concat_ws(' > ', concat('Doc ', doc_id), CASE WHEN n2 > 0 THEN hh2 END, h3) AS breadcrumb,
 sha256(body) AS content_hash FROM p WHERE length({v.sql_strip('body')}) >= {rules.BREADCRUMB_MIN_CHARS}"""


def code_chunks(spark, sf):
    fence = F.concat(F.lit("---\ntitle: T"), F.col("doc_id") % 5, F.lit("\n---\n"), F.regexp_replace("text", "\n([A-F][^\n]*)\n", "\n```sh\n$1\n```\n"))
    d = v.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("x/bin"), F.col("doc_id") % 7, F.lit(".md")).alias("path"), fence.alias("text"))
    return co.code_chunks(d).select("doc_id", "chunk_no", "title", "url", F.sha2("content", 256).alias("content_hash"))


SQL_CODE = f"""WITH d AS (SELECT doc_id, concat('T', doc_id % 5) AS nm, concat('https://gtfobins.github.io/gtfobins/bin', doc_id % 7, '/') AS url,
 regexp_replace(text, '\\n([A-F][^\\n]*)\\n', concat(chr(10), '```sh', chr(10), '\\1', chr(10), '```', chr(10)), 'g') AS body FROM documents),
f AS (SELECT doc_id, nm, url, body, regexp_extract_all(body, '(?s)```(?:[a-zA-Z0-9_+-]+)?\\n(.*?)```', 1) AS bl FROM d),
u AS (SELECT doc_id, nm, url, {v.sql_strip('b')} AS b, i FROM (SELECT doc_id, nm, url, unnest(bl) AS b, generate_subscripts(bl, 1) AS i FROM f)),
a AS (SELECT doc_id, nm, url, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, concat('Binary Name: ', nm, chr(10), 'Abuse Code:', chr(10), '```bash', chr(10), b, chr(10), '```') AS content FROM u WHERE b <> ''
 UNION ALL SELECT doc_id, nm, url, 0, c FROM (SELECT doc_id, nm, url, {v.sql_strip("regexp_replace(body, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS c FROM f WHERE len(bl) = 0) WHERE c <> '')
SELECT doc_id, chunk_no, concat(nm, ' abuse') AS title, url, sha256(content) AS content_hash FROM a"""


def field_chunks(spark, sf):
    body = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("bin"), "source").alias("name"), F.array("lang", "source").alias("code"), F.col("lang").alias("abuse")))).when(
        F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.col("source").alias("binary"), F.concat(F.lit(" "), "lang").alias("commands")))
    ).otherwise(F.to_json(F.struct(F.col("lang").alias("note"), F.lit("x").alias("other"))))
    d = v.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("y/stem"), F.col("doc_id") % 4).alias("path"), body.alias("payload"))
    return co.field_chunks(d).select("doc_id", "chunk_no", "title", "url", "content")


def _entry(name: str, code: str) -> str:
    return f"concat('Binary Name: ', upper({name}), chr(10), 'Abuse Code:', chr(10), '```bash', chr(10), {code}, chr(10), '```')"


SQL_FIELDS = f"""WITH e AS (
 SELECT doc_id, concat('bin', source) AS nm, unnest([lang, lang, source]) AS code, unnest([0, 1, 2]) AS chunk_no FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT doc_id, source, lang, 0 FROM documents WHERE doc_id % 3 = 1
 UNION ALL SELECT doc_id, concat('stem', doc_id % 4), concat('note: ', lang, chr(10), 'other: x'), 0 FROM documents WHERE doc_id % 3 = 2)
SELECT doc_id, chunk_no, concat(upper(nm), ' abuse') AS title, concat('https://gtfobins.github.io/gtfobins/', lower(nm), '/') AS url, {_entry('nm', 'code')} AS content FROM e"""


def last_code(spark, sf):
    m = v.table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\n([^\n]*)\n", "\n```py\n$1\n```\n").alias("t"))
    return m.select("conv_id", "turn", F.coalesce(co.last_code_block("t"), F.lit("")).alias("last_code"))


SQL_LAST_CODE = f"""WITH m AS (SELECT conv_id, turn, regexp_replace(text, '\\n([^\\n]*)\\n', concat(chr(10), '```py', chr(10), '\\1', chr(10), '```', chr(10)), 'g') AS t FROM conversations)
SELECT conv_id, turn, coalesce({v.sql_strip("regexp_extract_all(t, '(?s)```(?:[a-zA-Z0-9_+-]+)?\\n(.*?)```', 1)[-1]")}, '') AS last_code FROM m"""


def fence_commands(spark, sf):
    """Command runs of every machine-hour fenced."""
    c = v.commands(spark, sf)
    text = F.concat(F.lit("try this\n$ "), "command", F.lit("\nls -la\nthen stop"))
    return c.select("seq", co.fence_commands(text).alias("fenced"))


_CMD_RE = r"^(?:\$\s*)?(?:sudo\s+)?(?:" + "|".join(rules.PROBABLE_COMMANDS) + r")\b"
SQL_FENCE = f"""WITH {v.SQL_COMMANDS} SELECT seq, CASE WHEN regexp_matches(concat('$ ', command), {v.sq(_CMD_RE)})
 THEN concat('try this', chr(10), '```bash', chr(10), command, chr(10), 'ls -la', chr(10), '```', chr(10), 'then stop')
 ELSE concat('try this', chr(10), '$ ', command, chr(10), '```bash', chr(10), 'ls -la', chr(10), '```', chr(10), 'then stop') END AS fenced FROM commands"""


def image_url(spark, sf):
    p = v.table(spark, sf, "pages")
    hits = p.select(
        (F.col("page_id") % 50).alias("query_id"), F.col("page_id").alias("rank"),
        F.when(F.col("page_id") % 5 == 4, F.concat(F.lit("https://i.example/p"), "page_id", F.lit(".PNG?x=1"))).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("see (https://c.example/q"), "page_id", F.lit(".jpg?w=2) and more"))).otherwise(F.lit("none")).alias("content"),
    )
    return co.image_url(hits)


SQL_IMAGE = """SELECT query_id, arg_min(img, page_id) AS image_url FROM (SELECT page_id % 50 AS query_id, page_id,
 CASE WHEN page_id % 5 = 4 THEN concat('https://i.example/p', page_id, '.PNG?x=1') WHEN page_id % 3 = 0 THEN concat('https://c.example/q', page_id, '.jpg?w=2') END AS img FROM pages) WHERE img IS NOT NULL GROUP BY 1"""


def walkthrough_norm(spark, sf):
    ev = v.table(spark, sf, "events")
    k = F.expr(v._K)
    raw = ev.select(
        F.col("event_id").alias("idx"),
        F.concat(F.when(k % 2 == 0, "HackTheBox - ").otherwise(" "), F.lit("Box  "), "user_id").alias("machine"), F.lit(None).cast("string").alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("v"), k)).otherwise("").alias("videoId"),
        F.struct((k - 5).cast("int").alias("minutes"), (k % 60).cast("int").alias("seconds")).alias("timestamp"),
        F.concat("event_type", F.when(k % 4 == 0, " with sudo").when(k % 4 == 1, " Reverse Shell ").otherwise(" nmap")).alias("line"),
        F.col("event_type").alias("tag"), F.lit("").alias("academy"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("url"),
        F.when(k % 3 == 1, F.lit("http://l")).alias("link"),
    )
    return co.normalise_walkthrough(raw).select("idx", "machine", "title", "url", "line", "timestamp_seconds", "phase")


SQL_WALK = f"""SELECT event_id AS idx, concat('Box ', user_id) AS machine, 'walkthrough' AS title,
 CASE WHEN k % 3 = 1 THEN 'http://l' WHEN k % 3 = 0 THEN concat('https://www.youtube.com/watch?v=v', k, '&t=', s, 's') ELSE '' END AS url,
 concat(event_type, CASE k % 4 WHEN 0 THEN ' with sudo' WHEN 1 THEN ' Reverse Shell' ELSE ' nmap' END) AS line, s AS timestamp_seconds,
 CASE k % 4 WHEN 0 THEN 'root' WHEN 1 THEN 'user' ELSE 'recon' END AS phase
FROM (SELECT *, greatest(0, (k - 5) * 60 + k % 60) AS s FROM (SELECT event_id, user_id, event_type, {v._K} AS k FROM events))"""


# ---------------------------------------------------------------- embedding
def hash_embed(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", vx.hash_embedding("text", 80).alias("e"))
    return d.select("doc_id", F.size("e").cast("long").alias("dims"), *[F.round(F.get("e", F.lit(i)), 6).alias(f"e{i}") for i in (0, 31, 32, 79)])


SQL_HASH = f"""SELECT doc_id, len(e) AS dims, round(e[1], 6) AS e0, round(e[32], 6) AS e31, round(e[33], 6) AS e32, round(e[80], 6) AS e79
 FROM (SELECT doc_id, CAST({v.sql_hash_vector('text', 80)} AS DOUBLE[]) AS e FROM documents)"""


def embed_distinct(spark, sf):
    d = em.embed_distinct(v.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), dims=64)
    return d.select("doc_id", F.round(F.get("embedding", F.lit(0)), 6).alias("e0"), F.round(F.get("embedding", F.lit(63)), 6).alias("e63"))


SQL_EMBED_DISTINCT = f"""SELECT doc_id, round(e[1], 6) AS e0, round(e[64], 6) AS e63 FROM (SELECT doc_id, CAST({v.sql_hash_vector('text', 64)} AS DOUBLE[]) AS e FROM documents)"""


def letter_model():
    """A stand-in model: counts of a few letters; refuses texts that hold a token assignment."""

    def encode(texts):
        if any("token = " in t for t in texts):
            raise ValueError("refused")
        return [[1.0 + t.count(c) for c in "aeio"] for t in texts]

    return encode


def embed_udf(spark, sf):
    """Failed rows per source with a model that refuses some texts."""
    d = v.table(spark, sf, "documents").select("source", F.col("text").alias("content"))
    return em.embedding_stats(em.try_embed(d, letter_model), ["source"])


SQL_EMBED_UDF = """SELECT source, count(*) AS total, count(*) FILTER (WHERE NOT contains(text, 'token = ')) AS ingested, count(*) FILTER (WHERE contains(text, 'token = ')) AS failed FROM documents GROUP BY 1"""


# ---------------------------------------------------------------- sources and sinks
def src_text(spark, sf):
    """Bytes with an invalid one in front, decoded by dropping and by replacing."""
    raw = F.concat(F.unhex(F.lit("41FF42")), F.col("text").cast("binary"))
    d = v.table(spark, sf, "documents").select("doc_id", raw.alias("b"))
    return d.select("doc_id", F.sha2(readers.lossy_text("b"), 256).alias("text_hash"), F.length(readers.replaced_text("b")).cast("long").alias("n_replaced"))


SQL_SRC_TEXT = "SELECT doc_id, sha256('AB' || text) AS text_hash, length(text) + 3 AS n_replaced FROM documents"


def walkthrough_scan(spark, sf):
    """Two entries per document, from texts with a list of entries and texts with an object that holds them."""
    entry = F.to_json(F.struct(
        F.concat(F.lit("HackTheBox - "), "source").alias("machine"), F.concat(F.lit("v"), "doc_id").alias("videoId"),
        F.struct((F.col("doc_id") % 90).cast("int").alias("minutes"), (F.col("doc_id") % 60).cast("int").alias("seconds")).alias("timestamp"),
        F.col("text").alias("line"), F.col("lang").alias("tag"),
    ))
    entries = F.concat(F.lit(" ["), entry, F.lit(', {"machine": "m", "line": null}]'))
    d = v.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, entries).otherwise(F.concat(F.lit('{"videos":'), entries, F.lit("}"))).alias("text"))
    return readers.walkthrough_entries(d).select("doc_id", "idx", "machine", F.coalesce("videoId", F.lit("")).alias("video"), F.coalesce(F.expr("timestamp.minutes * 60 + timestamp.seconds").cast("long"), F.lit(-1)).alias("at"), F.sha2(F.coalesce("line", F.lit("")), 256).alias("line_hash"), F.coalesce("tag", F.lit("")).alias("tag"))


SQL_WALKTHROUGH = """SELECT doc_id, 0 AS idx, concat('HackTheBox - ', source) AS machine, concat('v', doc_id) AS video, (doc_id % 90) * 60 + doc_id % 60 AS at, sha256(text) AS line_hash, lang AS tag FROM documents
 UNION ALL SELECT doc_id, 1, 'm', '', -1, sha256(''), '' FROM documents"""


def src_registry(spark, sf):
    rows = v.table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("name", F.when(F.length("name") > 4, F.concat(F.lit("ix_"), "name")).alias("index"), F.when(F.length("name") > 4, "methodology").alias("type"), F.concat(F.lit("https://g.example/"), "name").alias("clone_url"), F.concat(F.lit("/data/"), "name").alias("local_path"))
    return readers.source_registry(rows)


SQL_REGISTRY = """SELECT source AS name, CASE WHEN length(source) > 4 THEN concat('ix_', source) ELSE source END AS "index", CASE WHEN length(source) > 4 THEN 'methodology' ELSE 'general' END AS type,
 'markdown' AS parse_mode, '**/*.md' AS content_glob, concat('https://g.example/', source) AS clone_url, concat('/data/', source) AS local_path FROM (SELECT DISTINCT source FROM documents)"""


def doc_ingest(spark, sf):
    ext = F.element_at(F.array(*[F.lit(s) for s in (".log", ".TXT", ".md", ".json")]), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit('{"z": '), "doc_id", F.lit(', "a": {"y": 1, "b": [2, {"d": 1, "c": 2}]}}'))).otherwise(F.concat("text", F.repeat("text", F.lit(2))))
    d = v.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("f/d"), "doc_id", ext).alias("path"), text.alias("text"))
    return readers.document_body(d).select("doc_id", "format", "is_json", "truncated", F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("body_hash"))


_JSON_BODY = """concat('{"a":{"b":[2,{"c":2,"d":1}],"y":1},"z":', doc_id, '}')"""
SQL_DOC_INGEST = f"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'log' WHEN 1 THEN 'txt' ELSE 'json' END AS format, doc_id % 4 = 3 AS is_json,
 CASE WHEN doc_id % 4 = 3 THEN {_JSON_BODY} ELSE text || text || text END AS t FROM documents WHERE doc_id % 4 <> 2),
b AS (SELECT *, length(t) > {rules.DOC_MAX_CHARS} AS truncated, CASE WHEN length(t) > {rules.DOC_MAX_CHARS} THEN left(t, {rules.DOC_MAX_CHARS}) || chr(10) || chr(10) || '[...truncated for context budget...]' ELSE t END AS body FROM d)
SELECT doc_id, format, is_json, truncated, length(body) AS n_chars, sha256(body) AS body_hash FROM b"""


def sync_status(spark, sf):
    d = v.table(spark, sf, "documents")
    registry = d.select("source").distinct().union(d.select(F.concat(F.lit("new_"), "source")).distinct())
    log = d.select("source", F.col("source").alias("index"), F.col("doc_id").alias("last_sync"), F.col("n_chars").alias("count"), (F.col("doc_id") % 3).alias("failed"))
    return sinks.sync_status(registry, log).select("source", "status", "count", "failed")


SQL_SYNC = """SELECT source, CAST(max(doc_id) AS VARCHAR) AS status, arg_max(n_chars, doc_id) AS count, arg_max(doc_id % 3, doc_id) AS failed FROM documents GROUP BY 1
 UNION ALL SELECT DISTINCT concat('new_', source), 'never', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM documents"""


def purge_by_url(spark, sf):
    kept, _ = sinks.purge_by_url(v.table(spark, sf, "pages"), "EXAMPLE.net")
    return kept.select("page_id", "url")


def purge_count(spark, sf):
    return sinks.purge_by_url(v.table(spark, sf, "pages"), "EXAMPLE.net")[1]


def sink_ttl(spark, sf):
    """Documents written at their id's second that are still alive at a fixed time."""
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 3600)")
    d = sinks.with_ttl(v.table(spark, sf, "documents").select("doc_id", "source", at.alias("updated_at")))
    alive = sinks.unexpired(d, F.expr("timestamp'2024-02-05 00:00:00'"))
    return alive.groupBy("source").agg(F.count(F.lit(1)).alias("alive"), F.min("doc_id").alias("oldest"))


SQL_TTL = """SELECT source, count(*) AS alive, min(doc_id) AS oldest FROM documents
 WHERE timestamp '2024-01-01' + to_hours(doc_id) + INTERVAL 30 DAYS > timestamp '2024-02-05' GROUP BY 1"""


def redact_payload(spark, sf):
    d = v.table(spark, sf, "documents").select(
        "doc_id",
        F.create_map(
            F.lit("Token"), "source", F.lit("body"), "text", F.lit("img"), F.concat(F.lit("data:image/png;base64,"), "text"), F.lit("lang"), "lang", F.lit("x-api-key"), "lang"
        ).alias("m"),
    )
    p = d.select("doc_id", sinks.redact_map("m", 300).alias("m"))
    return p.select("doc_id", F.col("m")["Token"].alias("token"), F.sha2(F.col("m")["body"], 256).alias("body_hash"), F.col("m")["img"].alias("img"), F.col("m")["lang"].alias("lang"), F.col("m")["x-api-key"].alias("api_key"))


SQL_REDACT = """SELECT doc_id, '<redacted>' AS token, sha256(CASE WHEN length(text) > 300 THEN concat(left(text, 300), '...<truncated ', length(text) - 300, ' chars>') ELSE text END) AS body_hash,
 concat('<image-data-uri length=', length(text) + 22, '>') AS img, lang, '<redacted>' AS api_key FROM documents"""


def redact_nested(spark, sf):
    """Nested JSON payloads, redacted at every depth."""
    return _redacted(spark, sf, lambda p: sinks.redact_json(p, 300))


def redact_typed(spark, sf):
    """The same payloads by their schema."""
    return _redacted(spark, sf, lambda p: sinks.redact_typed(p, "outer struct<token: string, list: array<map<string, string>>>, text string", 300))


def _redacted(spark, sf, by) -> DataFrame:
    payload = F.to_json(F.struct(F.struct(F.col("source").alias("token"), F.array(F.struct(F.col("lang").alias("Authorization"), F.col("source").alias("keep"))).alias("list")).alias("outer"), "text"))
    d = v.table(spark, sf, "documents").select("doc_id", payload.alias("p")).select("doc_id", by("p").alias("p"))
    return d.select(
        "doc_id", F.get_json_object("p", "$.outer.token").alias("token"), F.get_json_object("p", "$.outer.list[0].Authorization").alias("auth"),
        F.get_json_object("p", "$.outer.list[0].keep").alias("keep"), F.sha2(F.get_json_object("p", "$.text"), 256).alias("body_hash"),
    )


SQL_REDACT_NESTED = """SELECT doc_id, '<redacted>' AS token, '<redacted>' AS auth, source AS keep, sha256(CASE WHEN length(text) > 300 THEN concat(left(text, 300), '...<truncated ', length(text) - 300, ' chars>') ELSE text END) AS body_hash FROM documents"""


def learning_append(spark, sf):
    b = v.table(spark, sf, "benchmark").select("item_id", F.col("item_id").alias("machine"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("  "), F.left("text", F.lit(15)))).otherwise(F.concat("text", F.lit("\n"))).alias("explanation"), F.when(F.col("item_id") % 6 == 0, "marker").otherwise("learning").alias("kind"), F.expr("timestamp'2024-01-01 00:00:00'").alias("created_at"))
    out = sinks.learning_rows(b)
    days = F.datediff(F.to_date("expires_at"), F.to_date("created_at")).cast("long")
    return out.select("item_id", "kind", "explanation", days.alias("ttl_days"))


SQL_LEARN = f"""SELECT item_id, kind, explanation, CASE kind WHEN 'marker' THEN 14 ELSE 365 END AS ttl_days FROM (
 SELECT item_id, CASE WHEN item_id % 6 = 0 THEN 'marker' ELSE 'learning' END AS kind, {v.sql_strip("CASE WHEN item_id % 3 = 0 THEN concat('  ', left(text, 15)) ELSE concat(text, chr(10)) END")} AS explanation FROM benchmark)
 WHERE kind = 'marker' OR length(explanation) >= 20"""


def chunk_rows(spark, sf):
    """The chunk table a refresh writes: pages cut, keyed, tagged, embedded, one row per key."""
    p = co.page_text(v.table(spark, sf, "pages")).select("page_id", "url", "title", "text", "rag_source")
    c = co.chunk_fixed(p).withColumns({"index": F.lit("webcrawl"), "source": F.lit("webcrawl")})
    keyed = co.with_doc_key(c, "source", "title", "url")
    tagged = keyed.withColumn("tags", F.create_map(F.lit("source"), "source", F.lit("type"), "source", F.lit("ingested_via"), F.lit("manual_crawl"), F.lit("rag_source"), "rag_source"))
    return em.embed(tagged, dims=v.DIMS)


def _chunk_table(spark, label: str) -> tables.ChunkTable:
    schema = "index string, doc_key string, chunk_no bigint, updated_at timestamp, expires_at timestamp, deleted boolean"
    return tables.ChunkTable(spark, new_path(spark, label), T.StructType.fromDDL(schema))


_AT = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, doc_id % 2000, 0, 0)"


def sink_refresh(spark, sf):
    """Documents in seven indexes, written as a table; then three indexes are refreshed, one of them from an empty source."""
    d = v.table(spark, sf, "documents").select(
        F.concat(F.lit("i"), F.pmod("doc_id", F.lit(7)).cast("string")).alias("index"), tx.content_key(F.col("source"), F.col("text")).alias("doc_key"), F.col("doc_id").alias("chunk_no"),
        F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(False).alias("deleted"),
    )
    table = _chunk_table(spark, "refresh")
    table.replace([f"i{k}" for k in range(7)], d)
    later = d.filter("(index = 'i1' AND chunk_no % 2 = 0) OR index = 'i3'").withColumn("chunk_no", F.col("chunk_no") + 1_000_000)
    table.replace(["i1", "i2", "i3"], later)
    return table.read().select("index", "doc_key", "chunk_no")


SQL_REFRESH = """WITH d AS (SELECT concat('i', doc_id % 7) AS "index", left(sha256(concat(source, '|', text)), 24) AS doc_key, doc_id FROM documents)
SELECT "index", doc_key, max(CASE WHEN "index" IN ('i1', 'i3') THEN doc_id + 1000000 ELSE doc_id END) AS chunk_no FROM d
WHERE "index" <> 'i2' AND ("index" <> 'i1' OR doc_id % 2 = 0) GROUP BY 1, 2"""


def upsert_compact(spark, sf):
    """Documents upserted by hour, some again later or with older rows, some deleted; compacted at a fixed time, and changed once more after it."""
    d = v.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("index"), F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(24)).alias("doc_key"), F.col("doc_id").alias("chunk_no"), F.expr(_AT).alias("updated_at")
    )
    table = _chunk_table(spark, "upsert")
    table.upsert(d.drop("doc_id"))
    changed = d.filter("doc_id % 3 = 0").withColumns({"chunk_no": F.col("chunk_no") + 1_000_000, "updated_at": F.col("updated_at") + F.expr("interval 20 days"), "deleted": F.col("doc_id") % 5 == 0})
    table.upsert(changed.drop("doc_id"))
    table.upsert(d.filter("doc_id % 4 = 0").withColumns({"chunk_no": F.lit(-1).cast("long"), "updated_at": F.col("updated_at") - F.expr("interval 1 days")}).drop("doc_id"))
    table.compact(F.expr("timestamp'2024-02-10 00:00:00'"))
    table.upsert(d.filter("doc_id % 7 = 0").withColumns({"updated_at": F.expr("timestamp'2024-05-01 00:00:00'"), "deleted": F.lit(True)}).drop("doc_id"))
    return table.read(now=F.expr("timestamp'2024-02-20 00:00:00'")).select("index", "doc_key", "chunk_no")


SQL_UPSERT = """WITH d AS (SELECT source, doc_id, timestamp '2024-01-01' + to_hours(doc_id % 2000) AS t FROM documents),
u AS (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000 ELSE doc_id END AS chunk_no, CASE WHEN doc_id % 3 = 0 THEN t + INTERVAL 20 DAYS ELSE t END + INTERVAL 30 DAYS AS until,
 doc_id % 3 = 0 AND doc_id % 5 = 0 AS gone FROM d)
SELECT source AS "index", left(sha256(CAST(doc_id AS VARCHAR)), 24) AS doc_key, chunk_no FROM u WHERE NOT gone AND until > timestamp '2024-02-20' AND doc_id % 7 <> 0"""


QUERIES = {
    "clean_text": (clean_text, SQL_CLEAN),
    "chunk_fixed": (chunk_fixed, f"WITH {SQL_CHUNKS} SELECT doc_id, start, sha256(content) AS content_hash, length(content) AS n_chars FROM chunks"),
    "content_key": (content_key, SQL_KEY),
    "corpus_dedup": (corpus_dedup, SQL_DEDUP),
    "tag_rules": (tag_rules, SQL_TAGS),
    "page_text": (page_text, _sql_pages()),
    "row_windows": (row_windows, SQL_WINDOWS),
    "md_title": (md_title, SQL_MD_TITLE),
    "md_url": (md_url, SQL_MD_URL),
    "md_headers": (md_headers, SQL_MD_HEADERS),
    "md_sections": (md_sections, SQL_MD_SECTIONS),
    "md_breadcrumbs": (md_breadcrumbs, SQL_MD_CRUMBS),
    "code_chunks": (code_chunks, SQL_CODE),
    "field_chunks": (field_chunks, SQL_FIELDS),
    "last_code": (last_code, SQL_LAST_CODE),
    "fence_commands": (fence_commands, SQL_FENCE),
    "image_url": (image_url, SQL_IMAGE),
    "walkthrough_norm": (walkthrough_norm, SQL_WALK),
    "hash_embed": (hash_embed, SQL_HASH),
    "embed_distinct": (embed_distinct, SQL_EMBED_DISTINCT),
    "embed_udf": (embed_udf, SQL_EMBED_UDF),
    "src_text": (src_text, SQL_SRC_TEXT),
    "src_registry": (src_registry, SQL_REGISTRY),
    "doc_ingest": (doc_ingest, SQL_DOC_INGEST),
    "sync_status": (sync_status, SQL_SYNC),
    "purge_by_url": (purge_by_url, "SELECT page_id, url FROM pages WHERE NOT contains(lower(url), 'example.net')"),
    "purge_count": (purge_count, "SELECT count(*) AS deleted FROM pages WHERE contains(lower(url), 'example.net')"),
    "sink_ttl": (sink_ttl, SQL_TTL),
    "sink_refresh": (sink_refresh, SQL_REFRESH),
    "upsert_compact": (upsert_compact, SQL_UPSERT),
    "walkthrough_scan": (walkthrough_scan, SQL_WALKTHROUGH),
    "redact_payload": (redact_payload, SQL_REDACT),
    "redact_nested": (redact_nested, SQL_REDACT_NESTED),
    "redact_typed": (redact_typed, SQL_REDACT_NESTED),
    "learning_append": (learning_append, SQL_LEARN),
}
