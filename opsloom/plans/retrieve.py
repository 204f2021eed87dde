"""Registered retrieval queries: (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom import rules
from opsloom.functions import text as tx
from opsloom.functions import vectors as vx
from opsloom.operators import composed
from opsloom.operators import knn as nn
from opsloom.operators import ranking as ra
from opsloom.operators import retrieval as re_
from opsloom.plans import views as v
from opsloom.sources import readers
from opsloom.session import keep, new_path, settle

K = 5
CTX = f"WITH {v.SQL_DOCS}, {v.SQL_QUERIES}, {v.SQL_TERMS}, {v.SQL_DOCWORDS}, {v.sql_lexical(K)}"


# ---------------------------------------------------------------- nearest neighbours
def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = v.table(spark, sf, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return q, e.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("index"), "embedding")


def knn_cosine(spark, sf):
    q, c = _vectors(spark, sf)
    return nn.knn(q, c, 10)


def knn_blocks(spark, sf):
    """Small tiles and blocks of queries, so that bounds decide which tiles are looked at."""
    q, c = _vectors(spark, sf)
    return nn.knn(q, c, 10, pivots=16, block_queries=6, tile_bytes=8_000, first_look=1)


def knn_machine(spark, sf):
    """A predicate per query: only vectors of the query's machine, where it names one (some name one that no vector has)."""
    q, c = _vectors(spark, sf)
    named = q.withColumn("machine", F.when(F.col("query_id") % 3 != 0, F.concat(F.lit("m"), (F.col("query_id") % 11).cast("string"))))
    return nn.knn(named, c.withColumn("machine", F.concat(F.lit("m"), (F.col("doc_id") % 9).cast("string"))), 5, machine="machine", only="machine", pivots=16, tile_bytes=8_000, first_look=1)


_EMB = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT vec_id AS doc_id, CAST(label AS BIGINT) AS "index", CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT query_id, "index", doc_id, round(1 - list_cosine_similarity(d.v, q.v), 6) AS distance, 1 - list_cosine_similarity(d.v, q.v) AS x FROM d, q)"""
SQL_KNN = f"""WITH {_EMB} SELECT * EXCLUDE (x) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY x, doc_id) AS rank FROM p) WHERE rank <= 10"""
SQL_KNN_MACHINE = f"""WITH {_EMB} SELECT * EXCLUDE (x) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY x, doc_id) AS rank FROM p WHERE query_id % 3 = 0 OR query_id % 11 = doc_id % 9) WHERE rank <= 5"""


def knn_cosine_safe(spark, sf):
    """Vectors with an empty, a cut and a zero one among them; those have similarity 0."""
    q, c = _vectors(spark, sf)
    broken = (
        F.when(F.col("doc_id") % 10 == 3, F.array().cast("array<float>"))
        .when(F.col("doc_id") % 10 == 4, F.slice("embedding", 1, 7))
        .when(F.col("doc_id") % 10 == 5, F.transform("embedding", lambda x: x * 0))
        .otherwise(F.col("embedding"))
    )
    hits = nn.knn(q, c.withColumns({"embedding": broken, "index": F.lit("all")}), 60)
    return hits.select("query_id", "doc_id", F.round(1 - F.col("distance"), 6).alias("similarity"), "rank")


SQL_SAFE = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT query_id, doc_id, CASE WHEN doc_id % 10 IN (3, 4, 5) THEN 0.0 ELSE list_cosine_similarity(d.v, q.v) END AS s FROM d, q)
SELECT query_id, doc_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, doc_id) AS rank FROM p) WHERE rank <= 60"""


def pair_similarity(spark, sf):
    """Guarded cosine as a column, for row-wise use."""
    e = v.table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("previous"))
    pairs = e.join(other, "vec_id")
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice("previous", 1, 3)).otherwise(F.col("previous"))
    return pairs.select("vec_id", F.round(vx.cosine_safe(F.col("embedding"), cut), 6).alias("similarity"))


SQL_PAIR = """SELECT a.vec_id, CASE WHEN a.vec_id % 5 = 0 THEN 0.0 ELSE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) END AS similarity
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1"""


def knn_top1(spark, sf):
    q, c = _vectors(spark, sf)
    return nn.knn(q, c.withColumn("index", F.lit("all")), 1).select("query_id", "doc_id", "distance")


SQL_TOP1 = f"""WITH {_EMB} SELECT query_id, arg_min(doc_id, (x, doc_id)) AS doc_id, min(distance) AS distance FROM p GROUP BY 1"""


# ---------------------------------------------------------------- terms and lexical hits
def query_tokens(spark, sf):
    return re_.term_rows(v.queries(spark, sf)).select("query_id", F.col("ord").cast("long").alias("ord"), "term")


def lexical(spark, sf, k: int = K) -> DataFrame:
    return re_.lexical_hits(v.queries(spark, sf), v.docs(spark, sf), k)


def lexical_join(spark, sf):
    """Small blocks and short looks, so that the threshold decides what is looked at."""
    return re_.search_index(v.queries(spark, sf), *re_.build_index(v.docs(spark, sf), block_docs=16), K, first_look=1)


def _missing(spark, sf) -> DataFrame:
    """Queries that only have a word in front that no text starts with, and their own words behind."""
    return v.queries(spark, sf).withColumn("text", F.concat(F.lit("zzqx "), F.get(F.split("text", " "), F.lit(2)), F.lit(" "), F.get(F.split("text", " "), F.lit(1))))


WELL_MATCHED = 10


def title_rescue(spark, sf):
    """Queries of which no text has ten terms are looked up by title."""
    q, d = _missing(spark, sf), v.docs(spark, sf)
    good = lexical(spark, sf).filter(F.col("matched") >= WELL_MATCHED)
    return re_.title_rescue(q, d, good, K, only_index=None).select("query_id", "index", "doc_id", F.col("ord").cast("long").alias("ord"), "rank")


SQL_RESCUE = f"""WITH good AS ({CTX} SELECT DISTINCT query_id FROM lexical WHERE matched >= {WELL_MATCHED}), {v.SQL_DOCS}, q0 AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id NOT IN (FROM good)), queries AS (SELECT query_id, concat('zzqx ', string_split(text, ' ')[3], ' ', string_split(text, ' ')[2]) AS text FROM q0), {v.SQL_TERMS},
w AS (SELECT DISTINCT doc_id, "index", unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w FROM docs),
f AS (SELECT query_id, "index", doc_id, min(ord) AS ord FROM w JOIN terms ON w = term WHERE length(w) >= 2 GROUP BY 1, 2, 3),
g AS (SELECT *, min(ord) OVER (PARTITION BY query_id, "index") AS fo FROM f)
SELECT query_id, "index", doc_id, ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY doc_id) AS rank FROM g WHERE ord = fo) WHERE rank <= {K}"""


def canonical_key(spark, sf):
    d = v.table(spark, sf, "documents")
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, " HackTheBox - ").otherwise("\t"), F.regexp_extract("text", r"^([^\n]*)", 1), F.lit(" "))
    return d.select("doc_id", tx.canonical_machine(name).alias("machine_key"))


SQL_CANON = f"""SELECT doc_id, {v.sql_canonical("concat(CASE WHEN doc_id % 2 = 0 THEN ' HackTheBox - ' ELSE chr(9) END, regexp_extract(text, '^([^\\n]*)', 1), ' ')")} AS machine_key FROM documents"""


def machine_filter(spark, sf):
    d = v.docs(spark, sf)
    named = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Box "), F.upper("machine"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("HackTheBox - Box"), F.initcap("machine"))).otherwise(F.concat(F.lit("Box "), F.initcap("machine"))).alias("machine"))
    targets = v.queries(spark, sf).select(F.concat(F.lit("box "), F.lower(F.regexp_replace("target", "HackTheBox - ", ""))).alias("machine"))
    return re_.filter_machine(named, targets)


SQL_MACHINE = """SELECT doc_id, machine FROM (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN concat('Box ', upper(lang)) WHEN 1 THEN concat('HackTheBox - Box', upper(lang[1]), lang[2:]) ELSE concat('Box ', upper(lang[1]), lang[2:]) END AS machine FROM documents)
 WHERE lang IN ('en', 'de', 'es') AND machine <> concat('Box ', upper(lang))"""


def target_first(spark, sf):
    """Exact-target hits; the other queries get their lexical hits."""
    q, d = v.queries(spark, sf), v.docs(spark, sf)
    first = re_.target_hits(q.withColumn("machine", F.col("target")), d, K).withColumn("origin", F.lit("target"))
    rest = re_.with_fallback(first, q, lambda left: re_.lexical_hits(left, d, 1).select("query_id", "index", "doc_id", "distance", "rank").withColumn("origin", F.lit("lexical")))
    return rest


_TARGET = f"""tq AS (SELECT query_id, {v.sql_canonical('target')} AS key FROM queries),
td AS (SELECT doc_id, "index", {v.sql_canonical('machine')} AS key, content AS c, row_number() OVER (PARTITION BY {v.sql_canonical('machine')}, "index" ORDER BY doc_id) AS n FROM docs),
tc AS (SELECT *, row_number() OVER (PARTITION BY key, "index", c ORDER BY n) AS copy FROM td WHERE n <= {3 * K}),
tr AS (SELECT key, "index", doc_id, row_number() OVER (PARTITION BY key ORDER BY "index", n) AS rank FROM tc WHERE copy = 1),
target AS (SELECT query_id, "index", doc_id, CAST(0 AS DOUBLE) AS distance, rank, 'target' AS origin FROM tr JOIN tq USING (key) WHERE key <> '' AND rank <= {K})"""
SQL_TARGET = f"""WITH {v.SQL_DOCS}, {v.SQL_QUERIES}, {v.SQL_TERMS}, {v.SQL_DOCWORDS}, {v.sql_lexical(1)}, {_TARGET}
SELECT * FROM target UNION ALL SELECT query_id, "index", doc_id, distance, rank, 'lexical' FROM lexical WHERE query_id NOT IN (SELECT query_id FROM target)"""


def _hash_vector_hits(spark, sf, k: int) -> DataFrame:
    d = v.docs(spark, sf).select("doc_id", "index", vx.hash_embedding("content", v.DIMS).alias("embedding"))
    q = v.queries(spark, sf).select("query_id", vx.hash_embedding("text", v.DIMS).alias("embedding"))
    return nn.knn(q, d, k)


def hybrid_merge(spark, sf):
    merged = re_.hybrid_merge(lexical(spark, sf, 3), _hash_vector_hits(spark, sf, K), v.docs(spark, sf), K)
    return merged.select("query_id", "index", "doc_id", "distance", "origin", "rank")


_MERGE = f"""WITH {v.SQL_DOCS}, {v.SQL_QUERIES}, {v.SQL_TERMS}, {v.SQL_DOCWORDS}, {v.sql_lexical(3)}, {v.sql_vector(K)},
mb AS (SELECT query_id, "index", doc_id, distance, rank, 0 AS o, 'lexical' AS origin FROM lexical UNION ALL SELECT query_id, "index", doc_id, distance, rank, 1, 'vector' FROM vector),
mk AS (SELECT mb.*, row_number() OVER (PARTITION BY query_id, mb."index", content ORDER BY o, rank, mb.doc_id) AS copy FROM mb JOIN docs USING (doc_id)),
merged AS (SELECT * FROM (SELECT query_id, "index", doc_id, distance, origin, row_number() OVER (PARTITION BY query_id, "index" ORDER BY o, rank, doc_id) AS rank FROM mk WHERE copy = 1) WHERE rank <= {K})"""


# ---------------------------------------------------------------- lists per query
ORDER = ("src3", "src1", "src10")


def federated(spark, sf):
    f = re_.federated(lexical(spark, sf), 2, candidates=3, index_order=ORDER)
    return f.select("query_id", "index", "doc_id", "rank", "position")


_PLACE = " ".join(f"WHEN {v.sq(s)} THEN {n}" for n, s in enumerate(ORDER))
SQL_FED = f"""{CTX} SELECT query_id, "index", doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE "index" {_PLACE} ELSE 3 END, "index", rank) AS position FROM lexical WHERE rank <= 3"""


def source_filter(spark, sf):
    """Hits restricted by the source named in the query; half of the queries name none."""
    names = F.array(*[F.lit(f"src{i}") for i in range(5)])
    q = v.queries(spark, sf)
    said = F.when(F.col("query_id") % 2 == 0, F.concat("text", F.lit(" ONLY "), F.get(names, (F.col("query_id") % 5).cast("int")), F.lit(" please"))).otherwise(F.col("text"))
    allowed = q.select("query_id", re_.source_filter_of(said, r"\bonly\s+(src[0-9]+)\b").alias("source")).filter(F.col("source").isNotNull())
    return re_.apply_source_filter(lexical(spark, sf), allowed).select("query_id", "index", "doc_id", "rank")


SQL_SRCFILTER = f"""{CTX} SELECT query_id, "index", doc_id, rank FROM lexical WHERE query_id % 2 = 1 OR "index" = concat('src', query_id % 5)"""


def source_phrase(spark, sf):
    """The phrase rule itself, over all documents, with both spellings of an alias."""
    said = F.concat("text", F.lit(" Only  "), F.when(F.col("doc_id") % 3 == 0, "GTFOBS").when(F.col("doc_id") % 3 == 1, "gtfobins,").otherwise("nothing"))
    return v.table(spark, sf, "documents").select("doc_id", F.coalesce(re_.source_filter_of(said), F.lit("")).alias("named_source"))


def hits(spark, sf) -> DataFrame:
    """Capped lexical hits with a position over the query; read more than once, so settled."""
    return settle(re_.federated(lexical(spark, sf), K))


def hits_docs(spark, sf) -> DataFrame:
    """Hits with their documents, query text and target."""
    h = hits(spark, sf)
    return h.join(ra.hit_docs(v.docs(spark, sf), h), ["index", "doc_id"]).join(v.queries(spark, sf).withColumnRenamed("text", "query"), "query_id")


def scored_hits(spark, sf, phase=None) -> DataFrame:
    """Hits with what scoring needs of their documents and queries."""
    h = hits(spark, sf)
    q = v.queries(spark, sf).withColumnRenamed("text", "query").select("query_id", "query", "phase_bucket")
    return h.join(ra.hit_features(v.docs(spark, sf), h, phase=phase), ["index", "doc_id"]).join(q, "query_id").withColumn("lexical", ra.overlap_of_tokens("query", "tokens"))


_HD = """hd AS (SELECT l.query_id, l."index", l.doc_id, l.distance, l.matched, l.rank, row_number() OVER (PARTITION BY l.query_id ORDER BY l."index", l.rank) AS position,
 d.machine, d.title, d.url, d.content, q.text AS query, q.target, q.phase_bucket FROM lexical l JOIN docs d USING (doc_id) JOIN queries q ON q.query_id = l.query_id)"""
HD = f"{CTX}, {_HD}"


def target_postfilter(spark, sf):
    h = hits_docs(spark, sf)
    kept = re_.prefer_target(h, v.queries(spark, sf).select("query_id", "target"))
    return kept.select("query_id", "doc_id", "machine")


SQL_POST = f"""{HD}, m AS (SELECT *, {v.sql_canonical('machine')} = {v.sql_canonical('target')} AND {v.sql_canonical('target')} <> '' AS is_match FROM hd)
SELECT query_id, doc_id, machine FROM (SELECT *, bool_or(is_match) OVER (PARTITION BY query_id) AS any_match FROM m) WHERE is_match OR NOT any_match"""


def query_expand(spark, sf):
    """Queries of a machine with the machine's commands as history."""
    from pyspark.sql import Window

    w = Window.partitionBy("machine").orderBy(F.desc("sec"), F.desc("seq"))
    recent = v.commands(spark, sf).withColumn("n", F.row_number().over(w)).filter("n <= 15").groupBy("machine").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "command")), asc=False), lambda e: e["command"]).alias("history")
    )
    q = v.queries(spark, sf).withColumn("machine", F.col("query_id") % 7).join(recent, "machine", "left")
    q = q.withColumns({"machine": F.concat(F.lit(" M"), F.col("machine").cast("string")), "history": F.coalesce("history", F.array().cast("array<string>"))})
    return re_.expand_queries(q).select("query_id", "expanded")


SQL_EXPAND = f"""WITH {v.SQL_COMMANDS}, {v.SQL_QUERIES}, r AS (SELECT machine, string_agg(command, chr(10) ORDER BY sec, seq) AS h FROM (
 SELECT *, row_number() OVER (PARTITION BY machine ORDER BY sec DESC, seq DESC) AS n FROM commands) WHERE n <= 10 GROUP BY 1)
SELECT query_id, concat(text, chr(10), 'Current machine: m', query_id % 7, chr(10), 'Recent shell context:', CASE WHEN h IS NOT NULL THEN concat(chr(10), h) ELSE '' END) AS expanded FROM queries LEFT JOIN r ON machine = query_id % 7"""


# ---------------------------------------------------------------- scores
_PHASE_TEXT = "CASE doc_id % 6 WHEN 0 THEN concat(text, chr(10), 'Phase: Root-x', chr(10), 'end') WHEN 1 THEN concat(text, ' Sudo -L ') WHEN 2 THEN concat('ssh ', text) WHEN 3 THEN concat(text, ' NMAP') ELSE text END"


def snippet_phase(spark, sf):
    return v.table(spark, sf, "documents").withColumn("t", F.expr(_PHASE_TEXT)).select("doc_id", ra.snippet_phase("t").alias("phase"))


def _sql_phase(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '(?im)^phase:\\s*([a-z-]+)$') THEN lower(regexp_extract({c}, '(?im)^phase:\\s*([a-z-]+)$', 1)) ELSE {v.sql_group(f'lower({c})', rules.SNIPPET_PHASES, 'unknown')} END"


SQL_SNIP_PHASE = f"SELECT doc_id, {_sql_phase('t')} AS phase FROM (SELECT doc_id, {_PHASE_TEXT} AS t FROM documents)"


def overlap_score(spark, sf):
    return scored_hits(spark, sf).select("query_id", "doc_id", F.round("lexical", 6).alias("overlap"))


_OV_TOK = "list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9_/-]+'), lambda x: length(x) >= 2))"
_OV = f"CASE WHEN len({_OV_TOK}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({_OV_TOK}, regexp_extract_all(lower(concat(title, chr(10), machine, chr(10), content)), '[a-z0-9_/-]+'))) AS DOUBLE) / len({_OV_TOK}) END"


def length_scorer():
    """A stand-in scoring model."""

    def score(queries, texts):
        return [(len(q) % 10 + len(t) % 7) / 20.0 for q, t in zip(queries, texts)]

    return score


def rerank_udf(spark, sf):
    h = hits_docs(spark, sf).select("query_id", "doc_id", "query", "content", F.lit(0.0).alias("lexical"))
    return ra.cross_score(h, length_scorer, whole=False).select("query_id", "doc_id", F.round("rerank_score", 6).alias("score"))


SQL_RERANK_UDF = f"{HD} SELECT query_id, doc_id, round((length(query) % 10 + length(content) % 7) / 20.0, 6) AS score FROM hd"


def phase_bonus(spark, sf):
    d = v.table(spark, sf, "documents").select(
        "doc_id", F.element_at(F.array(*[F.lit(p) for p in ("recon", "user", "root", "unknown")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("phase"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Networking-x"), F.lit("SUID"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("exploit"), F.lit("privesc"), F.lit("hash"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.concat("source", F.when(F.col("doc_id") % 5 == 0, " > Payload Discovery suid").otherwise(" > lateral")).alias("crumb"),
    )
    return d.select("doc_id", F.round(ra.phase_bonus("phase", "tags", "crumb"), 6).alias("bonus"))


SQL_BONUS = f"""WITH w(phase, tag, weight) AS (VALUES {', '.join(f"('{p}', '{t}', {x})" for p, t, x in rules.PHASE_BONUS)}),
d AS (SELECT doc_id, ['recon', 'user', 'root', 'unknown'][doc_id % 4 + 1] AS phase, lower(CASE doc_id % 3 WHEN 0 THEN 'Networking-x SUID' WHEN 1 THEN 'exploit privesc hash' ELSE '' END) AS tags,
 lower(concat(source, CASE WHEN doc_id % 5 = 0 THEN ' > Payload Discovery suid' ELSE ' > lateral' END)) AS crumb FROM documents)
SELECT doc_id, round(least(0.5, sum(CASE WHEN contains(tags, tag) THEN CAST(weight AS DOUBLE) ELSE 0 END + CASE WHEN contains(crumb, tag) THEN CAST(weight AS DOUBLE) / 2 ELSE 0 END)), 6) AS bonus FROM d JOIN w USING (phase) GROUP BY 1"""


_FP_SQL = """sha1(concat("index", '|', machine, '|', title, '|', content))"""


def _shown(spark, sf) -> DataFrame:
    """Turns at which documents were shown to their machine: turn = id / 50, one turn per hour."""
    d = v.docs(spark, sf)
    return d.select(
        "machine", F.floor(F.col("doc_id") / 50).cast("long").alias("turn"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, doc_id div 50)").alias("shown_at"),
        F.col("index").alias("source"), ra.fingerprint("index", "machine", "title", "content").alias("fingerprint"),
    )


def recent_penalty(spark, sf):
    """Hits whose fingerprint was shown to their machine in its last three turns."""
    recent = ra.recent_fingerprints(_shown(spark, sf))
    flagged = ra.with_shown_flag(scored_hits(spark, sf).withColumn("target", F.col("machine")), recent)
    return flagged.select("query_id", "doc_id", "recently_shown")


_RECENT = f"""sh AS (SELECT machine, doc_id // 50 AS turn, {_FP_SQL} AS fp FROM docs),
rt AS (SELECT machine, turn FROM (SELECT machine, turn, row_number() OVER (PARTITION BY machine ORDER BY turn DESC) AS n FROM (SELECT DISTINCT machine, turn FROM sh)) WHERE n <= 3),
recent AS (SELECT DISTINCT machine, fp FROM sh JOIN rt USING (machine, turn))"""
SQL_RECENT = f"""{HD}, {_RECENT} SELECT query_id, doc_id, (machine, {_FP_SQL}) IN (SELECT (machine, fp) FROM recent) AS recently_shown FROM hd"""


def recent_ttl(spark, sf):
    """Fingerprints that still count at a given hour, of sources whose name holds a 1."""
    now = F.expr("timestamp'2024-01-01 23:30:00'")
    return ra.recent_fingerprints(_shown(spark, sf), now, source_like="1")


SQL_RECENT_TTL = f"""WITH {v.SQL_DOCS}, s AS (SELECT machine, doc_id // 50 AS turn, "index" AS source, {_FP_SQL} AS fingerprint FROM docs),
rt AS (SELECT machine, turn FROM (SELECT machine, turn, row_number() OVER (PARTITION BY machine ORDER BY turn DESC) AS n, max(turn) OVER (PARTITION BY machine) AS newest FROM (SELECT DISTINCT machine, turn FROM s)) WHERE n <= 3
 AND timestamp '2024-01-01' + to_hours(CAST(newest AS BIGINT)) > timestamp '2024-01-01 23:30:00' - INTERVAL 6 HOURS)
SELECT DISTINCT machine, fingerprint FROM s JOIN rt USING (machine, turn) WHERE contains(source, '1')"""


def reranked(spark, sf) -> DataFrame:
    recent = ra.recent_fingerprints(_shown(spark, sf))
    phase = F.when(F.col("doc_id") % 4 == 0, "recon").when(F.col("doc_id") % 4 == 1, "user").otherwise(ra.snippet_phase("content"))
    h = ra.with_shown_flag(scored_hits(spark, sf, phase).withColumn("target", F.col("machine")), recent)
    return ra.rerank(ra.cross_score(h).drop("rank", "tokens"), shown="recently_shown").drop("machine", "target")


def rerank(spark, sf):
    return reranked(spark, sf).select("query_id", "doc_id", "final_score", "rank")


_RERANK = f"""{_RECENT},
rp AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'recon' WHEN 1 THEN 'user' ELSE {_sql_phase('content')} END AS phase, {_OV} AS ov, (machine, {_FP_SQL}) IN (SELECT (machine, fp) FROM recent) AS shown,
 lower(query) AS lq, {_OV_TOK} AS qt FROM hd),
ro AS (SELECT *, bool_or(phase <> 'recon') OVER (PARTITION BY query_id) AS other FROM rp),
rs AS (SELECT query_id, doc_id, "index", position, distance, machine, title, url, content, target, query, round(0.65 * ov + 0.25 * greatest(0.0, least(1.0, 1.0 - distance))
 + CASE WHEN phase_bucket <> 'unknown' AND phase = phase_bucket THEN 0.20 ELSE 0.0 END
 + CASE WHEN ((contains(lq, 'find') AND contains(lq, 'suid')) OR contains(lq, 'setuid') OR contains(lq, 'sudo -l')) THEN CASE "index" WHEN 'gtfobins' THEN 0.25 WHEN 'hacktricks' THEN 0.22 ELSE 0.0 END ELSE 0.0 END
 + CASE WHEN len(qt) = 1 AND length(qt[1]) <= 4 AND "index" = 'gtfobins' THEN 0.45 ELSE 0.0 END
 - CASE WHEN shown THEN 0.30 ELSE 0.0 END, 6) AS final_score FROM ro WHERE phase_bucket NOT IN ('user', 'root') OR NOT other OR phase <> 'recon'),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, position) AS rank FROM rs)"""
RR = f"{HD}, {_RERANK}"


def diverse_topk(spark, sf):
    return ra.diverse_topk(reranked(spark, sf), 30).select("query_id", "doc_id", "index", "slot")


_DIVERSE = """dv0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY rank) > 1 AS later FROM reranked),
selected AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, rank) AS slot FROM dv0) WHERE slot <= 30)"""


def selected(spark, sf) -> DataFrame:
    top = keep(ra.diverse_topk(reranked(spark, sf), 6), "selected")
    return top.join(ra.hit_docs(v.docs(spark, sf), top), ["index", "doc_id"])


_SELECTED6 = _DIVERSE.replace("slot <= 30", "slot <= 6")
SEL = f"{RR}, {_SELECTED6}"


def similarity_stats(spark, sf):
    s = ra.similarity_stats(knn_cosine(spark, sf))
    return s.select("query_id", "best_similarity", F.array_join(F.transform("top_similarity", lambda x: F.format_string("%.6f", x)), ",").alias("top3"), "confident")


SQL_SIM = f"""WITH {_EMB}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY distance, doc_id) AS rank FROM p),
s AS (SELECT query_id, round(greatest(0.0, least(1.0, 1 - distance)), 6) AS sim FROM h WHERE rank <= 10),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC) AS n FROM s)
SELECT query_id, max(sim) AS best_similarity, string_agg(printf('%.6f', sim), ',' ORDER BY n) FILTER (WHERE n <= 3) AS top3, bool_or(sim >= 0.4) AS confident FROM t GROUP BY 1"""


def _prioritised(spark, sf) -> DataFrame:
    s = selected(spark, sf).join(v.queries(spark, sf).select("query_id", "target"), "query_id")
    s = s.withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit(" Methodology"))).otherwise(F.col("content")))
    return ra.with_priority(s.withColumn("rank", F.col("slot")))


def budget_trim(spark, sf):
    t = ra.budget_trim(_prioritised(spark, sf))
    return t.select("query_id", "doc_id", "token_cost", "priority", "kept_no")


_HAY = "lower(concat(machine, ' ', title, ' ', c2))"
_PRIO = f"""bp AS (SELECT query_id, doc_id, slot, distance, greatest(1, (length(title) + length(url) + length(c2) + 2) // 4) AS token_cost,
 CASE WHEN want <> '' AND (lower(machine) = want OR contains({_HAY}, want)) THEN 2 ELSE 0 END - CASE WHEN {v.sql_contains(_HAY, rules.GENERIC_HINTS)} THEN 1 ELSE 0 END AS priority
 FROM (SELECT *, lower(trim(target)) AS want, CASE WHEN doc_id % 5 = 0 THEN concat(content, ' Methodology') ELSE content END AS c2 FROM selected)),
bo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, distance, token_cost, slot) AS o FROM bp)"""
SQL_BUDGET = SEL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_PRIO},
walk AS (SELECT query_id, o, token_cost AS used, 1 AS kept, true AS take FROM bo WHERE o = 1
 UNION ALL SELECT b.query_id, b.o, CASE WHEN w.used < 1500 AND w.used + b.token_cost <= 1500 THEN w.used + b.token_cost ELSE w.used END,
  CASE WHEN w.used < 1500 AND w.used + b.token_cost <= 1500 THEN w.kept + 1 ELSE w.kept END, w.used < 1500 AND w.used + b.token_cost <= 1500
  FROM walk w JOIN bo b ON b.query_id = w.query_id AND b.o = w.o + 1)
SELECT bo.query_id, bo.doc_id, bo.token_cost, bo.priority, walk.kept AS kept_no FROM bo JOIN walk ON bo.query_id = walk.query_id AND bo.o = walk.o WHERE take"""


def _web(spark, sf) -> DataFrame:
    p = v.table(spark, sf, "pages")
    return p.select(
        (F.col("page_id") % 45).alias("query_id"), F.col("page_id").alias("web_rank"), F.concat(F.lit(" t"), "page_id").alias("title"),
        F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("html")).alias("content"), F.concat(F.lit("snip "), "url").alias("snippet"),
    )


def web_norm(spark, sf):
    return ra.normalise_web(_web(spark, sf))


_WEB = f"""web AS (SELECT query_id, web_rank, title, url, {v.sql_strip('s').replace('trim(s', 'trim(s')} AS s0 FROM (
 SELECT page_id % 45 AS query_id, page_id AS web_rank, concat('t', page_id) AS title, CASE WHEN page_id % 4 = 0 THEN '' ELSE url END AS url,
 CASE WHEN page_id % 3 = 0 THEN concat('snip ', url) ELSE html END AS s, row_number() OVER (PARTITION BY page_id % 45 ORDER BY page_id) AS n FROM pages) WHERE n <= 5 AND url <> '')"""
SQL_WEB = f"WITH {_WEB} SELECT query_id, web_rank, title, url, left(s0, 300) AS snippet FROM web"


def tiered_fallback(spark, sf):
    """Vector hits; queries whose best similarity is below 0.99 (all but exact copies) also get web rows."""
    q = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id")).filter("query_id % 20 = 0")
    hits = knn_cosine(spark, sf).filter("doc_id <> query_id OR query_id % 3 = 0").filter("rank <= 3")
    out = ra.tiered_fallback(q, hits, ra.normalise_web(_web(spark, sf)), threshold=0.99, allow=F.col("query_id") % 4 != 1)
    return out.withColumn("position", F.col("position").cast("long"))


SQL_TIER = f"""WITH {_EMB}, {_WEB}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY x, doc_id) AS rank FROM p) WHERE rank <= 3 AND (doc_id <> query_id OR query_id % 3 = 0)),
b AS (SELECT q.query_id, coalesce(1 - min(distance), 0) AS best FROM q LEFT JOIN h USING (query_id) GROUP BY 1),
u AS (SELECT w.* FROM web w JOIN b USING (query_id) WHERE best < 0.99 AND query_id % 4 <> 1)
SELECT query_id, tier, position, ref, query_id IN (SELECT query_id FROM u) AS used_web FROM (
 SELECT query_id, 'local' AS tier, rank AS position, CAST(doc_id AS VARCHAR) AS ref FROM h UNION ALL SELECT query_id, 'web', web_rank, url FROM u)"""


# ---------------------------------------------------------------- rendering
_KV = "concat('machine: m', doc_id % 9, chr(10), 'phase: p', doc_id % 4, chr(10), 'TAG : ', lang, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('line: - l', doc_id, chr(10), 'academy: ', source, chr(10)) ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN concat('url: http://u', doc_id, chr(10)) ELSE '' END, 'phase: q', doc_id % 5, chr(10), 'empty:', chr(10), 'free ', source)"
_SUMTEXT = f"CASE doc_id % 4 WHEN 3 THEN text ELSE {_KV} END"


def snippet_summary(spark, sf):
    d = v.table(spark, sf, "documents").withColumn("t", F.expr(_SUMTEXT))
    return d.select("doc_id", ra.snippet_summary("t").alias("summary"))


def _sql_summary(c: str, by: str) -> str:
    """CTE chain ``sm(by, summary)`` over ``src(by, c)``."""
    strip = v.sql_strip
    return f"""ln AS (SELECT {by}, {strip('l')} AS l, i FROM (SELECT {by}, unnest(string_split({c}, chr(10))) AS l, generate_subscripts(string_split({c}, chr(10)), 1) AS i FROM src)),
kv AS (SELECT {by}, lower({strip("split_part(l, ':', 1)")}) AS k, {strip("substr(l, position(':' IN l) + 1)")} AS val, i FROM ln WHERE contains(l, ':')),
kl AS (SELECT {by}, k, arg_max(val, i) AS val FROM kv WHERE k <> '' AND val <> '' GROUP BY 1, 2),
fr AS (SELECT {by}, arg_min(l, i) AS f FROM ln WHERE l <> '' AND NOT contains(l, ':') GROUP BY 1),
mb4 AS (SELECT {by}, k, val, row_number() OVER (PARTITION BY {by} ORDER BY list_position({list(rules.SUMMARY_KEYS)!r}, k)) AS n FROM kl WHERE k IN {tuple(rules.SUMMARY_KEYS)!r}),
al AS (SELECT {by}, n, concat('- ', replace(k, '_', ' '), ': ', val) AS b FROM mb4 WHERE n <= 4
 UNION ALL SELECT {by}, 5, concat('- machine: ', val) FROM kl WHERE k = 'machine'
 UNION ALL SELECT s.{by}, 6, CASE WHEN u.val IS NOT NULL THEN concat('- url: ', u.val) ELSE concat('- note: ', left(f, 140)) END FROM src s LEFT JOIN (SELECT * FROM kl WHERE k = 'url') u USING ({by}) LEFT JOIN fr USING ({by}) WHERE u.val IS NOT NULL OR f IS NOT NULL),
ar AS (SELECT {by}, b, row_number() OVER (PARTITION BY {by} ORDER BY n) AS r FROM al),
sm AS (SELECT s.{by}, coalesce(string_agg(b, ' ' ORDER BY r) FILTER (WHERE r <= 5), concat('- note: ', left({strip(f"regexp_replace(any_value(s.{c}), '\\s+', ' ', 'g')")}, 220))) AS summary FROM src s LEFT JOIN ar USING ({by}) GROUP BY 1)"""


SQL_SUMMARY = f"WITH src AS (SELECT doc_id, {_SUMTEXT} AS t FROM documents), {_sql_summary('t', 'doc_id')} SELECT doc_id, summary FROM sm"


def reference_block(spark, sf):
    return ra.reference_block(v.queries(spark, sf), selected(spark, sf), order="slot")


SQL_REFBLOCK = f"""{SEL}, src AS (SELECT DISTINCT doc_id, content AS t FROM selected), {_sql_summary('t', 'doc_id')}
SELECT q.query_id, coalesce(concat('Reference Material:', chr(10), string_agg(concat('- [', "index", '] ', machine, ' | ', title, ' | ', url, chr(10), '  ', summary), chr(10) ORDER BY slot)), 'Reference Material: none') AS reference_block
FROM queries q LEFT JOIN selected s ON s.query_id = q.query_id LEFT JOIN sm USING (doc_id) GROUP BY 1"""
SQL_REFBLOCK = SQL_REFBLOCK.replace("coalesce(concat('Reference Material:', chr(10), string_agg", "coalesce('Reference Material:' || chr(10) || (string_agg")


def web_block(spark, sf):
    return ra.web_block(ra.normalise_web(_web(spark, sf)))


SQL_WEBBLOCK = f"""WITH {_WEB}, w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY web_rank) AS n FROM web)
SELECT query_id, concat('Live Web Results (cite these URLs if you use this information):', chr(10), string_agg(concat(chr(10), '[', n, '] ', title, chr(10), '    URL: ', url, CASE WHEN s0 <> '' THEN concat(chr(10), '    ', left(s0, 300)) ELSE '' END), chr(10) ORDER BY n)) AS web_block FROM w GROUP BY 1"""


def solution_block(spark, sf):
    s = ra.solution_block(selected(spark, sf).withColumn("target", F.lit("box")), order="slot")
    return s.select("query_id", F.sha2("solution_block", 256).alias("block_hash"))


SQL_SOLUTION = f"""{SEL}, r AS (SELECT query_id, slot, concat('## ', CASE WHEN title = '' THEN 'Untitled' ELSE title END, ' (', "index", ')', chr(10), CASE WHEN url <> '' THEN concat(url, chr(10)) ELSE '' END, chr(10), content, chr(10)) AS t FROM selected)
SELECT query_id, sha256(concat('# box - Guided Solution Material', chr(10), chr(10), string_agg(t, chr(10) ORDER BY slot))) AS block_hash FROM r GROUP BY 1"""


def methodology_block(spark, sf):
    h = selected(spark, sf).withColumn("breadcrumb", F.when(F.col("doc_id") % 2 == 0, F.concat("index", F.lit(" > "), "title")))
    return ra.methodology_block(h, order="slot").select("query_id", F.sha2("methodology_block", 256).alias("block_hash"))


SQL_METH = f"""{SEL}, r AS (SELECT query_id, slot, concat(chr(10), '[HackTricks #', slot, '] ', title, CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), 'Location: ', "index", ' > ', title) ELSE '' END,
 chr(10), 'Reference: ', url, chr(10), chr(10), 'Content:', chr(10), content, chr(10)) AS t FROM selected)
SELECT query_id, sha256(concat(chr(10), '--- HackTricks Methodology Reference ---', chr(10), string_agg(t, chr(10) ORDER BY slot), chr(10), '--- End HackTricks Reference ---', chr(10))) AS block_hash FROM r GROUP BY 1"""


def search_results(spark, sf):
    """The composed result per query; queries that name no machine may use the web."""
    q = v.queries(spark, sf)
    web = ra.normalise_web(_web(spark, sf)).join(q.filter("target = ''"), "query_id", "left_semi")
    r = ra.search_results(q, selected(spark, sf), web, order="slot")
    return r.select("query_id", "used_web", F.size("hits").cast("long").alias("n_hits"), F.when(F.col("used_web"), F.size("web_results")).otherwise(-1).cast("long").alias("n_web"), F.sha2("reference_block", 256).alias("block_hash"))


def hits_by_source(spark, sf):
    h = ra.hits_by_source(selected(spark, sf), order="slot")
    return h.select("query_id", "source", "n_hits", F.sha2("block", 256).alias("block_hash"))


SQL_RESULTS = f"""WITH rb AS ({SQL_REFBLOCK}), wb AS (SELECT * FROM ({SQL_WEBBLOCK}) WHERE query_id IN (SELECT query_id FROM (WITH {v.SQL_QUERIES} FROM queries) WHERE target = '')), nw AS (SELECT query_id, count(*) AS n FROM ({SQL_WEB}) GROUP BY 1)
SELECT rb.query_id, web_block IS NOT NULL AS used_web, 6 AS n_hits, CASE WHEN web_block IS NULL THEN -1 ELSE n END AS n_web,
 sha256(reference_block || coalesce(chr(10) || chr(10) || 'Cite the URLs below if you use any of this information.' || chr(10) || chr(10) || web_block, '')) AS block_hash FROM rb LEFT JOIN wb USING (query_id) LEFT JOIN nw USING (query_id)"""
SQL_BYSRC = f"""{SEL}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY slot) AS no FROM selected),
c AS (SELECT query_id, doc_id, "index", no, title, machine, url, distance, list_transform(string_split(content, chr(10)), lambda x: concat(chr(10), '      ', x)) AS ls FROM n)
SELECT query_id, "index" AS source, count(*) AS n_hits, sha256(concat('### SOURCE: ', upper("index"), chr(10), string_agg(concat('[', no, '] title: ', CASE WHEN title = '' THEN '-' ELSE title END, chr(10), '    machine: ', machine, chr(10), '    url: ', url, chr(10), '    score: ', printf('%.4f', distance), chr(10), '    content:', array_to_string(ls, '')), chr(10) || chr(10) ORDER BY no))) AS block_hash FROM c GROUP BY 1, 2"""


def hits_by_title(spark, sf):
    h = hits_docs(spark, sf)
    return ra.hits_by_title(h).select("query_id", "group_key", "n_hits", "source_mix", "group_no")


SQL_BYTITLE = f"""{HD}, g AS (SELECT query_id, lower(CASE WHEN title = '' THEN 'untitled' ELSE title END) AS group_key, "index" AS s, count(*) AS n FROM hd GROUP BY 1, 2, 3),
t AS (SELECT query_id, group_key, sum(n) AS n_hits, string_agg(concat(s, ':', n), ', ' ORDER BY n DESC, s) AS source_mix FROM g GROUP BY 1, 2)
SELECT query_id, group_key, CAST(n_hits AS BIGINT) AS n_hits, source_mix, row_number() OVER (PARTITION BY query_id ORDER BY n_hits DESC, group_key) AS group_no FROM t"""


def recall_overlap(spark, sf):
    """Conversation turns as learnings, recalled for the benchmark texts."""
    turns = v.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("learning_id"), (F.col("conv_id") % 5).cast("string").alias("machine"), F.col("text").alias("explanation"))
    q = v.queries(spark, sf).select("query_id", "text", (F.col("query_id") % 6).cast("string").alias("exclude_machine"))
    return ra.recall_overlap(q, turns).select("query_id", "learning_id", "score", "rank")


SQL_RECALL = """WITH t AS (SELECT DISTINCT query_id, x, w FROM (SELECT item_id AS query_id, CAST(item_id % 6 AS VARCHAR) AS x, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM benchmark) WHERE length(w) > 3),
l AS (SELECT conv_id * 1000 + turn AS learning_id, CAST(conv_id % 5 AS VARCHAR) AS machine, lower(text) AS e FROM conversations),
s AS (SELECT query_id, learning_id, count(*) AS score FROM t JOIN l ON contains(e, w) AND machine <> x GROUP BY 1, 2)
SELECT query_id, learning_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, learning_id) AS rank FROM s) WHERE rank <= 20"""


def _advisory_files(spark, sf) -> DataFrame:
    """An advisory file per document; every seventh one breaks off."""
    path = F.concat(F.lit("file:/advisories/"), F.col("doc_id") % 3, F.lit("/cve-2021-"), F.col("doc_id") + 4000, F.lit(".json"))
    body = F.to_json(F.struct(F.col("text").alias("description"), F.struct(F.col("lang").alias("name")).alias("vendor")))
    return v.table(spark, sf, "documents").select(path.alias("path"), F.when(F.col("doc_id") % 7 == 0, F.left(body, F.lit(12))).otherwise(body).alias("text"))


def advisory_scan(spark, sf):
    """Advisories by id, with what the payload says besides the description."""
    a = readers.advisory_rows(_advisory_files(spark, sf))
    return a.select("cve_id", F.sha2("description", 256).alias("description_hash"), F.variant_get("payload", "$.vendor.name", "string").alias("vendor"))


SQL_ADVISORIES = "SELECT concat('CVE-2021-', doc_id + 4000) AS cve_id, sha256(text) AS description_hash, lang AS vendor FROM documents WHERE doc_id % 7 <> 0"


def cve_enrich(spark, sf):
    """Ids in tool outputs, in both cases, with their advisories where these can be read."""
    o = v.outputs(spark, sf)
    out = ra.cve_enrich(o.select("run_id", F.concat("output", F.lit(" again "), F.lower("output")).alias("text")), readers.advisory_rows(_advisory_files(spark, sf)))
    return out.select("run_id", "cve_id", F.sha2(F.coalesce("description", F.lit("")), 256).alias("description_hash"))


SQL_CVE = f"""WITH {v.SQL_OUTPUTS} SELECT run_id, concat('CVE-2021-', 4000 + k % 50) AS cve_id, sha256(coalesce(text, '')) AS description_hash
FROM outputs LEFT JOIN documents ON doc_id = k % 50 AND doc_id % 7 <> 0 WHERE event_type = 'error'"""


def index_counts(spark, sf):
    d = v.docs(spark, sf)
    reg = d.select("index").union(d.select(F.concat(F.lit("empty_"), "machine").alias("index")))
    return re_.index_counts(reg, d)


SQL_COUNTS = """SELECT source AS "index", count(*) AS num_docs, true AS ok FROM documents GROUP BY 1 UNION ALL SELECT DISTINCT concat('empty_', lang), 0, false FROM documents"""


def flagship(spark, sf):
    """Chunks of all documents, keyed, searched for every query, scored, and the five most diverse per query."""
    from opsloom.operators import corpus as co

    d = v.table(spark, sf, "documents").select("doc_id", F.col("source").alias("index"), F.col("lang").alias("machine"), "text")
    chunks = co.chunk_fixed(d).withColumn("title", F.regexp_extract("content", r"^([^\n]{0,60})", 1))
    keyed = co.with_doc_key(chunks, "index", "title").withColumn("chunk_id", F.col("doc_id") * 1_000_000 + F.col("start"))
    unit = keyed.select(F.col("chunk_id").alias("doc_id"), "index", "machine", "title", "content", "doc_key")
    q = v.queries(spark, sf).select("query_id", "text")
    found = settle(re_.federated(re_.lexical_hits(q, unit, 2), 2, candidates=2))
    full = found.join(ra.hit_features(unit, found, also=["doc_key"]), ["index", "doc_id"]).join(q.withColumnRenamed("text", "query"), "query_id")
    scored = full.withColumns({"rerank_score": ra.overlap_of_tokens("query", "tokens"), "phase_bucket": F.lit("unknown")})
    top = ra.diverse_topk(ra.rerank(scored.drop("rank", "tokens")), 5)
    return top.select("query_id", "slot", F.col("doc_id").alias("chunk_id"), "index", "doc_key", "final_score")


SQL_FLAGSHIP = f"""WITH queries AS (SELECT item_id AS query_id, text FROM benchmark),
docs AS (SELECT doc_id * 1000000 + start AS doc_id, "index", machine, regexp_extract(content, '^([^\\n]{{0,60}})', 1) AS title, content FROM (
 SELECT doc_id, source AS "index", lang AS machine, start, {v.sql_strip('substr(t, start + 1, 1000)')} AS content FROM (SELECT doc_id, source, lang, t, unnest(range(0, length(t), 900)) AS start FROM (SELECT *, {v.sql_strip('text')} AS t FROM documents)))
 WHERE length(content) > 40),
{v.SQL_TERMS}, {v.SQL_DOCWORDS}, {v.sql_lexical(2)},
hd AS (SELECT l.query_id, l."index", l.doc_id, distance, row_number() OVER (PARTITION BY l.query_id ORDER BY l."index", l.rank) AS position, title, machine, content, q.text AS query, lower(q.text) AS lq
 FROM lexical l JOIN docs d ON d.doc_id = l.doc_id JOIN queries q ON q.query_id = l.query_id),
rs AS (SELECT *, round(0.65 * {_OV} + 0.25 * (1 - distance), 6) AS final_score FROM hd),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, position) AS rank FROM rs),
d0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY rank) > 1 AS later FROM reranked)
SELECT query_id, slot, doc_id AS chunk_id, "index", left(sha256(concat("index", '|', title, '|', content)), 24) AS doc_key, final_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, rank) AS slot FROM d0) WHERE slot <= 5"""


# ---------------------------------------------------------------- from text to selected hits
_TAGS = "CASE doc_id % 3 WHEN 0 THEN array('Networking-x', 'SUID') WHEN 1 THEN array('exploit', 'privesc', 'hash') ELSE array() END"


def _retrieved(spark, sf) -> DataFrame:
    q = v.queries(spark, sf).withColumn("history", F.array(F.concat(F.lit("ls "), (F.col("query_id") % 5).cast("string"))))
    d = v.docs(spark, sf).withColumns({"tags": F.expr(_TAGS), "breadcrumb": F.concat("index", F.when(F.col("doc_id") % 5 == 0, " > Payload Discovery suid").otherwise(" > lateral"))})
    return composed.retrieve(q, d, K, shown=_shown(spark, sf), index_order=ORDER, embed=lambda c: vx.hash_embedding(c, v.DIMS))


def retrieve_full(spark, sf):
    """Target pass, expansion, word and vector search, merge, scores with all bonuses and the shown penalty, and the diverse best of each query."""
    return _retrieved(spark, sf).select("query_id", "slot", "index", "doc_id", "origin", F.round("final_score", 6).alias("final_score"))


_TAGS_SQL = "CASE doc_id % 3 WHEN 0 THEN 'networking-x suid' WHEN 1 THEN 'exploit privesc hash' ELSE '' END"
_CRUMB_SQL = """lower(concat("index", CASE WHEN doc_id % 5 = 0 THEN ' > Payload Discovery suid' ELSE ' > lateral' END))"""
# In doubles and in the order of the column expression, so that sums agree to the last bit.
_META = "CAST(0 AS DOUBLE) + " + " + ".join(
    f"CASE WHEN phase_bucket = {v.sq(p)} THEN CASE WHEN contains({_TAGS_SQL}, {v.sq(t)}) THEN CAST({w} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    f" + CASE WHEN contains({_CRUMB_SQL}, {v.sq(t)}) THEN CAST({w * 0.5} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END ELSE CAST(0 AS DOUBLE) END"
    for p, t, w in rules.PHASE_BONUS
)
_LIMIT = max(rules.RERANK_CANDIDATES, K)
# 1e-9: halves of the sixth digit round up, as Spark rounds a double by its decimal form.
RETRIEVED = f"""WITH {v.SQL_DOCS}, {v.SQL_QUERIES.replace('queries AS', 'asked AS', 1)},
queries AS (SELECT query_id, concat(text, chr(10), 'Current machine: ', lower(trim(target)), chr(10), 'Recent shell context:', chr(10), 'ls ', query_id % 5) AS text, target FROM asked),
{v.SQL_TERMS}, {v.SQL_DOCWORDS}, {v.sql_lexical(_LIMIT)}, {v.sql_vector(_LIMIT)}, {_TARGET},
free AS (SELECT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM target) AND {v.sql_canonical('target')} = ''),
mb AS (SELECT query_id, "index", doc_id, distance, rank, 0 AS o, 'lexical' AS origin FROM lexical WHERE query_id IN (FROM free)
 UNION ALL SELECT query_id, "index", doc_id, distance, rank, 1, 'vector' FROM vector WHERE query_id IN (FROM free)),
mk AS (SELECT mb.*, row_number() OVER (PARTITION BY query_id, mb."index", content ORDER BY o, rank, mb.doc_id) AS copy FROM mb JOIN docs USING (doc_id)),
merged AS (SELECT * FROM (SELECT query_id, "index", doc_id, distance, origin, row_number() OVER (PARTITION BY query_id, "index" ORDER BY o, rank, doc_id) AS rank FROM mk WHERE copy = 1) WHERE rank <= {_LIMIT}),
allh AS (SELECT query_id, "index", doc_id, distance, rank, origin FROM target UNION ALL SELECT query_id, "index", doc_id, distance, rank, origin FROM merged),
hd AS (SELECT a.*, row_number() OVER (PARTITION BY a.query_id ORDER BY CASE a."index" {_PLACE} ELSE 3 END, a."index", a.rank) AS position, d.machine, d.title, d.url, d.content, q.text AS query,
 {v.sql_canonical('q.target')} AS target, q.phase_bucket FROM allh a JOIN docs d USING (doc_id) JOIN asked q ON q.query_id = a.query_id),
{_RECENT},
rp AS (SELECT *, {_sql_phase('content')} AS phase, {_OV} AS ov, {_FP_SQL} AS fp, (target, {_FP_SQL}) IN (SELECT (machine, fp) FROM recent) AS shown, lower(query) AS lq, {_OV_TOK} AS qt, least({rules.PHASE_BONUS_CAP}, {_META}) AS meta FROM hd),
ro AS (SELECT *, bool_or(phase <> 'recon') OVER (PARTITION BY query_id) AS other FROM rp),
rs AS (SELECT query_id, doc_id, "index", origin, position, target, fp, round(0.65 * ov + 0.25 * greatest(0.0, least(1.0, 1.0 - distance))
 + CASE WHEN phase_bucket <> 'unknown' AND phase = phase_bucket THEN 0.20 ELSE 0.0 END + meta
 + CASE WHEN ((contains(lq, 'find') AND contains(lq, 'suid')) OR contains(lq, 'setuid') OR contains(lq, 'sudo -l')) THEN CASE "index" WHEN 'gtfobins' THEN 0.25 WHEN 'hacktricks' THEN 0.22 ELSE 0.0 END ELSE 0.0 END
 + CASE WHEN len(qt) = 1 AND length(qt[1]) <= 4 AND "index" = 'gtfobins' THEN 0.45 ELSE 0.0 END
 - CASE WHEN shown THEN 0.30 ELSE 0.0 END + 1e-9, 6) AS final_score FROM ro WHERE phase_bucket NOT IN ('user', 'root') OR NOT other OR phase <> 'recon'),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, position) AS rank FROM rs),
d0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY rank) > 1 AS later FROM reranked),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, rank) AS slot FROM d0) WHERE slot <= {K})"""
SQL_RETRIEVE = f"""{RETRIEVED} SELECT query_id, slot, "index", doc_id, origin, final_score FROM chosen"""


def retrieve_shown(spark, sf):
    """What counts as shown to each machine after a retrieval was added to the list as its next turn."""
    before, path = _shown(spark, sf), new_path(spark, "shown")
    before.write.parquet(path)
    composed.append_shown(_retrieved(spark, sf), path, F.expr("timestamp'2024-03-01 00:00:00'"), before)
    return ra.recent_fingerprints(spark.read.schema(before.schema).parquet(path))


SQL_RETRIEVE_SHOWN = f"""{RETRIEVED}, after AS (SELECT machine, turn, fp FROM sh UNION ALL SELECT DISTINCT target, (SELECT coalesce(max(turn), 0) + 1 FROM sh WHERE sh.machine = target), fp FROM chosen WHERE target <> ''),
lately AS (SELECT machine, turn FROM (SELECT machine, turn, row_number() OVER (PARTITION BY machine ORDER BY turn DESC) AS n FROM (SELECT DISTINCT machine, turn FROM after)) WHERE n <= 3)
SELECT DISTINCT machine, fp AS fingerprint FROM after JOIN lately USING (machine, turn)"""


QUERIES = {
    "flagship": (flagship, SQL_FLAGSHIP),
    "retrieve_full": (retrieve_full, SQL_RETRIEVE),
    "retrieve_shown": (retrieve_shown, SQL_RETRIEVE_SHOWN),
    "knn_cosine": (knn_cosine, SQL_KNN),
    "knn_machine": (knn_machine, SQL_KNN_MACHINE),
    "knn_blocks": (knn_blocks, SQL_KNN),
    "knn_cosine_safe": (knn_cosine_safe, SQL_SAFE),
    "pair_similarity": (pair_similarity, SQL_PAIR),
    "knn_top1": (knn_top1, SQL_TOP1),
    "query_tokens": (query_tokens, f"WITH {v.SQL_QUERIES}, {v.SQL_TERMS} SELECT query_id, ord, term FROM terms"),
    "lexical_search": (lexical, f"{CTX} SELECT * FROM lexical"),
    "lexical_join": (lexical_join, f"{CTX} SELECT * FROM lexical"),
    "title_rescue": (title_rescue, SQL_RESCUE),
    "canonical_key": (canonical_key, SQL_CANON),
    "machine_filter": (machine_filter, SQL_MACHINE),
    "target_first": (target_first, SQL_TARGET),
    "hybrid_merge": (hybrid_merge, f"{_MERGE} SELECT * FROM merged"),
    "federated": (federated, SQL_FED),
    "source_filter": (source_filter, SQL_SRCFILTER),
    "source_phrase": (source_phrase, "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'gtfobins' ELSE '' END AS named_source FROM documents"),
    "target_postfilter": (target_postfilter, SQL_POST),
    "query_expand": (query_expand, SQL_EXPAND),
    "snippet_phase": (snippet_phase, SQL_SNIP_PHASE),
    "overlap_score": (overlap_score, f"{HD} SELECT query_id, doc_id, round({_OV}, 6) AS overlap FROM hd"),
    "rerank_udf": (rerank_udf, SQL_RERANK_UDF),
    "phase_bonus": (phase_bonus, SQL_BONUS),
    "recent_penalty": (recent_penalty, SQL_RECENT),
    "recent_ttl": (recent_ttl, SQL_RECENT_TTL),
    "rerank": (rerank, f"{RR} SELECT query_id, doc_id, final_score, rank FROM reranked"),
    "diverse_topk": (diverse_topk, f'{RR}, {_DIVERSE} SELECT query_id, doc_id, "index", slot FROM selected'),
    "similarity_stats": (similarity_stats, SQL_SIM),
    "budget_trim": (budget_trim, SQL_BUDGET),
    "web_norm": (web_norm, SQL_WEB),
    "tiered_fallback": (tiered_fallback, SQL_TIER),
    "snippet_summary": (snippet_summary, SQL_SUMMARY),
    "reference_block": (reference_block, SQL_REFBLOCK),
    "web_block": (web_block, SQL_WEBBLOCK),
    "solution_block": (solution_block, SQL_SOLUTION),
    "methodology_block": (methodology_block, SQL_METH),
    "search_results": (search_results, SQL_RESULTS),
    "hits_by_source": (hits_by_source, SQL_BYSRC),
    "hits_by_title": (hits_by_title, SQL_BYTITLE),
    "recall_overlap": (recall_overlap, SQL_RECALL),
    "advisory_scan": (advisory_scan, SQL_ADVISORIES),
    "cve_enrich": (cve_enrich, SQL_CVE),
    "index_counts": (index_counts, SQL_COUNTS),
}
