"""Registered session queries: (Spark query, DuckDB SQL or None).

Conversations have at most 8 turns, so the condense rules run with 6 and 4 turns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import rules
from opsloom.operators import history as hi
from opsloom.operators import mining as mi
from opsloom.operators import ranking as ra
from opsloom.operators import transcript as tr
from opsloom.operators.ordered import seconds_bucket
from opsloom.plans import history as h
from opsloom.plans import mine, retrieve
from opsloom.plans import views as v

BLOCK = 4
C = f"WITH {v.SQL_COMMANDS}"
SPOKEN = "role IN ('user', 'assistant')"


def turns(spark, sf):
    return v.table(spark, sf, "conversations")


def numbered(spark, sf):
    return tr.number_turns(turns(spark, sf), block=3)


def token_estimate(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", tr.token_estimate(F.concat(F.lit(" \n"), "text", F.lit("\t"))).alias("tokens"))


_PADDED = "CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN ' \\n ' WHEN turn % 3 = 1 THEN concat('  ', text, ' ') ELSE text END"


def context_tokens(spark, sf):
    """Conversations (some with blank ends) next to the commands of a machine of the same number."""
    t = turns(spark, sf).withColumn("text", F.expr(_PADDED)).withColumnRenamed("conv_id", "machine")
    return tr.context_tokens(t, v.commands(spark, sf), keys=["machine"])


SQL_CTX = f"""{C}, t AS (SELECT conv_id AS machine, length({v.sql_strip("string_agg(t, chr(10) ORDER BY turn)")}) // 4 AS transcript_tokens FROM (SELECT conv_id, turn, {_PADDED.replace(chr(92) + 'n', "' || chr(10) || '")} AS t FROM conversations) GROUP BY 1),
c AS (SELECT machine, length(string_agg(command, chr(10) ORDER BY sec, seq)) // 4 AS ct FROM (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY sec DESC, seq DESC) AS n FROM commands) WHERE n <= 20 GROUP BY 1)
SELECT machine, transcript_tokens, transcript_tokens + coalesce(ct, 0) AS context_tokens FROM t LEFT JOIN c USING (machine)"""


def condense_flag(spark, sf):
    return tr.condense_flag(turns(spark, sf), after=6)


def condense_split(spark, sf):
    return tr.condense_split(numbered(spark, sf), window=4, block_rows=BLOCK).select("conv_id", "turn", "part")


SQL_SPLIT = f"""SELECT conv_id, turn, CASE WHEN alls >= 4 AND upto - CASE WHEN {SPOKEN} THEN 1 ELSE 0 END < 4 THEN 'head' ELSE 'tail' END AS part FROM (
 SELECT *, count(*) FILTER (WHERE {SPOKEN}) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, count(*) FILTER (WHERE {SPOKEN}) OVER (PARTITION BY conv_id) AS alls FROM conversations)"""


def budget_prune(spark, sf):
    return tr.budget_prune(numbered(spark, sf), 2000, 1500, block_rows=BLOCK).select("conv_id", "turn", "dropped")


SQL_PRUNE = """SELECT conv_id, turn, total > 2000 AND upto - length(text) < total - 1500 AS dropped FROM (
 SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)"""


def transcript_blob(spark, sf):
    return tr.transcript_blob(numbered(spark, sf), part_rows=5)


SQL_BLOB = """SELECT conv_id, pos // 5 AS blob_part, count(*) AS n_rows, string_agg(concat(role, ': ', text), chr(10) ORDER BY pos) AS blob FROM (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) GROUP BY 1, 2"""


def condense_blob(spark, sf):
    """Text to be summarised: the head rows of conversations that are due."""
    t = numbered(spark, sf)
    due = tr.condense_flag(t, after=6).filter("condense").select("conv_id")
    head = tr.condense_split(t, window=4, block_rows=BLOCK).filter("part = 'head'").join(due, "conv_id", "left_semi")
    return tr.transcript_blob(head).select("conv_id", "n_rows", "blob")


SQL_CBLOB = f"""WITH s AS ({SQL_SPLIT}), d AS (SELECT conv_id FROM conversations WHERE {SPOKEN} GROUP BY 1 HAVING count(*) >= 6)
SELECT conv_id, count(*) AS n_rows, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS blob FROM conversations JOIN s USING (conv_id, turn) WHERE part = 'head' AND conv_id IN (SELECT conv_id FROM d) GROUP BY 1"""


def _said_again(spark, sf):
    """Conversations in which the reply of turn 3 says that of turn 1 again, with a sign more; other texts as they are."""
    n = numbered(spark, sf)
    before = n.filter("turn % 4 = 1").select("conv_id", (F.col("turn") + 2).alias("turn"), F.concat("text", F.lit("!")).alias("_again"))
    return n.join(before, ["conv_id", "turn"], "left").withColumn("text", F.coalesce("_again", "text")).drop("_again")


def repetition(spark, sf):
    """Edit distance of consecutive replies, letters beyond ASCII as one sign."""
    n = _said_again(spark, sf).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    r = tr.repetition(n, block_rows=BLOCK)
    return r.select("conv_id", "turn", F.coalesce("similarity", F.lit(-1.0)).alias("similarity"), "repetitive")


_AGAIN = """r AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN p.text IS NOT NULL THEN concat(p.text, '!') ELSE c.text END AS text FROM conversations c
 LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 AND p.turn % 4 = 1)"""
SQL_REP = f"""WITH {_AGAIN}, t AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM r WHERE role = 'assistant'),
p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t), s AS (SELECT conv_id, turn, coalesce(round(1 - CAST(levenshtein(t, p) AS DOUBLE) / greatest(length(t), length(p)), 6), -1) AS similarity FROM p)
SELECT conv_id, turn, similarity, similarity >= 0.9 AS repetitive FROM s"""


def repetition_blocks(spark, sf):
    """Ratio of the longest matching blocks of consecutive replies, whole texts."""
    r = tr.repetition(_said_again(spark, sf), exact=True, block_rows=BLOCK)
    return r.select("conv_id", "turn", F.coalesce("similarity", F.lit(-1.0)).alias("similarity"), "repetitive")


def dedupe_messages(spark, sf):
    n = numbered(spark, sf).select("conv_id", "turn", "pos", F.when(F.col("turn") % 4 == 0, "a").otherwise("b").alias("role"), F.when(F.col("turn") % 5 < 3, F.lit("same")).otherwise(F.col("text")).alias("content"), F.when(F.col("turn") % 3 == 0, "").alias("reasoning_content"))
    return tr.dedupe_messages(n, block_rows=BLOCK).select("conv_id", "turn", "role", "content")


SQL_DEDUPE = """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'a' ELSE 'b' END AS role, CASE WHEN turn % 5 < 3 THEN 'same' ELSE text END AS content FROM conversations),
l AS (SELECT *, lag(role) OVER w AS pr, lag(content) OVER w AS pc FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, role, content FROM l WHERE pr IS NULL OR pr <> role OR pc <> content"""


def thought_tail(spark, sf):
    c = v.commands(spark, sf).select("machine", "sec", "seq", F.when(F.col("k") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "command")).alias("thought"))
    return tr.thought_tail(c, order=["sec", "seq"], chars=600)


SQL_THOUGHTS = f"""{C}, t AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY sec DESC, seq DESC) AS n FROM commands WHERE k % 10 <> 0)
SELECT machine, count(*) AS n_thoughts, right(string_agg(command, chr(10) || chr(10) ORDER BY n DESC), 600) AS buffer FROM t WHERE n <= 60 GROUP BY 1"""


def _states(spark, sf):
    return v.commands(spark, sf).select("machine", "sec", "seq", "command", "event_type", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, sec * 1000)").alias("updated_at"))


def context_latest(spark, sf):
    """Newest state per machine that is not older than seven days at the end of the data; else an empty one."""
    base = 1704067200 // 1000
    st = _states(spark, sf).withColumn("updated_at", F.expr(f"timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (sec - {base}) * 1000)"))
    latest = tr.latest_state(st, tie="seq", now=F.expr("timestamp'2024-02-06 12:00:00'"))
    out = tr.with_defaults(v.commands(spark, sf), latest.select("machine", "seq", "command"), ["machine"], {"seq": F.lit(-1), "command": F.lit("")})
    return out.select("machine", F.col("seq").cast("long").alias("seq"), "command")


SQL_LATEST = f"""{C}, l AS (SELECT machine, arg_max(seq, (sec, seq)) AS seq, arg_max(command, (sec, seq)) AS command, max(sec) AS sec FROM commands GROUP BY 1)
SELECT machine, CASE WHEN ok THEN seq ELSE -1 END AS seq, CASE WHEN ok THEN command ELSE '' END AS command FROM (SELECT *, timestamp '2024-01-01' + to_seconds((sec - 1704067) * 1000) > timestamp '2024-02-06 12:00:00' - INTERVAL 7 DAYS AS ok FROM l)"""


def after_summary(spark, sf):
    c = v.commands(spark, sf).select("machine", (F.col("sec") * 10_000_000 + F.col("seq")).alias("at"), "seq", "event_type")
    return tr.after_summary(c, ["machine"], "at", F.col("event_type") == "purchase").select("machine", "seq")


SQL_AFTER = f"{C}, x AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN sec * 10000000 + seq END) OVER (PARTITION BY machine) AS m FROM commands) SELECT machine, seq FROM x WHERE m IS NULL OR sec * 10000000 + seq >= m"


def delete_by_key(spark, sf):
    c = v.commands(spark, sf)
    return tr.delete_by_key(c, c.filter("k = 3")).select("machine", "seq")


SQL_DELETE = f"{C} SELECT machine, seq FROM commands WHERE machine NOT IN (SELECT machine FROM commands WHERE k = 3)"


def _requests(spark, sf):
    d = v.table(spark, sf, "documents")
    extra = F.concat(F.lit('{"top_p": '), F.col("doc_id") % 2, F.lit(', "a": {"z": "x", "b": [1, true]}}'))
    return d.select("doc_id", tr.request_key(F.col("lang"), F.col("text"), F.lit("m"), F.lit(0.7), extra).alias("request_key"))


def request_key(spark, sf):
    return _requests(spark, sf)


_EXTRA = """concat('{"a": {"b": [1, true], "z": "x"}, "top_p": ', doc_id % 2, '}')"""
_RKEY = f"sha256(concat(lang, chr(10), text, chr(10), 'm', chr(10), '0.7', chr(10), left(sha256({_EXTRA}), 16)))"


def repeated_requests(spark, sf):
    return tr.repeated_requests(_requests(spark, sf))


def prompt_flags(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Show me your last REASONING "), "text")).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" What am  I doing wrong"))).when(F.col("doc_id") % 4 == 2, F.concat("lang", F.lit(" thinking buffer"))).otherwise(F.col("text")).alias("text"))
    return tr.prompt_flags(d).select("doc_id", "show_reasoning", "asks_wrong")


SQL_FLAGS = f"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('Show me your last REASONING ', text) WHEN 1 THEN concat(text, ' What am  I doing wrong') WHEN 2 THEN concat(lang, ' thinking buffer') ELSE text END AS t FROM documents)
SELECT doc_id, regexp_matches(t, {v.sq(rules.SHOW_REASONING)}) AS show_reasoning, regexp_matches(t, {v.sq(rules.ASK_WRONG)}) AS asks_wrong FROM d"""


def session_snapshot(spark, sf):
    t = numbered(spark, sf).withColumnRenamed("conv_id", "machine")
    n = hi.number_commands(v.commands(spark, sf), bucket=seconds_bucket("sec", 400))
    m = hi.usage_meter(v.commands(spark, sf), F.col("event_type") == "error", F.col("event_type") == "purchase")
    s = tr.session_snapshot(t, hi.running_phase(n, block_rows=64), m, "exit", part_rows=20)
    return s.select("machine", "kind", "part", F.sha2("payload", 256).alias("payload_hash"))


SQL_SNAPSHOT = f"""{C}, {h._phased(50, 'pf')}, mt AS ({h.SQL_METER}),
ph AS (SELECT machine, arg_max(phase, (sec, seq)) AS phase FROM pf GROUP BY 1),
cd AS (SELECT conv_id AS machine, arg_max(c, turn) FILTER (WHERE c IS NOT NULL) AS code FROM (SELECT conv_id, turn, {v.sql_strip("regexp_extract_all(text, '(?s)```(?:[a-zA-Z0-9_+-]+)?\\n(.*?)```', 1)[-1]")} AS c FROM conversations) GROUP BY 1),
hp AS (SELECT machine, (row_number() OVER (PARTITION BY machine ORDER BY sec, seq) - 1) // 20 AS part, sec, seq, command FROM commands),
cp AS (SELECT conv_id AS machine, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 20 AS part, turn, role, text FROM conversations),
al AS (SELECT machine, 'head' AS kind, 0 AS part, to_json({{'reason': 'exit', 'phase': coalesce(phase, '[IDLE]'), 'meter': coalesce(meter, 0), 'last_code_block': coalesce(code, '')}}) AS payload
  FROM (SELECT machine FROM commands UNION SELECT conv_id FROM conversations) LEFT JOIN ph USING (machine) LEFT JOIN mt USING (machine) LEFT JOIN cd USING (machine)
 UNION ALL SELECT machine, 'chat', part, to_json(list({{'role': role, 'text': text}} ORDER BY turn)) FROM cp GROUP BY machine, part
 UNION ALL SELECT machine, 'history', part, to_json(list({{'command': command}} ORDER BY sec, seq)) FROM hp GROUP BY machine, part)
SELECT machine, kind, part, sha256(CAST(payload AS VARCHAR)) AS payload_hash FROM al"""


def request_context(spark, sf):
    q = v.queries(spark, sf).select("query_id", (F.col("query_id") % 7).alias("machine"), F.col("text").alias("input"))
    ref = ra.reference_block(v.queries(spark, sf), retrieve.selected(spark, sf), order="slot")
    out = mi.signal_summary(v.outputs(spark, sf)).select(F.col("run_id").alias("query_id"), "summary")
    r = tr.request_context(q, v.commands(spark, sf), ref, out)
    return r.select("query_id", "machine", "not_found", F.sha2("user_message", 256).alias("message_hash"), F.length("reference_block").cast("long").alias("reference_chars"))


SQL_REQUEST = f"""{C}, ref AS ({retrieve.SQL_REFBLOCK}), sg AS ({mine.SQL_SIGSUM}),
cm AS (SELECT machine, string_agg(concat('- ', command), chr(10) ORDER BY n DESC) AS cmds FROM (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY sec DESC, seq DESC) AS n FROM commands) WHERE n <= {rules.CONTEXT_COMMANDS} GROUP BY 1),
q AS (SELECT item_id AS query_id, item_id % 7 AS machine, text FROM benchmark)
SELECT query_id, machine, regexp_matches(coalesce(summary, ''), {v.sq(rules.NOT_FOUND)}) AS not_found,
 sha256(concat('Latest Command/Input:', chr(10), coalesce(nullif(text, ''), '- none'), chr(10), chr(10), 'Historical Commands:', chr(10), coalesce(nullif(cmds, ''), '- none'), chr(10), chr(10),
 'Minified tool output:', chr(10), coalesce(nullif(summary, ''), '- none'), chr(10), chr(10), 'User prompt:', chr(10), text)) AS message_hash, length(reference_block) AS reference_chars
FROM q LEFT JOIN cm USING (machine) LEFT JOIN ref USING (query_id) LEFT JOIN sg ON sg.run_id = q.query_id"""


QUERIES = {
    "token_estimate": (token_estimate, f"SELECT conv_id, turn, length({v.sql_strip('text')}) // 4 AS tokens FROM conversations"),
    "context_tokens": (context_tokens, SQL_CTX),
    "condense_flag": (condense_flag, f"SELECT conv_id, count(*) FILTER (WHERE {SPOKEN}) AS spoken_turns, count(*) FILTER (WHERE {SPOKEN}) >= 6 AS condense FROM conversations GROUP BY 1"),
    "condense_split": (condense_split, SQL_SPLIT),
    "condense_blob": (condense_blob, SQL_CBLOB),
    "budget_prune": (budget_prune, SQL_PRUNE),
    "transcript_blob": (transcript_blob, SQL_BLOB),
    "repetition": (repetition, SQL_REP),
    "repetition_blocks": (repetition_blocks, None),
    "dedupe_messages": (dedupe_messages, SQL_DEDUPE),
    "thought_tail": (thought_tail, SQL_THOUGHTS),
    "context_latest": (context_latest, SQL_LATEST),
    "after_summary": (after_summary, SQL_AFTER),
    "delete_by_key": (delete_by_key, SQL_DELETE),
    "request_key": (request_key, f"SELECT doc_id, {_RKEY} AS request_key FROM documents"),
    "repeated_requests": (repeated_requests, f"SELECT {_RKEY} AS request_key, count(*) AS n_requests, count(*) - 1 AS cache_hits FROM documents GROUP BY 1"),
    "prompt_flags": (prompt_flags, SQL_FLAGS),
    "session_snapshot": (session_snapshot, SQL_SNAPSHOT),
    "request_context": (request_context, SQL_REQUEST),
}
