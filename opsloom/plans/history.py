"""Registered history queries: (Spark query, DuckDB SQL or None).

The driver data has few commands per second, so thresholds are scaled down where a rule
would otherwise never fire; block sizes are set small so that the block paths are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom import rules
from opsloom.functions import commands as cx
from opsloom.operators import history as hi
from opsloom.operators.ordered import seconds_bucket
from opsloom.plans import views as v

BLOCK = 64
DAY = 200  # bucket width in our seconds
C = f"WITH {v.SQL_COMMANDS}"
_SIGNAL = f"""CASE WHEN length(command) > 300 OR {v.sql_prefix(v.sql_strip('command'), rules.CODE_PREFIXES)} OR {v.sql_strip('command')} IN {rules.HEREDOC_ENDS!r} OR {v.sql_contains('lower(command)', rules.PROSE_MARKS)} THEN NULL
 WHEN {v.sql_contains('lower(command)', rules.FAILURE_MARKS)} THEN 'failure' WHEN {v.sql_contains('lower(command)', rules.SUCCESS_MARKS)} THEN 'success' END"""
_WORD = "lower(CASE WHEN string_split(command, ' ')[1] IN ('sudo', 'doas') THEN string_split(command, ' ')[2] ELSE string_split(command, ' ')[1] END)"
_TECH = f"(NOT {v.sql_prefix('command', rules.CODE_PREFIXES)} AND ({_WORD} IN {rules.TOOLS!r} OR {v.sql_prefix(_WORD, rules.TOOL_PREFIXES)}))"
_PHASE = "CASE " + " ".join(f"WHEN {v.sql_match('command', ps)} THEN {v.sq(name)}" for name, ps in rules.PHASE_RULES) + " END"
_BUCKET = "CASE phase " + " ".join(f"WHEN {v.sq(a)} THEN {v.sq(b)}" for a, b in rules.PHASE_BUCKETS) + " ELSE 'unknown' END"
W = "PARTITION BY machine ORDER BY sec, seq"


def numbered(spark, sf) -> DataFrame:
    return hi.number_commands(v.commands(spark, sf), bucket=seconds_bucket("sec", DAY))


# ---------------------------------------------------------------- parsing and per-row rules
def history_parse(spark, sf):
    """History texts in the three shell formats, one per event, parsed back."""
    c = v.commands(spark, sf)
    raw = F.concat(F.lit(": 17"), F.lpad(F.col("seq").cast("string"), 8, "0"), F.lit(":0;"), "command", F.lit("\n\n- cmd: "), "command", F.lit("\n  "), "command", F.lit(" \n: 5:0;  \n"))
    return hi.parse_history(c.select("seq", raw.alias("raw"))).select("seq", "line_no", "epoch", "command")


SQL_PARSE = f"""{C} SELECT seq, 0 AS line_no, CAST(concat('17', lpad(CAST(seq AS VARCHAR), 8, '0')) AS BIGINT) AS epoch, command FROM commands
 UNION ALL SELECT seq, 2, NULL, command FROM commands UNION ALL SELECT seq, 3, NULL, command FROM commands"""


def command_hash(spark, sf):
    return v.commands(spark, sf).select("seq", cx.command_hash(F.concat(F.lit(" "), F.replace("command", F.lit(" "), F.lit(" \t ")))).alias("command_hash"))


def first_seen(spark, sf):
    return hi.first_seen(v.commands(spark, sf)).select("machine", "command", "sec", "seq")


SQL_FIRST = f"{C} SELECT machine, command, sec, seq FROM (SELECT *, row_number() OVER (PARTITION BY machine, command ORDER BY sec, seq) AS n FROM commands) WHERE n = 1"


def technical_cmd(spark, sf):
    return v.commands(spark, sf).select("seq", cx.is_technical("command").alias("technical"), cx.is_code_line(F.concat(F.lit("import "), "command")).alias("code"))


def feedback_signal(spark, sf):
    """Signals of the commands and of document lines."""
    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("line").alias("kind"), F.explode(F.split("text", "\n")).alias("command"))
    c = v.commands(spark, sf).select(F.col("seq").alias("id"), F.lit("command").alias("kind"), "command")
    s = c.unionByName(d).withColumn("signal", F.coalesce(cx.feedback_signal("command"), F.lit("none")))
    return s.groupBy("kind", "id", "signal").agg(F.count(F.lit(1)).alias("n"))


SQL_SIGNAL = f"""{C}, x AS (SELECT seq AS id, 'command' AS kind, command FROM commands UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents)
SELECT kind, id, coalesce({_SIGNAL}, 'none') AS signal, count(*) AS n FROM x GROUP BY 1, 2, 3"""


def cd_target(spark, sf):
    """cd commands in the shapes the rule tells apart."""
    shape = F.element_at(F.array(*[F.lit(s) for s in ("cd %s", "cd ~/htb/%s", "cd '%s'", "cd /abs/%s", "cd 8%s", "cd .. %s", "CD a/%s")]), (F.col("k") % 7 + 1).cast("int"))
    c = v.commands(spark, sf).select("seq", F.replace(shape, F.lit("%s"), F.regexp_extract("command", r"([A-Za-z0-9]+)$", 1)).alias("c"))
    return c.select("seq", F.coalesce(cx.cd_target("c"), F.lit("")).alias("cd_target"))


SQL_CD = f"""{C}, x AS (SELECT seq, k % 7 AS s, regexp_extract(command, '([A-Za-z0-9]+)$', 1) AS w FROM commands)
SELECT seq, CASE WHEN s IN (0, 1, 2, 6) AND regexp_matches(w, '{rules.NAME_PATTERN}') THEN lower(w) ELSE '' END AS cd_target FROM x"""


def host_target(spark, sf):
    c = v.commands(spark, sf).withColumn("c", F.concat(F.lit("ping host.htb "), "command"))
    return c.select("seq", F.coalesce(cx.host_target("c"), F.lit("")).alias("host_target"))


SQL_HOST = f"{C} SELECT seq, CASE WHEN event_type = 'click' THEN concat('box', k % 7) ELSE '' END AS host_target FROM commands"


def json_hint(spark, sf):
    c = v.commands(spark, sf).withColumn("c", F.when(F.col("k") % 3 == 0, F.concat("command", F.lit(" -oJ x"))).otherwise(F.col("command")))
    return c.select("seq", cx.needs_json_hint("c").alias("hint"))


SQL_JSONHINT = f"{C} SELECT seq, k % 3 <> 0 AND (event_type = 'click' OR (event_type = 'view' AND k % 2 = 0)) AS hint FROM commands"


def pending_hint(spark, sf):
    """First long quiet output line after each command that should have used JSON."""
    c = v.commands(spark, sf)
    out = c.filter("k % 2 = 1").select("machine", (F.col("sec") + 3).alias("sec"), F.col("seq").alias("line_id"), F.when(F.col("k") % 3 == 0, F.lit("short")).otherwise(F.repeat(F.lit("x y "), F.lit(60))).alias("line"))
    return hi.pending_json_hint(c, out, bucket=seconds_bucket("sec", DAY), block_rows=BLOCK).select("machine", "seq", "line_id")


SQL_PENDING = f"""{C}, p AS (SELECT machine, sec + 3 AS sec, seq AS line_id FROM commands WHERE k % 2 = 1 AND k % 3 <> 0),
u AS (SELECT machine, sec, 0 AS side, seq AS tie, seq, command, NULL AS line_id FROM commands UNION ALL SELECT machine, sec, 1, line_id, NULL, NULL, line_id FROM p),
a AS (SELECT *, last_value(seq IGNORE NULLS) OVER w AS cseq FROM u WINDOW w AS (PARTITION BY machine ORDER BY sec, side, tie ROWS UNBOUNDED PRECEDING)),
b AS (SELECT a.machine, cseq AS seq, a.sec, a.line_id FROM a JOIN commands c ON c.seq = a.cseq WHERE a.line_id IS NOT NULL AND (starts_with(c.command, 'nmap') OR starts_with(c.command, 'gobuster')))
SELECT machine, seq, arg_min(line_id, (sec, line_id)) AS line_id FROM b GROUP BY 1, 2"""


def history_events(spark, sf):
    a = hi.annotate(v.commands(spark, sf))
    return a.select("seq", F.coalesce("feedback_signal", F.lit("")).alias("feedback_signal"), F.coalesce("feedback_line", F.lit("")).alias("feedback_line"), "technical", "json_hint", F.coalesce("cd_target", F.lit("")).alias("cd_target"), F.coalesce("host_target", F.lit("")).alias("host_target"), "trigger")


SQL_EVENTS = f"""{C}, x AS (SELECT *, {_SIGNAL} AS s, {_TECH} AS t FROM commands)
SELECT seq, coalesce(s, '') AS feedback_signal, CASE WHEN s IS NOT NULL THEN command ELSE '' END AS feedback_line, t AS technical,
 event_type = 'click' OR (event_type = 'view' AND k % 2 = 0) AS json_hint, CASE WHEN event_type = 'signup' THEN concat('box', k % 12) ELSE '' END AS cd_target,
 CASE WHEN event_type = 'click' THEN concat('box', k % 7) ELSE '' END AS host_target, t OR s IS NOT NULL AS "trigger" FROM x"""


# ---------------------------------------------------------------- bounded look-back
def rolling_context(spark, sf):
    r = hi.rolling_context(numbered(spark, sf), block_rows=BLOCK)
    return r.select("seq", F.size("context").cast("long").alias("n_context"), F.sha2(F.array_join("context", "\n"), 256).alias("context_hash"))


SQL_ROLL = f"{C} SELECT seq, len(c) AS n_context, sha256(array_to_string(c, chr(10))) AS context_hash FROM (SELECT seq, list(command) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS c FROM commands)"


def phased(spark, sf, size: int = 3) -> DataFrame:
    return hi.running_phase(numbered(spark, sf), size=size, block_rows=BLOCK)


def phase_running(spark, sf):
    p = phased(spark, sf).select("seq", "phase", "phase_bucket")
    full = hi.running_phase(numbered(spark, sf), block_rows=BLOCK).select("seq", F.col("phase").alias("phase_50"))
    return p.join(full, "seq")


def _phased(size: int, name: str = "ph") -> str:
    return f"""{name} AS (SELECT *, {_BUCKET} AS phase_bucket FROM (SELECT *, coalesce(last_value(p IGNORE NULLS) OVER ({W} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW), '[IDLE]') AS phase FROM (SELECT *, {_PHASE} AS p FROM commands)))"""


SQL_PHASE = f"{C}, {_phased(3)}, {_phased(50, 'pf')} SELECT ph.seq, ph.phase, ph.phase_bucket, pf.phase AS phase_50 FROM ph JOIN pf USING (seq)"


def phase_changes(spark, sf):
    return hi.phase_changes(phased(spark, sf), block_rows=BLOCK).select("machine", "seq", "previous_phase", "phase")


SQL_CHANGES = f"{C}, {_phased(3)}, x AS (SELECT *, coalesce(lag(phase) OVER ({W}), '[IDLE]') AS previous_phase FROM ph) SELECT machine, seq, previous_phase, phase FROM x WHERE phase <> previous_phase"


def methodology_audit(spark, sf):
    return hi.methodology_audit(numbered(spark, sf), size=4, block_rows=BLOCK).select("machine", "seq", "command")


SQL_AUDIT = f"""{C}, x AS (SELECT *, {v.sql_match('command', rules.EXPLOIT_PATTERNS)} AS e, bool_or({v.sql_match('command', rules.RECON_PATTERNS)}) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS r FROM commands)
SELECT machine, seq, command FROM x WHERE e AND NOT r"""


def similar_command(spark, sf):
    return hi.similar_to_previous(numbered(spark, sf), block_rows=BLOCK).select("seq", "similar_command")


SQL_SIMCMD = f"{C} SELECT seq, coalesce(regexp_replace(lower(command), '[0-9]+', 'NUM', 'g') = regexp_replace(lower(lag(command) OVER ({W})), '[0-9]+', 'NUM', 'g'), false) AS similar_command FROM commands"


def similar_input(spark, sf):
    return hi.similar_to_previous(numbered(spark, sf), block_rows=BLOCK).select("seq", "similar_input")


_N = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
SQL_SIMIN = f"""{C}, x AS (SELECT seq, command, lag(command) OVER ({W}) AS p FROM commands), y AS (SELECT seq, {_N('command')} AS a, {_N('p')} AS b, p FROM x),
z AS (SELECT *, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM y)
SELECT seq, coalesce(a = b OR (a <> '' AND b <> '' AND CAST(len(list_intersect(ta, tb)) AS DOUBLE) / len(list_distinct(list_concat(ta, tb))) >= 0.6), false) AS similar_input FROM z"""


def progress_signature(spark, sf):
    """Turns: the event types of each machine; the signature spans one command, so it stays the same now and then."""
    n = numbered(spark, sf)
    return hi.progress_signature(n, command="event_type", size=1, limit=2, block_rows=BLOCK).select("seq", "signature", "turns_same", "stuck")


SQL_PROGRESS = f"""{C}, s AS (SELECT *, sha256(array_to_string(list(event_type) OVER ({W} ROWS BETWEEN 0 PRECEDING AND CURRENT ROW), chr(10))) AS signature, row_number() OVER ({W}) AS pos FROM commands),
c AS (SELECT *, signature IS DISTINCT FROM lag(signature) OVER ({W}) AS ch FROM s),
g AS (SELECT *, pos - max(CASE WHEN ch THEN pos END) OVER ({W}) AS turns_same FROM c)
SELECT seq, signature, turns_same, turns_same > 0 AND turns_same % 2 = 0 AS stuck FROM g"""


def signature_five(spark, sf):
    """The signature over the default five commands."""
    return hi.progress_signature(numbered(spark, sf), block_rows=BLOCK).select("seq", "signature")


SQL_SIG5 = f"{C} SELECT seq, sha256(array_to_string(list(command) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), chr(10))) AS signature FROM commands"


def stuck_status(spark, sf):
    n = numbered(spark, sf).withColumn("command", F.when(F.col("k") % 9 == 0, F.lit("try Command Injection")).otherwise(F.col("command")))
    return hi.stuck_status(n, block_rows=BLOCK).select("seq", "status")


_S = [v.sq(t) for t in rules.STUCK_TEXTS]
SQL_STUCK = f"""{C}, x AS (SELECT seq, lower(array_to_string(list(CASE WHEN k % 9 = 0 THEN 'try Command Injection' ELSE command END) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ' ')) AS b FROM commands)
SELECT seq, CASE WHEN contains(b, 'command injection') AND (contains(b, '/ip') OR contains(b, ' ip ') OR contains(b, 'ip parameter')) THEN {_S[0]} WHEN contains(b, 'command injection') THEN {_S[1]} WHEN contains(b, '/ip') OR contains(b, 'ip parameter') THEN {_S[2]} ELSE {_S[3]} END AS status FROM x"""


def target_switch(spark, sf):
    return hi.target_switch(numbered(spark, sf), block_rows=BLOCK).select("machine", "seq", "target")


SQL_SWITCH = f"""{C}, x AS (SELECT *, CASE event_type WHEN 'signup' THEN concat('box', k % 12) WHEN 'click' THEN concat('box', k % 7) END AS target FROM commands), y AS (SELECT *, lag(target) OVER ({W}) AS p FROM x WHERE target IS NOT NULL)
SELECT machine, seq, target FROM y WHERE target IS DISTINCT FROM p"""


# ---------------------------------------------------------------- any distance back
def retried(spark, sf) -> DataFrame:
    n = numbered(spark, sf).withColumn("command", F.col("event_type"))
    return hi.retry_loop(n, window=60, threshold=2, block_rows=BLOCK)


def retry_loop(spark, sf):
    return retried(spark, sf).select("seq", "retries", "retry_loop")


_RETRY = f"""ra AS (SELECT *, row_number() OVER ({W}) AS pos, coalesce(event_type = lag(event_type) OVER ({W}) AND sec - lag(sec) OVER ({W}) < 60, false) AS again FROM commands),
rt AS (SELECT *, pos - max(CASE WHEN NOT again THEN pos END) OVER ({W}) AS retries FROM ra)"""
SQL_RETRY = f"{C}, {_RETRY} SELECT seq, retries, retries >= 2 AS retry_loop FROM rt"


def _probes(spark, sf) -> DataFrame:
    """One probe per command some time later, and probes of machines without commands."""
    c = v.commands(spark, sf)
    own = c.select("machine", (F.col("sec") + F.col("k")).alias("sec"), F.col("seq").alias("probe_id"))
    return own.unionByName(c.filter("k = 7").select((F.col("machine") + 100000).alias("machine"), "sec", (F.col("seq") + 10000000).alias("probe_id")))


_PROBE = """pr AS (SELECT machine, sec + k AS sec, seq AS probe_id FROM commands UNION ALL SELECT machine + 100000, sec, seq + 10000000 FROM commands WHERE k = 7)"""


def stall_state(spark, sf):
    s = hi.stall_state(retried(spark, sf), _probes(spark, sf), stall=60, threshold=2, bucket=seconds_bucket("sec", DAY), block_rows=BLOCK)
    return s.select("machine", "probe_id", "elapsed", "state")


SQL_STALL = f"""{C}, {_RETRY}, {_PROBE},
u AS (SELECT machine, sec, 0 AS side, seq AS tie, sec AS seen_at, retries, NULL AS probe_id FROM rt UNION ALL SELECT machine, sec, 1, probe_id, NULL, NULL, probe_id FROM pr),
l AS (SELECT *, last_value(seen_at IGNORE NULLS) OVER w AS la, last_value(retries IGNORE NULLS) OVER w AS lr FROM u WINDOW w AS (PARTITION BY machine ORDER BY sec, side, tie ROWS UNBOUNDED PRECEDING))
SELECT machine, probe_id, sec - la AS elapsed, CASE WHEN la IS NULL THEN 'idle' WHEN lr >= 2 THEN 'retry_loop' WHEN sec - la >= 60 THEN 'stalled' WHEN sec - la >= 60 * 0.67 THEN 'stalling' ELSE 'idle' END AS state FROM l WHERE probe_id IS NOT NULL"""


def hint_level(spark, sf):
    progress = hi.progress_rows(phased(spark, sf), block_rows=BLOCK)
    h = hi.hint_levels(progress, _probes(spark, sf), limits=(40, 90), bucket=seconds_bucket("sec", DAY), block_rows=BLOCK)
    return h.select("machine", "probe_id", "elapsed", "hint_level", "allow_web")


SQL_HINT = f"""{C}, {_phased(3)}, {_PROBE}, x AS (SELECT *, coalesce(lag(phase) OVER ({W}), '[IDLE]') AS pp FROM ph), g AS (SELECT * FROM x WHERE {_TECH} OR phase <> pp),
u AS (SELECT machine, sec, 0 AS side, seq AS tie, sec AS seen_at, NULL AS probe_id FROM g UNION ALL SELECT machine, sec, 1, probe_id, NULL, probe_id FROM pr),
l AS (SELECT *, sec - last_value(seen_at IGNORE NULLS) OVER (PARTITION BY machine ORDER BY sec, side, tie ROWS UNBOUNDED PRECEDING) AS elapsed FROM u)
SELECT machine, probe_id, elapsed, CASE WHEN elapsed IS NULL OR elapsed < 40 THEN 'vague' WHEN elapsed < 90 THEN 'conceptual' ELSE 'direct' END AS hint_level, coalesce(elapsed >= 90, false) AS allow_web FROM l WHERE probe_id IS NOT NULL"""


# ---------------------------------------------------------------- sequential rules
def cooldown(spark, sf):
    """Thirty-second rule over the commands that carry a signal."""
    c = v.commands(spark, sf).filter(cx.feedback_signal("command").isNotNull())
    f = hi.cooldown(c, 30, bucket=seconds_bucket("sec", 100))
    return f.select("machine", "seq", "fired")


def _sql_cooldown(rows: str, seconds: int) -> str:
    return f"""WITH RECURSIVE {v.SQL_COMMANDS}, e AS (SELECT machine, sec, seq, row_number() OVER ({W}) AS pos FROM commands WHERE {rows}),
f AS (SELECT machine, seq, pos, sec AS last, true AS fired FROM e WHERE pos = 1
 UNION ALL SELECT e.machine, e.seq, e.pos, CASE WHEN e.sec - f.last >= {seconds} THEN e.sec ELSE f.last END, e.sec - f.last >= {seconds} FROM f JOIN e ON e.machine = f.machine AND e.pos = f.pos + 1)
SELECT machine, seq, fired FROM f"""


def coach_throttle(spark, sf):
    """Ten-second rule over the commands that would trigger."""
    c = hi.annotate(v.commands(spark, sf)).filter("trigger")
    return hi.cooldown(c, rules.COACH_SECONDS, bucket=seconds_bucket("sec", 100)).select("machine", "seq", "fired")


def guarded_cooldown(spark, sf):
    c = v.commands(spark, sf).filter(cx.feedback_signal("command").isNotNull())
    return hi.guarded_cooldown(c, 30, line="command").select("machine", "seq")


SQL_GUARDED = f"""WITH RECURSIVE {v.SQL_COMMANDS}, e AS (SELECT machine, sec, seq, command, row_number() OVER ({W}) AS pos FROM commands WHERE {_SIGNAL} IS NOT NULL),
f AS (SELECT machine, seq, pos, sec AS last, true AS fired, [command] AS seen FROM e WHERE pos = 1
 UNION ALL SELECT e.machine, e.seq, e.pos, CASE WHEN e.sec - f.last >= 30 AND NOT list_contains(f.seen, e.command) THEN e.sec ELSE f.last END,
  e.sec - f.last >= 30 AND NOT list_contains(f.seen, e.command),
  CASE WHEN e.sec - f.last >= 30 AND NOT list_contains(f.seen, e.command) THEN CASE WHEN len(f.seen) >= 200 THEN [] ELSE list_append(f.seen, e.command) END ELSE f.seen END
  FROM f JOIN e ON e.machine = f.machine AND e.pos = f.pos + 1)
SELECT machine, seq FROM f WHERE fired"""


def scoped_context(spark, sf):
    """Last commands given in the machine's working directory."""
    c = v.commands(spark, sf).withColumn("command", F.when(F.col("event_type") == "signup", F.when(F.col("k") % 3 == 0, F.lit("cd /work/area")).when(F.col("k") % 3 == 1, F.lit("cd sub")).otherwise(F.lit("cd /else"))).otherwise(F.lower("event_type")))
    s = hi.scoped_context(c.withColumn("cwd", F.lit("/work/area")), limit=20, bucket=seconds_bucket("sec", DAY))
    return s.select("machine", "seq", "command")


# Only "/" or a part of the directory in the text, or being in /work/area, puts a command in scope.
SQL_SCOPED = f"""{C}, x AS (SELECT machine, sec, seq, CASE WHEN event_type = 'signup' THEN CASE k % 3 WHEN 0 THEN 'cd /work/area' WHEN 1 THEN 'cd sub' ELSE 'cd /else' END ELSE event_type END AS command FROM commands),
y AS (SELECT *, max(CASE WHEN starts_with(command, 'cd /') THEN seq END) OVER ({W}) AS abs_at FROM x),
z AS (SELECT *, (SELECT command FROM x x2 WHERE x2.seq = y.abs_at) AS base, count(*) FILTER (WHERE command = 'cd sub') OVER (PARTITION BY machine, abs_at ORDER BY sec, seq) AS subs FROM y),
s AS (SELECT *, (coalesce(base, 'cd /work/area') = 'cd /work/area' AND subs = 0) OR contains(command, '/') OR (subs > 0 AND contains(command, 'sub')) AS ok FROM z)
SELECT machine, seq, command FROM (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY sec DESC, seq DESC) AS n FROM s WHERE ok) WHERE n <= 20
UNION ALL SELECT machine, seq, command FROM (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY sec DESC, seq DESC) AS n FROM s WHERE machine NOT IN (SELECT machine FROM s WHERE ok)) WHERE n <= 20"""


# ---------------------------------------------------------------- aggregates
def rabbit_hole(spark, sf):
    c = v.commands(spark, sf)
    used = c.select("machine", F.upper("event_type").alias("service"))
    solution = c.filter("k < 20").select("machine", F.col("event_type").alias("service"))
    return hi.rabbit_hole(used, solution, threshold=8)


SQL_RABBIT = f"""{C}, s AS (SELECT DISTINCT machine, event_type FROM commands WHERE k < 20)
SELECT machine, event_type AS service, count(*) AS n_commands FROM commands c WHERE machine IN (SELECT machine FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.machine = c.machine AND s.event_type = c.event_type) GROUP BY 1, 2 HAVING count(*) >= 8"""


def recon_summary(spark, sf):
    c = v.commands(spark, sf).withColumn("command", F.when(F.col("k") < 5, F.concat(F.lit("mount 10.9.8."), "k", F.lit(" smb"))).when(F.col("machine") % 10 == 0, "ls").otherwise(F.col("command")))
    return hi.recon_summary(c)


SQL_RECON = f"""{C}, x AS (SELECT machine, sec, seq, k, CASE WHEN k < 5 THEN concat('mount 10.9.8.', k, ' smb') WHEN machine % 10 = 0 THEN 'ls' ELSE command END AS c FROM commands)
SELECT machine, coalesce('that weird SMB share on ' || arg_max(CASE WHEN k < 5 THEN concat('10.9.8.', k) END, (sec, seq)) FILTER (WHERE k < 5),
 'your recent recon command: ' || left(arg_max(c, (sec, seq)) FILTER (WHERE {v.sql_contains('lower(c)', rules.RECON_TOOLS)}), 120), 'your last recon trail') AS recon_summary FROM x GROUP BY 1"""


def tool_suggest(spark, sf):
    return v.commands(spark, sf).select("seq", F.coalesce(cx.tool_suggestion("command"), F.lit("")).alias("suggestion"))


SQL_SUGGEST = f"{C} SELECT seq, CASE " + " ".join(f"WHEN contains(lower(command), {v.sq(t)}) THEN {v.sq(rules.TIP_MARK + x)}" for t, x in rules.TOOL_SUGGESTIONS) + " ELSE '' END AS suggestion FROM commands"


def usage_meter(spark, sf):
    return hi.usage_meter(v.commands(spark, sf), F.col("event_type") == "error", F.col("event_type") == "purchase").withColumn("meter", F.col("meter").cast("long"))


SQL_METER = f"""{C}, s AS (SELECT machine, count(*) FILTER (WHERE event_type = 'error') AS easy, count(*) FILTER (WHERE event_type = 'purchase') AS ok FROM commands GROUP BY 1)
SELECT machine, easy, ok, CAST(CASE WHEN easy + ok = 0 THEN 0 ELSE round_even(easy * 10.0 / (easy + ok), 0) END AS BIGINT) AS meter FROM s"""

QUERIES = {
    "history_parse": (history_parse, SQL_PARSE),
    "command_hash": (command_hash, f"{C} SELECT seq, sha256(command) AS command_hash FROM commands"),
    "first_seen": (first_seen, SQL_FIRST),
    "technical_cmd": (technical_cmd, f"{C} SELECT seq, {_TECH} AS technical, true AS code FROM commands"),
    "feedback_signal": (feedback_signal, SQL_SIGNAL),
    "cd_target": (cd_target, SQL_CD),
    "host_target": (host_target, SQL_HOST),
    "json_hint": (json_hint, SQL_JSONHINT),
    "pending_hint": (pending_hint, SQL_PENDING),
    "history_events": (history_events, SQL_EVENTS),
    "rolling_context": (rolling_context, SQL_ROLL),
    "phase_running": (phase_running, SQL_PHASE),
    "phase_changes": (phase_changes, SQL_CHANGES),
    "methodology_audit": (methodology_audit, SQL_AUDIT),
    "similar_command": (similar_command, SQL_SIMCMD),
    "similar_input": (similar_input, SQL_SIMIN),
    "progress_signature": (progress_signature, SQL_PROGRESS),
    "signature_five": (signature_five, SQL_SIG5),
    "stuck_status": (stuck_status, SQL_STUCK),
    "target_switch": (target_switch, SQL_SWITCH),
    "retry_loop": (retry_loop, SQL_RETRY),
    "stall_state": (stall_state, SQL_STALL),
    "hint_level": (hint_level, SQL_HINT),
    "cooldown": (cooldown, _sql_cooldown(f"{_SIGNAL} IS NOT NULL", 30)),
    "coach_throttle": (coach_throttle, _sql_cooldown(f"({_TECH} OR {_SIGNAL} IS NOT NULL)", 10)),
    "guarded_cooldown": (guarded_cooldown, SQL_GUARDED),
    "scoped_context": (scoped_context, SQL_SCOPED),
    "rabbit_hole": (rabbit_hole, SQL_RABBIT),
    "recon_summary": (recon_summary, SQL_RECON),
    "tool_suggest": (tool_suggest, SQL_SUGGEST),
    "usage_meter": (usage_meter, SQL_METER),
}
