"""Registered tool-output queries: (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import rules
from opsloom.operators import mining as mi
from opsloom.plans import views as v
from opsloom.sources import readers

O = f"WITH {v.SQL_OUTPUTS}"
_LINES = f"""ln AS (SELECT * FROM (SELECT run_id, event_type, command, i, {v.sql_strip('l')} AS l FROM (
 SELECT run_id, event_type, command, unnest(string_split(output, chr(10))) AS l, generate_subscripts(string_split(output, chr(10)), 1) AS i FROM outputs)) WHERE l <> '')"""
OL = f"{O}, {_LINES}"


def tool_route(spark, sf):
    return v.outputs(spark, sf).select("run_id", mi.route("command", "output").alias("tool"))


_ROUTE = """CASE event_type WHEN 'view' THEN CASE WHEN k % 4 = 1 THEN 'services_json' WHEN k % 4 = 2 THEN 'services_xml' ELSE 'services_text' END
 WHEN 'click' THEN 'paths' WHEN 'signup' THEN 'edges' WHEN 'error' THEN 'injection' ELSE 'privesc' END"""


def sniff_format(spark, sf):
    """Outputs as they are, and documents as one line, as CSV and as JSON."""
    o = v.outputs(spark, sf).select(F.lit("output").alias("kind"), F.col("run_id").alias("id"), F.col("output").alias("t"))
    d = v.table(spark, sf, "documents")
    c = d.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" a,b\n"), F.col("doc_id"), F.lit(",2\n\n"))).when(
        F.col("doc_id") % 4 == 1, F.to_json(F.struct("doc_id", "text"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("<broken>"), "lang", F.lit("</b>"))).otherwise(F.col("text")).alias("t"))
    return o.unionByName(c).select("kind", "id", mi.sniff_format("t").alias("format"))


SQL_SNIFF = f"""{O} SELECT 'output' AS kind, run_id AS id, CASE WHEN event_type = 'view' AND k % 4 = 1 THEN 'json' WHEN event_type = 'view' AND k % 4 = 2 THEN 'xml' ELSE 'raw' END AS format FROM outputs
 UNION ALL SELECT 'doc', doc_id, CASE WHEN doc_id % 4 = 0 THEN 'csv' WHEN doc_id % 4 = 1 THEN 'json' WHEN doc_id % 4 = 2 THEN 'raw'
 WHEN (SELECT count(*) >= 2 AND bool_and(contains(x, ',')) FROM (SELECT unnest(string_split(text, chr(10))) AS x) WHERE trim(x) <> '') THEN 'csv' ELSE 'raw' END FROM documents"""


def parse_output(spark, sf):
    o = v.outputs(spark, sf).filter("event_type = 'view'").withColumn("output", F.when(F.col("k") % 8 == 0, F.concat(F.lit('h1,"x, ""y"""\n'), "k", F.lit(",\n"))).otherwise(F.col("output")))
    p = mi.parse_output(o)
    return p.select(
        "run_id", "format", F.coalesce(F.try_variant_get("data", "$[0].ports[2].port", "bigint"), F.lit(0)).alias("third_port"),
        F.coalesce(F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";"), F.lit("")).alias("cells"),
    )


SQL_PARSE = f"""{O} SELECT run_id, CASE WHEN k % 8 = 0 THEN 'csv' WHEN k % 4 = 1 THEN 'json' WHEN k % 4 = 2 THEN 'xml' ELSE 'raw' END AS format,
 CASE WHEN k % 4 = 1 THEN 1000 + k ELSE 0 END AS third_port, CASE WHEN k % 8 = 0 THEN concat('h1|x, "y";', k, '|') ELSE '' END AS cells FROM outputs WHERE event_type = 'view'"""


def _route_is(spark, sf, name):
    o = v.outputs(spark, sf)
    return o.filter(mi.route("command", "output") == name)


def services_text(spark, sf):
    s = mi.services_text(_route_is(spark, sf, "services_text"))
    return s.select("run_id", "item", "port", "protocol", "service", "version")


_OPEN = v.sq(rules.OPEN_PORT)
SQL_ST = f"""{OL} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY i) AS item, regexp_extract(l, {_OPEN}, 1) AS port, lower(regexp_extract(l, '^[0-9]+/([a-z]+)', 1)) AS protocol, regexp_extract(l, {_OPEN}, 2) AS service, regexp_extract(l, {_OPEN}, 3) AS version
 FROM ln WHERE event_type = 'view' AND NOT starts_with(l, '[') AND NOT starts_with(l, '<') AND regexp_matches(l, {_OPEN})"""


def services_json(spark, sf):
    return mi.services_json(_route_is(spark, sf, "services_json"))


SQL_SJ = f"""{O}, j AS (SELECT run_id, k FROM outputs WHERE event_type = 'view' AND k % 4 = 1)
SELECT run_id, 1 AS item, concat('10.0.0.', k) AS host, '22' AS port, 'tcp' AS protocol, 'ssh' AS service, concat('9.', k % 10) AS version FROM j
 UNION ALL SELECT run_id, 2, concat('10.0.0.', k), CAST(1000 + k AS VARCHAR), 'udp', '', '' FROM j
 UNION ALL SELECT run_id, 3, concat('h', k), '443', 'tcp', 'https', '' FROM j"""


def services_xml(spark, sf):
    return mi.services_xml(_route_is(spark, sf, "services_xml"))


SQL_SX = f"""{O} SELECT run_id, 1 AS item, concat('10.1.0.', k) AS host, CAST(2000 + k AS VARCHAR) AS port, 'tcp' AS protocol, concat('svc', k % 9) AS service, concat('v', k % 4) AS version FROM outputs WHERE event_type = 'view' AND k % 4 = 2"""


def service_counts(spark, sf):
    """All scans as one table, rolled up by service."""
    return mi.services(v.outputs(spark, sf)).groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"))


SQL_SC = f"""WITH t AS ({SQL_ST}), j AS ({SQL_SJ}), x AS ({SQL_SX}), u AS (SELECT run_id, service FROM t UNION ALL SELECT run_id, service FROM j UNION ALL SELECT run_id, service FROM x)
SELECT service, count(*) AS n, count(DISTINCT run_id) AS runs FROM u GROUP BY 1"""


def paths(spark, sf):
    p = mi.found_paths(_route_is(spark, sf, "paths"))
    return p.select("run_id", "item", "path", F.col("status").cast("long").alias("status"), "size")


SQL_PATHS = f"""{O} SELECT run_id, 1 AS item, concat('/admin', k) AS path, 301 AS status, k * 7 AS size FROM outputs WHERE event_type = 'click' AND k % 5 <> 0
 UNION ALL SELECT run_id, 2, '/login', 200, NULL FROM outputs WHERE event_type = 'click' AND k % 5 <> 0"""


def keyword_lines(spark, sf):
    return mi.keyword_lines(_route_is(spark, sf, "injection"))


SQL_KW = f"""{OL}, m AS (SELECT *, {v.sql_contains('lower(l)', rules.INJECTION_WORDS)} AS hit, regexp_matches(lower(l), '\\[(info|critical)\\]') AS rest FROM ln WHERE event_type = 'error'),
a AS (SELECT *, bool_or(hit) OVER (PARTITION BY run_id) AS ah, bool_or(rest) OVER (PARTITION BY run_id) AS ar FROM m)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY i) AS item, l AS line FROM a WHERE hit OR (NOT ah AND (rest OR NOT ar))"""


def edges(spark, sf):
    return mi.edges(_route_is(spark, sf, "edges"))


SQL_EDGES = f"""{O} SELECT run_id, 1 AS item, concat('USER', k) AS src, concat('DOMAIN', k % 5) AS dst, 'MemberOf' AS rel FROM outputs WHERE event_type = 'signup'
 UNION ALL SELECT run_id, 2, concat('SRV', k % 7, '$'), concat('USER', k), 'linked' FROM outputs WHERE event_type = 'signup'"""


def edge_degrees(spark, sf):
    return mi.edge_degrees(edges(spark, sf))


SQL_DEG = f"""WITH e AS ({SQL_EDGES}), n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM n GROUP BY 1"""


def privesc_lines(spark, sf):
    return mi.privesc_lines(_route_is(spark, sf, "privesc"))


SQL_PRIV = f"""{O} SELECT run_id, 1 AS item, concat('RED: /etc/shadow ', k) AS line FROM outputs WHERE event_type = 'purchase'
 UNION ALL SELECT run_id, 2, concat('YELLOW: sudo -l shows NOPASSWD ', k % 3) FROM outputs WHERE event_type = 'purchase'"""


def head_lines(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.sha2(mi.head_lines("text", 3), 256).alias("head_hash"))


SQL_HEAD = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, {v.sql_strip('l')} AS l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l WHERE {v.sql_strip('l')} <> '')
SELECT d.doc_id, sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (WHERE n <= 3), '')) AS head_hash FROM documents d LEFT JOIN n USING (doc_id) GROUP BY 1"""


def compact_lines(spark, sf):
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(mi.compact_lines("text", max_lines=4), 256).alias("compact_hash"))


SQL_COMPACT = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, {v.sql_strip("regexp_replace(l, '\\s+', ' ', 'g')")} AS l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM l WHERE {v.sql_strip('l')} <> '')
SELECT d.doc_id, sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (WHERE n <= 4) || CASE WHEN max(c) > 4 THEN concat(chr(10), '... (', max(c) - 4, ' lines omitted)') ELSE '' END, '')) AS compact_hash FROM documents d LEFT JOIN n USING (doc_id) GROUP BY 1"""


def compact_tools(spark, sf):
    """The tool-specific filters."""
    o = v.outputs(spark, sf).filter("event_type IN ('view', 'click')")
    return o.select("run_id", mi.compact_lines("output", "command").alias("compact"))


SQL_COMPACT_TOOLS = f"""{O} SELECT run_id, CASE WHEN event_type = 'click' THEN CASE WHEN k % 5 = 0 THEN concat('/plain', k) ELSE concat('/admin', k, ' (Status: 301) [Size: ', k * 7, ']', chr(10), '/login (Status: 200)') END
 WHEN k % 4 IN (1, 2) THEN output WHEN k % 4 = 3 THEN concat('Host is up (0.', k, 's)', chr(10), '80/tcp closed http')
 ELSE concat(k, '/tcp open ssh OpenSSH 9.', k % 10, chr(10), '80/tcp closed http', chr(10), '443/udp open https nginx 1.', k) END AS compact FROM outputs WHERE event_type IN ('view', 'click')"""


def signal_summary(spark, sf):
    return mi.signal_summary(v.outputs(spark, sf))


_H = "'### Signal Summary: '"
SQL_SIGSUM = f"""{O}, r AS (SELECT *, {_ROUTE} AS tool FROM outputs), kw AS ({SQL_KW.replace(OL, 'WITH ' + _LINES, 1)}),
kt AS (SELECT run_id, string_agg(concat('- ', line), chr(10) ORDER BY item) AS t FROM kw WHERE item <= 25 GROUP BY 1)
SELECT run_id, tool, CASE tool
 WHEN 'services_json' THEN concat('{{"nmap_summary":[{{"host":"10.0.0.', k, '","port":"22","protocol":"tcp","service":"ssh","version":"9.', k % 10, '"}},{{"host":"10.0.0.', k, '","port":"', 1000 + k, '","protocol":"udp","service":"","version":""}},{{"host":"h', k, '","port":"443","protocol":"tcp","service":"https","version":""}}]}}')
 WHEN 'services_xml' THEN concat('{{"nmap_summary":[{{"host":"10.1.0.', k, '","port":"', 2000 + k, '","protocol":"tcp","service":"svc', k % 9, '","version":"v', k % 4, '"}}]}}')
 WHEN 'services_text' THEN CASE WHEN k % 4 = 3 THEN concat({_H}, 'Nmap Summary', chr(10), '- Host is up (0.', k, 's)') ELSE concat({_H}, 'Nmap Open Services', chr(10), '- ', k, ' ssh OpenSSH 9.', k % 10, chr(10), '- 443 https nginx 1.', k) END
 WHEN 'paths' THEN concat({_H}, 'Gobuster Paths', chr(10), CASE WHEN k % 5 = 0 THEN concat('- /plain', k) ELSE concat('- /admin', k, ' status=301 size=', k * 7, chr(10), '- /login status=200 size=?') END)
 WHEN 'edges' THEN concat({_H}, 'BloodHound Signals', chr(10), '- USER', k, ' -> DOMAIN', k % 5, ' (MemberOf)', chr(10), '- SRV', k % 7, '$ -> USER', k, ' (linked)')
 WHEN 'injection' THEN concat({_H}, 'SQLMap Findings', chr(10), t)
 ELSE concat({_H}, 'LinPEAS High-Priority Findings', chr(10), '- RED: /etc/shadow ', k, chr(10), '- YELLOW: sudo -l shows NOPASSWD ', k % 3) END AS summary FROM r LEFT JOIN kt USING (run_id)"""


# ---------------------------------------------------------------- findings
_PATTERNS = rules.FINDING_PATTERNS_PROSE + rules.FINDING_PATTERNS


def doc_findings(spark, sf):
    """Findings in documents, with manual ones that repeat an automatic one or are new."""
    d = v.table(spark, sf, "documents").select("doc_id", "text", "source")
    manual = d.filter("doc_id % 10 = 0").select("doc_id", F.lit("config").alias("type"), "source", F.col("source").alias("value")).drop("source")
    return mi.findings(d, patterns=_PATTERNS, manual=manual)


def findings(spark, sf):
    return doc_findings(spark, sf).select("doc_id", "type", "value", "source", "pattern_no", "match_no")


def _sql_findings() -> str:
    arms = "\n UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS type, {n} AS p, generate_subscripts(m, 1) - 1 AS i, unnest(m) AS raw FROM (SELECT doc_id, regexp_extract_all(text, {v.sq(p)}, 1) AS m FROM documents)"
        for n, (kind, p) in enumerate(_PATTERNS)
    )
    value = f"trim({v.sql_strip('raw')}, '\"''`')"
    return f"""WITH a AS ({arms}), b AS (SELECT doc_id, type, p, i, {value} AS value, 'terminal_output' AS source FROM a
 UNION ALL SELECT doc_id, 'config', {len(_PATTERNS)}, 0, source, 'manual' FROM documents WHERE doc_id % 10 = 0),
findings AS (SELECT doc_id, type, value, source, p AS pattern_no, i AS match_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY p, i) AS n FROM b) WHERE n = 1)"""


def findings_report(spark, sf):
    r = mi.findings_report(doc_findings(spark, sf), scope="doc_id", part_rows=10**9)
    return r.select("doc_id", "type", "type_no", "n_findings", "report")


_ORD = list(rules.FINDING_REPORT_ORDER)
_ICON = "CASE type " + " ".join(f"WHEN '{t}' THEN {v.sq(i)}" for t, i in rules.FINDING_ICONS.items()) + " END"
SQL_REPORT = f"""{_sql_findings()} SELECT doc_id, type, list_position({_ORD!r}, type) AS type_no, count(*) AS n_findings,
 string_agg(concat('- ', {_ICON}, ' **', upper(type), '**: `', value, '`'), chr(10) ORDER BY value COLLATE "C") AS report FROM findings GROUP BY 1, 2""".replace(' COLLATE "C"', "")


def findings_markdown(spark, sf):
    """Reports of all documents, in parts of three findings, with the language as context of what was found in the text."""
    d = v.table(spark, sf, "documents")
    manual = d.filter("lang = 'de'").select("doc_id", F.lit("config").alias("type"), F.concat("source", F.lit(".conf")).alias("value"), F.lit(7).alias("position"), F.lit("by hand").alias("context"))
    return mi.findings_markdown(mi.findings(d, patterns=_PATTERNS, manual=manual, context="lang"), d, part_rows=3).select("doc_id", "part_no", "n_findings", F.sha2("report", 256).alias("report_hash"))


_HEADING = "CASE type " + " ".join(f"WHEN '{t}' THEN {v.sq(x)}" for t, x in rules.FINDING_HEADINGS.items()) + " END"
SQL_MARKDOWN = f"""{_sql_findings().replace(f"SELECT doc_id, 'config', {len(_PATTERNS)}, 0, source, 'manual' FROM documents WHERE doc_id % 10 = 0", f"SELECT doc_id, 'config', {len(_PATTERNS)}, 7, source || '.conf', 'manual' FROM documents WHERE lang = 'de'")},
f AS (SELECT f.*, list_position({_ORD!r}, type) AS type_no, CASE WHEN f.source = 'manual' THEN 'by hand' ELSE d.lang END AS told FROM findings f JOIN documents d ON d.doc_id = f.doc_id),
bl AS (SELECT doc_id, type, type_no, pattern_no, match_no // 3 AS blk, count(*) AS n, string_agg(concat('- ', {_ICON}, ' **', upper(type), '**: `', value, '`', CASE WHEN told <> '' THEN concat(' (', told, ')') ELSE '' END), chr(10) ORDER BY match_no) AS t FROM f GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT *, row_number() OVER w AS no, lag(type) OVER w AS before, lead(type) OVER w AS after FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY type_no, pattern_no, blk))
SELECT d.doc_id, coalesce(no, 1) - 1 AS part_no, coalesce(n, 0) AS n_findings, sha256(CASE WHEN no IS NULL THEN {v.sq(rules.FINDING_TITLE + chr(10) + rules.FINDING_NONE)}
 ELSE concat(CASE WHEN no = 1 THEN {v.sq(rules.FINDING_TITLE + chr(10))} ELSE '' END, CASE WHEN type IS NOT DISTINCT FROM before THEN '' ELSE concat('### ', {_HEADING}, chr(10), chr(10)) END, t, CASE WHEN type IS NOT DISTINCT FROM after THEN '' ELSE chr(10) END) END) AS report_hash
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id"""


def findings_total(spark, sf):
    """Corpus-wide report parts, reduced to their sizes."""
    f = mi.findings(v.outputs(spark, sf), scope="run_id", text="output")
    r = mi.findings_report(f, part_rows=100)
    return r.groupBy("type").agg(F.sum("n_findings").alias("n_findings"), F.max(F.col("n_findings") > 250).alias("oversize"))


SQL_TOTAL = f"""{O} SELECT type, CAST(sum(n) AS BIGINT) AS n_findings, false AS oversize FROM (SELECT unnest(['password', 'port', 'cve', 'user']) AS type, count(*) AS n FROM outputs WHERE event_type = 'error' GROUP BY 1
 UNION ALL SELECT 'password', count(*) FROM outputs WHERE event_type = 'purchase') GROUP BY 1"""


# ---------------------------------------------------------------- replies and runs
def _replies(spark, sf):
    c = v.table(spark, sf, "conversations")
    shape = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("<Thought> t "), "role", F.lit("</THOUGHT>"), "text", F.lit("<thought>b</thought>")))
    shape = shape.when(F.col("turn") % 5 == 1, F.concat(F.lit("thought\nthe "), "role", F.lit("\nResponse:\n\"say "), "conv_id", F.lit("\"")))
    shape = shape.when(F.col("turn") % 5 == 2, F.concat(F.lit("<thought>only "), "conv_id", F.lit("</thought> \n")))
    shape = shape.when(F.col("turn") % 5 == 3, "  ").otherwise(F.concat(F.lit("intro "), "conv_id", F.lit(" response: 'it'")))
    return c.select("conv_id", "turn", shape.alias("content"), F.when(F.col("turn") % 5 == 3, F.concat(F.lit("why "), "conv_id")).alias("reasoning"), "role", "text")


def thought_split(spark, sf):
    t = mi.thought_split(_replies(spark, sf), reasoning="reasoning")
    return t.select("conv_id", "turn", "thought", "answer", "reasoning")


SQL_THOUGHT = f"""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN concat('t ', role, chr(10), chr(10), 'b') WHEN 1 THEN concat('the ', role) WHEN 2 THEN concat('only ', conv_id) ELSE '' END AS thought,
 CASE turn % 5 WHEN 0 THEN {v.sql_strip('text')} WHEN 1 THEN concat('say ', conv_id) WHEN 2 THEN concat('only ', conv_id) WHEN 3 THEN concat('why ', conv_id) ELSE 'it' END AS answer, '' AS reasoning FROM conversations"""


def strip_markup(spark, sf):
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(mi.strip_markup(F.concat(F.lit("[bold]"), "text", F.lit("[/bold][red]x[/red][dim][/dim][green]"))), 256).alias("plain_hash"))


def notfound_flag(spark, sf):
    return v.outputs(spark, sf).select("run_id", mi.not_found("output").alias("not_found"))


def run_rollup(spark, sf):
    return mi.run_rollup(mi.run_results(v.outputs(spark, sf)))


_NL = "len(string_split(output, chr(10)))"
SQL_RUNS = f"""{O}, t AS (SELECT CASE event_type WHEN 'view' THEN 'nmap' WHEN 'click' THEN 'gobuster' WHEN 'signup' THEN 'bloodhound-python' WHEN 'error' THEN 'sqlmap' ELSE './linpeas.sh' END AS tool, exit_code, {_NL} AS n FROM outputs)
SELECT tool, count(*) AS runs, count(*) FILTER (WHERE exit_code = 0) AS ok_runs, round(avg(n), 6) AS avg_lines FROM t GROUP BY 1"""


# ---------------------------------------------------------------- traces
def trace_metrics(spark, sf):
    """Trace lines built from the events, read back and rolled up."""
    ev = v.table(spark, sf, "events").select("event_id", "event_type", F.expr(v._K).alias("k"))
    usage = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"tokens_cached":'), "k", F.lit(',"total_tokens":'), "k", F.lit("}"))).when(
        F.col("k") % 3 == 1, F.concat(F.lit('{"prompt_tokens_details":{"cached_tokens":'), F.col("k") - 50, F.lit('},"total_tokens":7}'))
    ).otherwise('{"total_tokens":1}')
    timing = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"total_ms":0,"latency_ms":'), F.col("k") * 10, F.lit("}"))).otherwise("null")
    line = F.concat(
        F.lit('{"ts":"2024-01-01T00:00:00+00:00","event":"x","trace_id":"'), "event_id", F.lit('","provider":"p0","machine":"m","payload":{"provider":"'), "event_type",
        F.lit('","model":"m1","latency_ms":33,"usage":'), usage, F.lit(',"timings":'), timing, F.lit("}}"),
    )
    return readers.metrics_rollup(readers.completion_metrics(readers.traces_from_text(ev.select(line.alias("value"))))).drop("p50_latency_ms")


SQL_TRACE = f"""WITH e AS (SELECT event_type AS provider, {v._K} AS k FROM events), m AS (SELECT provider, CASE WHEN k % 2 = 0 AND k > 0 THEN k * 10 WHEN k % 2 = 0 THEN 33 ELSE 33 END AS ms,
 CASE k % 3 WHEN 0 THEN k WHEN 1 THEN greatest(0, k - 50) ELSE 0 END AS c, CASE k % 3 WHEN 0 THEN k WHEN 1 THEN 7 ELSE 1 END AS t FROM e)
SELECT provider, 'm1' AS model, count(*) AS n, round(avg(ms), 6) AS avg_latency_ms, CAST(sum(c) AS BIGINT) AS tokens_cached, count(*) FILTER (WHERE c > 0) AS cache_hits, CAST(sum(t) AS BIGINT) AS total_tokens FROM m GROUP BY 1"""


QUERIES = {
    "tool_route": (tool_route, f"{O} SELECT run_id, {_ROUTE} AS tool FROM outputs"),
    "sniff_format": (sniff_format, SQL_SNIFF),
    "parse_output": (parse_output, SQL_PARSE),
    "services_text": (services_text, SQL_ST),
    "services_json": (services_json, SQL_SJ),
    "services_xml": (services_xml, SQL_SX),
    "service_counts": (service_counts, SQL_SC),
    "paths": (paths, SQL_PATHS),
    "keyword_lines": (keyword_lines, SQL_KW),
    "edges": (edges, SQL_EDGES),
    "edge_degrees": (edge_degrees, SQL_DEG),
    "privesc_lines": (privesc_lines, SQL_PRIV),
    "head_lines": (head_lines, SQL_HEAD),
    "compact_lines": (compact_lines, SQL_COMPACT),
    "compact_tools": (compact_tools, SQL_COMPACT_TOOLS),
    "signal_summary": (signal_summary, SQL_SIGSUM),
    "findings": (findings, f"{_sql_findings()} SELECT * FROM findings"),
    "findings_markdown": (findings_markdown, SQL_MARKDOWN),
    "findings_report": (findings_report, SQL_REPORT),
    "findings_total": (findings_total, SQL_TOTAL),
    "thought_split": (thought_split, SQL_THOUGHT),
    "strip_markup": (strip_markup, "SELECT doc_id, sha256(concat(text, 'x[green]')) AS plain_hash FROM documents"),
    "notfound_flag": (notfound_flag, f"{O} SELECT run_id, event_type = 'click' AND k % 5 = 0 AS not_found FROM outputs"),
    "run_rollup": (run_rollup, SQL_RUNS),
    "trace_metrics": (trace_metrics, SQL_TRACE),
}
