"""The driver tables as this package's input tables, and the same derivations as SQL text.

``commands`` and ``outputs`` are derived from ``events``, the retrieval corpus from
``documents``, the markdown texts from ``documents`` by turning some line starts into
headings.  Every row of a driver table gives a row here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom import rules
from opsloom.session import spread


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(scan(spark, sf_dir, name))


def sq(s: str) -> str:
    """SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_contains(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {sq(w)})" for w in words) + ")"


def sql_prefix(c: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({c}, {sq(w)})" for w in words) + ")"


def sql_match(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {sq(p)})" for p in patterns) + ")"


def sql_group(c: str, groups, default: str) -> str:
    cases = " ".join(f"WHEN {sql_contains(c, words)} THEN {sq(name)}" for name, words in groups)
    return f"CASE {cases} ELSE {sq(default)} END"


_ws = "".join(f"chr({ord(ch)})||" for ch in rules.WHITESPACE).rstrip("|")
SQL_WS = f"({_ws})"


def sql_strip(c: str) -> str:
    return f"trim({c}, {SQL_WS})"


# ---------------------------------------------------------------- commands and outputs
SECONDS = "unix_date(to_date(ts)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))"

_COMMAND_CASE = """CASE event_type
 WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN concat('nmap -sV 10.10.10.', k) ELSE concat('sudo masscan -p1-65535 10.10.11.', k) END
 WHEN 'click' THEN concat('gobuster dir -u http://box', k % 7, '.htb/ip', k)
 WHEN 'signup' THEN concat('cd htb/Box', k % 12)
 WHEN 'error' THEN CASE k % 3 WHEN 0 THEN concat('smbclient //10.10.10.', k, '/share: Access denied') WHEN 1 THEN concat('python3 exploit', k, '.py') ELSE concat('Connection refused by 10.10.10.', k) END
 ELSE CASE k % 4 WHEN 0 THEN 'whoami' WHEN 1 THEN 'id: uid=0(root) gid=0(root)' WHEN 2 THEN concat('echo done ', k) ELSE 'msfconsole -q' END
END"""

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """machine, sec, seq, event_type, k, command.  One "second" is 1,000 s of event time."""
    return spread(derive_commands(scan(spark, sf_dir, "events")))


def derive_commands(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "user_id AS machine", f"CAST(floor(({SECONDS}) / 1000) AS BIGINT) AS sec", "event_id AS seq", "event_type", "value", f"{_K} AS k"
    ).withColumn("command", F.expr(_COMMAND_CASE))


SQL_COMMANDS = f"""commands AS (SELECT *, {_COMMAND_CASE} AS command FROM (
 SELECT user_id AS machine, epoch_us(ts) // 1000000000 AS sec, event_id AS seq, event_type, value, {_K} AS k FROM events))"""

_JSON_PORTS = (
    """concat('[{"ip":"10.0.0.', k, '","ports":[{"port":22,"state":"open","service":"ssh","version":"9.', k % 10, '"},"""
    """{"port":80,"state":"closed"},{"port":', 1000 + k, ',"protocol":"udp"}]},{"host":"h', k, '","ports":[{"port":443,"state":"open","service":"https"}]}]')"""
)
_XML_PORTS = (
    """concat('<?xml version="1.0"?><nmaprun><host><address addr="10.1.0.', k, '"/><ports>"""
    """<port protocol="tcp" portid="', 2000 + k, '"><state state="open"/><service name="svc', k % 9, '" version="v', k % 4, '"/></port>"""
    """<port protocol="tcp" portid="80"><state state="closed"/></port></ports></host></nmaprun>')"""
)
NL = "chr(10)"
_OUTPUT_CASE = f"""CASE event_type
 WHEN 'view' THEN CASE k % 4
   WHEN 1 THEN {_JSON_PORTS}
   WHEN 2 THEN {_XML_PORTS}
   WHEN 3 THEN concat('Starting Nmap', {NL}, 'Host is up (0.', k, 's)', {NL}, '80/tcp closed http', {NL}, 'Nmap done')
   ELSE concat('Starting Nmap', {NL}, '  ', k, '/tcp open ssh OpenSSH 9.', k % 10, {NL}, '80/tcp closed http', {NL}, '443/udp open https nginx 1.', k, {NL}, 'Nmap done') END
 WHEN 'click' THEN CASE WHEN k % 5 = 0 THEN concat('nothing here', {NL}, '/plain', k, {NL}, 'Status: 404 not found')
   ELSE concat('/admin', k, ' (Status: 301) [Size: ', k * 7, ']', {NL}, '/login (Status: 200)', {NL}, 'banner line') END
 WHEN 'signup' THEN concat('USER', k, ' -> DOMAIN', k % 5, ' (MemberOf)', {NL}, 'SRV', k % 7, '$ => USER', k, {NL}, 'group of users', {NL}, 'noise')
 WHEN 'error' THEN concat('[INFO] back-end DBMS: MySQL >= 5.', k, {NL}, '[INFO] testing', {NL}, '[CRITICAL] connection reset', {NL}, 'password: pw', k % 13, ' on port ', 8000 + k, {NL}, 'see CVE-2021-', 4000 + k % 50, ' user=admin', k % 3)
 ELSE concat(chr(27), '[31mRED', chr(27), '[0m: /etc/shadow ', k, {NL}, 'harmless', {NL}, 'YELLOW: sudo -l shows NOPASSWD ', k % 3, {NL}, 'YELLOW: sudo -l shows NOPASSWD ', k % 3) END"""
_OUTCMD_CASE = """CASE event_type
 WHEN 'view' THEN concat('sudo nmap 10.0.0.', k) WHEN 'click' THEN concat('gobuster dir -u http://t', k)
 WHEN 'signup' THEN 'bloodhound-python -u user' WHEN 'error' THEN 'sqlmap -u http://t' ELSE './linpeas.sh' END"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, machine, command, output, exit_code."""
    ev = scan(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    derived = ev.selectExpr("event_id AS run_id", "user_id AS machine", "event_type", f"{_K} AS k").selectExpr(
        "run_id", "machine", "event_type", "k", f"{_OUTCMD_CASE} AS command", f"{_OUTPUT_CASE} AS output",
        "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code",
    )
    return spread(derived)


SQL_OUTPUTS = f"""outputs AS (SELECT *, {_OUTCMD_CASE} AS command, {_OUTPUT_CASE} AS output,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code FROM (
 SELECT event_id AS run_id, user_id AS machine, event_type, {_K} AS k FROM events))"""


# ---------------------------------------------------------------- corpus and queries
def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, index, machine, title, url, content: one chunk per document."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source AS `index`", "lang AS machine",
        "regexp_extract(text, '^([A-Za-z]*)', 1) AS title", "concat('https://', lang, '.example/', source, '/', doc_id) AS url", "text AS content",
    )


SQL_DOCS = """docs AS (SELECT doc_id, source AS "index", lang AS machine, regexp_extract(text, '^([A-Za-z]*)', 1) AS title,
 concat('https://', lang, '.example/', source, '/', doc_id) AS url, text AS content FROM documents)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, target (a machine for every fourth query), phase_bucket."""
    return scan(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS query_id", "text",
        "CASE item_id % 4 WHEN 1 THEN 'HackTheBox - DE' WHEN 2 THEN '' WHEN 3 THEN 'es ' ELSE 'en' END AS target",
        "CASE item_id % 3 WHEN 0 THEN 'recon' WHEN 1 THEN 'user' ELSE 'unknown' END AS phase_bucket",
    )


SQL_QUERIES = """queries AS (SELECT item_id AS query_id, text,
 CASE item_id % 4 WHEN 1 THEN 'HackTheBox - DE' WHEN 2 THEN '' WHEN 3 THEN 'es ' ELSE 'en' END AS target,
 CASE item_id % 3 WHEN 0 THEN 'recon' WHEN 1 THEN 'user' ELSE 'unknown' END AS phase_bucket FROM benchmark)"""

# Query terms in order (split, compact form, distinct, first 12) as SQL.
SQL_TERMS = f"""toks AS (
  SELECT query_id, i, tok FROM (
    SELECT query_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (
      SELECT query_id, regexp_extract_all(lower(text), '[a-z0-9_/-]+') AS t FROM queries)) WHERE length(tok) >= 2),
variants AS (
  SELECT query_id, i, unnest(p) AS term, generate_subscripts(p, 1) AS j FROM (SELECT query_id, i, string_split_regex(tok, '[-_/]+') AS p FROM toks)
  UNION ALL
  SELECT query_id, i, regexp_replace(tok, '[-_/]+', '', 'g'), 1000000 FROM toks WHERE regexp_matches(tok, '[-_/]')),
firsts AS (
  SELECT query_id, term, min(i * 10000000 + j) AS o FROM variants WHERE length(term) >= 2 GROUP BY 1, 2),
terms AS (
  SELECT query_id, term, ord FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY o) AS ord FROM firsts) WHERE ord <= {rules.MAX_QUERY_TERMS})"""

SQL_DOCWORDS = """words AS (
  SELECT DISTINCT doc_id, "index", unnest(regexp_extract_all(lower(title || chr(10) || content), '[a-z0-9]+')) AS w FROM docs)"""


def sql_lexical(k: int) -> str:
    return f"""lexall AS (
  SELECT query_id, "index", doc_id, count(DISTINCT term) AS matched FROM words JOIN terms ON starts_with(w, term) WHERE length(w) >= 2 GROUP BY 1, 2, 3),
lexical AS (
  SELECT query_id, "index", doc_id, CAST({rules.LEXICAL_DISTANCE} AS DOUBLE) AS distance, matched, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY matched DESC, doc_id) AS rank FROM lexall) WHERE rank <= {k})"""


def sql_hash_vector(c: str, dims: int) -> str:
    return f"list_transform(range({dims}), lambda i: (CAST(concat('0x', substr(sha256({c}), (i % 32) * 2 + 1, 2)) AS INTEGER) / 255.0) * 2 - 1)"


DIMS = 64


def sql_vector(k: int) -> str:
    return f"""dv AS (SELECT doc_id, "index", CAST({sql_hash_vector('content', DIMS)} AS DOUBLE[]) AS v FROM docs),
qv AS (SELECT query_id, CAST({sql_hash_vector('text', DIMS)} AS DOUBLE[]) AS v FROM queries),
vector AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "index" ORDER BY distance, doc_id) AS rank FROM (
    SELECT query_id, "index", doc_id, round(1 - list_cosine_similarity(dv.v, qv.v), 6) AS distance FROM dv, qv)) WHERE rank <= {k})"""


def sql_canonical(c: str) -> str:
    return (
        f"trim(regexp_replace(CASE WHEN starts_with(lower({sql_strip(c)}), 'hackthebox - ') "
        f"THEN substr(lower({sql_strip(c)}), 14) ELSE lower({sql_strip(c)}) END, '[^a-z0-9-]+', ' ', 'g'))"
    )


# ---------------------------------------------------------------- markdown


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, text: documents with an H1 and some line starts as H2 and H3."""
    text = F.concat(
        F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\nintro "), "source", F.lit("\n")),
        F.regexp_replace(F.regexp_replace("text", "\n([A-F])", "\n## $1"), "\n([L-P])", "\n### $1"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))


SQL_MARKDOWN = r"""markdown AS (SELECT doc_id, source, concat('# Doc ', doc_id, chr(10), 'intro ', source, chr(10),
 regexp_replace(regexp_replace(text, '\n([A-F])', concat(chr(10), '## \1'), 'g'), '\n([L-P])', concat(chr(10), '### \1'), 'g')) AS text FROM documents)"""
