"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import math

from opsloom.llm import centroids, dialogue, licences, privacy, quality


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- op2
def _licences() -> str:
    lower = f"translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    places = []
    for phrase, label in licences.PHRASES:
        ws = phrase.split()
        same = " AND ".join(f"w[i + {k}] = {_q(x)}" for k, x in enumerate(ws))
        places.append(f"SELECT doc_id, {_q(label)} AS label, unnest(list_filter(range(1, len(w) - {len(ws) - 2}), lambda i: {same})) - 1 AS pos FROM docs")
    rows = [f"({_q(label)}, [{', '.join(map(_q, sorted(set(text.split()))))}], {math.ceil(licences.THRESHOLD * len(set(text.split())) - 1e-9)})" for label, text in licences.TEMPLATES]
    return f"""WITH docs AS (SELECT doc_id, regexp_extract_all({lower}, {word}) AS w, string_split({lower}, chr(10)) AS lines FROM documents),
places AS ({' UNION ALL '.join(places)}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY 1),
templates(label, words, need) AS (VALUES {', '.join(rows)}),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(line, {word})) AS t FROM (SELECT doc_id, unnest(lines) AS line FROM docs)),
met AS (SELECT doc_id, label, len(list_intersect(t, words)) AS o, len(words) AS n, need FROM blocks, templates),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(o / n) AS best FROM met WHERE o >= need GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
 coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
 CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM docs d LEFT JOIN base b ON b.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""


LICENCES = _licences()

# ---------------------------------------------------------------- op3
REPEATS = r"""WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM docs),
windows AS (SELECT s.doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts s JOIN docs d ON d.doc_id = s.doc_id),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT x.doc_id, unnest(range(i, i + 50)) AS k FROM windows x JOIN firsts f ON f.h = x.h WHERE x.doc_id > f.first),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

# ---------------------------------------------------------------- op6
_BAD = " OR ".join(f"contains(lower(l), {_q(p)})" for p in quality.BOILERPLATE)
_END = quality.SENTENCE_END.replace("'", "''")
QUALITY = rf"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, l, k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
judged AS (SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(l, '{quality.SEPARATORS}')) AS menu, len(regexp_extract_all(l, '[#*$%&|<>]')) AS sym FROM lines),
byline AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup,
 sum(CASE WHEN NOT regexp_matches(regexp_replace(l, '[\x20\x09-\x0D]+$', ''), '{_END}') OR sym > {quality.LINE_SYMBOLS} * n OR (menu >= 2 AND menu * {quality.MENU_WORDS_PER_SEPARATOR} >= n) OR {_BAD} THEN 0 ELSE n END) AS kept_words FROM judged GROUP BY 1),
wins AS (SELECT doc_id, w[i:i + 2] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM wins) WHERE c > 1) GROUP BY 1),
out AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
 coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(kept_words, 0) AS n_kept_words FROM docs d LEFT JOIN byline b ON b.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_kept_words >= {quality.LEAST_KEPT} * n_words AS kept FROM out"""

# ---------------------------------------------------------------- op7
WARC = """WITH heads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM heads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM firsts"""

# ---------------------------------------------------------------- op10
_RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) ELSE (2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INT)) // 10 + (2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INT)) % 10 END)) % 10 = 0"
_VALID = {
    "email": "true", "ip": "list_max(list_transform(string_split(v, '.'), lambda x: CAST(x AS HUGEINT))) <= 255",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _kind(order: int, kind: str) -> str:
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, pos AS s, pos + length(v) AS e, v FROM (
 SELECT doc_id, vs[k] AS v, CAST(list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(vs[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM (
  SELECT doc_id, gs, vs, unnest(range(1, len(vs) + 1)) AS k FROM (SELECT doc_id, string_split_regex(text, '{_RE[kind]}') AS gs, regexp_extract_all(text, '{_RE[kind]}') AS vs FROM docs))) WHERE {_VALID[kind]}"""


_TERM = r"[\p{L}\p{N}]{3,}"
PRIVACY = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({' UNION ALL '.join(_kind(i, k) for i, k in enumerate(privacy.KINDS))}),
ents AS (SELECT kind || ':' || lower(v) AS entity, count(DISTINCT doc_id) AS ne FROM base GROUP BY 1),
cut AS (SELECT doc_id, generate_subscripts(vs, 1) AS k, unnest(gs[1:len(vs)]) AS g, unnest(vs) AS v FROM
 (SELECT doc_id, string_split_regex(text, '{_TERM}') AS gs, regexp_extract_all(text, '{_TERM}') AS vs FROM docs WHERE doc_id IN (SELECT doc_id FROM base))),
placed AS (SELECT doc_id, lower(v) AS term, CAST(upto - length(v) AS BIGINT) AS s, CAST(upto AS BIGINT) AS e FROM
 (SELECT doc_id, v, sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM cut)),
own_terms AS (SELECT * FROM placed p WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.s < p.e AND p.s < b.e)),
met AS (SELECT DISTINCT p.doc_id, kind || ':' || lower(b.v) AS entity, term FROM own_terms p JOIN base b ON b.doc_id = p.doc_id),
pairs AS (SELECT entity, term, count(*) AS nb FROM met GROUP BY 1, 2),
terms AS (SELECT term, count(*) AS nt FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{_TERM}'))) AS term FROM docs) GROUP BY 1),
told AS (SELECT entity, term FROM (SELECT p.entity, p.term, nb, log2(nb * n / (ne * nt)) AS pmi, -log2(ne / n) AS ic FROM pairs p JOIN ents e ON e.entity = p.entity JOIN terms t ON t.term = p.term,
 (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs)) WHERE ic > 0 AND least(1.0, pmi / ic) * (1.0 - pow(2.0, 1 - nb)) >= {privacy.GENERALISE}),
marked AS (SELECT DISTINCT p.doc_id, 9 AS o, 'term' AS kind, p.s, p.e FROM own_terms p JOIN met m ON m.doc_id = p.doc_id AND m.term = p.term JOIN told t ON t.entity = m.entity AND t.term = m.term),
own AS (SELECT doc_id, count_if(kind = 'email') AS n_email, count_if(kind = 'ip') AS n_ip, count_if(kind = 'card') AS n_card, count_if(kind = 'phone') AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS b FROM base GROUP BY 1),
every AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS a FROM (SELECT doc_id, o, kind, s, e FROM base UNION ALL SELECT * FROM marked) GROUP BY 1)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM docs d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN every ON every.doc_id = d.doc_id"""


# ---------------------------------------------------------------- op12
def _centroids() -> str:
    k, rounds, n = centroids.CENTROIDS, centroids.ROUNDS, centroids.DIMENSIONS
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: isfinite(x) AND abs({centroids.SCALE} * CAST(x AS DOUBLE)) <= {centroids.LARGEST})) = {n}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(kv) AS v, min({{'d': d, 'c': c}}) AS best FROM
 (SELECT r, vec_id, kept.v AS kv, c, CAST(list_sum(list_transform(range(1, {n + 1}), lambda i: (kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i]))) AS BIGINT) AS d FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(w, v) AS v FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM
 (SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {n + 1}) AS t(i) GROUP BY 1, 2) GROUP BY c) USING (c))""")
    return f"""WITH {",\n".join(steps)},
own AS (SELECT best.c AS c, CAST(sum(best.d) AS BIGINT) AS s FROM a{rounds} GROUP BY 1)
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, s AS cluster_inertia, (SELECT CAST(sum(s) AS BIGINT) FROM own) AS inertia,
 sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN own ON own.c = best.c JOIN c{rounds} ON c{rounds}.c = best.c"""


CENTROIDS = _centroids()


# ---------------------------------------------------------------- op11
def _dialogue() -> str:
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {bit})"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    fault = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({key}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda crc, b: {byte}), 4294967295) % 20"
    blanks = " || ".join(f"chr({ord(c)})" for c in dialogue.BLANKS)
    # (last role, inserts, last role then, letters, turns): none, one or two turns before the next row
    inserts = "(0, 0, 0, '', []), (1, 0, 1, '', []), (2, 0, 2, '', []), (3, 0, 3, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 2, 3, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']), (0, 4, 3, 'II', ['user:', 'assistant:']), (1, 4, 3, 'II', ['user:', 'assistant:'])"
    return f"""WITH RECURSIVE marked AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, {fault} AS f FROM conversations),
damaged AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE r END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS text,
 unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM marked),
convs AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (SELECT cid, turn, role, text, right(rtrim(text, {blanks}), 1) AS e, left(role, 1) AS init,
 row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i
 FROM damaged JOIN convs ON damaged.conv_id IS NOT DISTINCT FROM convs.conv_id),
judged AS MATERIALIZED (SELECT *, CASE WHEN e = '' THEN 'b' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'd' WHEN e IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
 lag(init) OVER (PARTITION BY cid ORDER BY i) || init AS pair FROM numbered),
inserts(st, c, nst, letters, turns) AS (VALUES {inserts}),
walk AS (SELECT cid, CAST(0 AS BIGINT) AS i, 0 AS st, {{'cost': 0, 'audit': '', 'said': CAST([] AS VARCHAR[])}} AS best FROM convs
UNION ALL
SELECT cid, i, st, min(best) AS best FROM (
 SELECT j.cid, j.i, CASE WHEN letter = 'D' THEN s.nst WHEN letter = 'K' AND init = 's' THEN 1 WHEN s.nst = 2 THEN 3 ELSE 2 END AS st,
  {{'cost': best.cost + s.c + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 't' THEN 1 ELSE 0 END,
   'audit': best.audit || s.letters || letter,
   'said': list_concat(best.said, s.turns, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN s.nst = 2 THEN 'assistant:' ELSE 'user:' END || text] END)}} AS best
 FROM walk JOIN inserts s ON s.st = walk.st JOIN judged j ON j.cid = walk.cid AND j.i = walk.i + 1, (VALUES ('D'), ('R'), ('K')) AS edits(letter)
 WHERE letter = 'D' OR (fault IN ('', 't') AND (letter = 'R' OR init = CASE WHEN s.nst = 2 THEN 'a' ELSE 'u' END OR (init = 's' AND s.nst = 0)))
) GROUP BY cid, i, st),
counts AS (SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
 count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY cid),
done AS (SELECT walk.cid, min({{'cost': best.cost + s.c, 'audit': best.audit || s.letters, 'said': list_concat(best.said, s.turns)}}) AS best
 FROM walk JOIN inserts s ON s.st = walk.st LEFT JOIN counts ON counts.cid = walk.cid WHERE walk.i = coalesce(n, 0) AND s.nst IN (0, 3) GROUP BY walk.cid)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM convs JOIN done USING (cid) LEFT JOIN counts USING (cid)"""


DIALOGUE = _dialogue()


# ---------------------------------------------------------------- op13
#: The pages mark their article; its blocks are paragraphs and one heading.  SQL has no HTML parser, so it reads just that form, with the character references that stand there.
EXTRACTION = r"""WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
blocks AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda b:
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b FROM articles),
texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda t: t <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts"""
