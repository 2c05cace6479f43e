"""DuckDB SQL for the queries that SQL can express on whole tables, written without the operators' own code."""

from __future__ import annotations

from .license_scan import FAMILIES, NOTICES, PHRASES

OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least_id AND least_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least_id THEN least_id END AS refers_to
FROM g
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(y AS DOUBLE)) AS DOUBLE) FOR y IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM (SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q
  JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Windows of the flow from its definition: when a source of weight w has had x blocks, source q has had
#: least(n_q, w_q x / w). The recursion gives each slot to the released block of the earliest deadline.
OP3_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source,
    row_number() OVER (PARTITION BY source ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) - 1 AS rank_in_source,
    count(*) OVER (PARTITION BY source) AS k
  FROM documents
), s AS MATERIALIZED (
  SELECT source, CAST(row_number() OVER (ORDER BY source NULLS FIRST) AS BIGINT) AS sid,
    (k + 63) // 64 AS n, CAST(floor(sqrt(k)) AS BIGINT) AS w
  FROM (SELECT DISTINCT source, k FROM d)
), x AS (
  SELECT a.sid, i, sum(least(CAST(b.n AS HUGEINT) * a.w, CAST(b.w AS HUGEINT) * i)) AS had, any_value(a.w) AS w
  FROM (SELECT sid, w, unnest(range(0, n + 1)) AS i FROM s) a CROSS JOIN s b GROUP BY a.sid, i
), jobs AS MATERIALIZED (
  SELECT f.sid, f.i, CAST(f.had // f.w AS BIGINT) AS release, CAST((l.had + l.w - 1) // l.w AS BIGINT) AS due
  FROM x f JOIN x l ON l.sid = f.sid AND l.i = f.i + 1
), slots(t, sid, done) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), (SELECT list(CAST(0 AS BIGINT)) FROM s)
  UNION ALL
  SELECT t + 1, pick, list_transform(done, lambda c, k: c + CAST(k = pick AS BIGINT))
  FROM (
    SELECT r.t, any_value(r.done) AS done, arg_min(j.sid, (j.due, j.sid)) AS pick
    FROM slots r JOIN jobs j ON j.release <= r.t + 1 AND j.i = r.done[j.sid] GROUP BY r.t
  )
)
SELECT d.doc_id, d.source, CAST(rank_in_source AS BIGINT) AS rank_in_source, CAST(rank_in_source // 64 AS BIGINT) AS block,
  CAST(t AS BIGINT) AS slot, CAST(t * 64 + rank_in_source % 64 AS BIGINT) AS place
FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source
JOIN slots ON slots.sid = s.sid AND t >= 0 AND done[s.sid] = rank_in_source // 64 + 1
"""


def _either(words: str) -> str:
    """Pattern for words in either case, ASCII letters only; what isn't a letter stands for itself."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: kind, how it is shown, pattern, group that is measured, least and most code points in it.
_SECRETS = [
    (0, "assign", f"({_either('password|passwd|secret|token')}|{_either('api')}_?{_either('key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12, 1 << 30),
    (1, "access", "AKIA[A-Z0-9]+", 0, 18, 1 << 30),
    (2, "hex", "[0-9a-f]+", 0, 16, 1 << 30),
    (3, "link_id", f"\\b(?:{_either('user')}(?:{_either('name')})?|{_either('login|account|client')}_?{_either('id')}|{_either('key')}_?{_either('id')})[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9._@-]{{3,}}|\\b(?:ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{{12,}}", 0, 0, 1 << 30),
    (4, "link_secret", f"\\b(?:{_either('pwd|pass|passphrase|auth|credential')}|{_either('credentials|private')}_?{_either('key')}|{_either('credentials')}|{_either('access')}_?{_either('key')})[\"'']?\\x20*[:=]\\x20*[\"'']?[^ \\t\\n\\x0B\\f\\r\"'',;]{{6,}}", 0, 0, 1 << 30),
    (5, "link_endpoint", f"\\b(?:{_either('http')}[Ss]?|{_either('jdbc')}:[A-Za-z]+|{_either('postgres')}(?:{_either('ql')})?|{_either('mysql|mongodb|redis|amqp')}[Ss]?|[Ss]?{_either('ftp')}|[Ss]3)://[^ \\t\\n\\x0B\\f\\r\"''<>]+|\\b(?:{_either('host|endpoint|server')})[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9.-]{{4,}}", 0, 0, 1 << 30),
    (6, "link_secret", "[A-Za-z0-9+/=]{40,}", 0, 40, 40),
]


def _matches(kind: int, shown: str, pattern: str, group: int, least: int, most: int) -> str:
    """Places of the matches: the gaps before them, from splitting, and their own lengths, from extracting."""
    return f"""
  SELECT rid, {kind} AS kind, '{shown}' AS shown, CAST(till - len AS BIGINT) AS a, CAST(till AS BIGINT) AS b FROM (
    SELECT rid, len, size, sum(gap + len) OVER (PARTITION BY rid ORDER BY k) AS till FROM (
      SELECT rid, unnest(range(len(found))) AS k, unnest(found) AS m, length(m) AS len,
        unnest([length(g) FOR g IN gaps][1:len(found)]) AS gap, unnest([length(z) FOR z IN sized]) AS size
      FROM (
        SELECT rid, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', {group}) AS sized
        FROM d WHERE regexp_matches(t, '{pattern}')
      )
    )
  ) WHERE size BETWEEN {least} AND {most}"""


OP5_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), m AS MATERIALIZED ({' UNION ALL '.join(_matches(*x) for x in _SECRETS)}
), strong AS (
  SELECT * FROM m WHERE kind < 3
), parts AS MATERIALIZED (
  SELECT * FROM strong UNION ALL
  SELECT * FROM m WHERE kind >= 3 AND NOT EXISTS (FROM strong s WHERE s.rid = m.rid AND s.a < m.b AND m.a < s.b)
), linked AS (
  SELECT x.rid, x.kind, x.shown, x.a, x.b, bool_or(y.kind IN (1, 3)) AS has_id, bool_or(y.kind IN (0, 2, 4, 6)) AS has_secret
  FROM parts x JOIN parts y ON y.rid = x.rid AND (y.a >= x.b AND y.a - x.b <= 200 OR x.a >= y.b AND x.a - y.b <= 200)
  WHERE x.kind >= 3 GROUP BY ALL
), spans AS (
  SELECT rid, kind, shown, a, b FROM strong UNION ALL
  SELECT rid, kind, shown, a, b FROM linked WHERE CASE kind WHEN 3 THEN has_secret WHEN 5 THEN has_id AND has_secret ELSE has_id END
), texts AS (
  SELECT rid, string_agg(shown || ':' || a || ':' || b, ',' ORDER BY a, kind, b) AS spans,
    string_agg(CASE WHEN kind < 3 THEN shown || ':' || a || ':' || b END, ',' ORDER BY a, kind, b) AS base,
    count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (rid)
"""

#: Every window of 200 bytes, counted; the places that repeated ones cover, in runs; the rest put together as hexadecimal digits.
OP7_SQL = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT rid, i, substr(h, 2 * i + 1, 400) AS x FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)
), twice AS (
  SELECT rid, i FROM w WHERE x IN (SELECT x FROM w GROUP BY x HAVING count(*) > 1)
), r AS MATERIALIZED (
  SELECT rid, min(i) AS a, max(i) + 200 AS b FROM (
    SELECT rid, i, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS run FROM (
      SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS opens FROM twice
    )
  ) GROUP BY rid, run
), k AS (
  SELECT rid, h, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before, lead(a) OVER (PARTITION BY rid ORDER BY a) AS nxt FROM r JOIN d USING (rid)
), g AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN nxt IS NULL THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM k GROUP BY rid
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""

_GAP = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"


def _values(of: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in of.items())


#: Words and places from lists; behind each tag, one token of the licence expression after the other changes the
#: state: whether a licence is due, the depth, what ``with`` leaves out, whether the expression has ended or is wrong.
OP10_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR x IN regexp_extract_all(t, '[^{_GAP}]+')] AS words
  FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)
), w AS (
  SELECT rid, words, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS x FROM d
), phrases(phrase, label) AS (VALUES {_values(PHRASES)}
), notices(phrase, label) AS (VALUES {_values(NOTICES)}
), known(prefix, label) AS (VALUES {_values(FAMILIES)}
), base AS MATERIALIZED (
  SELECT rid, i - 1 AS place, label FROM w JOIN phrases ON x = split_part(phrase, ' ', 1) AND words[i:i + len(string_split(phrase, ' ')) - 1] = string_split(phrase, ' ')
), tags AS MATERIALIZED (
  SELECT rid, i, row_number() OVER () AS tid, regexp_extract_all(regexp_extract(rest, '^(?:[ \\t]*(?:[()]|[A-Za-z0-9][A-Za-z0-9.:+-]*))*'), '[()]|[A-Za-z0-9][A-Za-z0-9.:+-]*') AS tokens
  FROM (
    SELECT rid, i, regexp_extract(substr(t, length(array_to_string(regexp_extract_all(t, '[{_GAP}]*[^{_GAP}]+')[1:i + 2], '')) + 1), '^[ \\t]*:?([^\\r\\n]*)', 1) AS rest
    FROM w JOIN d USING (rid) WHERE x = 'spdx' AND w.words[i + 1] = 'license' AND w.words[i + 2] = 'identifier'
  )
), tokens AS MATERIALIZED (
  SELECT tid, k, word, lower(word) IN ('or', 'and', 'with') AS op, lower(word) AS name,
    coalesce((SELECT arg_max(label, length(prefix)) FROM known WHERE plain = prefix OR starts_with(plain, prefix || '-')), plain) AS family
  FROM (SELECT tid, unnest(range(1, len(tokens) + 1)) AS k, unnest(tokens) AS word, regexp_replace(lower(unnest(tokens)), '\\++$', '') AS plain FROM tags)
), parse(tid, k, due, depth, behind, left_out, found, ended, wrong, labels) AS (
  SELECT tid, CAST(0 AS BIGINT), true, 0, false, -1, 0, false, false, CAST([] AS VARCHAR[]) FROM tags
  UNION ALL
  SELECT p.tid, p.k + 1,
    CASE WHEN is_id THEN false WHEN is_op THEN true ELSE due END,
    CASE WHEN opens THEN depth + 1 WHEN closes THEN depth - 1 ELSE depth END,
    CASE WHEN is_op THEN name = 'with' WHEN is_id OR opens THEN false ELSE behind END,
    CASE WHEN opens AND behind AND left_out < 0 THEN depth WHEN closes AND left_out = depth - 1 THEN -1 ELSE left_out END,
    found + CAST(is_id AS INTEGER),
    NOT (is_id OR is_op OR opens OR closes),
    due AND NOT (is_id OR opens),
    CASE WHEN is_id AND NOT behind AND left_out < 0 THEN list_append(labels, family) ELSE labels END
  FROM (
    SELECT p.*, name, family,
      due AND word NOT IN ('(', ')') AND NOT op AND (family IN (SELECT label FROM known) OR regexp_matches(regexp_replace(word, '\\.+$', ''), '[-.0-9]')) AS is_id,
      NOT due AND op AS is_op, due AND word = '(' AS opens, NOT due AND word = ')' AND depth > 0 AS closes
    FROM parse p JOIN tokens t ON t.tid = p.tid AND t.k = p.k + 1 WHERE NOT ended
  ) p
), said AS MATERIALIZED (
  SELECT rid, last.labels AS labels, NOT last.wrong AND last.depth = 0 AND NOT last.due AND last.found > 0 AS good
  FROM (SELECT tid, arg_max(parse, k) AS last FROM parse GROUP BY tid) JOIN tags USING (tid)
), own AS (
  SELECT rid, label FROM d JOIN notices ON contains(' ' || array_to_string(words, ' ') || ' ', ' ' || phrase || ' ')
  UNION SELECT rid, unnest(labels) FROM said
), n AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid
), o AS (
  SELECT rid, count(*) AS n_own FROM own GROUP BY rid
), e AS (
  SELECT rid, count(*) AS n_tags, bool_and(good) AS good FROM said GROUP BY rid
), l AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM own UNION SELECT rid, label FROM base) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  (1 - pow(CAST(0.5 AS DOUBLE), least(coalesce(n_base, 0) + coalesce(n_own, 0) + coalesce(n_tags, 0), 60))) * CASE WHEN coalesce(good, true) THEN CAST(1 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS score
FROM d LEFT JOIN n USING (rid) LEFT JOIN o USING (rid) LEFT JOIN e USING (rid) LEFT JOIN l USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_top_k": OP2_SQL, "op3_source_mix": OP3_SQL, "op5_secret_scan": OP5_SQL, "op7_suffix_dedup": OP7_SQL, "op10_license_scan": OP10_SQL}
