"""SQL (DuckDB) of the queries that SQL can express over whole tables at test sizes."""

from __future__ import annotations

import math
import re

from .licenses import PHRASES, TEMPLATES, WIDTH
from .urls import GLOBS, SITES

_UPPER = "".join(map(chr, range(65, 91)))
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE octet_length(b) >= 100 GROUP BY d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d"""


def _components(links: str, nodes: str, node: str) -> str:
    """CTEs: ``far`` (a, b) holds all that links reach, ``comp`` the smallest of each node's, ``deg`` its links."""
    return (f"far AS (SELECT a, b FROM {links} UNION SELECT far.a, l.b FROM far JOIN {links} l ON far.b = l.a), "
            f"comp AS (SELECT {node}, least({node}, coalesce(min(b), {node})) AS component_id FROM {nodes} LEFT JOIN far ON a = {node} GROUP BY {node}), "
            f"deg AS (SELECT {node}, count(b) AS n_links FROM {nodes} LEFT JOIN {links} l ON a = {node} GROUP BY {node})")


EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_components("links", "v", "vec_id")}
SELECT vec_id, n_links::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp JOIN deg USING (vec_id)"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS m FROM w),
r AS (SELECT doc_id, m, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS five FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT DISTINCT doc_id, hash(five) AS g FROM r WHERE five IS NOT NULL
  UNION ALL SELECT doc_id, hash(array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_components("links", "n", "doc_id")}
SELECT doc_id, n::BIGINT AS n_shingles, n_links::BIGINT AS n_links, component_id FROM n JOIN comp USING (doc_id) JOIN deg USING (doc_id)"""


def licenses(threshold: float = 0.9) -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    rows = ", ".join(f"({k}, {label!r}, {sorted(set(words.split()))}, {math.ceil(threshold * len(set(words.split())))}, {WIDTH * len(words.split())})"
                     for k, (label, words) in enumerate(TEMPLATES))

    def places(phrase: str) -> str:
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        return f"list_filter(range(len(w) - {len(parts) - 1}), lambda i: {test})"

    found = ", ".join(f"{places(p)} AS p{k}" for k, p in enumerate(PHRASES))
    every = "list_concat(list_concat(p0, p1), p2)"
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    text = "coalesce(array_to_string(list_sort(list_distinct({})), ','), '')"
    return f"""
WITH t(k, label, tw, need, width) AS (VALUES {rows}), d AS (SELECT doc_id, {_LOW} AS s FROM documents),
w AS (SELECT doc_id, regexp_extract_all(s, '{word}') AS w FROM d),
p AS (SELECT doc_id, len(w) AS n, {found} FROM w),
q AS (SELECT doc_id, n, {every} AS spots, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM p),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
v AS (SELECT k, need, width, unnest(tw) AS x FROM t),
l AS (SELECT doc_id, k, width, need, i, x FROM u JOIN v USING (x)),
e AS (SELECT doc_id, k FROM l GROUP BY doc_id, k HAVING count(DISTINCT x) >= min(need)),
l2 AS MATERIALIZED (SELECT l.* FROM l JOIN e USING (doc_id, k)),
m AS (SELECT a.doc_id, a.k, a.i, count(DISTINCT b.x) AS c FROM l2 a JOIN l2 b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i >= a.i AND b.i < a.i + a.width GROUP BY ALL),
h AS (SELECT doc_id, list(DISTINCT label) AS more, max(c / len(tw)::DOUBLE) AS share FROM m JOIN t USING (k) WHERE c >= need GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, len(spots)::BIGINT AS n_base, list_min(spots)::BIGINT AS first_word, list_max(spots)::BIGINT AS last_word,
  {text.format("base")} AS base_labels, {text.format("list_concat(base, coalesce(more, []))")} AS labels,
  CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM q LEFT JOIN h USING (doc_id)"""

# crc32 of the decimal doc_id, bit by bit over its ASCII codes.
_CRC = ("xor(list_reduce(range(8 * length(doc_id::VARCHAR)), lambda c, k: xor((CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))) ELSE c END) >> 1, "
        "3988292384 * (xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1)) ELSE 0 END) & 1)), 4294967295::BIGINT), 4294967295)")

RUNS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC} AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
v AS (SELECT doc_id, n, unnest(range(n)) AS i, a, p, h % 10 = 0 AS loop, w FROM p),
u AS MATERIALIZED (SELECT doc_id, n, i, w[CASE WHEN loop AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS x FROM v),
m AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM u l JOIN u r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = u.doc_id AND u.i >= r.start + r.period AND u.i < r.start + r.length) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
  arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS best FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _regex(glob: str) -> str:
    """A glob of URL rules as a regular expression over ``.host/path``."""
    parts = {"**": ".*", "*": "[^/]*", "?": "."}
    return "".join(parts.get(t) or re.escape(t) for t in re.findall(r"\*\*|\*|\?|[^*?]+", glob))


def urls() -> str:
    """Site rules by the ends of hosts and starts of paths; where none fits, globs as regular expressions."""
    sites = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in SITES)
    globs = " ".join(f"WHEN regexp_full_match(u, '{_regex(g)}', 's') THEN '{g}'" for g in sorted(GLOBS, key=lambda g: (-len(g), g)))
    return f"""
WITH s(rule_host, rule_path, verdict) AS (VALUES {sites}),
t AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
f AS (SELECT k, arg_max({{'rule': rule_host || rule_path, 'verdict': s.verdict}}, length(rule_host || rule_path)) AS best
  FROM p JOIN s ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k),
g AS (SELECT p.*, best, '.' || host || path AS u FROM p LEFT JOIN f USING (k)),
v AS (SELECT *, CASE WHEN best IS NULL THEN CASE {globs} END END AS pattern FROM g)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern FROM v"""
