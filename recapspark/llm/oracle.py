"""DuckDB SQL of the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

#: Of equal payloads of 1000 bytes or more the largest page_id is the response.
WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
    sha1(payload) AS payload_digest
  FROM p
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000
    THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response
  FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM r
"""

#: Windows of 100 bytes by digest, cut from pieces of 256 starts; texts as hexadecimal digits.
REPEATS = """
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT doc_id, c, substr(h, c * 512 + 1, 2 * 355) AS piece
  FROM (SELECT doc_id, h, unnest(range(length(h) // 512 + 1)) AS c FROM d)
), windows AS (
  SELECT doc_id, c * 256 + i AS place, md5(substr(piece, 2 * i + 1, 200)) AS k
  FROM (SELECT doc_id, c, piece,
          unnest(range(greatest(length(piece) // 2 - 99, 0))) AS i FROM pieces)
), repeated AS (
  SELECT doc_id, place FROM windows
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, place) > 1
), islands AS (
  SELECT doc_id, place, count(*) FILTER (gap) OVER (PARTITION BY doc_id ORDER BY place) AS island
  FROM (SELECT doc_id, place,
          place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 100 AS gap FROM repeated)
), spans AS (
  SELECT doc_id, min(place) AS first, max(place) + 100 AS past FROM islands GROUP BY doc_id, island
), ends AS (
  SELECT doc_id, first, past FROM spans
  UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d
), kept AS (
  SELECT doc_id, first, past,
    coalesce(lag(past) OVER (PARTITION BY doc_id ORDER BY first, past NULLS LAST), 0) AS lo
  FROM ends
)
SELECT doc_id, CAST(any_value(length(h)) // 2 AS BIGINT) AS n_bytes,
  CAST(coalesce(sum(past - first), 0) AS BIGINT) AS n_removed,
  count(past) AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * lo + 1, 2 * (first - lo)), '' ORDER BY lo, first)))
    AS kept_sha256
FROM kept JOIN d USING (doc_id)
GROUP BY doc_id
"""

#: All pairs, for the sizes of the correctness check.
VECTOR_LINKS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, x, sqrt(list_sum([y * y FOR y IN x])) AS norm
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        WHERE len(embedding) > 0
          AND len([y FOR y IN embedding IF y IS NOT NULL AND isfinite(y)]) = len(embedding))
), links AS MATERIALIZED (
  SELECT a.vec_id AS i, b.vec_id AS j
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.norm > 0 AND b.norm > 0
    AND list_inner_product(a.x, b.x) / a.norm / b.norm >= 0.95
), reach AS (
  SELECT i, j FROM links
  UNION
  SELECT reach.i, links.j FROM reach JOIN links ON reach.j = links.i
), components AS (
  SELECT i AS vec_id, min(j) AS component FROM reach GROUP BY i
), degrees AS (
  SELECT i AS vec_id, count(*) AS n FROM links GROUP BY i
), placed AS (
  SELECT e.vec_id, coalesce(n, 0) AS n_links,
    least(e.vec_id, coalesce(component, e.vec_id)) AS component_id
  FROM embeddings e LEFT JOIN components USING (vec_id) LEFT JOIN degrees USING (vec_id)
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM placed
"""

_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of documents as lists of ten words, cut to the length of the items' windows.
LEAKS = f"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (
    SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), ahead AS (
  SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p
    ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws
  FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d)
), hits AS MATERIALIZED (
  SELECT r, p, win.n, item
  FROM (SELECT r, p, n, array_to_string(ws[1 : n], ' ') AS k
        FROM ahead JOIN (SELECT DISTINCT n FROM win) ON len(ws) >= n) a
  JOIN win ON win.n = a.n AND win.k = a.k
), words AS (
  SELECT r, count(DISTINCT place) AS n_hit
  FROM (SELECT r, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT r, p, n FROM hits))
  GROUP BY r
), names AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""


def _field(column: str, value: str | None = None) -> str:
    text = f"CAST({value or column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({text})) || ':' || {text} END"


def _levels(name: str, group: str, height: int) -> str:
    """Levels of the trees of ``{name}0``: runs of sixteen until one node is left."""
    steps = []
    for k in range(height):
        steps.append(f"""
{name}run{k} AS MATERIALIZED (
  SELECT {group}, pos // 16 AS run, list(node ORDER BY pos) AS nodes, any_value(total) AS total
  FROM {name}{k} GROUP BY {group}, pos // 16
), {name}{k + 1} AS MATERIALIZED (
  SELECT {group}, run AS pos, (total + 15) // 16 AS total,
    CASE WHEN total = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node
  FROM {name}run{k}
)""")
    return ",".join(steps)


def _climb(name: str, group: str, start: str, height: int) -> str:
    """From ``{start}`` up: the siblings of each path, and the node folded with them."""
    steps, before = [], start
    for k in range(height):
        steps.append(f"""
{name}up{k} AS (
  SELECT u.* REPLACE (
    u.pos // 16 AS pos,
    CASE WHEN total = 1 THEN proof ELSE proof || array_to_string(
      list_concat(nodes[1 : u.pos % 16], nodes[u.pos % 16 + 2 :]), '') END AS proof,
    CASE WHEN total = 1 THEN folded ELSE sha256(array_to_string(list_concat(
      nodes[1 : u.pos % 16], [folded], nodes[u.pos % 16 + 2 :]), '')) END AS folded)
  FROM {before} u JOIN {name}run{k} r
    ON r.{group} IS NOT DISTINCT FROM u.{group} AND r.run = u.pos // 16
)""")
        before = f"{name}up{k}"
    return ",".join(steps)


#: Bits of the checksum, one step per bit; eight steps per digit of the id.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([
    [CAST(unicode(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]
    FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
  lambda c, b: (xor(c, b) >> 1) ^^ (xor(c, b) & 1)), CAST(4294967295 AS BIGINT))""".replace(
    "(xor(c, b) >> 1) ^^ (xor(c, b) & 1)", "xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)"
)
_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_HEIGHT, _TOP = 7, 6  # enough for 16 ** 7 documents of a source and 16 ** 6 sources

MANIFEST = f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, source, sha256({_HEAD} || {_field("text")}) AS node,
    sha256({_HEAD} || {_field("text", _SMALL)}) AS small, {_CRC} % 5 = 0 AS tampered
  FROM documents
), a0 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS total
  FROM docs
), {_levels("a", "source", _HEIGHT)}, b0 AS MATERIALIZED (
  SELECT source, node, 1 AS one, count(*) OVER () AS total,
    row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos
  FROM a{_HEIGHT}
), {_levels("b", "one", _TOP)}, leaves AS (
  SELECT doc_id, source, node AS leaf, pos, '' AS proof,
    CASE WHEN tampered THEN small ELSE node END AS folded FROM a0
), {_climb("a", "source", "leaves", _HEIGHT)}, tops AS (
  SELECT u.doc_id, u.leaf, u.proof, u.folded, b0.node AS subroot, b0.pos, b0.one
  FROM aup{_HEIGHT - 1} u JOIN b0 ON b0.source IS NOT DISTINCT FROM u.source
), {_climb("b", "one", "tops", _TOP)}
SELECT doc_id, leaf, subroot, b.node AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = b.node AS verified
FROM bup{_TOP - 1} CROSS JOIN (SELECT node FROM b{_TOP}) b
"""

ORACLE_SQL = {
    "op4_warc": WARC,
    "op5_suffix_array": REPEATS,
    "op7_hnsw": VECTOR_LINKS,
    "op11_decontamination": LEAKS,
    "op13_manifest": MANIFEST,
}
