"""DuckDB SQL with the results of the queries that SQL can express on whole tables."""

from __future__ import annotations

from tripweave.llm import license_scan, vector_codes

LINE_DEDUP = r"""
WITH base AS (
  SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, text, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM base
), full_lines AS (
  SELECT doc_id, text, pos, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), windows AS (
  SELECT doc_id, text, pos AS s, line AS a,
    lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, lead(pos, 2) OVER w AS e
  FROM full_lines WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)
), placed AS (
  SELECT *, first_value(doc_id) OVER g AS f_doc, first_value(text) OVER g AS f_text,
    first_value(s) OVER g AS f_s, first_value(e) OVER g AS f_e
  FROM windows WHERE e IS NOT NULL
  WINDOW g AS (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, md5(text), s)
), ranges AS (
  SELECT doc_id, text,
    CASE WHEN doc_id IS NOT DISTINCT FROM f_doc AND text = f_text THEN greatest(s, f_e + 1) ELSE s END AS s, e
  FROM placed WHERE NOT (doc_id IS NOT DISTINCT FROM f_doc AND text = f_text AND s = f_s)
), removed AS (
  SELECT DISTINCT doc_id, text, unnest(generate_series(s, e)) AS pos FROM ranges WHERE s <= e
), result AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(r.pos) AS n_removed,
    string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE r.pos IS NULL) AS kept
  FROM lines l LEFT JOIN removed r
    ON l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.text = r.text AND l.pos = r.pos
  GROUP BY l.doc_id, l.text
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.kept, '') END AS text,
  r.n_lines, r.n_removed
FROM documents d LEFT JOIN result r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.text = r.text
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), sized AS (
  SELECT page_id, html, strlen(html) AS n FROM p
), origins AS (
  SELECT html AS h, max(page_id) AS origin FROM sized WHERE n >= 1000 GROUP BY html
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN origin IS NOT NULL AND page_id IS DISTINCT FROM origin THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN page_id IS DISTINCT FROM origin THEN origin END AS refers_to
FROM sized LEFT JOIN origins ON html = h
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE
      WHEN len(words) = 0 THEN []::VARCHAR[]
      WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 1),
        lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles
  FROM w
), sized AS (
  SELECT doc_id, len(shingles) AS n, shingles FROM sets
), tokens AS (
  SELECT doc_id, n, unnest(shingles) AS shingle FROM sized
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS n
  FROM tokens a JOIN tokens b
    ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared WHERE 100 * n >= 90 * (n_a + n_b - n)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM sized
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON r.other = e.a
)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, min(r.other) AS component_id
FROM sized s JOIN reached r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.n
"""

# CRC-32 over the bytes of a text: a table of 256 remainders, then one step for each byte.
CRC_TABLE = r"""
WITH crc_table AS (
  SELECT list(value ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS value
    FROM range(256) AS r(i))
)"""

SHARDING = CRC_TABLE + r""", sized AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), summed AS (
  SELECT doc_id, strlen(text) + 16 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(text), '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc
  FROM sized, crc_table
), drawn AS (
  SELECT doc_id, size, crc, s,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE) AS draw
  FROM summed, range(41) AS r(s)
), chosen AS (
  SELECT doc_id, size, crc, arg_min(s, draw) FILTER (WHERE s < 40) AS shard, arg_min(s, draw) AS grown
  FROM drawn GROUP BY doc_id, size, crc
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  grown::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard
    ORDER BY substr(md5('slot:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13), doc_id) - 1 AS slot
FROM chosen
"""

DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), item_windows AS (
  SELECT item_id, least(13, len(words)) AS size,
    unnest(list_transform(range(1, len(words) - least(13, len(words)) + 2),
      lambda k: array_to_string(words[k : k + least(13, len(words)) - 1], ' '))) AS win
  FROM i WHERE len(words) > 0
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS pos,
    unnest(list_transform(range(1, len(words) - size + 2),
      lambda k: array_to_string(words[k : k + size - 1], ' '))) AS win
  FROM d, sizes WHERE len(words) >= size
), met AS (
  SELECT DISTINCT doc_id, pos, size, item_id FROM doc_windows JOIN item_windows USING (size, win)
), hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
    SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def license_sql() -> str:
    """The licence scan; its templates are normalised once more, by SQL."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    rows = ", ".join(
        f"({quoted(name)}, {quoted(text)})" for name, text in sorted(license_scan.TEMPLATES.items())
    )
    pairs = r"""list_distinct(list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]))"""
    words = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH templates AS (
  SELECT name, {pairs.format(w="words")} AS t
  FROM (SELECT name, {words.format(t="body")} AS words FROM (VALUES {rows}) AS v(name, body))
), units AS (
  SELECT doc_id, -1 AS line_no, text AS body FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1, unnest(string_split(text, chr(10)))
  FROM documents WHERE text IS NOT NULL
), sets AS (
  SELECT doc_id, line_no, {pairs.format(w="words")} AS u
  FROM (SELECT doc_id, line_no, {words.format(t="body")} AS words FROM units)
), scored AS (
  SELECT doc_id, line_no, len(u) AS n, name, 2.0::DOUBLE * len(list_intersect(u, t)) / (len(u) + len(t)) AS dice
  FROM sets JOIN templates ON 2.0::DOUBLE * least(len(u), len(t)) >= {license_scan.THRESHOLD} * (len(u) + len(t))
  WHERE len(u) > 0
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, name) AS place
  FROM scored WHERE dice >= {license_scan.THRESHOLD}::DOUBLE
)
SELECT doc_id, line_no::INT AS line_no, name AS template, split_part(name, '/', 1) AS license,
  n::BIGINT AS n_bigrams, dice
FROM best WHERE place = 1
"""


# Every prefix of a rebuilt conversation by the digests of its turns.
CONVERSATION_TRIE = CRC_TABLE + r""", turns AS (
  SELECT conv_id AS c, text, md5(len(role) || ':' || role || text) AS id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
      substr(md5(len(role) || ':' || role || text), 1, 24), len(text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(c::VARCHAR), '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns), crc_table
), joined AS (
  SELECT v.c, 0 AS side, pos, id, text FROM convs v JOIN turns t ON t.c = base AND pos <= h
  UNION ALL
  SELECT v.c, 1, pos, id, text FROM convs v JOIN turns t ON t.c = v.c AND pos > h
), numbered AS (
  SELECT c, id, len(text) AS n, row_number() OVER (PARTITION BY c ORDER BY side, pos) AS d FROM joined
), members AS MATERIALIZED (
  SELECT c, d, n, string_agg(id, '') OVER (PARTITION BY c ORDER BY d) AS path FROM numbered
  UNION ALL SELECT c, 0, 0, '' FROM convs
), nodes AS MATERIALIZED (
  SELECT d, path, substr(path, 1, greatest(32 * (d - 1), 0)) AS above, min(c) AS c, count(*) AS n_convs,
    (count(*) - 1) * any_value(n) AS saved
  FROM members GROUP BY d, path
), families AS (
  SELECT d - 1 AS d, above AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY d, above
), subtrees AS (
  SELECT m.d, m.path, count(*) FILTER (WHERE f.n_children IS NULL) AS n_leaves, sum(saved) AS saved
  FROM nodes k LEFT JOIN families f ON f.d = k.d AND f.path = k.path
    JOIN members m ON m.c = k.c AND m.d <= k.d GROUP BY m.d, m.path
), ends AS (
  SELECT d, path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest
  FROM members m JOIN (SELECT c, max(d) AS d FROM members GROUP BY c) USING (c, d) GROUP BY d, path
)
SELECT k.c AS conv_id, k.d::BIGINT AS depth, p.c AS parent_conv_id, k.n_convs,
  coalesce(f.n_children, 0) AS n_children, n_leaves, s.saved::BIGINT AS saved_tokens,
  coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes k JOIN subtrees s ON s.d = k.d AND s.path = k.path
  LEFT JOIN nodes p ON p.d = k.d - 1 AND p.path = k.above
  LEFT JOIN families f ON f.d = k.d AND f.path = k.path
  LEFT JOIN ends e ON e.d = k.d AND e.path = k.path
"""


def vector_codes_sql() -> str:
    """Codes in 64-bit integers, for vectors of one width that the number of parts divides."""
    rounds, before = [], "book0"
    for number in range(vector_codes.ROUNDS + 1):
        rounds.append(f"""near{number} AS MATERIALIZED (
  SELECT r, c.part, any_value(c.p) AS p,
    min(list_sum(list_transform(list_zip(c.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT
      * {vector_codes.ENTRIES} + entry) AS best
  FROM cut c JOIN {before} b ON c.part = b.part GROUP BY r, c.part
)""")
        if number < vector_codes.ROUNDS:
            rounds.append(f"""book{number + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(any_value(m.p), any_value(b.p)) AS p
  FROM {before} b LEFT JOIN (
    SELECT part, entry, list(v ORDER BY i) AS p FROM (
      SELECT part, entry, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM (
        SELECT part, best % {vector_codes.ENTRIES} AS entry, unnest(p) AS v, generate_subscripts(p, 1) AS i
        FROM near{number}) GROUP BY part, entry, i) GROUP BY part, entry
  ) m ON m.part = b.part AND m.entry = b.entry GROUP BY b.part, b.entry
)""")
            before = f"book{number + 1}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding,
    list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v,
    len(embedding) // {vector_codes.PARTS} AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT r, part, v[part * w + 1:part * w + w] AS p FROM kept, range({vector_codes.PARTS}) AS n(part)
), seeds AS (
  SELECT first(r ORDER BY embedding) AS r, row_number() OVER (ORDER BY vec_id) - 1 AS entry
  FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id
), book0 AS MATERIALIZED (
  SELECT part, entry, p FROM seeds JOIN cut USING (r) WHERE entry < {vector_codes.ENTRIES}
), {", ".join(rounds)}, coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(best % {vector_codes.ENTRIES})), 2, '0'), '' ORDER BY part) AS code,
    sum(best // {vector_codes.ENTRIES})::BIGINT AS error
  FROM near{vector_codes.ROUNDS} GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) AS digest FROM {before}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  digest AS codebooks_sha256
FROM kept JOIN coded USING (r), books
"""


def all_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": LINE_DEDUP,
        "op5_warc": WARC,
        "op6_ngram_join": NGRAM_JOIN,
        "op7_license_scan": license_sql(),
        "op9_sharding": SHARDING,
        "op10_decontaminate": DECONTAMINATE,
        "op12_vector_codes": vector_codes_sql(),
        "op13_conversation_trie": CONVERSATION_TRIE,
    }
