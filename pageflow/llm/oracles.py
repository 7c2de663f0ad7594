"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op4_source_mix"] = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * max(level) OVER ()) AS target,
    ('0x' || substr(md5('mix' || coalesce('+' || source, '-')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM levels
), ranked AS (
  SELECT doc_id, size, t.source_size, t.target, t.shift,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS expected,
    row_number() OVER (PARTITION BY s.source
      ORDER BY length(bin(size)), coalesce((doc_id % 64 + 64) % 64, 0), size, doc_id NULLS FIRST) AS rank
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(expected * rank + shift) - floor(expected * (rank - 1) + shift)))::BIGINT AS taken
FROM ranked
"""

ORACLES["op5_reply_trees"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS no
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY no) AS spoken,
    coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '') AS loss,
    sum(12 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(role) - length(replace(role, chr(10), ''))
        + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 10 + 1) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(spoken) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM joined
"""

ORACLES["op9_site_lines"] = rf"""
WITH split AS (
  SELECT doc_id, source, text, row_number() OVER () AS no, string_split(text, chr(10)) AS lines FROM documents
), totals AS (
  SELECT source, count(*) AS total FROM documents GROUP BY source
), held AS (
  SELECT source, line, count(*) AS pages
  FROM (SELECT DISTINCT no, source, unnest(lines) AS line FROM split) WHERE regexp_matches(line, '{_WORD}')
  GROUP BY source, line HAVING count(*) >= 5
), bad AS (
  SELECT h.source, h.line FROM held h JOIN totals t ON h.source IS NOT DISTINCT FROM t.source
  WHERE h.pages > t.total * 0.1::DOUBLE
), kept AS (
  SELECT s.no, string_agg(s.line, chr(10) ORDER BY s.at) AS text
  FROM (SELECT no, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS at FROM split) s
  ANTI JOIN bad b ON s.source IS NOT DISTINCT FROM b.source AND s.line = b.line
  GROUP BY s.no
)
SELECT s.doc_id, coalesce(len(s.lines), 0)::BIGINT AS n_lines, coalesce(length(s.text), 0)::BIGINT AS n_chars,
  coalesce(length(k.text), 0)::BIGINT AS kept_chars,
  CASE WHEN s.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS kept_md5
FROM split s LEFT JOIN kept k ON s.no = k.no
"""

ORACLES["op7_warc_index"] = r"""
WITH digests AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), largest AS (
  SELECT html, max(page_id) AS last FROM digests GROUP BY html
)
SELECT page_id, strlen(d.html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (('0x' || substr(sha, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT)::INT % 32, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM digests d JOIN largest l ON d.html = l.html
"""

ORACLES["op2_vector_graph"] = r"""
WITH RECURSIVE units AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
), reached AS (
  SELECT vec_id, vec_id AS root FROM embeddings
  UNION
  SELECT l.b AS vec_id, r.root FROM reached r JOIN links l ON r.vec_id = l.a
)
SELECT e.vec_id, coalesce(any_value(c.n), 0)::BIGINT AS n_links, min(r.root)::BIGINT AS component_id,
  e.vec_id = min(r.root) AS kept
FROM embeddings e JOIN reached r USING (vec_id) LEFT JOIN counts c USING (vec_id) GROUP BY e.vec_id
"""

ORACLES["op11_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS no
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, t.no, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.no <= c.h
  UNION ALL SELECT c.conv_id, t.no + 1000000, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.no > c.h
), steps AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
    md5(string_agg(md5(length(role) || ':' || role || text), '') OVER w) AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), members AS (
  SELECT conv_id, depth, bytes, path FROM steps UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), ends AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM members GROUP BY conv_id) GROUP BY path
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved
  FROM members GROUP BY path, depth
), ways AS (
  SELECT n.path, n.saved, m.path AS above, m.depth AS above_depth, n.depth
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
), children AS (
  SELECT above AS path, count(*) AS n FROM ways WHERE above_depth = depth - 1 GROUP BY above
), sums AS (
  SELECT w.above AS path, sum(w.saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM ways w LEFT JOIN children c ON c.path = w.path GROUP BY w.above
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(c.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
  coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN ways w ON w.path = n.path AND w.above_depth = n.depth - 1 LEFT JOIN nodes p ON p.path = w.above
"""

ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, list_slice(w, i, i + size - 1) AS words FROM starts, (SELECT unnest(range(1, 5)) AS size) WHERE i + size - 1 <= len(w)
), counts AS (
  SELECT lang, words, count(*) AS f FROM grams GROUP BY lang, words
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(words) = 1 GROUP BY lang
), frequent AS (
  SELECT * FROM counts WHERE f >= 30
), cuts AS (
  SELECT c.lang, c.words, c.f, k, l.f AS l, r.f AS r, (c.f::HUGEINT * 2000000) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM frequent WHERE len(words) > 1) c
  JOIN frequent l ON l.lang = c.lang AND l.words = list_slice(c.words, 1, k) JOIN frequent r ON r.lang = c.lang AND r.words = list_slice(c.words, k + 1, len(c.words))
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, list_slice(words, a, b) AS words, f FROM (
    SELECT lang, words, f, a, unnest(range(a + 1, len(words) + 1)) AS b
    FROM (SELECT *, unnest(range(1, len(words))) AS a FROM frequent)) WHERE b - a + 1 < len(words)
), held AS (
  SELECT lang, words, max(f) AS f FROM inner_parts GROUP BY lang, words
), ranked AS (
  SELECT s.lang, array_to_string(s.words, ' ') AS phrase, s.f AS a, s.l, s.r, s.score,
    row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.f DESC, array_to_string(s.words, ' ')) AS rank
  FROM lowest s LEFT JOIN held h ON h.lang = s.lang AND h.words = s.words WHERE h.f IS NULL OR 100 * h.f < 80 * s.f
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

ORACLES["op13_top_products"] = r"""
WITH scaled AS (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.no <> c.no AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id NULLS LAST) <= 20
"""
