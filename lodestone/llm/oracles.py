"""DuckDB SQL for the queries that SQL can state; the others are held by tests."""

#: Words of an ASCII-lower-cased text, and its CRC-32 by a table of the polynomial.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_TABLE = "(SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda s, i: xor(s >> 1, (s & 1) * 3988292384), b)) AS tab)"
_BYTES = "list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::INTEGER, 2))::BIGINT)"

NGRAM_JOIN = f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
same AS (  -- documents of one set are one
  SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS rep FROM (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS key FROM shingles GROUP BY 1)),
reps AS (SELECT s.doc_id, g, n FROM shingles s JOIN sizes USING (doc_id) JOIN same m ON m.doc_id = s.doc_id AND m.rep = s.doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM reps a JOIN reps b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT rep AS a, rep AS b FROM same UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
copies AS (SELECT rep, count(*) AS copies FROM same GROUP BY 1),
linked AS (SELECT l.a AS rep, sum(c.copies) AS links FROM links l JOIN copies c ON c.rep = l.b GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, (coalesce(links, 0) + coalesce(copies - 1, 0))::BIGINT AS n_links, coalesce(copies, 1) AS n_copies
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN same USING (doc_id) LEFT JOIN least_of ON a = same.rep LEFT JOIN copies c ON c.rep = same.rep LEFT JOIN linked k ON k.rep = same.rep
"""

SHARDING = f"""
WITH sized AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 16 AS size FROM documents),
placed AS (
  SELECT doc_id, size, t, row_number() OVER w - 1 AS nth, sum(size) OVER w AS upto, sum(size) OVER () AS total
  FROM (SELECT *, md5(t) AS digest FROM sized) WINDOW w AS (ORDER BY digest, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cut AS (SELECT *, least(39, (((2 * upto - size) * 40) // (2 * total)))::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, xor(list_reduce({_BYTES.format('t')}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32, 'bytes' AS law, shard,
  nth - min(nth) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard
FROM cut, {_CRC_TABLE}
"""

DECONTAMINATION = f"""
WITH words_of AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, row_number() OVER () AS r FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS key FROM items WHERE len(w) > 0),
places AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS key FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words_of, (SELECT DISTINCT size FROM windows))),
found AS (SELECT p.r, p.i, p.size, x.item_id FROM places p JOIN windows x USING (size, key)),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY 1),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words_of LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

HARD_NEGATIVES = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM fine a JOIN fine c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
    xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda crc, b:
      list_reduce(range(8), lambda s, i: xor(s >> 1, (s & 1) * 3988292384), xor(crc, b)), 4294967295), 4294967295) % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 5),
steps AS (SELECT c, len(turns) AS length, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
prefixes AS (SELECT c, length, depth, sha256(turns[1:depth]::VARCHAR) AS node, sha256(turns[1:depth - 1]::VARCHAR) AS parent, strlen(turns[depth].text) AS bytes FROM steps),
nodes AS (
  SELECT depth, node, min(c) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, coalesce(any_value(bytes), 0) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN length = depth THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, node),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.parent = n.node) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent),
above AS (  -- every node with each node over it, by way of its least conversation
  SELECT l.n_children, l.n_convs, l.bytes, p.depth, p.node FROM linked l JOIN prefixes p ON p.c = l.conv_id AND p.depth <= l.depth),
sums AS (SELECT depth, node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM above GROUP BY depth, node)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM linked JOIN sums USING (depth, node)
"""

SQL = {
    "op1_ngram_join": NGRAM_JOIN,
    "op4_sharding": SHARDING,
    "op7_decontamination": DECONTAMINATION,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_hard_negatives": HARD_NEGATIVES,
}
