"""DuckDB SQL for the queries that SQL can express."""

OP8 = r"""
WITH conv AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                   (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT)
    AS formatted_chars
FROM conv GROUP BY conv_id
"""

OP9 = r"""
WITH parts AS (
  SELECT doc_id, text, string_split(regexp_replace(text, '([.!?] |\n)', '\1' || chr(30), 'g'), chr(30)) AS p
  FROM documents),
lines AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM parts),
full_lines AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM lines WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
windows AS (
  SELECT doc_id, k, t AS a, lead(t) OVER w AS b, lead(t, 2) OVER w AS c
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
ranked AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS n
  FROM windows WHERE c IS NOT NULL AND length(a) + length(b) + length(c) >= 40),
covered AS (SELECT DISTINCT doc_id, k + j AS k FROM ranked, (VALUES (0), (1), (2)) AS s(j) WHERE n > 1),
gone AS (SELECT f.doc_id, f.pos FROM full_lines f JOIN covered c ON f.doc_id = c.doc_id AND f.k = c.k),
kept AS (
  SELECT l.doc_id, string_agg(l.line, '' ORDER BY l.pos) FILTER (g.pos IS NULL) AS text,
    count(g.pos) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
  coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}::VARCHAR, ''),
    lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295)"""

OP11 = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                       sha256(coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS base, """ + CRC.format("c") + """ % 6 AS h FROM (SELECT DISTINCT c FROM own)),
heads AS (SELECT v.c, o.i, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.i < v.h),
given AS (SELECT c, count(*) AS n FROM heads GROUP BY c),
rebuilt AS (
  SELECT * FROM heads UNION ALL
  SELECT o.c, o.i - v.h + coalesce(g.n, 0), o.role, o.text
  FROM own o JOIN convs v ON o.c = v.c LEFT JOIN given g ON g.c = o.c WHERE o.i >= v.h),
path AS (
  SELECT c, i + 1 AS depth, length(text) AS chars,
    string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY i) AS key
  FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT depth, key, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars
          FROM path GROUP BY depth, key),
tied AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN path a ON a.c = n.conv_id
           AND a.depth = n.depth - 1 LEFT JOIN nodes p ON p.depth = a.depth AND p.key = a.key),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children
         FROM tied WHERE depth > 0 GROUP BY ALL),
sums AS (SELECT a.depth, a.key, count(*) FILTER (k.n_children IS NULL) AS n_leaves,
           CAST(sum((t.n - 1) * t.chars) AS BIGINT) AS saved_tokens
         FROM tied t LEFT JOIN kids k ON k.conv_id = t.conv_id AND k.depth = t.depth
         JOIN path a ON a.c = t.conv_id AND a.depth <= t.depth GROUP BY a.depth, a.key),
ends AS (SELECT depth, key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256
         FROM (SELECT c, max(depth) AS depth, arg_max(key, depth) AS key FROM path GROUP BY c) GROUP BY depth, key)
SELECT t.conv_id, t.depth, t.parent_conv_id, t.n AS n_convs, coalesce(k.n_children, 0) AS n_children,
  s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM tied t JOIN sums s ON s.depth = t.depth AND s.key = t.key
LEFT JOIN kids k ON k.conv_id = t.conv_id AND k.depth = t.depth
LEFT JOIN ends e ON e.depth = t.depth AND e.key = t.key
"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "({0})", "text")) + ")"

OP12 = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, """ + _LEAF.format("n_chars") + """ AS leaf, """ + _LEAF.format("n_chars + 1") + """ AS other,
    """ + CRC.format("doc_id") + """ % 7 = 0 AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
           FROM leaves),
levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 2),
    lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos
             FROM levels WHERE len(nodes) = 1),
uppers AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2),
    lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM uppers WHERE len(nodes) > 1),
sides AS (
  SELECT p.doc_id, p.leaf, 0 AS part, l.level, p.pos >> l.level AS spot, l.nodes
  FROM placed p JOIN levels l ON l.lang IS NOT DISTINCT FROM p.lang AND len(l.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, 1, u.level, s.pos >> u.level, u.nodes
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN uppers u ON len(u.nodes) > 1),
proofs AS (
  SELECT doc_id, leaf, list(CASE WHEN spot % 2 = 1 THEN nodes[spot] || ':' ELSE ':' || coalesce(nodes[spot + 2], '') END
                            ORDER BY part, level) AS proof
  FROM sides GROUP BY doc_id, leaf),
folded AS (
  SELECT p.doc_id, p.lang, p.leaf, coalesce(q.proof, []) AS proof, list_reduce(
    [CASE WHEN p.tampered THEN coalesce(p.other, p.leaf) ELSE p.leaf END] || coalesce(q.proof, []),
    lambda node, side: sha256(split_part(side, ':', 1) || node || split_part(side, ':', 2))) AS folded_root
  FROM placed p LEFT JOIN proofs q ON q.doc_id = p.doc_id AND q.leaf = p.leaf)
SELECT f.doc_id, f.leaf, s.subroot, u.nodes[1] AS root,
  sha256(replace(array_to_string(f.proof, ''), ':', '')) AS proof_sha256, f.folded_root,
  f.folded_root = u.nodes[1] AS verified
FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang JOIN uppers u ON len(u.nodes) = 1
"""

ORACLES = {"op8_reply_trees": OP8, "op9_line_windows": OP9, "op11_prefix_trie": OP11,
           "op12_merkle_manifest": OP12}
