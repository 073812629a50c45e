"""DuckDB SQL of the corpus operators that SQL can express."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

OP11 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.other FROM reach r JOIN links l ON r.other = l.vec_id
), least AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), degrees AS (
  SELECT vec_id, count(*) AS n FROM links GROUP BY vec_id
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN degrees USING (vec_id)
"""

OP12 = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, other, score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), found AS (
  SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)::INTEGER AS rank
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, nodes: str, levels: int) -> str:
    """CTEs of a forest over nodes (g, pos, d, n): <name>_0.. with each node's siblings."""
    out = []
    for k in range(levels):
        run = "PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}_{k} AS (
  SELECT *, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {nodes}
), {name}_up{k} AS (
  SELECT g, pos // 16 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d, (any_value(n) + 15) // 16 AS n
  FROM {nodes} GROUP BY g, pos // 16
)""")
        nodes = f"{name}_up{k}"
    return ", ".join(out)


def op13(levels: int = 6) -> str:
    """Sources of up to 16 ** levels rows, and as many sources."""
    joins, names = "", []
    for tree, place, group in (("doc", "x.pos", "x.g"), ("src", "y.pos", "''")):
        for k in range(levels):
            a = f"{tree}{k}"
            joins += f" JOIN {tree}_{k} {a} ON {a}.g = {group} AND {a}.pos = {place} // {16**k}"
            names.append(a)
    # each step of the fold is a query of its own, so that none is written twice
    wide = ", ".join(f"{a}.l AS {a}_l, {a}.r AS {a}_r, {a}.n AS {a}_n" for a in names)
    steps, before = [], "held"
    for i, a in enumerate(names):
        steps.append(f"fold{i} AS (SELECT * REPLACE (CASE WHEN {a}_n > 1 THEN sha256({a}_l || h || {a}_r) ELSE h END AS h) FROM {before})")
        before = f"fold{i}"
    whole = " || ".join(f"{a}_l || {a}_r" for a in names)
    return f"""
WITH table_ AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT] || list_transform(range(8), lambda z: 0::UBIGINT), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t
), checked AS (
  SELECT *, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INTEGER])), 4294967295::UBIGINT) AS crc
  FROM documents, table_
), leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS g, {_leaf("text")} AS leaf,
    CASE WHEN crc % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM checked
), placed AS (
  SELECT *, leaf AS d, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
), doc_nodes AS (SELECT g, pos, d, n FROM placed), {_tree("doc", "doc_nodes", levels)},
subroots AS (
  SELECT g AS source_g, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM doc_up{levels - 1}
), src_nodes AS (SELECT '' AS g, pos, d, n FROM subroots), {_tree("src", "src_nodes", levels)},
held AS (
  SELECT x.doc_id, x.leaf, y.d AS subroot, top.d AS root, coalesce(x.changed, x.leaf) AS h, {wide}
  FROM placed x JOIN subroots y ON y.source_g = x.g JOIN src_up{levels - 1} top ON true{joins}
), {", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256({whole}) AS proof_sha256, h AS folded_root, h = root AS verified FROM {before}
"""


OP13 = op13()
