"""The manifest's audit as SQL: recursive levels of a table small enough for one machine."""


def _field(c: str) -> str:
    value = f"CAST({c} AS VARCHAR)"
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs `<name>_nodes` and `<name>_sides` from `leaves` (tree, pos, h): every level's nodes, and
    the siblings of each node to its left and right."""
    return f"""
{name}_nodes AS (
  SELECT tree, 0 AS level, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3)
  FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, pos // 3),
{name}_sides AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name}_nodes a JOIN {name}_nodes b
    ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY ALL)"""


def _walk(name: str, start: str, tree: str) -> str:
    """CTE `<name>` of rows that climb `tree` from `start` (row, tree, pos, proof, h)."""
    return f"""
{name}_all AS (
  SELECT row, tree, 0 AS level, pos, proof, h FROM {start}
  UNION ALL
  SELECT row, w.tree, w.level + 1, w.pos // 3, proof || l || r, sha256(l || h || r)
  FROM {name}_all w JOIN {tree}_sides s
    ON w.tree IS NOT DISTINCT FROM s.tree AND w.level = s.level AND w.pos = s.pos),
{name} AS (SELECT row, arg_max(proof, level) AS proof, arg_max(h, level) AS h FROM {name}_all GROUP BY row)"""


#: CRC-32 of a decimal number, bit by bit (4294967295 and 3988292384 are fixed values of CRC-32).
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))), lambda c, b: list_reduce(
  list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

AUDIT = f"""WITH RECURSIVE
rows AS (SELECT doc_id, source, {_leaf("text")} AS leaf,
  {_leaf(f"(CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS fresh FROM documents),
placed AS (SELECT *, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  row_number() OVER () AS row, leaf AS h FROM rows),{_tree("low", "placed")},
subroots AS (SELECT tree AS source, h, 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM low_nodes WHERE n = 1),
{_tree("top", "subroots")},
started AS (SELECT row, tree, pos, '' AS proof, fresh AS h FROM placed),{_walk("risen", "started", "low")},
lifted AS (SELECT r.row, 0 AS tree, s.pos, r.proof, r.h FROM risen r JOIN placed p USING (row)
  JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source),{_walk("done", "lifted", "top")}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = t.h AS verified
FROM placed p JOIN done d USING (row) JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source, (SELECT h FROM top_nodes WHERE n = 1) t"""
