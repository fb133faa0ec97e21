"""DuckDB SQL for the operators that SQL can express, written apart from their methods."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: str, pattern: str) -> str:
    """The matches of a pattern in a text whose A to Z are lower-cased."""
    return f"coalesce(regexp_extract_all(translate({column}, '{UPPER}', '{LOWER}'), '{pattern}'), [])"


# -- op3: every pair of vectors ------------------------------------------------------------------------------------------

NEIGHBOURS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sound AS (
  SELECT vec_id, v, list_dot_product(v, v) AS norm FROM vectors
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(a.norm * b.norm) >= 0.9
), reach(id, r) AS (
  SELECT vec_id, vec_id FROM vectors UNION SELECT reach.id, y FROM reach JOIN links ON x = r
), degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) ON id = vec_id LEFT JOIN degrees ON x = vec_id
"""

# -- op4: every pair of documents that share a shingle -------------------------------------------------------------------

PIECE = r"[^\x20\x09-\x0D]+"
NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {words('text', PIECE)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM docs, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) t(i)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * same >= 80 * (a.n + b.n - same)
), reach(id, r) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT reach.id, y FROM reach JOIN links ON x = r
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN reach ON id = d.doc_id GROUP BY d.doc_id, n
"""

# -- op8: every window of every document ----------------------------------------------------------------------------------

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, {words('text', WORD)} AS w FROM documents
), items AS (
  SELECT item_id, {words('text', WORD)} AS w FROM benchmark
), asked AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT *, least(len(w), 10) AS k FROM items WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) t(i)
), seen AS (
  SELECT row, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM docs, (SELECT DISTINCT k FROM asked), unnest(range(1, greatest(len(w) - k + 2, 1))) t(i)
), hits AS (SELECT DISTINCT row, item_id, i, k FROM seen JOIN asked USING (k, g)),
covered AS (SELECT row, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + k)) t(p) GROUP BY row),
found AS (SELECT row, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c USING (row) LEFT JOIN found f USING (row)
"""

# -- op11: every document that shares a term ------------------------------------------------------------------------------

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH = f"""
WITH words AS (
  SELECT d.rowid AS row, d.doc_id, unnest({words('d.text', TERM)}) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents) d
), lengths AS (SELECT row, count(*) AS n FROM words GROUP BY row),
counts AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY row, doc_id, term),
held AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest({words('text', TERM)}) AS term
  FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM held, totals
), scores AS (
  SELECT a.item_id, c.row, c.doc_id,
         CAST(sum(w.weight * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + ((50 * l.n * t.docs) // t.total)))))
              AS BIGINT) AS score
  FROM asked a JOIN counts c USING (term) JOIN weights w USING (term) JOIN lengths l ON l.row = c.row, totals t
  GROUP BY a.item_id, c.row, c.doc_id
), ranked AS (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

# -- op13: levels and walks by recursion ----------------------------------------------------------------------------------


def field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# The first state of CRC-32 and its polynomial.  A byte is one element that is mixed in and eight steps.
ONES, POLYNOMIAL = 4294967295, 3988292384
STEP = f"xor(xor(a, greatest(b, 0)) >> 1, {POLYNOMIAL} * (xor(a, greatest(b, 0)) & 1))"
CRC = f"""xor(list_reduce(list_concat([{ONES}], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: {STEP}), {ONES})"""
TAMPERED = f"CASE WHEN {CRC} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '-') AS tree, {leaf('text')} AS leaf,
         {leaf(TAMPERED)} AS claim
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM leaves
), nodes(tree, lvl, pos, size, h) AS (
  SELECT tree, 0, pos, size, leaf FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY tree, lvl, pos // 8, size
), roots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1
), tops(lvl, pos, size, h) AS (
  SELECT 0, pos, size, h FROM roots
  UNION ALL
  SELECT lvl + 1, pos // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE size > 1 GROUP BY lvl, pos // 8, size
), every AS (
  SELECT tree, lvl, pos, size, h FROM nodes UNION ALL SELECT '', lvl, pos, size, h FROM tops
), runs AS (
  SELECT tree, lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM every GROUP BY tree, lvl, pos // 8
), walk(row, tree, home, lvl, pos, size, proof, fold) AS (
  SELECT row, tree, tree, 0, pos, size, '', claim FROM placed
  UNION ALL
  SELECT w.row, CASE WHEN w.size = 1 THEN '' ELSE w.tree END, home,
         CASE WHEN w.size = 1 THEN 0 ELSE w.lvl + 1 END,
         CASE WHEN w.size = 1 THEN (SELECT pos FROM roots WHERE roots.tree = w.tree) ELSE w.pos // 8 END,
         CASE WHEN w.size = 1 THEN (SELECT size FROM roots WHERE roots.tree = w.tree) ELSE (w.size + 7) // 8 END,
         CASE WHEN w.size = 1 THEN proof ELSE proof || array_to_string(list_slice(hs, 1, w.pos % 8) || list_slice(hs, w.pos % 8 + 2, 8), '') END,
         CASE WHEN w.size = 1 THEN fold ELSE sha256(array_to_string(list_slice(hs, 1, w.pos % 8), '') || fold || array_to_string(list_slice(hs, w.pos % 8 + 2, 8), '')) END
  FROM walk w JOIN runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = w.pos // 8
  WHERE NOT (w.tree = '' AND w.size = 1)
), last AS (SELECT * FROM walk WHERE tree = '' AND size = 1),
root AS (SELECT h FROM tops WHERE size = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root.h AS root, sha256(l.proof) AS proof_sha256, l.fold AS folded_root, l.fold = root.h AS verified
FROM placed p JOIN last l USING (row) JOIN roots s ON s.tree = p.tree, root
"""

ORACLES = {
    "op3_neighbours": NEIGHBOURS,
    "op4_minhash": NEAR_DUPLICATES,
    "op8_winnowing": CONTAMINATION,
    "op11_search": SEARCH,
    "op13_manifest": MANIFEST,
}
