"""op11: components and numbers of links of all documents under the Jaccard similarity of their shingles."""

from __future__ import annotations

from leadlode.llm.common import documents
from leadlode.llm.parity_join import jaccard_join


def op11_parity_join(spark, folder):
    return jaccard_join(documents(spark, folder))


QUERIES = {"op11_parity_join": op11_parity_join}
SQL = {
    "op11_parity_join": r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
      lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM cut),
items AS (SELECT r, unnest(s) AS shingle FROM sets),
common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS n FROM items a JOIN items b USING (shingle)
  JOIN sets p ON p.r = a.r JOIN sets q ON q.r = b.r
  WHERE a.r <> b.r AND 100 * least(len(p.s), len(q.s)) >= 90 * greatest(len(p.s), len(q.s)) GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sets p ON p.r = x JOIN sets q ON q.r = y
  WHERE 100 * n >= 90 * (len(p.s) + len(q.s) - n)),
reached(r, doc_id) AS (
  SELECT r, doc_id FROM sets
  UNION SELECT y, doc_id FROM reached JOIN links ON x = r)
SELECT doc_id, len(s)::BIGINT AS n_shingles,
  CASE WHEN len(s) = 0 THEN doc_id ELSE (SELECT min(g.doc_id) FROM reached g WHERE g.r = sets.r) END AS component_id,
  (SELECT count(*) FROM links WHERE x = sets.r) AS n_links
FROM sets
"""
}
