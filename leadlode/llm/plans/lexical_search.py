"""op13: the ten best documents of every benchmark item."""

from __future__ import annotations

from leadlode.llm.common import documents
from leadlode.llm.lexical_search import search


def op13_lexical_search(spark, folder):
    return search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


_TERMS = (
    r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

QUERIES = {"op13_lexical_search": op13_lexical_search}
SQL = {
    "op13_lexical_search": f"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS terms FROM documents),
docs AS (SELECT r, doc_id, len(terms) AS n, terms FROM cut WHERE len(terms) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM docs),
asked AS (
  SELECT DISTINCT item_id, list_sort(list_distinct(t)) AS terms
  FROM (SELECT item_id, {_TERMS.format("coalesce(text, '')")} AS t FROM benchmark) WHERE len(t) > 0),
items AS (SELECT row_number() OVER () AS q, item_id, terms FROM asked),
wanted AS (SELECT q, unnest(terms) AS term FROM items),
tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, whole GROUP BY term, n_docs),
scores AS (
  SELECT q, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN w USING (term) JOIN docs USING (r), whole GROUP BY q, r),
placed AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
  FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed JOIN items USING (q) WHERE rank <= 10
"""
}
