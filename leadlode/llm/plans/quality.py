"""op8: quality rules over all documents."""

from __future__ import annotations

from leadlode.llm.common import documents
from leadlode.llm.quality import judge

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality(spark, folder):
    return judge(documents(spark, folder)).select("row.doc_id", *COLUMNS)


QUERIES = {"op8_quality": op8_quality}

SQL = {
    "op8_quality": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
c1 AS (SELECT *, regexp_replace(t, '[a-z]+', '', 'g') AS r1 FROM w),
c2 AS (SELECT *, regexp_replace(r1, '[\x20\x09-\x0D]+', '', 'g') AS r2 FROM c1),
c3 AS (SELECT *, regexp_replace(r2, '[A-Z]+', '', 'g') AS r3 FROM c2),
c4 AS (SELECT *, regexp_replace(r3, '[0-9]+', '', 'g') AS r4 FROM c3),
c5 AS (SELECT *, regexp_replace(r4, '[.,;:!?''"()\-]+', '', 'g') AS r5 FROM c4),
c6 AS (SELECT *, regexp_replace(r5, '\p{L}+', '', 'g') AS r6 FROM c5),
p AS (
  SELECT rid, doc_id, lang, t, w, len(w) AS n_words, length(t) - (length(r1) - length(r2)) AS word_chars,
    length(r6) - length(translate(r6, '#*$%&|<>', '')) AS n_symbols,
    [length(t) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4),
     length(r4) - length(r5), length(r5) - length(r6), length(r6)] AS classes,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    ' ' || regexp_replace(lower(t), '[\x20\x09-\x0D]+', '  ', 'g') || ' ' AS plain
  FROM c6),
win AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM p WHERE len(w) >= 5)),
twice AS (SELECT rid, s FROM win GROUP BY rid, s HAVING count(*) > 1),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM win JOIN twice USING (rid, s), (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
cls AS (
  SELECT lang, list_transform([sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]), sum(classes[6]),
      sum(classes[7])], lambda x: x::DOUBLE / sum(length(t))::DOUBLE) AS classes_q
  FROM p JOIN documents USING (doc_id, lang) WHERE text IS NOT NULL GROUP BY lang),
each AS (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+')) AS word FROM d WHERE lang IS NOT NULL)
  GROUP BY lang, word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS nth, sum(n) OVER (PARTITION BY lang) AS total FROM each),
refs AS (
  SELECT lang, list(word ORDER BY nth) AS ref_words,
    list_append(list(n::DOUBLE / total::DOUBLE ORDER BY nth), (first(total) - sum(n))::DOUBLE / first(total)::DOUBLE) AS words_q
  FROM ranked WHERE nth <= 16 GROUP BY lang),
hit AS (
  SELECT p.*, coalesce(rep.n, 0) AS n_repeat_words, classes_q, words_q,
    list_transform(ref_words, lambda r: (length(plain) - length(replace(plain, ' ' || r || ' ', ''))) // (length(r) + 2)) AS hits
  FROM p LEFT JOIN rep USING (rid) LEFT JOIN refs USING (lang) LEFT JOIN cls USING (lang)),
spread AS (SELECT *, list_append(hits, n_words - list_sum(hits)) AS words_n FROM hit),
dist AS (
  SELECT *,
    sqrt(greatest(0, list_sum(list_transform(list_zip(classes, classes_q), lambda z:
      CASE WHEN z[1] > 0 THEN z[1] / list_sum(classes) * log2(z[1] / list_sum(classes) / ((z[1] / list_sum(classes) + z[2]) / 2)) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] / list_sum(classes) + z[2]) / 2)) ELSE 0 END)) / 2)) AS cd,
    sqrt(greatest(0, list_sum(list_transform(list_zip(words_n, words_q), lambda z:
      CASE WHEN z[1] > 0 THEN z[1] / list_sum(words_n) * log2(z[1] / list_sum(words_n) / ((z[1] / list_sum(words_n) + z[2]) / 2)) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] / list_sum(words_n) + z[2]) / 2)) ELSE 0 END)) / 2)) AS wd,
    CASE WHEN o > 0 THEN 0.9 * sqrt((1 - o + log2(2 / (1 + o)) + o * log2(2 * o / (1 + o))) / 2) END AS empty
  FROM (SELECT *, words_q[-1] AS o FROM spread)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM dist)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (n_words < 50 OR coalesce(cd <= 0.3 AND wd <= 0.42 AND coalesce(wd <= empty, true), true)) AS kept
FROM b
"""
}
