"""op2: all documents mixed to the weights 1, 2, 3 of their sources."""

from __future__ import annotations

from leadlode.llm.common import documents
from leadlode.llm.mixing import mix_sizes


def op2_mix(spark, folder):
    return mix_sizes(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mix": op2_mix}

SQL = {
    "op2_mix": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
capped AS (SELECT *, (pos - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM named),
ranked AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS rnk FROM capped),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER prev, 0))::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER prev, 0))::DOUBLE AS level
  FROM ranked WINDOW prev AS (ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, min(CASE WHEN cap > level * w THEN rnk END) OVER () AS first_rnk FROM levels),
per AS (
  SELECT source, source_size, CASE WHEN rnk >= first_rnk
      THEN max(CASE WHEN rnk = first_rnk THEN level END) OVER () * w ELSE cap::DOUBLE END AS target
  FROM opened),
rule AS (
  SELECT *, target - whole * source_size AS rest,
    CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS share
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM per)),
s AS (SELECT d.*, source_size, target, whole, rest, share, size * 100 > source_size AS large
  FROM d JOIN rule r ON d.source IS NOT DISTINCT FROM r.source),
big AS (
  SELECT source, share, key, size, row_number() OVER (PARTITION BY source ORDER BY size DESC, key) AS k
  FROM (SELECT source, share, key, sum(size)::BIGINT AS size FROM s WHERE large GROUP BY source, share, key)),
fold AS (
  SELECT source, k, key, size, seen, taken + CASE WHEN take THEN size ELSE 0 END AS taken, take FROM (
    SELECT source, k, key, size, 0::BIGINT AS taken, 0::BIGINT AS seen,
      (2.0::DOUBLE * (0 - share * 0) + size * (1.0::DOUBLE - 2.0::DOUBLE * share)) < 0 AS take FROM big WHERE k = 1)
  UNION ALL
  SELECT source, k, key, size, seen, taken + CASE WHEN take THEN size ELSE 0 END, take FROM (
    SELECT b.source, b.k, b.key, b.size, f.taken, f.seen + f.size AS seen,
      (2.0::DOUBLE * (f.taken - b.share * (f.seen + f.size)) + b.size * (1.0::DOUBLE - 2.0::DOUBLE * b.share)) < 0 AS take
    FROM fold f JOIN big b ON b.k = f.k + 1 AND b.source IS NOT DISTINCT FROM f.source)),
lt AS (SELECT source, sum(CASE WHEN take THEN size ELSE 0 END) AS large_taken FROM fold GROUP BY source),
want AS (SELECT r.*, r.rest - coalesce(large_taken, 0) AS want
  FROM rule r LEFT JOIN lt ON r.source IS NOT DISTINCT FROM lt.source),
small AS (SELECT source, key, key >> 50 AS rng, sum(size)::BIGINT AS size FROM s WHERE NOT large GROUP BY source, key),
ranges AS (
  SELECT source, rng, sum(size) AS size,
    coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY rng ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM small GROUP BY source, rng),
found AS (
  SELECT r.source, rng, below, want FROM ranges r JOIN want w ON r.source IS NOT DISTINCT FROM w.source
  WHERE below < want AND below + size >= want),
inside AS (
  SELECT f.*, m.key, f.below + coalesce(sum(m.size) OVER (PARTITION BY f.source ORDER BY m.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + m.size / 2.0::DOUBLE AS upto
  FROM found f JOIN small m ON m.rng = f.rng AND m.source IS NOT DISTINCT FROM f.source),
cuts AS (SELECT source, coalesce(max(CASE WHEN upto <= want THEN key END), (first(rng) << 50) - 1) AS cut FROM inside GROUP BY source),
final AS (
  SELECT w.source, w.want, coalesce(c.cut, CASE WHEN w.want <= 0 THEN -1 ELSE 1152921504606846976 END) AS cut
  FROM want w LEFT JOIN cuts c ON w.source IS NOT DISTINCT FROM c.source)
SELECT s.doc_id, s.size, s.source_size, s.target,
  (s.whole + CASE WHEN s.large THEN coalesce(f.take, false)::INT ELSE (s.key <= x.cut)::INT END) * s.size AS taken
FROM s JOIN final x ON s.source IS NOT DISTINCT FROM x.source
LEFT JOIN fold f ON s.large AND f.key = s.key AND f.source IS NOT DISTINCT FROM s.source
"""
}
