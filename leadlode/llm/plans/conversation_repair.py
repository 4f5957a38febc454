"""op12: the cheapest repair of every conversation, after a seeded damage."""

from __future__ import annotations

from leadlode.llm.conversation_repair import damage, repair


def op12_conversation_repair(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    return repair(damage(rows), rows.select("conv_id"))


def _more(value: str, cost: str, letter: str) -> str:
    """A state's ``cost, audit`` (six digits and letters) after one more edit."""
    return f"(lpad((left({value}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({value}, 7) || '{letter}')"


def _stay(to: str, sources: str, initial: str) -> str:
    """Least of a row's edits that end in state ``to``."""
    options = [_more(to, "3", "D")]
    for s in sources:
        options.append(f"CASE WHEN may AND init = '{initial}' THEN {_more(s, 'late', 'K')} END")
        if initial != "s":
            options.append(f"CASE WHEN may THEN {_more(s, '2 + late', 'R')} END")
    return f"least({', '.join(options)})"


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
SQL = {
    "op12_conversation_repair": rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations),
dealt AS (
  SELECT conv_id, turn, role, text, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))) % 20 AS fate
  FROM named),
rows0 AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, range(2) AS t(copy) WHERE copy < CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
rows1 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM (
    SELECT *, trim(text, E' \t\n\x0b\x0c\r') AS bare,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM rows0)),
told AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS init, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate,
    bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows1),
steps AS (SELECT conv_id, i, init, NOT (blank OR duplicate) AS may, truncated::INT AS late FROM told),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM told GROUP BY conv_id),
paths(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, '000000', NULL::VARCHAR, '000002I', '000004II' FROM counts
  UNION ALL
  SELECT conv_id, i, e, s, u2, least(a1, {_more("u2", "2", "I")}) FROM (
    SELECT *, least(u1, {_more("e", "2", "I")}, {_more("s", "2", "I")}, {_more("a1", "2", "I")}) AS u2 FROM (
      SELECT p.conv_id, p.i + 1 AS i, {_more("e", "3", "D")} AS e, {_stay("s", "e", "s")} AS s,
        {_stay("u", "esa", "u")} AS u1, {_stay("a", "u", "a")} AS a1
      FROM paths p JOIN steps t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1))),
best AS (
  SELECT p.conv_id, left(least(e, a), 6)::BIGINT AS cost, substr(least(e, a), 7) AS audit
  FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n),
letters AS (SELECT conv_id, k, audit[k] AS letter FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM best)),
placed AS (
  SELECT *, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS pos FROM letters
  WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (
  SELECT p.conv_id, p.k, p.letter, p.pos, t.role, t.text, max((p.letter = 'K' AND t.init = 's')::INT) OVER (PARTITION BY p.conv_id) AS opened
  FROM placed p LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i AND p.letter <> 'I' WHERE p.letter <> 'D'),
digests AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (pos - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS digest FROM said GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
}
