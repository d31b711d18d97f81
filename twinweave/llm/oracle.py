"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from twinweave.llm.mixing import PRIMES

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce({_WORDS}, []) AS w FROM documents),
n AS (SELECT count(*) AS docs, sum(len(w))::DOUBLE / count(*) AS mean FROM d),
t AS (SELECT r, doc_id, len(w) AS dl, unnest(w) AS word FROM d),
p AS (SELECT r, doc_id, dl, word, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT word, count(*) AS df FROM p GROUP BY word),
q AS (SELECT DISTINCT doc_id AS query_id, text, w FROM d WHERE doc_id % 50 = 0),
qt AS (SELECT query_id, text, unnest(w) AS word FROM q),
qc AS (SELECT query_id, text, word, count(*) AS times FROM qt GROUP BY ALL),
s AS (
  SELECT query_id, qc.text, r, p.doc_id, sum(times * round(1e9 * ln(1 + (docs - df + 0.5) / (df + 0.5))
      * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))))::BIGINT) AS units
  FROM qc JOIN p USING (word) JOIN f USING (word) CROSS JOIN n
  WHERE p.doc_id <> query_id GROUP BY ALL
),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY units DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, doc_id, round(units::DOUBLE / 1e9, 6) AS score FROM k WHERE rank <= 10
"""

_NAME = "coalesce('=' || source, 'null')"


def _number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


_PRIMES = "[" + ", ".join(map(str, PRIMES)) + "]"

OP6 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
h AS (SELECT *, {_number("concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR, '42')")} AS h FROM d),
c AS (SELECT *, h % greatest(1, (SELECT (count(*) + 4999) // 5000 FROM d)) AS chunk FROM h),
pos AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY chunk, h, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c
),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s0),
s2 AS (SELECT *, [5.0, 2.0, 1.0][sid % 3 + 1]::DOUBLE AS weight, source_size * 2 AS most FROM s1),
s3 AS (
  SELECT *, row_number() OVER w AS turn,
    (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s2 WINDOW w AS (ORDER BY most / weight, sid)
),
s4 AS (SELECT coalesce(arg_min(level, turn), 0) AS level FROM s3 WHERE level * weight <= most),
s5 AS (
  SELECT sid, source, source_size, least(most::DOUBLE, s4.level * weight) AS target,
    ceil(source_size / 128)::BIGINT AS blocks FROM s3 CROSS JOIN s4
),
s6 AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(blocks * 2, round(target * blocks / source_size)::BIGINT) ELSE 0 END AS slots,
    {_number(f"{_NAME} || '|step0|42'")} % 8 AS step0, {_number(f"{_NAME} || '|step1|42'")} % 8 AS step1,
    {_number(f"{_NAME} || '|shift0|42'")} AS shift0, {_number(f"{_NAME} || '|shift1|42'")} AS shift1
  FROM s5
),
sl AS (SELECT *, unnest(range(slots)) AS slot FROM s6 WHERE slots > 0),
taken_blocks AS (
  SELECT sid, (slot % blocks * CASE WHEN slot < blocks THEN {_PRIMES}[step0 + 1] ELSE {_PRIMES}[step1 + 1] END
      + CASE WHEN slot < blocks THEN shift0 ELSE shift1 END) % blocks AS block, count(*) AS times
  FROM sl GROUP BY ALL
),
k AS (SELECT row_number() OVER () AS r, pos.*, sid, source_size AS ss, target FROM pos JOIN s6 ON pos.source IS NOT DISTINCT FROM s6.source),
cut AS (SELECT r, sid, start, size, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM k WHERE size > 0),
t AS (
  SELECT r, sum((least(start + size, (cut.block + 1) * 128) - greatest(start, cut.block * 128)) * times)::BIGINT AS taken
  FROM cut JOIN taken_blocks USING (sid, block) GROUP BY r
)
SELECT doc_id, size, ss AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM k LEFT JOIN t USING (r)
"""

_ESC = (r"replace(replace(replace(coalesce(text, ''), '\', '\b'), '###', '\h'), '</turn>', '\e')")
_ROLE = (r"replace(replace(replace(replace(coalesce(role, ''), '\', '\b'), '###', '\h'), '</turn>', '\e'), ': ', '\c')")

OP9 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
e AS (
  SELECT *, sum(length({_ROLE}) + length({_ESC}) + 14) OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ROLE}) + length({_ESC}) + 14)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS examples,
  coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
FROM e GROUP BY conv_id
"""

OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) t(k)
),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT cut.lang, cut.k, cut.phrase, a, cut, x.c AS l, y.c AS r, ((2000000::HUGEINT * a) // (x.c + y.c))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM c, (VALUES (1), (2), (3)) t(i), (VALUES (2), (3)) u(m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
),
kept AS (
  SELECT low.* FROM low LEFT JOIN inner_ USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM kept JOIN tot USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op4_exact_search": OP4,
    "op6_source_mix": OP6,
    "op9_chat_format": OP9,
    "op11_collocations": OP11,
}
