"""The registered queries as SQL over the same tables, for the DuckDB check.

Written from the definition of each operator, not from its plan: windows instead of
pre-aggregation, plain joins instead of salted ones, the pair condition instead of
expanded keys.
"""

from __future__ import annotations

from twinweave.plans.workload import BATCH_STEPS, FIT, MODEL_FITS, N_WORKERS, WEIGHTS

_PATTERN = "[^0-9A-Za-z.]+"

# -- views ------------------------------------------------------------------

_DOCS = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS sub, text, lang,
         CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN 'source' ELSE 'target' END AS db
  FROM documents)"""
_QUALITY = """quality AS (
  SELECT docs.sub, docs.db, CAST(l.quality AS VARCHAR) AS obj
  FROM labels l JOIN docs ON docs.sub = CAST(l.doc_id AS VARCHAR))"""
_LINES = """lines AS (
  SELECT sub, db, obj FROM (
    SELECT sub, db, unnest(string_split(text, chr(10))) AS obj FROM docs) WHERE obj <> '')"""
_TITLES = """titles AS (
  SELECT CAST(page_id AS VARCHAR) AS sub, url,
         regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
         CASE WHEN starts_with(url, 'https:') THEN 'target' ELSE 'source' END AS db
  FROM pages)"""
_COPIES = """copies AS (
  SELECT a.sub AS source, b.sub AS target FROM docs a JOIN docs b USING (text)
  WHERE a.db = 'source' AND b.db = 'target')"""
_NAMES = """names AS (
  SELECT CAST(c_custkey AS VARCHAR) AS sub, 'source' AS db, c_name AS obj, c_nationkey AS nk FROM customer
  UNION ALL
  SELECT CAST(s_suppkey AS VARCHAR), 'target', s_name, s_nationkey FROM supplier),
nations AS (SELECT sub, db, n_name AS obj FROM names JOIN nation ON nk = n_nationkey)"""
_ORDERS = """op AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target,
         max(l_discount) * 10 AS d, max(l_quantity) / 50 AS q, max(l_tax) * 12.5 AS t,
         max(l_returnflag) AS flag,
         CASE WHEN max(l_linestatus) = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS closed
  FROM lineitem GROUP BY l_orderkey, l_partkey),
sc AS (SELECT *, (d + q + t) / 3 AS score FROM op)"""
_ORDER_REF = """ref AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target
  FROM lineitem WHERE l_returnflag = 'R')"""
_ORDER_LABELS = "lab AS (SELECT source, target, closed AS is_match FROM op WHERE q > 0.5)"
_TOP1 = """top1 AS (
  SELECT source, target FROM (
    SELECT *, rank() OVER (PARTITION BY source ORDER BY score DESC) AS r FROM sc WHERE score > 0.5)
  WHERE r = 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _rare(kv: str, max_len: int) -> str:
    """``kv(sub, db, obj)`` to ``keys(sub, db, key)``; a value is identified by its text."""
    return f"""val AS (SELECT DISTINCT sub, db, lower(obj) AS obj FROM {kv}),
occ AS (
  SELECT unnest(list_filter(regexp_split_to_array(lower(obj), '{_PATTERN}'), lambda x: x <> '')) AS word
  FROM {kv}),
freq AS (SELECT word, count(*) AS cnt FROM occ GROUP BY word),
vw AS (
  SELECT DISTINCT sub, db, obj, unnest(list_filter(regexp_split_to_array(obj, '{_PATTERN}'), lambda x: x <> '')) AS word
  FROM val),
rk AS (
  SELECT sub, db, obj, word, rnk, max(rnk) OVER (PARTITION BY sub, db, obj) AS top FROM (
    SELECT sub, db, obj, vw.word,
           dense_rank() OVER (PARTITION BY sub, db, obj ORDER BY cnt) AS rnk
    FROM vw JOIN freq USING (word)) WHERE rnk <= {max_len}),
keys AS (
  SELECT DISTINCT sub, db, word AS key FROM rk WHERE top = 1
  UNION
  SELECT DISTINCT a.sub, a.db, a.word || '@' || b.word
  FROM rk a JOIN rk b ON a.sub = b.sub AND a.db = b.db AND a.obj = b.obj AND a.rnk < b.rnk)"""


_TEXT = "txt AS (SELECT sub, db, text AS obj FROM docs)"
_TITLE = "ttl AS (SELECT sub, db, title AS obj FROM titles)"


def _pairs(universe: str) -> str:
    """``keys`` to ``pairs(source, target)``; an instance without a key meets everybody."""
    return f"""lone AS (SELECT sub, db FROM {universe} EXCEPT SELECT sub, db FROM keys),
pairs AS (
  SELECT a.sub AS source, b.sub AS target FROM keys a JOIN keys b USING (key)
  WHERE a.db = 'source' AND b.db = 'target'
  UNION
  SELECT a.sub, b.sub FROM lone a JOIN (SELECT DISTINCT sub, db FROM {universe}) b
  ON a.db = 'source' AND b.db = 'target'
  UNION
  SELECT a.sub, b.sub FROM (SELECT DISTINCT sub, db FROM {universe}) a JOIN lone b
  ON a.db = 'source' AND b.db = 'target')"""


_ONES = """ones AS (
  SELECT key, min(sub) FILTER (db = 'source') AS source, min(sub) FILTER (db = 'target') AS target
  FROM keys GROUP BY key
  HAVING count(DISTINCT sub) FILTER (db = 'source') = 1 AND count(DISTINCT sub) FILTER (db = 'target') = 1)"""

_DOC_KEYS = [_DOCS, _TEXT, _rare("txt", 1)]
_DOC_PAIRS = [*_DOC_KEYS, _pairs("docs")]
_PAGE_PAIRS = [_TITLES, _TITLE, _rare("ttl", 2), _pairs("ttl")]
_PARTY_PAIRS = [_NAMES, _rare("names", 1), _pairs("names")]
_HASHED = "md5(source || '|' || target || '|{seed}|{use}')"

# Key table of one wildcard level, ``lv(sub, db, obj)`` over ``docs``.
_WILD_QUALITY = [_DOCS, _QUALITY, """known AS (SELECT DISTINCT sub, db, lower(obj) AS obj FROM quality),
absent AS (SELECT sub, db FROM docs WHERE (sub, db) NOT IN (SELECT sub, db FROM known)),
wild AS (
  SELECT sub, db, obj FROM known
  UNION ALL SELECT sub, db, 'NULL' FROM absent
  UNION ALL SELECT a.sub, a.db, k.obj FROM absent a
  JOIN (SELECT DISTINCT db, obj FROM known) k ON a.db <> k.db)"""]

# Documents with their words and quality, for the two-level pair condition.
_QUALITY_OF = "dq AS (SELECT docs.*, quality.obj AS quality FROM docs LEFT JOIN quality USING (sub, db))"


def _levels(condition: str) -> str:
    return _with(*_DOC_PAIRS, _QUALITY, _QUALITY_OF) + f"""
SELECT p.source, p.target FROM pairs p
JOIN dq s ON s.sub = p.source AND s.db = 'source' JOIN dq t ON t.sub = p.target AND t.db = 'target'
WHERE {condition}"""


# -- learner ----------------------------------------------------------------


def _recursion(examples: str, start: str, one_pass: bool, n_dims: int = 3,
               fits: dict | None = None, ex: str = "ex", run: str = "run") -> str:
    """Sequential learner as a recursion over ``examples(model, i, cnt, x0.., y)``.

    ``fits`` names the settings of each model; without it all have those of ``FIT``.
    """
    p, dims = FIT, range(n_dims)

    def of(name: str, row: str = "") -> str:
        if not fits:
            return str(getattr(FIT, name))
        cases = " ".join(f"WHEN '{m}' THEN {float(getattr(q, name))}" for m, q in fits.items())
        return f"(CASE {row}model {cases} END)::DOUBLE"

    out = "(2 / (1 + exp(-(" + " + ".join(f"w{i} * x{i}" for i in dims) + "))) - 1)"
    mean = "(" + " + ".join(f"x{i}" for i in dims) + f") / {n_dims}"
    weight = [
        f"CASE WHEN abs(s.z{i}) <= {of('l1', 's.')} THEN 0.0 "
        f"ELSE (sign(s.z{i}) * {of('l1', 's.')} - s.z{i}) / "
        f"({of('l2', 's.')} + ({of('beta', 's.')} + sqrt(s.n{i})) / {of('alpha', 's.')}) END AS w{i}"
        for i in dims
    ]
    carry = ", ".join([*[f"s.z{i}, s.n{i}" for i in dims], "s.k", "s.streak", "s.trained"])
    stop = "s.k < e.cnt" if one_pass else f"s.k < {p.max_iter} AND s.streak < {p.epochs}"
    clip = "greatest(1e-12, least(1 - 1e-12, o))"
    z = ", ".join(
        f"z{i} + (o - y) * x{i} - (sqrt(n{i} + (o - y) * (o - y) * x{i} * x{i}) - sqrt(n{i})) / {of('alpha')} * w{i},"
        f" n{i} + (o - y) * (o - y) * x{i} * x{i}, w{i}" for i in dims
    )
    state = ", ".join(f"z{i}, n{i}, w{i}" for i in dims)
    return f"""{ex} AS MATERIALIZED ({examples}),
{run}(model, {state}, k, streak, trained) AS (
  {start}
  UNION ALL
  SELECT model, {z}, k + 1,
         CASE WHEN -y * ln({clip}) - (1 - y) * ln(1 - {clip}) < {p.eta} THEN streak + 1 ELSE 0 END, true
  FROM (SELECT *, CASE WHEN trained THEN {out} ELSE {mean} END AS o FROM (
    SELECT s.model, {carry}, {", ".join(weight)}, {", ".join(f"e.x{i}" for i in dims)}, e.y
    FROM {run} s JOIN {ex} e ON e.model = s.model AND e.i = s.k % e.cnt WHERE {stop})))"""


def _last(run: str, n_dims: int = 3) -> str:
    cols = ", ".join(f"round({a}{i}, 5) AS {a}{i}" for a in "znw" for i in range(n_dims))
    return f"""
SELECT model, {cols}, 1::BIGINT AS version FROM {run}
QUALIFY row_number() OVER (PARTITION BY model ORDER BY k DESC) = 1"""


def _learner(examples: str, start: str, one_pass: bool, fits: dict | None = None) -> str:
    return _recursion(examples, start, one_pass, fits=fits) + _last("run")


_ZERO = ", ".join(f"0.0::DOUBLE AS z{i}, 0.0::DOUBLE AS n{i}, 0.0::DOUBLE AS w{i}" for i in range(3))


def _start(source: str) -> str:
    return f"SELECT DISTINCT model, {_ZERO}, 0::BIGINT, 0::BIGINT, false FROM {source}"


_FIT_EXAMPLES = f"""
  SELECT model, i, least(count(*) OVER (PARTITION BY model), {FIT.max_iter}) AS cnt, x0, x1, x2, y FROM (
    SELECT flag AS model, d AS x0, q AS x1, t AS x2, closed AS y,
           row_number() OVER (PARTITION BY flag ORDER BY {_HASHED.format(seed=1, use="order")}) - 1 AS i FROM op)"""

_UPDATE_EXAMPLES = f"""
  SELECT 'default' AS model, row_number() OVER (ORDER BY {_HASHED.format(seed=2, use="order")}) - 1 AS i,
         count(*) OVER () AS cnt, d AS x0, q AS x1, t AS x2, closed AS y
  FROM (SELECT * FROM sc WHERE score BETWEEN 0.4 AND 0.6 ORDER BY {_HASHED.format(seed=5, use="sample")} LIMIT 400)
  WHERE closed > 0.5 OR substr({_HASHED.format(seed=2, use="thin")}, 1, 8) < '{int(0.25 * 16**8):08x}'"""

_MODELS_EXAMPLES = f"""
  SELECT flag AS model,
         row_number() OVER (PARTITION BY flag ORDER BY {_HASHED.format(seed=4, use="order")}) - 1 AS i,
         count(*) OVER (PARTITION BY flag) AS cnt, d AS x0, q AS x1, t AS x2, closed AS y
  FROM (SELECT * FROM sc WHERE score BETWEEN 0.4 AND 0.6 ORDER BY {_HASHED.format(seed=9, use="sample")} LIMIT 600)"""

_PRF = """
SELECT matched, hit, ref, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1
FROM (SELECT *, CASE WHEN matched > 0 THEN hit / matched END AS p, CASE WHEN ref > 0 THEN hit / ref END AS r
  FROM (SELECT (SELECT count(*) FROM m) AS matched,
               (SELECT count(*) FROM m JOIN g USING (source, target)) AS hit,
               (SELECT count(*) FROM g) AS ref))"""


def _jaccard(threshold_default: float = 0.0) -> str:
    """``sim`` of the line sets of every pair; the default where a side has none."""
    return f"""ls AS (SELECT sub, db, list(DISTINCT lower(obj)) AS v FROM lines GROUP BY sub, db),
jac AS (
  SELECT p.source, p.target,
         CASE WHEN s.v IS NULL OR t.v IS NULL THEN {threshold_default}
              ELSE len(list_intersect(s.v, t.v)) / (len(s.v) + len(t.v) - len(list_intersect(s.v, t.v))) END AS sim
  FROM pairs p LEFT JOIN ls s ON s.sub = p.source AND s.db = 'source'
  LEFT JOIN ls t ON t.sub = p.target AND t.db = 'target')"""


# ``vp(x, y)``, pairs of non-empty texts, to ``ratio(x, y, r)``: the longest common run of an area,
# first in ``x`` and then in ``y``, then the areas before and behind it.  In a ``y`` of 200
# characters and more the common ones (over 1/100 of it) start no run but may continue one; where
# no other is left, only what both areas begin with counts.
_RATIO = """vn AS (SELECT *, row_number() OVER () AS id, length(x) AS nx, length(y) AS ny FROM vp),
cx AS (SELECT id, i, substr(x, i + 1, 1) AS c FROM (SELECT id, x, unnest(range(nx)) AS i FROM vn)),
cy AS (SELECT id, ny, j, substr(y, j + 1, 1) AS c FROM (SELECT id, y, ny, unnest(range(ny)) AS j FROM vn)),
common AS (SELECT id, c FROM cy GROUP BY id, c HAVING any_value(ny) >= 200 AND count(*) > any_value(ny) // 100 + 1),
cell AS (
  SELECT cx.id, i, j - i AS d, common.c IS NULL AS rare
  FROM cx JOIN cy ON cx.id = cy.id AND cx.c = cy.c LEFT JOIN common ON common.id = cy.id AND common.c = cy.c),
diag AS (SELECT *, i - row_number() OVER (PARTITION BY id, d ORDER BY i) AS g FROM cell),
held AS (
  SELECT *, min(i) OVER (PARTITION BY id, d, g) AS lo, max(i) OVER (PARTITION BY id, d, g) + 1 AS hi,
         i - row_number() OVER (PARTITION BY id, d, rare ORDER BY i) AS h FROM diag),
run AS (
  SELECT id, d, min(i) AS i0, max(i) + 1 AS i1, any_value(lo) AS lo, any_value(hi) AS hi, false AS weak
  FROM held WHERE rare GROUP BY id, d, h
  UNION ALL SELECT id, d, min(i), max(i) + 1, min(i), max(i) + 1, true FROM diag
  WHERE id IN (SELECT id FROM common) GROUP BY id, d, g),
area(id, xlo, xhi, ylo, yhi, k) AS (
  SELECT id, 0::BIGINT, nx, 0::BIGINT, ny, 0::BIGINT FROM vn
  UNION ALL
  SELECT id, CASE s WHEN 0 THEN xlo ELSE b[5] END, CASE s WHEN 0 THEN b[4] ELSE xhi END,
         CASE s WHEN 0 THEN ylo ELSE b[5] + b[3] - b[2] END, CASE s WHEN 0 THEN b[4] + b[3] - b[2] ELSE yhi END,
         CASE s WHEN 0 THEN b[5] - b[4] ELSE 0 END
  FROM (
    SELECT id, xlo, xhi, ylo, yhi, min([CASE WHEN weak THEN 0 ELSE i - e END, i, i + d, greatest(lo, xlo, ylo - d), least(hi, xhi, yhi - d)]) AS b
    FROM (
      SELECT area.*, d, lo, hi, weak, greatest(i0, xlo, ylo - d) AS i, least(i1, xhi, yhi - d) AS e
      FROM area JOIN run USING (id))
    WHERE xlo < xhi AND ylo < yhi AND i < e AND (NOT weak OR (i = xlo AND i + d = ylo)) GROUP BY id, xlo, xhi, ylo, yhi)
  CROSS JOIN (VALUES (0), (1)) AS side(s)),
ratio AS (
  SELECT x, y, 2.0::DOUBLE * m / (nx + ny) AS r
  FROM vn JOIN (SELECT id, sum(k)::BIGINT AS m FROM area GROUP BY id) USING (id))"""


def _soft_jaccard(threshold: float = 0.8, default: float = 0.0) -> str:
    """``soft(source, target, sim)``: every line takes its first free similar line.

    Characters outside the common runs must be deleted or inserted, so the edit distance
    (of bytes) bounds the ratio and spares most pairs of lines the recursion.
    """
    return f"""lv AS (
  SELECT *, row_number() OVER (PARTITION BY sub, db ORDER BY v) AS at FROM (
    SELECT DISTINCT sub, db, lower(obj) AS v FROM lines)),
ln AS (SELECT sub, db, count(*) AS n FROM lv GROUP BY sub, db),
vm AS (
  SELECT p.source, p.target, s.v AS x, t.v AS y, s.at AS i, t.at AS j FROM pairs p
  JOIN lv s ON s.sub = p.source AND s.db = 'source' JOIN lv t ON t.sub = p.target AND t.db = 'target'
  WHERE 2 * least(length(s.v), length(t.v)) >= {threshold} * (length(s.v) + length(t.v))),
vp AS (
  SELECT DISTINCT x, y FROM vm WHERE x <> y
  AND levenshtein(x, y) <= strlen(x) + strlen(y) - {threshold} * (length(x) + length(y))),
{_RATIO},
nb AS (
  SELECT source, target, i, list(j ORDER BY j) AS js,
         row_number() OVER (PARTITION BY source, target ORDER BY i) AS k
  FROM vm LEFT JOIN ratio USING (x, y) WHERE x = y OR r >= {threshold}::DOUBLE GROUP BY source, target, i),
taking(source, target, k, taken) AS (
  SELECT DISTINCT source, target, 0::BIGINT, []::BIGINT[] FROM nb
  UNION ALL
  SELECT source, target, nb.k, list_concat(taken, list_filter(js, lambda j: NOT list_contains(taken, j))[1:1])
  FROM taking JOIN nb USING (source, target) WHERE nb.k = taking.k + 1),
greedy AS (SELECT source, target, max(len(taken)) AS d FROM taking GROUP BY source, target),
soft AS (
  SELECT source, target, CASE WHEN s.n IS NULL OR t.n IS NULL THEN {default}
    ELSE coalesce(d, 0)::DOUBLE / (s.n + t.n - coalesce(d, 0)) END AS sim
  FROM pairs LEFT JOIN greedy USING (source, target)
  LEFT JOIN ln s ON s.sub = source AND s.db = 'source' LEFT JOIN ln t ON t.sub = target AND t.db = 'target')"""


def _ratio_of(view: str) -> str:
    """``rt(source, target, sim)`` of the single values ``view(sub, db, u)`` of every pair."""
    return f"""uv AS (
  SELECT source, target, s.u AS x, t.u AS y FROM pairs
  LEFT JOIN {view} s ON s.sub = source AND s.db = 'source' LEFT JOIN {view} t ON t.sub = target AND t.db = 'target'),
vp AS (SELECT DISTINCT x, y FROM uv WHERE x <> y AND x <> '' AND y <> ''),
{_RATIO},
rt AS (
  SELECT source, target, CASE WHEN x = y THEN 1 WHEN x IS NULL OR y IS NULL THEN 0 ELSE coalesce(r, 0) END AS sim
  FROM uv LEFT JOIN ratio USING (x, y))"""


def _with_recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _equal(view: str, name: str, default: float) -> str:
    return f"""{name} AS (
  SELECT p.source, p.target, coalesce(CAST(lower(s.obj) = lower(t.obj) AS INT)::DOUBLE, {default}) AS sim
  FROM pairs p LEFT JOIN {view} s ON s.sub = p.source AND s.db = 'source'
  LEFT JOIN {view} t ON t.sub = p.target AND t.db = 'target')"""


_LANG = "langs AS (SELECT sub, db, lang AS obj FROM docs)"
_MET_LINES = """met AS (
  SELECT p.source, p.target, coalesce(CAST(lower(s.obj) = lower(t.obj) AS INT)::DOUBLE, 0.0) AS sim
  FROM pairs p LEFT JOIN lines s ON s.sub = p.source AND s.db = 'source'
  LEFT JOIN lines t ON t.sub = p.target AND t.db = 'target')"""
_DOT = f"({WEIGHTS[0]} * d + {WEIGHTS[1]} * q + {WEIGHTS[2]} * t)"
_HIGH = f"""(SELECT source, target, d, q, t FROM (
  SELECT *, rank() OVER (PARTITION BY source ORDER BY score DESC) AS r FROM sc WHERE score >= 0.5)
  WHERE r = 1 ORDER BY {_HASHED.format(seed=3, use="sample")} LIMIT 101)"""
_LOW = f"(SELECT source, target, d, q, t FROM sc WHERE score < 0.5 ORDER BY {_HASHED.format(seed=3, use="sample")} LIMIT 99)"


# The learned run over native features: ``ms(source, target, x0, x1, score)``.
_ZERO2 = ", ".join(f"0.0::DOUBLE AS z{i}, 0.0::DOUBLE AS n{i}, 0.0::DOUBLE AS w{i}" for i in range(2))
_BY = _HASHED.format(seed=0, use="sample")
_NATIVE = [
    *_DOC_PAIRS, _ONES, _LINES, _QUALITY, _COPIES, _jaccard(0.124), _equal("quality", "eq", 0.5),
    """ms AS (
  SELECT source, target, eq.sim AS x0, jac.sim AS x1, (eq.sim + jac.sim) / 2 AS score
  FROM eq JOIN jac USING (source, target))""",
    f"""smp AS (
  (SELECT source, target, x0, x1 FROM (
    SELECT *, rank() OVER (PARTITION BY source ORDER BY score DESC) AS r FROM ms WHERE score >= 0.5)
   WHERE r = 1 ORDER BY {_BY} LIMIT 101)
  UNION ALL (SELECT source, target, x0, x1 FROM ms WHERE score < 0.5 ORDER BY {_BY} LIMIT 99))""",
    """lab AS (
  SELECT smp.*, CASE WHEN copies.source IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y
  FROM smp LEFT JOIN copies USING (source, target))""",
]
_NATIVE_FIT = f"""
  SELECT 'default' AS model, row_number() OVER (ORDER BY {_HASHED.format(seed=0, use="order")}) - 1 AS i,
         least(count(*) OVER (), {FIT.max_iter}) AS cnt, x0, x1, y FROM lab"""
_NATIVE_ANSWERS = f"""
  SELECT 'default' AS model, row_number() OVER (ORDER BY {_HASHED.format(seed=0, use="order")}) - 1 AS i,
         count(*) OVER () AS cnt, x0, x1, 1.0::DOUBLE AS y FROM copies JOIN ms USING (source, target)"""
_FITTED = "(FROM run QUALIFY row_number() OVER (PARTITION BY model ORDER BY k DESC) = 1)"
_NATIVE_START = f"SELECT DISTINCT model, {_ZERO2}, 0::BIGINT, 0::BIGINT, false FROM ex"
_NATIVE_RUN = _recursion(_NATIVE_FIT, _NATIVE_START, False, 2)
_NATIVE_UPDATE = _recursion(
    _NATIVE_ANSWERS, f"SELECT model, z0, n0, w0, z1, n1, w1, 0::BIGINT, 0::BIGINT, true FROM {_FITTED}",
    True, 2, ex="ex2", run="run2")
_BEST_NATIVE = """
  SELECT source, target FROM (
    SELECT *, rank() OVER (PARTITION BY source ORDER BY learned DESC) AS r FROM lm
    {of} WHERE learned > {above}) WHERE r = 1"""

def _batch_steps(steps: int, n_dims: int = 3) -> str:
    """``b<steps>(model, z.., n.., w..)``: the full-batch learner, unrolled."""
    p, dims, x = FIT, range(n_dims), ("d", "q", "t")
    zeros = ", ".join(f"0.0::DOUBLE AS z{i}, 0.0::DOUBLE AS n{i}" for i in dims)
    parts = [f"b0 AS (SELECT DISTINCT flag AS model, {zeros} FROM op)"]
    for k in range(steps):
        weight = ", ".join(
            f"CASE WHEN abs(z{i}) <= {p.l1} THEN 0.0 ELSE (sign(z{i}) * {p.l1} - z{i}) / "
            f"({p.l2} + ({p.beta} + sqrt(n{i})) / {p.alpha}) END AS w{i}" for i in dims)
        output = ("(2 / (1 + exp(-(" + " + ".join(f"w{i} * {x[i]}" for i in dims) + "))) - 1)"
                  if k else "(d + q + t) / 3")
        sums = ", ".join(f"sum(({output} - closed) * {x[i]}) AS g{i}" for i in dims)
        step = ", ".join(
            f"z{i} + g{i} - (sqrt(n{i} + g{i} * g{i}) - sqrt(n{i})) / {p.alpha} * w{i} AS z{i}, "
            f"n{i} + g{i} * g{i} AS n{i}, w{i}" for i in dims)
        parts += [f"v{k} AS (SELECT model, z0, n0, z1, n1, z2, n2, {weight} FROM b{k})",
                  f"g{k} AS (SELECT model, {sums} FROM op JOIN v{k} ON flag = model GROUP BY model)",
                  f"b{k + 1} AS (SELECT model, {step} FROM v{k} JOIN g{k} USING (model))"]
    return ",\n".join(parts)


ORACLE_SQL: dict[str, str] = {
    "kg_tokens": _with(_DOCS, _TEXT) + f"""
SELECT sub, word, count(*) AS n FROM (
  SELECT sub, unnest(list_filter(regexp_split_to_array(lower(obj), '{_PATTERN}'), lambda x: x <> '')) AS word FROM txt)
GROUP BY sub, word""",
    "word_frequency": _with(*_DOC_KEYS) + "SELECT word, cnt FROM freq",
    "rare_word_keys_1": _with(*_DOC_KEYS) + "SELECT sub, db, key FROM keys",
    "rare_word_keys_2": _with(_TITLES, _TITLE, _rare("ttl", 2)) + "SELECT sub, db, key FROM keys",
    "word_pair_keys": _with(_DOCS, _LINES, _rare("lines", 2)) + "SELECT sub, db, key FROM keys",
    "partition_keys_lang": _with(_DOCS) + "SELECT sub, '$' || lower(lang) AS key, db FROM docs",
    "partition_wildcard_quality": _with(*_WILD_QUALITY) + "SELECT sub, '$' || obj AS key, db FROM wild",
    "partition_two_levels": _with(*_WILD_QUALITY)
    + "SELECT sub, '$' || obj || '$' || lower(lang) AS key, db FROM wild JOIN docs USING (sub, db)",
    "unique_blocks": _with(*_DOC_KEYS, _ONES) + """
SELECT source AS sub, 'source' AS db, '$' || key AS key FROM ones
UNION ALL SELECT target, 'target', '$' || key FROM ones""",
    "unique_pairs": _with(*_DOC_KEYS, _ONES) + "SELECT DISTINCT source, target FROM ones",
    "candidate_pairs": _with(*_DOC_PAIRS) + "SELECT source, target FROM pairs",
    "multi_level_block": _levels(
        "s.lang = t.lang AND (s.quality = t.quality OR s.quality IS NULL OR t.quality IS NULL)"),
    "stream_candidate_pairs": _levels(
        "s.quality = t.quality OR s.quality IS NULL OR t.quality IS NULL"),
    "multi_level_unique": _with(*_DOC_KEYS, *_WILD_QUALITY[1:], """k2 AS (
  SELECT wild.sub, wild.db, obj || '$' || key AS key FROM wild JOIN keys USING (sub, db)
  UNION ALL SELECT sub, db, obj FROM known)""") + """
SELECT DISTINCT min(sub) FILTER (db = 'source') AS source, min(sub) FILTER (db = 'target') AS target
FROM k2 GROUP BY key
HAVING count(DISTINCT sub) FILTER (db = 'source') = 1 AND count(DISTINCT sub) FILTER (db = 'target') = 1""",
    "three_level_wildcard": _with(
        *_DOC_PAIRS, _QUALITY, _QUALITY_OF,
        "g AS (SELECT CAST(doc_id AS VARCHAR) AS sub, toxic FROM labels WHERE quality = 1)") + """
SELECT p.source, p.target FROM pairs p
JOIN dq s ON s.sub = p.source AND s.db = 'source' JOIN dq t ON t.sub = p.target AND t.db = 'target'
LEFT JOIN g sg ON sg.sub = p.source LEFT JOIN g tg ON tg.sub = p.target
WHERE (s.quality = t.quality OR s.quality IS NULL OR t.quality IS NULL)
  AND (sg.toxic = tg.toxic OR sg.toxic IS NULL OR tg.toxic IS NULL)""",
    "missing_null_block": _levels(
        "s.quality = t.quality OR (s.quality IS NULL AND t.quality IS NULL)"),
    "missing_drop": _levels("s.quality = t.quality"),
    "wildcard_load": _with(*_WILD_QUALITY) + f"""
SELECT '$' || obj AS key, nl, nr, (nl * nr)::DOUBLE AS load,
       greatest(1, ceil((nl * nr)::DOUBLE * {N_WORKERS} / sum(nl * nr) OVER ()))::BIGINT AS n_part
FROM (SELECT obj, count(*) FILTER (db = 'source') AS nl, count(*) FILTER (db = 'target') AS nr
      FROM wild GROUP BY obj) WHERE nl > 0 AND nr > 0""",
    "block_load_report": f"""
SELECT key, nl, nr, (nl * nr)::DOUBLE AS load,
       greatest(1, ceil((nl * nr)::DOUBLE * {N_WORKERS} / sum(nl * nr) OVER ()))::BIGINT AS n_part
FROM (SELECT p_name AS key, count(*) FILTER (p_size <= 25) AS nl, count(*) FILTER (p_size > 25) AS nr
      FROM part GROUP BY p_name) WHERE nl > 0 AND nr > 0""",
    "balanced_join_parts": """
SELECT key, count(*) AS pairs, sum(s - t)::BIGINT AS apart FROM
  (SELECT p_name AS key, p_partkey AS s FROM part WHERE p_size <= 25)
  JOIN (SELECT p_name AS key, p_partkey AS t FROM part WHERE p_size > 25) USING (key) GROUP BY key""",
    "prefix_table_block": _with(*_DOC_PAIRS) + "SELECT DISTINCT source, target FROM pairs",
    "balanced_join_lines": """
SELECT s.l_orderkey, count(*) AS pairs, CAST(sum(s.l_partkey + t.l_partkey) AS BIGINT) AS part_sum
FROM lineitem s JOIN lineitem t ON s.l_orderkey = t.l_orderkey
WHERE s.l_linestatus = 'O' AND t.l_linestatus = 'F' GROUP BY s.l_orderkey""",
    "compare_exact_jaccard": _with(*_DOC_PAIRS, _LINES, _jaccard())
    + "SELECT source, target, round(sim, 6) AS sim FROM jac",
    "compare_soft_jaccard": _with_recursive(*_DOC_PAIRS, _LINES, _soft_jaccard())
    + "SELECT source, target, round(sim, 6) AS sim FROM soft",
    "compare_ratio": _with_recursive(
        *_DOC_PAIRS, "low AS (SELECT sub, db, lower(text) AS u FROM docs)", _ratio_of("low"))
    + "SELECT source, target, round(sim, 6) AS sim FROM rt",
    "compare_ratio_urls": _with_recursive(
        *_PAGE_PAIRS, "low AS (SELECT sub, db, regexp_replace(lower(url), 'https?://', '', 'g') AS u FROM titles)",
        _ratio_of("low"))
    + "SELECT source, target, round(sim, 6) AS sim FROM rt",
    "compare_empty_values": _with(*_PAGE_PAIRS, """bare AS (
  SELECT sub, db, regexp_replace(CASE WHEN db = 'target' OR contains(url, 'www.') THEN lower(url) END,
                                 'https://.*[0-4]$', '', 'g') AS u FROM titles)""") + """
SELECT source, target, round(coalesce(CASE WHEN s.u = '' AND t.u = '' THEN 1.0
  ELSE 1 - levenshtein(s.u, t.u) / greatest(length(s.u), length(t.u)) END, 0.3), 6) AS sim
FROM pairs JOIN bare s ON s.sub = source AND s.db = 'source' JOIN bare t ON t.sub = target AND t.db = 'target'""",
    "compare_levenshtein": _with(*_PAGE_PAIRS, """bare AS (
  SELECT sub, db, regexp_replace(lower(url), 'https?://', '', 'g') AS u FROM titles)""") + """
SELECT source, target, round(1 - levenshtein(s.u, t.u) / greatest(length(s.u), length(t.u)), 6) AS sim
FROM pairs JOIN bare s ON s.sub = source AND s.db = 'source' JOIN bare t ON t.sub = target AND t.db = 'target'""",
    "attribute_default_fill": _with(*_DOC_PAIRS, _QUALITY, _equal("quality", "eq", 0.126))
    + "SELECT source, target, round(sim, 6) AS sim FROM eq",
    "attribute_fanout": _with(*_DOC_PAIRS, _LINES, _MET_LINES)
    + "SELECT source, target, count(*) AS n, round(sum(sim), 6) AS equal_lines FROM met GROUP BY 1, 2",
    "attribute_best": _with(*_DOC_PAIRS, _LINES, _MET_LINES)
    + "SELECT source, target, max(sim) AS sim FROM met GROUP BY 1, 2",
    "sim_vector": _with(
        *_DOC_PAIRS, _LINES, _QUALITY, _LANG, _jaccard(0.124),
        _equal("quality", "eq", 0.3), _equal("langs", "el", 0.0),
    ) + """
SELECT source, target, el.sim AS lang, round(eq.sim, 6) AS quality, round(jac.sim, 6) AS lines
FROM jac JOIN eq USING (source, target) JOIN el USING (source, target)""",
    "score_mean": _with(_ORDERS) + "SELECT source, target, round(score, 6) AS score FROM sc",
    "score_trained": _with(_ORDERS)
    + f"SELECT source, target, round(2 / (1 + exp(-{_DOT})) - 1, 6) AS score FROM op",
    "score_by_model": _with(_ORDERS) + f"""
SELECT source, target, flag AS model,
       round(CASE WHEN flag = 'R' THEN 2 / (1 + exp(-{_DOT})) - 1 ELSE score END, 6) AS score FROM sc""",
    "top1_matches": _with(_ORDERS, _TOP1) + "SELECT source, target FROM top1",
    "one_to_one_matches": "WITH RECURSIVE " + _ORDERS + """,
o AS (SELECT source, target, score, md5(source || '|' || target || '|0|tie') AS tie FROM sc WHERE score > 0.5),
rec AS (
  SELECT *, false AS taken, 0 AS round FROM o
  UNION ALL
  SELECT source, target, score, tie,
         row_number() OVER (PARTITION BY source ORDER BY score DESC, tie) = 1
         AND row_number() OVER (PARTITION BY target ORDER BY score DESC, tie) = 1, round + 1
  FROM (SELECT *, bool_or(taken) OVER (PARTITION BY source) AS s, bool_or(taken) OVER (PARTITION BY target) AS t FROM rec)
  WHERE NOT s AND NOT t)
SELECT source, target FROM rec WHERE taken""",
    "mutual_best_matches": _with(_ORDERS) + """
SELECT source, target FROM (
  SELECT *, rank() OVER (PARTITION BY source ORDER BY score DESC) AS rs,
            rank() OVER (PARTITION BY target ORDER BY score DESC) AS rt FROM sc WHERE score > 0.5)
WHERE rs = 1 AND rt = 1""",
    "match_with_labels": _with(_ORDERS, _TOP1, _ORDER_LABELS) + """
SELECT source, target FROM top1
WHERE (source, target) NOT IN (SELECT source, target FROM lab WHERE is_match = 0)
UNION SELECT source, target FROM lab WHERE is_match = 1""",
    "decide_two_tables": _with(_ORDERS) + """
SELECT source, target FROM (
  SELECT *, rank() OVER (PARTITION BY source, flag = 'R' ORDER BY score DESC) AS r FROM sc
  WHERE score > CASE WHEN flag = 'R' THEN 0.4 ELSE 0.5 END) WHERE r = 1""",
    "label_pairs": _with(_ORDERS, _ORDER_REF) + """
SELECT source, target, round(d, 6) AS d, round(q, 6) AS q, round(t, 6) AS t,
       CASE WHEN ref.source IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS is_match
FROM op LEFT JOIN ref USING (source, target)""",
    "label_upsert": _with(_ORDERS, _ORDER_REF, _ORDER_LABELS) + """
SELECT source, target, 3::INT AS dim, coalesce(lab.is_match, CASE WHEN ref.source IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS is_match
FROM op LEFT JOIN ref USING (source, target) LEFT JOIN lab USING (source, target)""",
    "label_correct": _with(_ORDERS, _ORDER_REF, """dec AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS source, CAST(o_custkey AS VARCHAR) AS target,
         CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_match FROM orders)""") + """
SELECT source, target, CASE WHEN op.source IS NULL THEN 0::INT ELSE 3::INT END AS dim,
       coalesce(dec.is_match, CASE WHEN ref.source IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS is_match
FROM op FULL JOIN dec USING (source, target) LEFT JOIN ref USING (source, target)""",
    "label_log": _with(_ORDERS, _ORDER_REF) + """
SELECT source, target, 3::INT AS dim,
       (CASE WHEN d < 0.25 THEN flag = 'A' WHEN t > 0.5 THEN flag = 'N' WHEN q > 0.5 THEN closed = 1
             ELSE ref.source IS NOT NULL END)::INT::DOUBLE AS is_match
FROM op LEFT JOIN ref USING (source, target)""",
    "uncertain_band": _with(_ORDERS)
    + "SELECT source, target, round(score, 6) AS score FROM sc WHERE score BETWEEN 0.4 AND 0.6",
    "label_worklist": _with(_ORDERS) + f"""
SELECT source, target, round(score, 6) AS score,
       coalesce(o_orderpriority, '') AS s_what, coalesce(p_name, '') AS t_what
FROM (SELECT * FROM sc WHERE score BETWEEN 0.4 AND 0.6 ORDER BY {_HASHED.format(seed=7, use="sample")} LIMIT 50)
LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = source LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = target""",
    "training_sample": _with(_ORDERS) + f"""
SELECT source, target, round(d, 6) AS d, round(q, 6) AS q, round(t, 6) AS t
FROM ({_HIGH} UNION ALL {_LOW})""",
    "ftrl_fit_group": "WITH RECURSIVE " + _ORDERS + ",\n"
    + _learner(_FIT_EXAMPLES, _start("ex"), one_pass=False),
    "ftrl_fit_batch": _with(_ORDERS, _batch_steps(BATCH_STEPS)) + "SELECT model, " + ", ".join(
        f"round({a}{i}, 5) AS {a}{i}" for a in "znw" for i in range(3)) + f", 1::BIGINT AS version FROM b{BATCH_STEPS}",
    "ftrl_update_models": "WITH RECURSIVE " + _ORDERS + ",\n"
    + _learner(_MODELS_EXAMPLES, _start("ex"), one_pass=True, fits=MODEL_FITS),
    "model_round_trip": "WITH RECURSIVE " + _ORDERS + ",\n"
    + _recursion(_FIT_EXAMPLES, _start("ex"), one_pass=False) + f"""
SELECT source, target, model, {FIT.max_iter}::INT AS max_iter, {FIT.epochs}::INT AS epochs,
       round(2 / (1 + exp(-(w0 * d + w1 * q + w2 * t))) - 1, 6) AS score
FROM op JOIN {_FITTED} ON model = flag""",
    "match_learned_native": "WITH RECURSIVE " + ",\n".join([*_NATIVE, _NATIVE_RUN, f"""lm AS (
  SELECT source, target, 2 / (1 + exp(-(w0 * x0 + w1 * x1))) - 1 AS learned FROM ms, {_FITTED})""",
        "m0 AS (" + _BEST_NATIVE.format(
            of="JOIN (SELECT DISTINCT source, target FROM ones) USING (source, target)", above=0.4)
        + " UNION " + _BEST_NATIVE.format(of="", above=0.5) + ")", """m AS (
  SELECT * FROM m0 WHERE (source, target) NOT IN (SELECT source, target FROM lab WHERE y = 0)
  UNION SELECT source, target FROM lab WHERE y = 1)""", "g AS (FROM copies)"]) + _PRF,
    "match_updated": "WITH RECURSIVE " + ",\n".join([*_NATIVE, _NATIVE_RUN, _NATIVE_UPDATE])
    + _last("run2", 2).replace("1::BIGINT", "2::BIGINT"),
    "ftrl_update": "WITH RECURSIVE " + _ORDERS + ",\n"
    + _learner(_UPDATE_EXAMPLES, _start("ex"), one_pass=True),
    "eval_prf": _with(_ORDERS, _ORDER_REF, _TOP1, "m AS (FROM top1)", "g AS (FROM ref)") + _PRF,
    "eval_heldout": _with(
        _ORDERS, _ORDER_REF, _TOP1, _ORDER_LABELS,
        "m AS (SELECT * FROM top1 WHERE (source, target) NOT IN (SELECT source, target FROM lab))",
        "g AS (SELECT * FROM ref WHERE (source, target) NOT IN (SELECT source, target FROM lab))",
    ) + _PRF,
    "eval_blocking": _with(*_DOC_PAIRS, _ONES, _COPIES,
                           "u AS (SELECT DISTINCT source, target FROM ones)",
                           "b AS (SELECT * FROM u UNION SELECT * FROM pairs)") + """
SELECT * EXCLUDE (space), round(hit / ref, 6) AS recall, round(1 - pairs / space, 6) AS reduction FROM (
  SELECT (SELECT count(*) FROM u) AS "unique", (SELECT count(*) FROM pairs) AS candidate,
         (SELECT count(*) FROM copies) AS ref,
         (SELECT count(*) FROM b JOIN copies USING (source, target)) AS hit,
         (SELECT count(*) FROM u JOIN copies USING (source, target)) AS unique_hit,
         (SELECT count(*) FROM b) AS pairs),
  (SELECT count(*) FILTER (db = 'source')::DOUBLE * count(*) FILTER (db = 'target') AS space FROM docs)""",
    "fuse_attribute_longest": _with(*_PARTY_PAIRS) + """
SELECT source, target, CASE WHEN length(t.obj) > length(s.obj) THEN t.obj ELSE s.obj END AS name
FROM pairs JOIN names s ON s.sub = source AND s.db = 'source' JOIN names t ON t.sub = target AND t.db = 'target'""",
    "fuse_attribute_target": _with(_DOCS, _QUALITY, _COPIES) + """
SELECT source, target, coalesce(t.obj, s.obj) AS quality FROM copies
LEFT JOIN quality s ON s.sub = source AND s.db = 'source' LEFT JOIN quality t ON t.sub = target AND t.db = 'target'""",
    "fuse_relation_union": _with(*_PARTY_PAIRS) + """
SELECT source, target, obj AS nation FROM pairs JOIN nations ON sub = source AND db = 'source'
UNION SELECT source, target, obj FROM pairs JOIN nations ON sub = target AND db = 'target'""",
    "fuse_relation_common": _with(_DOCS, _LINES, _COPIES) + """
SELECT source, target, count(DISTINCT s.obj) AS lines FROM copies
JOIN lines s ON s.sub = source AND s.db = 'source'
JOIN lines t ON t.sub = target AND t.db = 'target' AND t.obj = s.obj GROUP BY source, target""",
    "fuse_relation_rule": _with(*_PARTY_PAIRS, """both_n AS (
  SELECT source, target, obj FROM pairs JOIN nations ON sub = source AND db = 'source'
  UNION ALL SELECT source, target, obj FROM pairs JOIN nations ON sub = target AND db = 'target')""") + """
SELECT source, target, obj AS nation FROM both_n GROUP BY source, target, obj HAVING count(*) = 1""",
    "match_end_to_end": _with(
        *_DOC_KEYS, """kk AS (SELECT keys.sub, keys.db, lang || '$' || key AS key FROM keys JOIN docs USING (sub, db)),
ones AS (
  SELECT min(sub) FILTER (db = 'source') AS source, min(sub) FILTER (db = 'target') AS target
  FROM (FROM kk UNION ALL SELECT sub, db, lang FROM docs) GROUP BY key
  HAVING count(DISTINCT sub) FILTER (db = 'source') = 1 AND count(DISTINCT sub) FILTER (db = 'target') = 1),
lone AS (SELECT sub, db, lang FROM docs WHERE (sub, db) NOT IN (SELECT sub, db FROM keys)),
cand AS (
  SELECT a.sub AS source, b.sub AS target FROM kk a JOIN kk b USING (key) WHERE a.db = 'source' AND b.db = 'target'
  UNION SELECT a.sub, b.sub FROM lone a JOIN docs b USING (lang) WHERE a.db = 'source' AND b.db = 'target'
  UNION SELECT a.sub, b.sub FROM docs a JOIN lone b USING (lang) WHERE a.db = 'source' AND b.db = 'target'),
pairs AS (SELECT source, target FROM ones UNION SELECT source, target FROM cand)""",
        _LINES, _QUALITY, _jaccard(0.124), _equal("quality", "eq", 0.5),
        "ms AS (SELECT source, target, (eq.sim + jac.sim) / 2 AS score FROM eq JOIN jac USING (source, target))",
    ) + """
SELECT source, target FROM (
  SELECT *, rank() OVER (PARTITION BY source ORDER BY score DESC) AS r
  FROM ms JOIN (SELECT DISTINCT source, target FROM ones) USING (source, target) WHERE score > 0.4) WHERE r = 1
UNION
SELECT source, target FROM (
  SELECT *, rank() OVER (PARTITION BY source ORDER BY score DESC) AS r
  FROM ms JOIN cand USING (source, target) WHERE score > 0.5) WHERE r = 1""",
}

ORACLE_SQL["match_fused"] = "WITH mm AS (" + ORACLE_SQL["match_end_to_end"] + "),\n" + ",\n".join(
    [_DOCS, _QUALITY, _LINES, """ln AS (
  SELECT source, target, count(DISTINCT obj) AS lines FROM (
    SELECT source, target, obj FROM mm JOIN lines ON sub = source AND db = 'source'
    UNION ALL SELECT source, target, obj FROM mm JOIN lines ON sub = target AND db = 'target')
  GROUP BY source, target)"""]) + """
SELECT source, target, coalesce(t.obj, s.obj) AS quality, lines FROM mm
LEFT JOIN quality s ON s.sub = source AND s.db = 'source' LEFT JOIN quality t ON t.sub = target AND t.db = 'target'
LEFT JOIN ln USING (source, target)"""
ORACLE_SQL |= {
    split: ORACLE_SQL[plain] for split, plain in {
        "split_candidate_pairs": "candidate_pairs", "split_sim_vector": "sim_vector",
        "split_top1": "top1_matches", "split_fuse_common": "fuse_relation_common",
        "compare_rows_jaccard": "compare_exact_jaccard",
    }.items()
}
