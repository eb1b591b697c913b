"""The same results as plain SQL over the supplied tables, for comparison only.

Amounts with two decimals are summed as whole hundredths, as in the views.
"""

from __future__ import annotations

from agropanel.vocabulary import DYNAMIC_FEATURES

DYN = DYNAMIC_FEATURES
VALUES = [*DYN, "yield_wheat", "fert_n", "fert_p"]

ITEMS = """items AS (
  SELECT *, l_suppkey AS pixel_id, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_discount * 100) AS BIGINT) AS disc,
    CAST(round(l_tax * 100) AS BIGINT) AS tax
  FROM lineitem)"""

MONTHLY = """monthly AS (
  SELECT pixel_id, year, month,
    sum(l_quantity) AS chirps_precip,
    sum(disc) / count(*) AS era5_temp2m,
    sum(tax) / (count(*) * 100) AS era5_soil_moisture,
    CASE WHEN count(*) >= 3 THEN sum(price) / (count(*) * 10000000) END AS modis_ndvi,
    min(l_discount) AS modis_evi,
    max(l_quantity) AS modis_lst_day,
    min(l_quantity) AS modis_lst_night,
    max(l_discount) - min(l_discount) AS era5_vpd
  FROM items GROUP BY pixel_id, year, month)"""

YEARLY = """yearly AS (
  SELECT pixel_id, year,
    CASE WHEN (pixel_id * 7 + year) % 17 <> 0 THEN sum(price) / (count(*) * 100) END AS yield_wheat,
    sum(tax) / 100 AS fert_n,
    CASE WHEN (pixel_id + year) % 13 <> 0 THEN avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) END AS fert_p
  FROM items GROUP BY pixel_id, year)"""

PANEL = """panel AS (
  SELECT m.*, y.yield_wheat, y.fert_n, y.fert_p FROM monthly m JOIN yearly y USING (pixel_id, year))"""

SEQ = """seq AS (SELECT pixel_id, year, count(*) AS n_months FROM panel GROUP BY pixel_id, year)"""

MASK = """mask AS (
  SELECT s_suppkey AS pixel_id, CASE WHEN s_acctbal >= 0 THEN 1.0 ELSE 0.0 END AS mask FROM supplier)"""

PREDS = """preds AS (
  SELECT CAST(year(l_shipdate) AS INT) AS year, l_extendedprice AS y,
    l_extendedprice * (0.75 + l_discount * 5 + l_tax) AS p
  FROM lineitem)"""

FINE = """fine AS (
  SELECT p_partkey % 40 AS fc, p_partkey // 40 AS fr, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS v
  FROM part), extent AS (SELECT max(p_partkey) // 40 + 1 AS h FROM part)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = ctes(ITEMS, MONTHLY, YEARLY, PANEL)
BASE_SEQ = ctes(ITEMS, MONTHLY, YEARLY, PANEL, SEQ)


def more(*parts: str) -> str:
    return ctes(ITEMS, MONTHLY, YEARLY, PANEL, *parts)


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


def rr(names, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(r(f"{prefix}{n}", n, digits) for n in names)


KEYS = "pixel_id, year, month"
MISSING = [*DYN, "fert_n", "fert_p"]


def union(selects) -> str:
    return "\nUNION ALL ".join(selects)


def missing(col: str) -> str:
    return f"avg(CASE WHEN {col} IS NULL THEN 1.0 ELSE 0.0 END)"


def histogram(col: str, bins: int) -> str:
    return BASE.rstrip() + f""",
e AS (SELECT min({col}) AS lo, max({col}) AS hi FROM panel),
c AS (SELECT least(CAST(floor(({col} - lo) / ((hi - lo) / {bins})) AS INT), {bins - 1}) AS bin, count(*) AS n
      FROM panel, e WHERE {col} IS NOT NULL GROUP BY 1)
SELECT '{col}' AS feature, CAST(b.bin AS INT) AS bin,
  round(lo + b.bin * ((hi - lo) / {bins}), 6) AS bin_from,
  round(lo + (b.bin + 1) * ((hi - lo) / {bins}), 6) AS bin_to,
  coalesce(c.n, 0) AS count
FROM (SELECT unnest(range(0, {bins})) AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin"""


def metrics(base: str, source: str, key: str | None) -> str:
    by = f"PARTITION BY {key}" if key else ""
    select = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    within = ", ".join(
        f"round(avg(CASE WHEN abs(p - y) / greatest(abs(y), 1e-6) * 100 <= {k} THEN 1.0 ELSE 0.0 END) * 100, 6) AS \"acc@{k}%\""
        for k in (10, 20, 30)
    )
    return f"""{base.rstrip()},
ranked AS (
  SELECT *,
    rank() OVER ({by} ORDER BY y) + (count(*) OVER (PARTITION BY {key + ', ' if key else ''}y) - 1) / 2.0 AS ry,
    rank() OVER ({by} ORDER BY p) + (count(*) OVER (PARTITION BY {key + ', ' if key else ''}p) - 1) / 2.0 AS rp
  FROM {source})
SELECT {select}
  round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
  round(avg(abs(p - y)), 6) AS mae,
  round(1 - sum((p - y) * (p - y)) / greatest(var_pop(y) * count(*), 1e-12), 6) AS r2,
  round(100 * avg(abs(p - y) / greatest(abs(y), 1e-6)), 6) AS "mape%",
  round(100 * avg(2 * abs(p - y) / greatest(abs(y) + abs(p), 1e-6)), 6) AS "smape%",
  round(avg(p - y), 6) AS bias,
  round(sqrt(avg((p - y) * (p - y))) / (avg(y) + 1e-8), 6) AS nrmse_mean,
  round(sqrt(avg((p - y) * (p - y))) / greatest(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 1e-8), 6) AS nrmse_iqr,
  round(CASE WHEN count(*) < 2 OR stddev_pop(y) < 1e-12 OR stddev_pop(p) < 1e-12 THEN 0 ELSE corr(y, p) END, 6) AS pearson_r,
  round(CASE WHEN count(*) < 2 THEN 0 ELSE corr(ry, rp) END, 6) AS spearman_rho,
  round(1 - var_pop(y - p) / greatest(var_pop(y), 1e-12), 6) AS explained_variance,
  {within},
  count(*) AS n
FROM ranked {group}"""


THRESHOLD_SPLIT = """parts AS (
  SELECT 'train' AS split, * FROM src WHERE year <= 1998
  UNION ALL SELECT 'val', * FROM src WHERE year = 1999
  UNION ALL SELECT 'test', * FROM src WHERE year >= 2000)"""


def split_rows(*selects: str) -> str:
    columns = "pixel_id, year, month, round(yield_wheat, 6) AS yield_wheat"
    return BASE + union(f"SELECT '{name}' AS split, {columns} FROM panel WHERE {cond}" for name, cond in selects)


def draw(keys: list[str], seed: int) -> str:
    state = str(seed)
    for k in keys:
        state = f"(((CAST({k} AS BIGINT) % 2147483647 + {state}) % 2147483647) * 1103515245 + 12345) % 2147483647"
        state = f"({state})"
    return state


def downsample(pick: str, extra: str = "") -> str:
    return more(
        "keys AS (SELECT DISTINCT pixel_id, year, yield_wheat AS y FROM panel WHERE yield_wheat IS NOT NULL)",
        "sized AS (SELECT *, count(*) OVER (PARTITION BY year) AS size FROM keys)",
        *([extra] if extra else []),
        f"picked AS ({pick})",
        "kept AS (SELECT pixel_id, year FROM sized WHERE size <= 40 UNION SELECT pixel_id, year FROM picked)",
    ) + ("SELECT pixel_id, year, month, round(yield_wheat, 6) AS yield_wheat FROM panel "
         "SEMI JOIN kept USING (pixel_id, year) WHERE yield_wheat IS NOT NULL")


EDGES = """edges AS (
  SELECT year, list_distinct(quantile_cont(y, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e
  FROM sized WHERE size > 40 GROUP BY year),
binned AS (
  SELECT s.*, greatest(len(e) - 1, 1) AS bins, greatest(len(list_filter(e, lambda x: x < y)) - 1, 0) AS bin
  FROM sized s JOIN edges USING (year) WHERE size > 40)"""

ORDER = draw(["pixel_id", "year"], 1337)

DECILE_PICK = f"""SELECT pixel_id, year FROM (
  SELECT *, row_number() OVER (PARTITION BY year, bin ORDER BY {ORDER}, pixel_id) AS rn FROM binned)
  WHERE rn <= greatest(40 // bins, 1)"""

RANDOM_PICK = f"""SELECT pixel_id, year FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY {ORDER}, pixel_id) AS rn FROM sized WHERE size > 40)
  WHERE rn <= 40"""


def annual(extra: str = "", agg=lambda c: f"avg({c})", earlier: str = "") -> str:
    aggs = ", ".join(f"{agg(c)} AS {c}" for c in DYN)
    carried = ", ".join(f"max({c}) AS {c}" for c in ("fert_n", "fert_p", "yield_wheat"))
    return more(f"""annual AS (SELECT pixel_id, year, {aggs}{', ' + extra if extra else ''}, {carried}
  FROM panel GROUP BY pixel_id, year)""")


def annual_result(extra_names=(), **kw) -> str:
    names = [*DYN, *extra_names, "fert_n", "fert_p", "yield_wheat"]
    return annual(**kw) + f"SELECT pixel_id, year, {rr(names)} FROM annual WHERE yield_wheat IS NOT NULL"


QUARTERS = [(c, q) for c in DYN for q in range(1, 5)]
STATS = [(c, s, f) for c in DYN for s, f in (("std", "stddev_pop"), ("min", "min"), ("max", "max"))]

DENSE_FILL = """
v1 AS (
  SELECT a.layer, a.r, a.c, coalesce(any_value(a.v), avg(b.v)) AS v FROM v0 a
  LEFT JOIN v0 b ON a.v IS NULL AND b.v IS NOT NULL AND a.layer = b.layer
    AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1
  GROUP BY a.layer, a.r, a.c),
v2 AS (
  SELECT a.layer, a.r, a.c, coalesce(any_value(a.v), avg(b.v)) AS v FROM v1 a
  LEFT JOIN v1 b ON a.v IS NULL AND b.v IS NOT NULL AND a.layer = b.layer
    AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1
  GROUP BY a.layer, a.r, a.c)"""

CELLS = "cells AS (SELECT unnest(range(0, (SELECT (max(s_suppkey) // 10 + 1) * 10 FROM supplier))) AS pixel_id)"

FILL = more(
    CELLS,
    """v0 AS (
  SELECT ym.year * 100 + ym.month AS layer, k.pixel_id // 10 AS r, k.pixel_id % 10 AS c, m.modis_ndvi AS v
  FROM cells k CROSS JOIN (SELECT DISTINCT year, month FROM panel) ym
  LEFT JOIN panel m ON m.pixel_id = k.pixel_id AND m.year = ym.year AND m.month = ym.month)""",
    DENSE_FILL.strip(),
) + """SELECT CAST(layer // 100 AS INT) AS year, CAST(layer % 100 AS INT) AS month,
  r * 10 + c AS pixel_id, round(v, 6) AS value FROM v2 WHERE v IS NOT NULL"""


def physical(c: str) -> str:
    if c in ("modis_ndvi", "modis_evi"):
        return f"{c} * 0.0001"
    if c in ("modis_lst_day", "modis_lst_night"):
        return f"{c} * 0.02 - 273.15"
    if c == "era5_temp2m":
        return f"{c} - 273.15"
    return c


BUILT = more(
    CELLS, MASK,
    "months AS (SELECT DISTINCT year, month FROM panel)",
    "conv AS (" + union(f"SELECT '{c}' AS d, pixel_id, year, month, {physical(c)} AS v FROM panel" for c in DYN) + ")",
    "names AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in DYN) + "]) AS d)",
    """v0 AS (
  SELECT n.d || '|' || ym.year || '|' || ym.month AS layer, k.pixel_id // 10 AS r, k.pixel_id % 10 AS c, x.v
  FROM cells k CROSS JOIN months ym CROSS JOIN names n
  LEFT JOIN conv x ON x.pixel_id = k.pixel_id AND x.year = ym.year AND x.month = ym.month AND x.d = n.d)""",
    DENSE_FILL.strip(),
    """filled AS (
  SELECT r * 10 + c AS pixel_id, CAST(string_split(layer, '|')[2] AS INT) AS year,
    CAST(string_split(layer, '|')[3] AS INT) AS month, """
    + ", ".join(f"max(CASE WHEN string_split(layer, '|')[1] = '{c}' THEN v END) AS {c}" for c in DYN)
    + " FROM v2 GROUP BY 1, 2, 3)",
) + f"""SELECT y.pixel_id, y.year, m.month, {rr(DYN, prefix='f.')},
  round(yield_wheat, 6) AS yield_wheat, round(fert_n, 6) AS fert_n, round(fert_p, 6) AS fert_p,
  CAST(s_nationkey AS DOUBLE) AS static_zone
FROM yearly y JOIN months m ON m.year = y.year JOIN mask k ON k.pixel_id = y.pixel_id AND k.mask >= 0.5
LEFT JOIN supplier s ON s.s_suppkey = y.pixel_id
LEFT JOIN filled f ON f.pixel_id = y.pixel_id AND f.year = y.year AND f.month = m.month
WHERE yield_wheat IS NOT NULL AND fert_n IS NOT NULL AND fert_p IS NOT NULL"""


def zscore(by_month: bool) -> str:
    stats = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in DYN)
    z = ", ".join(
        f"round(CASE WHEN {c} IS NULL THEN NULL WHEN {c}_s = 0 THEN 0 "
        f"ELSE greatest(least(({c} - {c}_m) / {c}_s, 5), -5) END, 6) AS {c}"
        for c in DYN
    )
    if by_month:
        return more(f"s AS (SELECT month, {stats} FROM panel WHERE year <= 1998 GROUP BY month)") + (
            f"SELECT pixel_id, year, month, {z} FROM panel LEFT JOIN s USING (month)")
    return more(f"s AS (SELECT {stats} FROM panel WHERE year <= 1998)") + f"SELECT {KEYS}, {z} FROM panel, s"


def real(expr: str, name: str) -> str:
    return f"round(CAST(CAST(coalesce({expr}, 0) AS FLOAT) AS DOUBLE), 6) AS {name}"


STEPS = [
    "src AS (SELECT * FROM panel WHERE yield_wheat IS NOT NULL)",
    """st AS (
  SELECT *, row_number() OVER (PARTITION BY pixel_id, year ORDER BY month) - 1 AS i,
    count(*) OVER (PARTITION BY pixel_id, year) AS n FROM src)""",
    "sq AS (SELECT pixel_id, year, max(n) AS n, max(yield_wheat) AS y FROM st GROUP BY pixel_id, year)",
]
SEQ_COLUMNS = f"{real('chirps_precip', 'chirps_precip')}, {real('modis_ndvi', 'modis_ndvi')}, {real('fert_n', 'fert_n')}"
Y = "round(CAST(CAST(y AS FLOAT) AS DOUBLE), 6) AS y"

SEQUENCES = more(*STEPS) + f"""SELECT t.pixel_id, t.year, CAST(i AS INT) AS step, CAST(month - 1 AS INT) AS month_idx,
  {Y}, {SEQ_COLUMNS} FROM st t JOIN sq USING (pixel_id, year) WHERE t.n >= 11"""


def padded(extra: str = "", join: str = "") -> str:
    return more(*STEPS) + f"""SELECT q.pixel_id, q.year, CAST(g.step AS INT) AS step,
  CAST(coalesce(t.month - 1, -1) AS INT) AS month_idx, {Y.replace('CAST(y ', 'CAST(q.y ')},
  {SEQ_COLUMNS}{extra}
FROM sq q CROSS JOIN (SELECT unnest(range(0, 12)) AS step) g
LEFT JOIN st t ON t.pixel_id = q.pixel_id AND t.year = q.year AND t.i = g.step - (12 - q.n) {join}
WHERE q.n >= 9"""


HISTORY = more(*STEPS, """ok AS (SELECT * FROM sq WHERE n >= 9)""", """two AS (
  SELECT a.pixel_id, a.year, a.y, a.n + b.n AS total, b.n AS first_n
  FROM ok a JOIN ok b ON b.pixel_id = a.pixel_id AND b.year = a.year - 1)""") + f"""
SELECT q.pixel_id, q.year, CAST(g.step AS INT) AS step, CAST(coalesce(t.month - 1, -1) AS INT) AS month_idx,
  {Y.replace('CAST(y ', 'CAST(q.y ')}, {SEQ_COLUMNS}
FROM two q CROSS JOIN (SELECT unnest(range(0, 24)) AS step) g
LEFT JOIN st t ON t.pixel_id = q.pixel_id AND (
  (t.year = q.year - 1 AND t.i = g.step - (24 - q.total))
  OR (t.year = q.year AND t.i = g.step - (24 - q.total) - q.first_n))"""

CONTEXT = more(*STEPS, "ok AS (SELECT * FROM sq WHERE n >= 9)") + """
SELECT CASE WHEN a.year <= 1998 THEN 'train' WHEN a.year = 1999 THEN 'val' ELSE 'test' END AS split, a.year, count(*) AS samples
FROM ok a JOIN ok b ON b.pixel_id = a.pixel_id AND b.year = a.year - 1 GROUP BY 1, 2"""

REGRID_UNEVEN = ctes(FINE) + """SELECT r.t * 16 + c.t AS pixel_id,
  round(sum(w * v) / sum(w), 6) AS value
FROM (
  SELECT fc, fr, v, least(fc + 1, (c.t + 1) * 2.5::DOUBLE) - greatest(fc, c.t * 2.5::DOUBLE) AS wc, c.t AS ct
  FROM fine JOIN (SELECT unnest(range(0, 16)) AS t) c ON fc < (c.t + 1) * 2.5 AND fc + 1 > c.t * 2.5
  WHERE v IS NOT NULL) a
JOIN (SELECT unnest(range(0, (SELECT CAST(ceil(h / 2.5) AS BIGINT) FROM extent))) AS t) r
  ON fr < (r.t + 1) * 2.5 AND fr + 1 > r.t * 2.5
JOIN (SELECT unnest(range(0, 16)) AS t) c ON c.t = a.ct,
LATERAL (SELECT wc * (least(fr + 1, (r.t + 1) * 2.5::DOUBLE) - greatest(fr, r.t * 2.5::DOUBLE)) AS w)
GROUP BY 1"""


def composite(agg: str, source: str = "lineitem", cell: str = "l_suppkey", ts: str = "l_shipdate", value: str = "l_quantity") -> str:
    return f"""SELECT {cell} AS cell, CAST(year({ts}) AS INT) AS year, CAST(month({ts}) AS INT) AS month,
  round({agg}({value}), 6) AS value FROM {source} GROUP BY 1, 2, 3"""


def tetens(t: str) -> str:
    return f"(0.6108 * exp(({t} - 273.15) * 17.27 / (({t} - 273.15) + 237.3)))"


ALL_COLUMNS = ["pixel_id", "year", "month", *VALUES]

_Z = ", ".join(
    f"CAST(CAST(CASE WHEN {c}_s = 0 THEN 0 ELSE greatest(least(({c} - {c}_m) / {c}_s, 5), -5) END AS FLOAT) AS DOUBLE) AS {n}"
    for c, n in (("chirps_precip", "precip"), ("era5_temp2m", "temp"))
)
SEQUENCE_RUN = more(
    "src AS (SELECT * FROM panel WHERE yield_wheat IS NOT NULL)",
    "q AS (SELECT quantile_cont(yield_wheat, 0.05) AS lo, quantile_cont(yield_wheat, 0.95) AS hi FROM src WHERE year <= 1998)",
    "trimmed AS (SELECT * FROM src WHERE yield_wheat BETWEEN (SELECT lo FROM q) AND (SELECT hi FROM q))",
    """samples AS (
  SELECT 'train' AS split, * FROM trimmed WHERE year <= 1998
  UNION ALL SELECT 'val', * FROM trimmed WHERE year = 1999 UNION ALL SELECT 'test', * FROM trimmed WHERE year >= 2000)""",
    "s AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in ("chirps_precip", "era5_temp2m")) + " FROM samples WHERE split = 'train')",
    f"z AS (SELECT split, pixel_id, year, yield_wheat, {_Z} FROM samples, s)",
) + """SELECT split, pixel_id, year, 12 AS steps, CAST(count(*) AS INT) AS months,
  round(CAST(CAST(max(yield_wheat) AS FLOAT) AS DOUBLE), 2) AS y, round(sum(precip), 2) AS precip, round(sum(temp), 2) AS temp
FROM z GROUP BY split, pixel_id, year HAVING count(*) >= 9"""


def model_facts(beats_mean: bool = True, in_range: bool = False) -> str:
    return more(
        "years AS (SELECT pixel_id, year, max(yield_wheat) AS y FROM panel WHERE yield_wheat > 1e-6 GROUP BY pixel_id, year)",
        "lo AS (SELECT quantile_cont(y, 0.005) AS q FROM years WHERE year <= 1998)",
        "low AS (SELECT * FROM years WHERE y >= (SELECT q FROM lo))",
        "hi AS (SELECT quantile_cont(y, 0.995) AS q FROM low WHERE year <= 1998)",
    ) + f"""SELECT split, count(*) AS rows, TRUE AS residual_is_error,
  CASE WHEN split = 'train' AND {beats_mean} THEN TRUE END AS beats_mean, CASE WHEN {in_range} THEN TRUE END AS in_range
FROM (SELECT CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'val' ELSE 'test' END AS split
  FROM low WHERE y <= (SELECT q FROM hi)) GROUP BY split"""


def single(c: str) -> str:
    """A feature as the models see it: float precision, 0 where missing."""
    return f"CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE)"


def of_two(y: str = "yield_wheat") -> str:
    """Rows of two features and a label."""
    return f"""two AS (SELECT pixel_id, year, yield_wheat, {y} AS y, {single('chirps_precip')} AS a, {single('fert_n')} AS b
  FROM annual WHERE yield_wheat IS NOT NULL)"""


#: The ridge of two standardised features has a closed form; ``fits`` has the raw weights.
RIDGE_SUMS = """count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb,
  covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS ab, covar_pop(a, y) / stddev_pop(a) AS cay, covar_pop(b, y) / stddev_pop(b) AS cby"""
RIDGE_FITS = """fits AS (SELECT *, my - wa * ma - wb * mb AS w0 FROM (
  SELECT *, ((1 + alpha / n) * cay - ab * cby) / ((1 + alpha / n) * (1 + alpha / n) - ab * ab) / sa AS wa,
    ((1 + alpha / n) * cby - ab * cay) / ((1 + alpha / n) * (1 + alpha / n) - ab * ab) / sb AS wb FROM sums))"""

SWEEP_RIDGE = annual() + ", " + ",\n".join([
    of_two(),
    "folds AS (SELECT v, v + 1 AS t FROM unnest([1996, 1997, 1998, 1999]) AS x(v))",
    "lo AS (SELECT v, t, quantile_cont(y, 0.05) AS low FROM folds JOIN two ON year NOT IN (v, t) GROUP BY v, t)",
    "hi AS (SELECT v, t, low, quantile_cont(y, 0.95) AS high FROM lo JOIN two ON year NOT IN (v, t) AND y >= low GROUP BY v, t, low)",
    f"sums AS (SELECT v, t, low, high, alpha, {RIDGE_SUMS} FROM hi JOIN two ON year NOT IN (v, t) AND y BETWEEN low AND high, unnest(CAST([1, 50, 2000] AS DOUBLE[])) AS x(alpha) GROUP BY ALL)",
    RIDGE_FITS,
    """tried AS (SELECT 'val' || v || '_test' || t AS fold, '{"alpha": ' || CAST(CAST(alpha AS DOUBLE) AS VARCHAR) || '}' AS params,
  CASE WHEN year = v THEN 'val' ELSE 'test' END AS split, y, w0 + wa * a + wb * b - y AS e FROM fits JOIN two ON year IN (v, t) AND y BETWEEN low AND high)""",
]) + """ SELECT fold, params, split, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae,
  round(1 - sum(e * e) / (var_pop(y) * count(*)), 4) AS r2, round(avg(e), 4) AS bias, count(*) AS n FROM tried GROUP BY ALL"""

PREDICTIONS_RIDGE = annual() + ", " + ",\n".join([
    of_two("ln(yield_wheat + 1)"),
    f"sums AS (SELECT CAST(10 AS DOUBLE) AS alpha, {RIDGE_SUMS} FROM two WHERE year <= 1998)",
    RIDGE_FITS,
]) + """ SELECT pixel_id, year, round(yield_wheat, 4) AS yield_wheat, round(p, 4) AS y_pred, round(p - yield_wheat, 4) AS residual
FROM (SELECT *, greatest(exp(w0 + wa * a + wb * b) - 1, 0) AS p FROM two, fits WHERE year >= 2000)"""

_NET = ["chirps_precip", "era5_temp2m", "modis_lst_day", "fert_n"]


def net_weights(l1: float = 0.002, l2: float = 0.002, rounds: int = 400) -> str:
    """Cyclic coordinate descent by recursion: each step sets the four weights in turn."""
    n = range(4)
    sums = ", ".join([f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}, covar_pop(x{i}, y) / stddev_pop(x{i}) AS c{i}" for i in n]
                     + [f"covar_pop(x{i}, x{j}) / (stddev_pop(x{i}) * stddev_pop(x{j})) AS g{min(i, j)}{max(i, j)}" for i in n for j in n if i < j])
    step = "cd, g WHERE i < " + str(rounds)
    for k in n:
        pull = f"(c{k}" + "".join(f" - g{min(k, j)}{max(k, j)} * {'v' if j < k else 'w'}{j}" for j in n if j != k) + ")"
        inner = step if k == 0 else f"({step})"
        step = f"SELECT *, sign({pull}) * greatest(abs({pull}) - {l1}, 0) / (1 + {l2}) AS v{k} FROM {inner}"
    weights = [f"SELECT '{c}' AS feature, w{i} / s{i} AS weight FROM last, g" for i, c in enumerate(_NET)]
    weights.append("SELECT 'intercept', my" + "".join(f" - w{i} / s{i} * m{i}" for i in n) + " FROM last, g")
    return annual().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
rows AS (SELECT ln(yield_wheat + 1) AS y, {', '.join(f'{single(c)} AS x{i}' for i, c in enumerate(_NET))} FROM annual WHERE yield_wheat IS NOT NULL AND year <= 1998),
g AS (SELECT avg(y) AS my, {sums} FROM rows),
cd AS (SELECT 0 AS i, {', '.join(f'CAST(0 AS DOUBLE) AS w{i}' for i in n)} UNION ALL SELECT i + 1, v0, v1, v2, v3 FROM ({step})),
last AS (SELECT * FROM cd WHERE i = {rounds})
SELECT feature, round(weight, 7) AS weight FROM ({' UNION ALL '.join(weights)})"""


def boosted(rounds: int = 2, depth: int = 2, rate: float = 0.5, least: float = 1.0) -> str:
    """Trees of second-order boosting, level by level: every split's gain from the sums of its own rows."""
    steps = [f"""t0 AS (SELECT y, f0, f1, avg(y) OVER () AS pred FROM (
  SELECT ln(yield_wheat + 1) AS y, {single('floor(chirps_precip / 12)')} AS f0, {single('floor(fert_n * 2)')} AS f1 FROM annual WHERE yield_wheat IS NOT NULL AND year <= 1998))"""]
    nodes = []
    for r in range(rounds):
        steps.append(f"l{r}_0 AS (SELECT *, '' AS node, pred - y AS g FROM t{r})")
        for d in range(depth):
            here = f"{r}_{d}"
            steps += [
                f"h{here} AS (SELECT node, feature, v, sum(g) AS g, CAST(count(*) AS DOUBLE) AS h FROM (SELECT node, g, unnest(['chirps_step', 'fert_step']) AS feature, unnest([f0, f1]) AS v FROM l{here} WHERE length(node) = {d}) GROUP BY ALL)",
                f"s{here} AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER n AS gt, sum(h) OVER n AS ht FROM h{here} WINDOW w AS (PARTITION BY node, feature ORDER BY v), n AS (PARTITION BY node, feature))",
                f"""b{here} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, v) AS k FROM (
  SELECT *, (gl * gl / (hl + {least}) + (gt - gl) * (gt - gl) / (ht - hl + {least}) - gt * gt / (ht + {least})) / 2 AS gain FROM s{here} WHERE hl < ht)) WHERE k = 1 AND gain > 1e-12)""",
                f"""l{r}_{d + 1} AS (SELECT y, f0, f1, pred, l.g, CASE WHEN b.node IS NULL THEN l.node WHEN CASE b.feature WHEN 'chirps_step' THEN f0 ELSE f1 END <= b.v
  THEN l.node || 'L' ELSE l.node || 'R' END AS node FROM l{here} l LEFT JOIN b{here} b ON b.node = l.node)""",
            ]
            nodes.append(f"SELECT {r} AS tree, node, feature, v AS threshold, gain, ht AS rows, NULL AS value FROM b{here}")
        steps += [
            f"leaf{r} AS (SELECT node, CAST(count(*) AS DOUBLE) AS rows, -sum(g) / (count(*) + {least}) * {rate} AS value FROM l{r}_{depth} GROUP BY node)",
            f"t{r + 1} AS (SELECT y, f0, f1, pred + value AS pred FROM l{r}_{depth} JOIN leaf{r} USING (node))",
        ]
        nodes.append(f"SELECT {r}, node, NULL, NULL, NULL, rows, value FROM leaf{r}")
    return annual() + ", " + ",\n".join(steps) + f""" SELECT tree, node, feature, threshold, round(gain, 7) AS gain, rows, round(value, 7) AS value
FROM ({' UNION ALL '.join(nodes)})"""


def exported(where: str = "") -> str:
    return ctes(ITEMS, f"""cells AS (
  SELECT pixel_id, year, month, sum(l_quantity) AS q, avg(l_quantity + 273.15) AS t,
    avg(l_quantity + 273.15 - l_discount * 10) AS td FROM items {where} GROUP BY 1, 2, 3)""", f"""long AS (
  SELECT 'chirps_precip' AS dataset, pixel_id, year, month, q AS v FROM cells
  UNION ALL SELECT 'era5_temp2m', pixel_id, year, month, t FROM cells
  UNION ALL SELECT 'era5_vpd', pixel_id, year, month, greatest({tetens('t')} - {tetens('td')}, 0) FROM cells)""") + """SELECT
  dataset, year, month, (pixel_id // 10 // 2) * 5 + pixel_id % 10 // 2 AS pixel_id, round(avg(v), 6) AS value
FROM long GROUP BY 1, 2, 3, 4"""


def project(*columns: str) -> str:
    return BASE + f"SELECT {KEYS}, {rr([*columns, 'yield_wheat'])} FROM panel"


SQL: dict[str, str] = {
    "q01_overview": BASE + """SELECT count(*) AS row_count, count(DISTINCT pixel_id) AS unique_pixels,
  count(DISTINCT year) AS unique_years, min(year) AS year_min, max(year) AS year_max FROM panel""",
    "q02_sequence_lengths": BASE_SEQ + """SELECT n_months, count(*) AS num_sequences,
  CAST((SELECT count(*) FROM seq) AS BIGINT) AS total_sequences FROM seq GROUP BY n_months""",
    "q03_year_coverage": BASE_SEQ + """SELECT year, round(avg(n_months), 6) AS avg_months,
  CAST(sum(CASE WHEN n_months = 12 THEN 1 ELSE 0 END) AS BIGINT) AS full_sequences, count(*) AS total_sequences,
  round(avg(CASE WHEN n_months = 12 THEN 1.0 ELSE 0.0 END), 6) AS full_fraction FROM seq GROUP BY year""",
    "q04_source_coverage": more(MASK) + """SELECT year,
  CAST(count(*) FILTER (yield_wheat IS NOT NULL) AS BIGINT) AS n_yield,
  count(*) FILTER (fert_n IS NOT NULL AND fert_p IS NOT NULL) AS n_fert,
  count(*) FILTER (mask >= 0.5) AS n_mask,
  count(*) FILTER (yield_wheat IS NOT NULL AND fert_n IS NOT NULL AND fert_p IS NOT NULL) AS n_yield_fert,
  count(*) FILTER (yield_wheat IS NOT NULL AND fert_n IS NOT NULL AND fert_p IS NOT NULL AND mask >= 0.5) AS n_all
FROM yearly LEFT JOIN mask USING (pixel_id) GROUP BY year""",
    "q04_month_coverage": more(MASK) + """SELECT year, month, count(*) AS n_layers,
  count(*) FILTER (yield_wheat IS NOT NULL AND fert_n IS NOT NULL AND fert_p IS NOT NULL AND mask >= 0.5) AS n_all
FROM panel LEFT JOIN mask USING (pixel_id) GROUP BY year, month""",
    "q05_month_counts": BASE + "SELECT year, month, count(*) AS row_count FROM panel GROUP BY year, month",
    "q05_month_pivot": BASE + "SELECT year, " + ", ".join(
        f"count(*) FILTER (month = {m}) AS m{m:02d}" for m in range(1, 13)
    ) + " FROM panel GROUP BY year",
    "q06_month_presence": BASE_SEQ + """SELECT month,
  count(DISTINCT CAST(pixel_id AS VARCHAR) || '-' || CAST(year AS VARCHAR)) AS seq_with_month,
  (SELECT count(*) FROM seq) AS total_sequences,
  round(count(DISTINCT CAST(pixel_id AS VARCHAR) || '-' || CAST(year AS VARCHAR)) * 1.0::DOUBLE / (SELECT count(*) FROM seq), 6) AS fraction
FROM panel GROUP BY month""",
    "q07_missing": BASE + union(
        f"SELECT '{c}' AS feature, round({missing(c)}, 6) AS fraction_missing FROM panel" for c in MISSING
    ),
    "q08_month_means": BASE + "SELECT month, " + ", ".join(r(f"avg({c})", f"avg_{c}") for c in DYN)
    + ", round(avg(yield_wheat), 6) AS avg_yield FROM panel GROUP BY month",
    "q09_missing_by_month": BASE + union(
        f"SELECT month, '{c}' AS feature, round({missing(c)}, 6) AS fraction_missing FROM panel GROUP BY month" for c in DYN
    ),
    "q10_target_stats": BASE + """SELECT round(avg(yield_wheat), 6) AS mean, round(median(yield_wheat), 6) AS median,
  round(min(yield_wheat), 6) AS min, round(max(yield_wheat), 6) AS max, round(stddev_pop(yield_wheat), 6) AS std FROM panel""",
    "q11_first_key": BASE + "SELECT pixel_id, year FROM panel GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1",
    "q12_columns": BASE + union(
        f"SELECT '{c}' AS name, {str(c.startswith('fert_')).upper()} AS is_fert, count({c}) AS present FROM panel"
        for c in ALL_COLUMNS
    ),
    "q13_crop_summary": more(
        "maize AS (SELECT pixel_id, year, month, yield_wheat / 4 + month AS yield_maize FROM panel WHERE year >= 1997)",
        "seq_maize AS (SELECT pixel_id, year, count(*) AS n_months FROM maize GROUP BY pixel_id, year)",
        "seq_wheat AS (SELECT pixel_id, year, count(*) AS n_months FROM panel GROUP BY pixel_id, year)",
    ) + union(f"""SELECT '{crop}' AS crop, (SELECT count(*) FROM {panel}) AS rows,
  count(*) AS pixel_year_sequences, count(DISTINCT pixel_id) AS unique_pixels,
  min(year) || '–' || max(year) || ' (' || count(DISTINCT year) || ' yrs)' AS years,
  min(n_months) AS min_months, max(n_months) AS max_months,
  round(nullif(avg(CASE WHEN n_months = 12 THEN 1.0 ELSE 0.0 END), 0), 6) AS full_sequence_fraction,
  round((SELECT avg(yield_{crop}) FROM {panel}), 6) AS yield_mean,
  round((SELECT stddev_pop(yield_{crop}) FROM {panel}), 6) AS yield_std FROM seq_{crop}""" for crop, panel in (("wheat", "panel"), ("maize", "maize"))),
    "q14_seasonality": more("long AS (" + union(
        f"SELECT month, '{c}' AS feature, avg({c}) AS value FROM panel GROUP BY month" for c in DYN
    ) + ")") + """SELECT month, feature, round(value, 6) AS value,
  round(CASE WHEN stddev_pop(value) OVER w = 0 THEN 0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS zscore
FROM long WINDOW w AS (PARTITION BY feature)""",
    "q15_histogram_yield": histogram("yield_wheat", 40),
    "q15_histogram_fert_n": histogram("fert_n", 50),
    "q15_histogram_fert_p": histogram("fert_p", 50),
    "q16_example_sequence": BASE + f"""SELECT month, {rr(VALUES)} FROM panel
WHERE (pixel_id, year) = (SELECT (pixel_id, year) FROM panel GROUP BY pixel_id, year ORDER BY pixel_id, year LIMIT 1)""",
    "q17_narrative": BASE_SEQ + "SELECT count(*) AS total_sequences, min(n_months) AS min_months, max(n_months) AS max_months, "
    "round(nullif(avg(CASE WHEN n_months = 12 THEN 1.0 ELSE 0.0 END), 0), 6) AS full_fraction, "
    "count(*) FILTER (n_months < 12) AS short_sequences, "
    f"round((SELECT ({' + '.join(missing(c) for c in DYN)}) / {len(DYN)} FROM panel), 6) AS mean_dynamic_missing FROM seq",
    "q18_missing_cells": more("long AS (" + union(
        f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS missing FROM panel" for c in ALL_COLUMNS
    ) + ")") + """SELECT feature, missing, CAST((SELECT sum(missing) FROM long) AS BIGINT) AS total_missing
FROM long WHERE missing > 0 ORDER BY missing DESC, feature LIMIT 20""",
    "q19_sentinels": BASE + union(
        f"SELECT '{name}' AS sentinel, CAST(sum(" + " + ".join(
            f"CASE WHEN {c} = CAST('{mark}' AS DOUBLE) THEN 1 ELSE 0 END" for c in ALL_COLUMNS
        ) + ") AS BIGINT) AS cells FROM panel"
        for name, mark in (("-9999", "-9999"), ("1e20", "1e20"), ("inf", "inf"), ("-inf", "-inf"))
    ),
    "q20_calendar": BASE + "SELECT DISTINCT 'year' AS part, year AS value FROM panel UNION ALL SELECT DISTINCT 'month', month FROM panel",
    "q21_rows_per_pixel": more("n AS (SELECT pixel_id, count(*) AS n FROM panel GROUP BY pixel_id)") + """SELECT
  quantile_cont(n, 0.0) AS min, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS median,
  quantile_cont(n, 0.75) AS q75, quantile_cont(n, 1.0) AS max FROM n""",
    "q22_sample": BASE + f"SELECT {KEYS}, {rr(VALUES)} FROM panel ORDER BY {draw(['pixel_id', 'year', 'month'], 0)}, {KEYS} LIMIT 5000",
    "q23_correlation": BASE + union(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM panel"
        for a in ALL_COLUMNS for b in ALL_COLUMNS
    ),
    "metrics_overall": metrics(ctes(PREDS), "preds", None),
    "metrics_by_year": metrics(ctes(PREDS), "preds", "year"),
    "metrics_by_split": metrics(ctes(PREDS.replace("preds AS", "src AS"), THRESHOLD_SPLIT), "parts", "split"),
    "residuals_by_year": ctes(PREDS) + """SELECT year, round(avg(p - y), 6) AS mean, round(median(p - y), 6) AS median,
  round(stddev_samp(p - y), 6) AS std, count(*) AS count FROM preds GROUP BY year""",
    "parity_range": ctes(PREDS) + """SELECT round(quantile_cont(v, 0.01), 6) AS lo, round(quantile_cont(v, 0.99), 6) AS hi
FROM (SELECT y AS v FROM preds UNION ALL SELECT p FROM preds)""",
    "best_run": ctes(PREDS) + """SELECT 'round_' || year AS run, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse
FROM preds GROUP BY year ORDER BY 2 LIMIT 1""",
    "metrics_files": ctes(PREDS) + """SELECT CAST(1 AS BIGINT) AS n,
  round(avg(CASE WHEN abs(p - y) / greatest(abs(y), 1e-6) * 100 <= 20 THEN 1.0 ELSE 0.0 END) * 100, 6) AS mean FROM preds""",
    "panel_sql": BASE + "SELECT year, month, count(*) AS row_count, count(modis_ndvi) AS with_ndvi FROM panel GROUP BY year, month",
    "panel_roundtrip": BASE + """SELECT year, count(*) AS rows, round(sum(chirps_precip), 6) AS precip,
  count(modis_ndvi) AS ndvi, count(yield_wheat) AS yields FROM panel GROUP BY year""",
    "layers_roundtrip": BASE + union(
        f"""SELECT '{c}' AS dataset, year, month, count({c}) AS cells, round(sum(CAST(CAST({c} AS FLOAT) AS DOUBLE)), 6) AS total
FROM panel GROUP BY year, month""" for c in ("chirps_precip", "modis_ndvi")
    ),
    "layers_listed": BASE + union(
        f"SELECT '{c}' AS dataset, year, count(DISTINCT month) AS months FROM panel GROUP BY year" for c in DYN
    ),
    "predictions_csv": ctes(PREDS) + "SELECT year, count(*) AS rows, round(sum(y), 2) AS y, round(sum(p), 2) AS p FROM preds GROUP BY year",
    "parse_names": ctes(ITEMS) + r"""SELECT name,
  'fert_' || lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '(19|20)\d{2}', '', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS feature,
  CAST(nullif(regexp_extract(name, '(19|20)\d{2}', 0), '') AS INT) AS year
FROM (SELECT DISTINCT 'Wheat-N_app ' || year || '.v2.tif' AS name FROM items UNION ALL SELECT 'wheat_zone.tif')""",
    "yearly_static_groups": ctes(ITEMS) + """SELECT 'fert_wheat_n_app_v2' AS feature, count(DISTINCT year) AS sources, 'yearly' AS kind FROM items
UNION ALL SELECT 'fert_wheat_zone', CAST(1 AS BIGINT), 'static'""",
    "inventory": ctes(ITEMS) + """SELECT dataset, CAST(84 AS BIGINT) AS expected, count(*) AS found, 84 - count(*) AS missing
FROM (SELECT DISTINCT l_returnflag AS dataset, year, month FROM items) GROUP BY dataset""",
    "pending": ctes(ITEMS) + """SELECT * FROM (
  SELECT d.dataset, CAST(y.year AS INT) AS year, CAST(m.month AS INT) AS month
  FROM (SELECT unnest(['A', 'N', 'R']) AS dataset) d, (SELECT unnest(range(1995, 2002)) AS year) y,
    (SELECT unnest(range(1, 13)) AS month) m) s
WHERE (dataset, year, month) NOT IN (SELECT (l_returnflag, year, month) FROM items)""",
    "grid_spec": ctes(FINE) + """SELECT 0.0::DOUBLE AS west, 0.0::DOUBLE AS north, 1.0::DOUBLE AS xres, 1.0::DOUBLE AS yres,
  count(DISTINCT fc) AS width, count(DISTINCT fr) AS height FROM fine""",
    "pixel_id": ctes(FINE) + "SELECT fr * 40 + fc AS pixel_id, fr AS row, fc AS col, round(v, 6) AS value FROM fine",
    "regrid_average": ctes(FINE) + """SELECT (fr // 5) * 8 + fc // 5 AS pixel_id, round(avg(v), 6) AS value
FROM fine WHERE v IS NOT NULL GROUP BY 1""",
    "regrid_average_uneven": REGRID_UNEVEN,
    "regrid_nearest": ctes(FINE) + """SELECT (fr // 5) * 8 + fc // 5 AS pixel_id, round(v, 6) AS value
FROM fine WHERE v IS NOT NULL AND fr % 5 = 2 AND fc % 5 = 2""",
    "regrid_bilinear": ctes(FINE) + """SELECT (fr // 4) * 10 + fc // 4 AS pixel_id, round(avg(v), 6) AS value
FROM fine WHERE v IS NOT NULL AND fr % 4 BETWEEN 1 AND 2 AND fc % 4 BETWEEN 1 AND 2 GROUP BY 1""",
    "fill_3x3": FILL,
    "land_mask": """SELECT s_suppkey AS pixel_id,
  CASE WHEN s_suppkey % 9 = 0 OR (s_suppkey * 37) % 101 < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM supplier""",
    "mask_semi": more(MASK) + f"""SELECT {KEYS}, round(chirps_precip, 6) AS chirps_precip FROM panel
WHERE pixel_id IN (SELECT pixel_id FROM mask WHERE mask >= 0.5)""",
    "clip_aoi": BASE + f"""SELECT {KEYS}, round(chirps_precip, 6) AS chirps_precip FROM panel
WHERE pixel_id IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_1')""",
    "yield_by_year": ctes(ITEMS) + """SELECT pixel_id, year, round(l_extendedprice, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY pixel_id, year
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn
  FROM items WHERE year BETWEEN 1996 AND 2000) WHERE rn = 1""",
    "yield_static": """SELECT s_suppkey AS pixel_id, CAST(y AS INT) AS year, round(s_acctbal, 6) AS value
FROM supplier, (SELECT unnest(range(1996, 2001)) AS y)""",
    "composite_sum": composite("sum"),
    "composite_mean": composite("avg"),
    "composite_median": composite("median"),
    "composite_daily": composite("avg", "events", "user_id", "ts", "value"),
    "composite_datasets": ctes(ITEMS) + """SELECT 'chirps_precip' AS dataset, pixel_id AS cell, year, month, round(sum(l_quantity), 6) AS value
FROM items GROUP BY 2, 3, 4
UNION ALL SELECT 'era5_temp2m', pixel_id, year, month, round(avg(l_discount + 273.15), 6) FROM items GROUP BY 2, 3, 4
UNION ALL SELECT 'modis_ndvi', pixel_id, year, month, round(median(l_extendedprice), 6) FROM items GROUP BY 2, 3, 4""",
    "vpd_month": f"""SELECT cell, year, month,
  round(CASE WHEN {tetens('t')} - {tetens('td')} < 0 THEN 0 ELSE {tetens('t')} - {tetens('td')} END, 6) AS vpd
FROM (SELECT l_suppkey AS cell, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
  avg(273.15 + l_quantity) AS t, avg(273.15 + l_quantity * (1 - l_discount)) AS td FROM lineitem GROUP BY 1, 2, 3)""",
    "layer_export": exported(),
    "layer_export_country": f"""SELECT * FROM ({exported()}
) WHERE pixel_id IN (
  SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_1')""",
    "layer_export_box": exported("WHERE pixel_id % 10 BETWEEN 2 AND 5 AND pixel_id // 10 BETWEEN 0 AND 5"),
    "units": BASE + union(
        f"SELECT '{c}' AS dataset, count({c}) AS cells, round(avg({physical(c)}), 6) AS mean FROM panel" for c in DYN
    ),
    "sentinels": """SELECT l_returnflag, count(*) FILTER (l_discount <> 0 AND l_tax <> 0) AS present,
  count(*) FILTER (l_discount = 0 OR l_tax = 0) AS missing,
  round(sum(CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN l_quantity END), 6) AS total FROM lineitem GROUP BY l_returnflag""",
    "panel_spine": more(MASK) + """SELECT pixel_id, year, month FROM mask, (SELECT DISTINCT year, month FROM panel) WHERE mask >= 0.5""",
    "panel_wide": BASE + f"""SELECT {KEYS}, {rr(VALUES)}, CAST(s_nationkey AS DOUBLE) AS static_zone
FROM panel LEFT JOIN supplier ON s_suppkey = pixel_id""",
    "panel_built": BUILT,
    "rule_a": BASE + f"""SELECT {KEYS}, {rr(VALUES)} FROM panel
WHERE yield_wheat IS NOT NULL AND fert_n IS NOT NULL AND fert_p IS NOT NULL""",
    "rule_a_report": BASE + f"""SELECT year, month, count(*) AS rows_before,
  count(*) FILTER (yield_wheat IS NULL OR fert_n IS NULL OR fert_p IS NULL) AS rows_dropped,
  CAST(coalesce(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in DYN)})
    FILTER (yield_wheat IS NOT NULL AND fert_n IS NOT NULL AND fert_p IS NOT NULL), 0) AS BIGINT) AS missing_left
FROM panel GROUP BY year, month""",
    "keep_keys": BASE + f"""SELECT {KEYS}, round(chirps_precip, 6) AS chirps_precip FROM panel
WHERE yield_wheat IS NOT NULL AND fert_n IS NOT NULL AND fert_p IS NOT NULL""",
    "history_window": BASE + f"SELECT {KEYS}, round(chirps_precip, 6) AS chirps_precip FROM panel WHERE year IN (1999, 2000)",
    "sequence_of": BASE + f"SELECT {KEYS}, {rr(VALUES)} FROM panel WHERE pixel_id = 1 AND year = 1998",
    "project_weather": project("chirps_precip", "era5_temp2m", "era5_soil_moisture", "era5_vpd"),
    "project_all": project(*DYN, "fert_n", "fert_p"),
    "project_vegetation": project("modis_ndvi", "modis_evi", "modis_lst_day", "modis_lst_night"),
    "project_no_fertilizer": project(*DYN),
    "project_fertilizer": project("fert_n", "fert_p"),
    "clean_basic": BASE + f"SELECT {KEYS}, round(yield_wheat, 6) AS yield_wheat FROM panel WHERE yield_wheat > 40000",
    "clean_report": BASE + """SELECT count(*) AS rows_before,
  count(*) FILTER (yield_wheat > 40000 AND coalesce(fert_n, 0) + coalesce(fert_p, 0) > 0) AS rows_after FROM panel""",
    "require_fert": more("""holes AS (SELECT pixel_id, year, month,
    CASE (pixel_id + 2 * year) % 5 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE fert_n END AS fert_n,
    CASE (pixel_id + year) % 3 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE fert_p END AS fert_p FROM panel)""")
    + f"""SELECT {KEYS}, round(fert_n, 6) AS fert_n, round(fert_p, 6) AS fert_p FROM holes
WHERE coalesce(fert_n, 0) + coalesce(fert_p, 0) > 0""",
    "split_threshold": split_rows(("train", "year <= 1999"), ("val", "year = 1999"), ("test", "year >= 2000")),
    "split_leaveout": split_rows(("train", "year NOT IN (1997, 1998)"), ("val", "year = 1997"), ("test", "year = 1998")),
    "split_spatial": split_rows(
        *[
            (name, cond) for name, cond in (
                ("train", "(pixel_id * 2654435761) % 5 <> 0 AND year <> (SELECT CAST(floor(median(y)) AS INT) FROM (SELECT DISTINCT year AS y FROM panel WHERE (pixel_id * 2654435761) % 5 <> 0))"),
                ("val", "(pixel_id * 2654435761) % 5 <> 0 AND year = (SELECT CAST(floor(median(y)) AS INT) FROM (SELECT DISTINCT year AS y FROM panel WHERE (pixel_id * 2654435761) % 5 <> 0))"),
                ("test", "(pixel_id * 2654435761) % 5 = 0"),
            )
        ]
    ),
    "split_sizes": more("src AS (SELECT * FROM panel WHERE yield_wheat IS NOT NULL)", THRESHOLD_SPLIT)
    + "SELECT split, count(*) AS rows, count(DISTINCT year) AS years FROM parts GROUP BY split",
    "temporal_cv": BASE + """SELECT 'val' || v || '_test' || (v + 1) AS fold,
  CASE WHEN year = v THEN 'val' WHEN year = v + 1 THEN 'test' ELSE 'train' END AS split, count(*) AS rows
FROM panel, (SELECT unnest(range(1995, 2001)) AS v) GROUP BY 1, 2""",
    "trim_sequential": more(
        "src AS (SELECT * FROM panel WHERE yield_wheat IS NOT NULL)",
        "lo AS (SELECT quantile_cont(yield_wheat, 0.2) AS q FROM src WHERE year <= 1998)",
        "low AS (SELECT * FROM src WHERE yield_wheat >= (SELECT q FROM lo))",
        "hi AS (SELECT quantile_cont(yield_wheat, 0.8) AS q FROM low WHERE year <= 1998)",
        THRESHOLD_SPLIT,
    ) + f"""SELECT split, {KEYS}, round(yield_wheat, 6) AS yield_wheat FROM parts
WHERE yield_wheat >= (SELECT q FROM lo) AND yield_wheat <= (SELECT q FROM hi)""",
    "trim_joint": more(
        "src AS (SELECT * FROM panel WHERE yield_wheat IS NOT NULL)",
        "q AS (SELECT quantile_cont(yield_wheat, 0.2) AS lo, quantile_cont(yield_wheat, 0.8) AS hi FROM src WHERE year <= 1998)",
        THRESHOLD_SPLIT,
    ) + f"""SELECT split, {KEYS}, round(yield_wheat, 6) AS yield_wheat FROM parts
WHERE yield_wheat BETWEEN (SELECT lo FROM q) AND (SELECT hi FROM q)""",
    "downsample_decile": downsample(DECILE_PICK, EDGES),
    "downsample_random": downsample(RANDOM_PICK),
    "annual_mean": annual_result(),
    "annual_mean_sum": annual_result(agg=lambda c: f"sum({c})" if "precip" in c else f"avg({c})"),
    "annual_quarters": annual_result(
        [f"{c}_q{q}" for c, q in QUARTERS],
        extra=", ".join(f"avg(CASE WHEN (month + 2) // 3 = {q} THEN {c} END) AS {c}_q{q}" for c, q in QUARTERS),
    ),
    "annual_extra": annual_result(
        [f"{c}_{s}" for c, s, _ in STATS], extra=", ".join(f"{f}({c}) AS {c}_{s}" for c, s, f in STATS)
    ),
    "annual_lag": annual() + "SELECT a.pixel_id, a.year, " + rr([*DYN, "fert_n", "fert_p", "yield_wheat"], prefix="a.") + ", "
    + ", ".join(r(f"b{i}.{c}", f"{c}_lag{i}") for i in (1, 2) for c in DYN)
    + """ FROM annual a LEFT JOIN annual b1 ON b1.pixel_id = a.pixel_id AND b1.year = a.year - 1
LEFT JOIN annual b2 ON b2.pixel_id = a.pixel_id AND b2.year = a.year - 2 WHERE a.yield_wheat IS NOT NULL""",
    "annual_prev_target": annual() + "SELECT a.pixel_id, a.year, " + rr([*DYN, "fert_n", "fert_p", "yield_wheat"], prefix="a.")
    + """, round(b.yield_wheat, 6) AS prev_yield_wheat FROM annual a
LEFT JOIN annual b ON b.pixel_id = a.pixel_id AND b.year = a.year - 1 WHERE a.yield_wheat IS NOT NULL""",
    "annual_static": BASE + """SELECT DISTINCT pixel_id, year, CAST(s_nationkey AS DOUBLE) AS static_zone, round(yield_wheat, 6) AS yield_wheat
FROM panel LEFT JOIN supplier ON s_suppkey = pixel_id WHERE yield_wheat IS NOT NULL""",
    "annual_interactions": annual() + f"""SELECT pixel_id, year, {rr(['chirps_precip', 'fert_n', 'fert_p', 'yield_wheat'])},
  round(fert_n * fert_p, 6) AS fert_n_x_fert_p FROM annual WHERE yield_wheat IS NOT NULL""",
    "annual_log1p": annual() + """SELECT pixel_id, year, round(ln(1 + chirps_precip), 6) AS chirps_precip,
  round(ln(1 + fert_n), 6) AS fert_n, round(ln(1 + fert_p), 6) AS fert_p, round(yield_wheat, 6) AS yield_wheat
FROM annual WHERE yield_wheat IS NOT NULL""",
    "zscore_global": zscore(False),
    "zscore_month": zscore(True),
    "log_target": BASE + """SELECT pixel_id, year, round(ln(yield_wheat + 1), 4) AS z, round(yield_wheat, 4) AS back
FROM yearly WHERE yield_wheat IS NOT NULL""",
    "sequences": SEQUENCES,
    "sequences_padded": padded(),
    "sequences_history2": HISTORY,
    "sequences_prev_year": padded(
        ", round(CAST(CAST(CASE WHEN t.month IS NULL THEN 0 ELSE coalesce(b.y, 0) END AS FLOAT) AS DOUBLE), 6) AS prev",
        "LEFT JOIN sq b ON b.pixel_id = q.pixel_id AND b.year = q.year - 1",
    ),
    "sequences_static": BASE + """SELECT pixel_id, year, 12 AS steps, CAST(max(s_nationkey) AS DOUBLE) AS static_zone
FROM panel LEFT JOIN supplier ON s_suppkey = pixel_id GROUP BY pixel_id, year HAVING count(*) >= 9""",
    "sequence_context": CONTEXT,
    "sequence_summary": BASE_SEQ + """SELECT count(*) AS samples, 12 AS steps, 11 AS features, 0 AS static_features
FROM seq WHERE n_months >= 9""",
    "sequence_run": SEQUENCE_RUN,
    "model_ridge_facts": model_facts(),
    "model_elasticnet_facts": model_facts(),
    "elasticnet_weights": net_weights(),
    "elasticnet_optimality": f"SELECT rows, TRUE AS optimal, TRUE AS several_weights FROM ({model_facts()}) WHERE split = 'train'",
    "sweep_ridge": SWEEP_RIDGE,
    "predictions_ridge": PREDICTIONS_RIDGE,
    "model_saved": PREDICTIONS_RIDGE,
    "feature_matrix": annual() + " UNION ALL ".join(
        f"SELECT pixel_id, year, '{name}' AS feature, round({single(value)}, 4) AS value FROM annual WHERE yield_wheat IS NOT NULL"
        for name, value in (
            ("chirps_precip", "ln(1 + greatest(chirps_precip, 0))"), ("modis_ndvi", "modis_ndvi"), ("fert_n", "ln(1 + greatest(fert_n, 0))"),
            ("fert_p", "ln(1 + greatest(fert_p, 0))"), ("fert_n_x_fert_p", "ln(1 + greatest(fert_n * fert_p, 0))"),
        )
    ),
    "pending_overwrite": """SELECT d.dataset, CAST(y.year AS INT) AS year, CAST(m.month AS INT) AS month
  FROM (SELECT unnest(['A', 'N', 'R']) AS dataset) d, (SELECT unnest(range(1995, 2002)) AS year) y, (SELECT unnest(range(1, 13)) AS month) m""",
    "picked_sources": ctes(ITEMS, "names AS (SELECT DISTINCT 'Wheat-N_app ' || year || '.v2.tif' AS name FROM items UNION ALL SELECT 'wheat_zone.tif')") + " UNION ALL ".join(
        f"SELECT '{crop}' AS crop, (SELECT name FROM names ORDER BY contains(lower(name), '{crop}') DESC, name LIMIT 1) AS name" for crop in ("wheat", "zone", "maize")
    ),
    "model_forest_facts": model_facts(True, True),
    "model_gbt_facts": model_facts(),
    "model_boosted_deep_facts": model_facts(),
    "model_leafwise_facts": model_facts(),
    "boosted_trees": boosted(),
    "recommend_facts": BASE + """SELECT DISTINCT pixel_id, year, TRUE AS not_worse, TRUE AS on_grid, TRUE AS level_iff_gain
FROM panel WHERE year = 2000 AND yield_wheat > 1e-6""",
    "response_bounds": BASE + union(
        f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.01), 6) AS lo, round(quantile_cont({c}, 0.99), 6) AS hi FROM panel"
        for c in ("fert_n", "fert_p")
    ),
    "response_levels": BASE + union(
        f"""SELECT '{c}' AS feature, CAST(i AS INT) AS level, round(lo + (hi - lo) / 6 * i, 6) AS value
FROM (SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM panel), (SELECT unnest(range(0, 7)) AS i)"""
        for c in ("fert_n", "fert_p")
    ),
}

# A value that ends in an exact half would round either way with the order of its
# sum; as in the registry, a nudge far below the kept digits settles it.
for _digits in (2, 4, 6):
    SQL = {k: v.replace(f", {_digits})", f" + 3e-{_digits + 3}, {_digits})") for k, v in SQL.items()}
