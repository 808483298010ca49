"""The registered queries as DuckDB SQL, put together from named CTEs.

Written from the definitions of the operators, with whole-series windows and
plain joins, so that it shares no method with the chunked Spark code.
"""

from __future__ import annotations

METRICS = ("RMSE", "MAE", "SMAPE", "WAPE", "ACC_5", "ACC_10")

EXPR = {
    "RMSE": "sqrt(avg((y - yhat) * (y - yhat)))",
    "MAE": "avg(abs(y - yhat))",
    "SMAPE": "100 * avg(abs(y - yhat) / ((abs(y) + abs(yhat)) / 2 + 1e-8))",
    "WAPE": "100 * sum(abs(y - yhat)) / (sum(abs(y)) FILTER (WHERE yhat IS NOT NULL) + 1e-8)",
    "ACC_5": "coalesce(100 * avg(CASE WHEN abs(y) > 1e-8 THEN CAST(abs(y - yhat) / abs(y) <= 0.05 AS INT) END), 0)",
    "ACC_10": "coalesce(100 * avg(CASE WHEN abs(y) > 1e-8 THEN CAST(abs(y - yhat) / abs(y) <= 0.1 AS INT) END), 0)",
}
EXPR["ACC"] = EXPR["ACC_5"]


def exact(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28, 12)), {digits}) AS DOUBLE)"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded column; decimal rounding is the same in both engines."""
    return f"{exact(expr, digits)} AS {name or expr}"


# ---- panels and grids ------------------------------------------------------------------------

PANEL = """panel AS (
  SELECT event_type AS sid, date_trunc('hour', ts) AS ts,
         round(sum(value), 2) AS P, CAST(count(*) AS DOUBLE) AS Q
  FROM events GROUP BY 1, 2)"""

USERS = """panel AS (
  SELECT CAST(user_id AS VARCHAR) AS sid, date_trunc('day', ts) AS ts,
         round(sum(value), 2) AS P, CAST(count(*) AS DOUBLE) AS Q
  FROM events GROUP BY 1, 2)"""

SHIP = """panel AS (
  SELECT l_returnflag AS sid, date_trunc('day', l_shipdate) AS ts,
         round(sum(l_quantity), 0) AS P, CAST(count(*) AS DOUBLE) AS Q,
         round(sum(l_discount), 2) AS discount, round(sum(l_tax), 2) AS tax
  FROM lineitem GROUP BY 1, 2)"""


ORDERS = """panel AS (
  SELECT 'orders' AS sid, date_trunc('day', o_orderdate) AS ts,
         round(sum(o_totalprice), 2) AS P, CAST(count(*) AS DOUBLE) AS Q
  FROM orders GROUP BY 2)"""


def grid_of(cols=("P", "Q"), step="1 hour") -> str:
    return f"""grid AS (
  SELECT s.sid, s.ts, row_number() OVER (PARTITION BY s.sid ORDER BY s.ts) - 1 AS rn,
         {", ".join("p." + c for c in cols)}
  FROM (SELECT sid, unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts
        FROM panel GROUP BY sid) s
  LEFT JOIN panel p ON p.sid = s.sid AND p.ts = s.ts)"""


GRID = PANEL + ",\n" + grid_of()

UP = "(PARTITION BY sid ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DOWN = "(PARTITION BY sid ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def marks(cols=("P", "Q")) -> str:
    """Nearest valid value and its position on both sides."""
    cells = []
    for c in cols:
        cells += [
            f"last_value({c} IGNORE NULLS) OVER {UP} AS {c}_pv",
            f"last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER {UP} AS {c}_pr",
            f"first_value({c} IGNORE NULLS) OVER {DOWN} AS {c}_nv",
            f"first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER {DOWN} AS {c}_nr",
        ]
    return f"marks AS (SELECT *, {', '.join(cells)} FROM grid)"


def line(c: str, both: bool = False) -> str:
    tail = f", {c}_nv" if both else ""
    return (
        f"coalesce({c}, CASE WHEN {c}_nr > {c}_pr THEN {c}_pv + ({c}_nv - {c}_pv) *"
        f" ((rn - {c}_pr) / ({c}_nr - {c}_pr)) END, {c}_pv{tail})"
    )


def interpolated(cols=("P", "Q"), both=False, name="filled") -> str:
    cells = ", ".join(f"{line(c, both)} AS {c}" for c in cols)
    return f"{marks(cols)},\n{name} AS (SELECT sid, ts, rn, {cells} FROM marks)"


FILLED = GRID + ",\n" + interpolated()

# complete rows preceded by 24 complete rows
SAMPLES = FILLED + """,
flagged AS (
  SELECT *, count(P) OVER h = 25 AND count(Q) OVER h = 25 AS ok FROM filled
  WINDOW h AS (PARTITION BY sid ORDER BY rn ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)),
samples AS (
  SELECT sid, ts, P, Q, row_number() OVER (PARTITION BY sid ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY sid) AS n
  FROM flagged WHERE ok)"""


# ---- predictions -----------------------------------------------------------------------------


def baseline(
    by="sid", horizons=(1, 12, 24), tw=50, k=3, seasons=(24,), rule="wrapped", targets=("P", "Q"),
    naive=True, name="simple",
) -> str:
    """Baseline forecasts over ``samples(by..., ts, rn, n, P, Q)``."""
    keys = by.split(", ")
    on = " AND ".join(f"s.{c} = a.{c}" for c in keys)
    mine = ", ".join(f"a.{c}" for c in keys)
    if rule == "wrapped":
        source = "(((te - m + horizon - 1 + i) % te) + te) % te"
    else:
        raw = "(te - m + horizon - 1 + i)"
        back = f"(CASE WHEN {raw} >= te THEN {raw} - m * (({raw} - te) // m + 1) ELSE {raw} END)"
        source = f"CASE WHEN {back} < 0 THEN i % te ELSE {back} END"
    hs = ", ".join(map(str, horizons))
    parts = []
    for t in targets:
        if naive:
            parts.append(
                f"SELECT {mine}, 'Naive' AS model, CAST(NULL AS INTEGER) AS season, horizon, fold, a.ts,"
                f" '{t}' AS target, a.{t} AS y, s.{t} AS yhat"
                f" FROM asked a JOIN samples s ON {on} AND s.rn = te - 1"
            )
        parts.append(
            f"SELECT {mine}, 'SeasonalNaive', m, horizon, fold, a.ts, '{t}' AS target,"
            f" a.{t} AS y, s.{t} AS yhat"
            f" FROM (SELECT *, {source} AS src FROM asked,"
            f" (SELECT unnest([{', '.join(map(str, seasons))}]) AS m)) a"
            f" JOIN samples s ON {on} AND s.rn = src"
        )
    if not naive:
        parts[0] = parts[0].replace("'SeasonalNaive', m,", "'SeasonalNaive' AS model, m AS season,")
    return f"""asked AS (
  SELECT * FROM (
    SELECT s.*, h.horizon, CAST(f.fold AS INTEGER) AS fold,
           s.n - h.horizon - {tw * k} + f.fold * {tw} AS te,
           s.rn - h.horizon - (s.n - h.horizon - {tw * k} + f.fold * {tw}) AS i
    FROM samples s, (SELECT unnest([{hs}]) AS horizon) h, (SELECT unnest(range({k})) AS fold) f
    WHERE s.n - h.horizon >= {tw * (k + 1)})
  WHERE i >= 0 AND i < {tw}),
{name} AS ({" UNION ALL ".join(parts)})"""


LINEAR = """pairs AS (
  SELECT a.sid, h.horizon, CAST(f.fold AS INTEGER) AS fold, a.rn, b.ts, a.P AS x, b.P AS y,
         a.n - h.horizon - 150 + f.fold * 50 AS te
  FROM samples a, (SELECT unnest([1, 12, 24]) AS horizon) h, (SELECT unnest(range(3)) AS fold) f,
       samples b
  WHERE b.sid = a.sid AND b.rn = a.rn + h.horizon),
fits AS (
  SELECT sid, horizon, fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt
  FROM pairs WHERE rn < te GROUP BY ALL),
linear AS (
  SELECT p.sid, 'LinearLag' AS model, CAST(NULL AS INTEGER) AS season, p.horizon, p.fold, p.ts,
         'P' AS target, p.y, f.icpt + f.slope * p.x AS yhat
  FROM pairs p JOIN fits f USING (sid, horizon, fold) WHERE p.rn >= p.te AND p.rn < p.te + 50)"""

PREDICTED = f"""{SAMPLES},
{baseline()},
{LINEAR},
predicted AS (SELECT * FROM simple UNION ALL SELECT * FROM linear)"""


def scored(source: str, by: str, names=METRICS, digits=6, name="results") -> str:
    cells = ", ".join(f"{EXPR[m]} AS {m}" for m in names)
    return f"{name} AS (SELECT {by}, {cells} FROM {source} GROUP BY ALL)"


def show(source: str, keys: str, names=METRICS, digits=6) -> str:
    return f"SELECT {keys}, {', '.join(r(m, digits=digits) for m in names)} FROM {source}"


RESULTS = PREDICTED + ",\n" + scored("predicted", "model, horizon, fold, target")
AVERAGED = RESULTS + ",\n" + (
    "averaged AS (SELECT model, horizon, target, "
    + ", ".join(f"avg({m}) AS {m}" for m in METRICS)
    + " FROM results GROUP BY ALL)"
)
LONG = AVERAGED + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT model, horizon, target, '{m}' AS metric, {m} AS value FROM averaged" for m in METRICS
) + ")"
COST = "CASE WHEN metric LIKE 'ACC%' THEN -value ELSE value END"


# ---- imputation ------------------------------------------------------------------------------

PQ = ("P", "Q")


def seasonal_parts(cols=PQ) -> str:
    """Decomposition after filling from both sides; ``shape`` has one row per series and phase."""
    trend = ", ".join(
        f"CASE WHEN count({c}) OVER w = 25 THEN (sum({c}) OVER w"
        f" - (lag({c}, 12) OVER o + lead({c}, 12) OVER o) / 2) / 24 END AS {c}_trend"
        for c in cols
    )
    shape = ", ".join(f"avg({c} - {c}_trend) AS {c}_m" for c in cols)
    centred = ", ".join(f"{c}_m - avg({c}_m) OVER (PARTITION BY sid) AS {c}_seasonal" for c in cols)
    return f"""{interpolated(cols, both=True, name="bothfill")},
trended AS (
  SELECT *, {trend} FROM bothfill
  WINDOW o AS (PARTITION BY sid ORDER BY rn),
         w AS (PARTITION BY sid ORDER BY rn ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
shape AS (
  SELECT sid, phase, {centred}
  FROM (SELECT sid, rn % 24 AS phase, {shape} FROM trended GROUP BY ALL))"""


def method(name: str, cols=PQ) -> tuple[str, str]:
    """CTEs needed after ``grid`` and a SELECT of ``sid, ts, rn, cols...`` for one strategy."""
    pick = lambda f: ", ".join(f"{f(c)} AS {c}" for c in cols)
    if name == "forward":
        return marks(cols), f"SELECT sid, ts, rn, {pick(lambda c: f'{c}_pv')} FROM marks"
    if name == "backward":
        return marks(cols), f"SELECT sid, ts, rn, {pick(lambda c: f'{c}_nv')} FROM marks"
    if name == "interpolate":
        return marks(cols), f"SELECT sid, ts, rn, {pick(line)} FROM marks"
    if name in ("mean", "median"):
        fn = "avg" if name == "mean" else "median"
        cells = pick(lambda c: f"coalesce({c}, {fn}({c}) OVER (PARTITION BY sid))")
        return "", f"SELECT sid, ts, rn, {cells} FROM grid"
    if name == "day_copy":
        cells = pick(lambda c: f"coalesce(g.{c}, d.{c})")
        return "", (
            f"SELECT g.sid, g.ts, g.rn, {cells} FROM grid g"
            " LEFT JOIN grid d ON d.sid = g.sid AND d.ts = g.ts - INTERVAL 7 DAY"
        )
    if name == "nearest_p":
        full = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        cells = pick(lambda c: f"coalesce(g.{c}, d.{c})")
        donor = (
            f"donor AS (SELECT * FROM grid WHERE {full} QUALIFY"
            " row_number() OVER (PARTITION BY sid ORDER BY abs(P - 60), ts) = 1)"
        )
        return donor, f"SELECT g.sid, g.ts, g.rn, {cells} FROM grid g LEFT JOIN donor d USING (sid)"
    cells = pick(lambda c: f"coalesce(g.{c}, {c}_seasonal)")
    return seasonal_parts(cols), (
        f"SELECT g.sid, g.ts, g.rn, {cells} FROM grid g"
        " LEFT JOIN shape s ON s.sid = g.sid AND s.phase = g.rn % 24"
    )


STRATEGIES = (
    "forward", "backward", "interpolate", "mean", "median", "day_copy", "seasonal", "nearest_p",
)


def compare_sql(every: str, tw: int, season: int) -> str:
    """Scores per strategy beside the number of series that are too short."""
    keys = "strategy, model, horizon, fold, target"
    return f"""WITH {every},
samples AS (
  SELECT strategy, sid, ts, P, Q,
         row_number() OVER (PARTITION BY strategy, sid ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY strategy, sid) AS n
  FROM every WHERE P IS NOT NULL AND Q IS NOT NULL),
short AS (
  SELECT strategy, count(*) FILTER (WHERE n - 1 < {4 * tw}) AS skipped FROM (
    SELECT strategy, sid, count(*) FILTER (WHERE P IS NOT NULL AND Q IS NOT NULL) AS n
    FROM every GROUP BY strategy, sid) GROUP BY strategy),
{baseline(by="strategy, sid", horizons=(1,), tw=tw, seasons=(season,), targets=("P",))},
{scored("simple", keys)},
shown AS ({show("results", keys)})
SELECT * FROM short LEFT JOIN shown USING (strategy)"""


def with_cells(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c) + "\n"


def filled_sql(name: str) -> str:
    ctes, body = method(name)
    return with_cells(GRID, ctes) + f"SELECT sid, ts, {r('P')}, {r('Q')} FROM ({body})"


def every_strategy() -> str:
    """CTE ``every(strategy, sid, ts, rn, P, Q)``; shared helper CTEs come once."""
    ctes = [marks(), method("nearest_p")[0]]
    bothfill = seasonal_parts()
    ctes.append(bothfill[bothfill.index("bothfill AS") :])
    parts = [f"SELECT '{s}' AS strategy, * FROM ({method(s)[1]})" for s in STRATEGIES]
    return ",\n".join([GRID, *ctes, f"every AS ({' UNION ALL '.join(parts)})"])


def rolling_sql(stat: str) -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[stat]
    cells, frames = [], []
    for n in (6, 12, 24):
        frames.append(
            f"w{n} AS (PARTITION BY sid ORDER BY rn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        )
        for c in PQ:
            value = f"CASE WHEN count({c}) OVER w{n} = {n} THEN {fn}({c}) OVER w{n} END"
            cells.append(r(value, f"{c}_roll_{stat}_{n}"))
    return (
        f"WITH {FILLED} SELECT sid, ts, {', '.join(cells)} FROM filled WINDOW {', '.join(frames)}"
    )


CALENDAR = [
    (f"{name}_{fn}", f"{fn}(2 * pi() * {part} / {size})")
    for name, part, size in (
        ("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12),
    )
    for fn in ("sin", "cos")
]


def matrix_sql() -> str:
    cols = ("P", "Q", "discount", "tax")
    cells = [f"lag({c}, {k}) OVER o AS {c}_lag_{k}" for c in cols for k in range(1, 25)]
    for c in cols:
        for n in (6, 12, 24):
            for stat, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
                cells.append(
                    f"CASE WHEN count({c}) OVER w{n} = {n} THEN {fn}({c}) OVER w{n} END"
                    f" AS {c}_roll_{stat}_{n}"
                )
    names = [x.rsplit(" AS ", 1)[1] for x in cells]
    full = " AND ".join(f"{x} IS NOT NULL" for x in ["P", "Q", *names])
    shown = [r(x) for x in ["P", "Q", *names]]
    shown += [r(expr, name) for name, expr in CALENDAR]
    return f"""WITH {SHIP},
{grid_of(cols, "1 day")},
{interpolated(cols)},
wide AS (
  SELECT *, {", ".join(cells)} FROM filled
  WINDOW o AS (PARTITION BY sid ORDER BY rn),
         w6 AS (PARTITION BY sid ORDER BY rn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
         w12 AS (PARTITION BY sid ORDER BY rn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING),
         w24 AS (PARTITION BY sid ORDER BY rn ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT sid, ts, {", ".join(shown)} FROM wide WHERE {full}"""


FOLDS = SAMPLES + """,
folds AS (
  SELECT sid, CAST(f.fold AS INTEGER) AS fold, n - 150 + f.fold * 50 AS train_end,
         n - 150 + f.fold * 50 AS test_start, n - 100 + f.fold * 50 AS test_end
  FROM (SELECT DISTINCT sid, n FROM samples), (SELECT unnest(range(3)) AS fold) f),
assigned AS (
  SELECT s.sid, s.ts, s.rn, f.fold, CASE WHEN s.rn < train_end THEN 'train' ELSE 'test' END AS role
  FROM samples s JOIN folds f ON f.sid = s.sid AND s.rn < f.test_end)"""


def last_rows(length: int) -> str:
    return f"""recent AS (
  SELECT sid, max(ts) AS last_ts, list(P ORDER BY rn) AS p, list(Q ORDER BY rn) AS q
  FROM (SELECT *, count(*) OVER (PARTITION BY sid) AS n,
               row_number() OVER (PARTITION BY sid ORDER BY rn) AS pos FROM filled)
  WHERE pos > n - {length} GROUP BY sid HAVING count(*) = {length})"""


WALK = f"""{FILLED},
{last_rows(24)},
walk AS (
  SELECT sid, last_ts, 1 AS step, {exact("p[24]", 2)} AS yhat, list_avg(p) AS mu FROM recent
  UNION ALL
  SELECT sid, last_ts, step + 1, {exact("yhat * 0.7 + mu * 0.3", 2)}, mu FROM walk WHERE step < 72)"""

ROLL = f"""{FILLED},
{last_rows(6)},
roll AS (
  SELECT sid, last_ts, 0 AS step, p AS h, CAST(NULL AS DOUBLE) AS yhat, 2.0 + q[6] * 0.5 AS c
  FROM recent
  UNION ALL
  SELECT sid, last_ts, step + 1, list_append(h[2:6], v), v, c
  FROM (SELECT *, c + h[1] * 0.05 + h[2] * 0.05 + h[3] * 0.1 + h[4] * 0.1 + h[5] * 0.2
                    + h[6] * 0.3 AS v FROM roll WHERE step < 72))"""

SEARCH = SAMPLES + ",\n" + baseline(
    horizons=(1,), tw=100, k=1, seasons=(12, 24, 48, 168), rule="textbook", targets=("P",), naive=False
) + ",\n" + scored("simple", "sid, season", name="trials")


COMPLETE = """ranked AS (
  SELECT sid, ts, P, Q, row_number() OVER (PARTITION BY sid ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY sid) AS n
  FROM filled WHERE P IS NOT NULL AND Q IS NOT NULL)"""

PAIR_MODEL = """model AS (
  SELECT *, my - w1 * m1 - w2 * m2 AS bias FROM (
    SELECT *, (b1 * a2 - b2 * c) / (a1 * a2 - c * c) / s1 AS w1, (b2 * a1 - b1 * c) / (a1 * a2 - c * c) / s2 AS w2
    FROM (SELECT *, v1 / (s1 * s1) + reg AS a1, v2 / (s2 * s2) + reg AS a2, c12 / (s1 * s2) AS c,
                 c1 / s1 AS b1, c2 / s2 AS b2
          FROM (SELECT *, sqrt(v1) + 1e-8 AS s1, sqrt(v2) + 1e-8 AS s2 FROM moments))))"""


def pair_moments(keys: str, source: str, where: str, reg: float) -> str:
    """Means, variances and covariances of two inputs x1, x2 and y."""
    return f"""moments AS (
  SELECT {keys}, {reg} AS reg, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2,
         covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
  FROM {source} WHERE {where} GROUP BY ALL)"""


def two_inputs(strategy: str, reg: float = 0.0) -> str:
    """Least squares of P and Q, 1 and 12 rows ahead, on P and Q; two folds of 100."""
    ahead = "h.horizon" if strategy == "direct" else "12"
    return f"""{FILLED},
{COMPLETE},
sample AS (
  SELECT a.sid, a.ts, a.rn, h.horizon, t.target, a.P AS x1, a.Q AS x2,
         CASE t.target WHEN 'P' THEN b.P ELSE b.Q END AS y, a.n - {ahead} - 200 AS first
  FROM ranked a, (SELECT unnest([1, 12]) AS horizon) h, (SELECT unnest(['P', 'Q']) AS target) t, ranked b
  WHERE b.sid = a.sid AND b.rn = a.rn + h.horizon AND a.rn < a.n - {ahead}),
{pair_moments("sid, horizon, target, fold", "sample, (SELECT unnest(range(2)) AS fold) f", "rn < first + 100 * fold", reg)},
{PAIR_MODEL},
two AS (
  SELECT s.sid, CAST(s.horizon AS INTEGER) AS horizon, CAST(m.fold AS INTEGER) AS fold, s.target, s.ts, s.y,
         m.bias + m.w1 * s.x1 + m.w2 * s.x2 AS yhat, 'LinearWindow' AS model
  FROM sample s JOIN model m ON m.sid = s.sid AND m.horizon = s.horizon AND m.target = s.target
   AND s.rn >= s.first + 100 * m.fold AND s.rn < s.first + 100 * (m.fold + 1))"""


AR_TWO = f"""{FILLED},
{COMPLETE},
sample AS (
  SELECT a.sid, a.rn, a.P AS x1, b.P AS x2, c.P AS y, a.n - 2 - 100 AS first
  FROM ranked a JOIN ranked b ON b.sid = a.sid AND b.rn = a.rn - 1
  JOIN ranked c ON c.sid = a.sid AND c.rn = a.rn + 1),
{pair_moments("sid", "sample", "rn - 1 < first", 0.0)},
{PAIR_MODEL},
two AS (
  SELECT s.sid, 2 AS lag, y, bias + w1 * x1 + w2 * x2 AS yhat FROM sample s JOIN model USING (sid) WHERE rn - 1 >= first
  UNION ALL
  SELECT s.sid, 1, y, my + c1 / v1 * (x1 - m1) FROM sample s JOIN model USING (sid) WHERE rn - 1 >= first)"""

LAGS = ("P_lag_1", "P_lag_2", "Q_lag_1", "Q_lag_2")
_LAGGED = ", ".join(f"lag({c}, {i}) OVER o AS {c}_lag_{i}" for c in ("P", "Q") for i in (1, 2))
_FEATURES = " UNION ALL ".join(f"SELECT *, {i} AS feature, {c} AS x FROM cell" for i, c in enumerate(LAGS))

STUMPS = f"""{FILLED},
lagged AS (SELECT *, {_LAGGED} FROM filled WINDOW o AS (PARTITION BY sid ORDER BY rn)),
samples AS (
  SELECT sid, ts, P, Q, {", ".join(LAGS)}, row_number() OVER (PARTITION BY sid ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY sid) AS n
  FROM lagged WHERE P IS NOT NULL AND Q IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in LAGS)}),
cell AS (
  SELECT a.sid, a.ts, a.rn, {", ".join("a." + c for c in LAGS)}, h.horizon, t.target,
         CASE t.target WHEN 'P' THEN b.P ELSE b.Q END AS y, a.n - h.horizon - 200 AS first
  FROM samples a, (SELECT unnest([1, 12]) AS horizon) h, (SELECT unnest(['P', 'Q']) AS target) t, samples b
  WHERE b.sid = a.sid AND b.rn = a.rn + h.horizon),
long AS ({_FEATURES}),
each AS (
  SELECT fold, horizon, target, feature, x, count(*) AS c, sum(y) AS s
  FROM long, (SELECT unnest(range(2)) AS fold) f WHERE rn < first + 100 * fold GROUP BY ALL),
running AS (
  SELECT *, sum(c) OVER w AS nl, sum(s) OVER w AS sl, lead(x) OVER o AS above,
         sum(c) OVER a AS nt, sum(s) OVER a AS st FROM each
  WINDOW o AS (PARTITION BY fold, horizon, target, feature ORDER BY x),
         w AS (PARTITION BY fold, horizon, target, feature ORDER BY x ROWS UNBOUNDED PRECEDING),
         a AS (PARTITION BY fold, horizon, target, feature)),
split AS (
  SELECT *, (x + above) / 2 AS threshold FROM running WHERE above IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY fold, horizon, target
    ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, feature) = 1),
stumps AS (
  SELECT m.model, l.sid, CAST(l.horizon AS INTEGER) AS horizon, CAST(p.fold AS INTEGER) AS fold, l.target, l.ts, l.y,
         CASE WHEN l.x <= p.threshold THEN sl / nl ELSE (st - sl) / (nt - nl) END AS yhat
  FROM long l JOIN split p ON p.horizon = l.horizon AND p.target = l.target AND p.feature = l.feature
   AND l.rn >= l.first + 100 * p.fold AND l.rn < l.first + 100 * (p.fold + 1),
   (SELECT unnest(['RandomForest', 'GradientBoosting']) AS model) m)"""

ISLANDS = f"""{GRID},
marked AS (
  SELECT sid, ts, P, Q, rn - row_number() OVER (PARTITION BY sid ORDER BY rn) AS island
  FROM grid WHERE P IS NOT NULL AND Q IS NOT NULL),
samples AS (
  SELECT *, row_number() OVER (PARTITION BY sid, island ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY sid, island) AS n FROM marked)"""


def mirrored(index: str, base: int) -> str:
    """Radical inverse of an index below 2**31."""
    digits = 1
    while base**digits < 1 << 31:
        digits += 1
    terms = [f"({index} // {base**k}) % {base} * {base ** (digits - 1 - k)}" for k in range(digits)]
    return f"(({' + '.join(terms)}) / {base**digits}.0::DOUBLE)"


USERS_FILLED = f"{USERS}, {grid_of(step='1 day')}, {interpolated()}"

USER_ROLL = f"""{USERS_FILLED},
{COMPLETE},
sample AS (
  SELECT a.sid, a.P AS x1, a.Q AS x2, b.P AS y FROM ranked a JOIN ranked b ON b.sid = a.sid AND b.rn = a.rn + 1
  WHERE a.n - 1 >= 20),
{pair_moments("sid", "sample", "TRUE", 1e-3)},
{PAIR_MODEL},
roll AS (
  SELECT r.sid, r.ts AS last_ts, 0 AS step, P AS value, Q AS q, bias, w1, w2
  FROM ranked r LEFT JOIN model m ON m.sid = r.sid WHERE r.rn = r.n - 1
  UNION ALL
  SELECT sid, last_ts, step + 1, bias + w1 * value + w2 * q, q, bias, w1, w2 FROM roll WHERE step < 72)"""

USER_RANGE = f"""{USERS_FILLED},
{last_rows(6)},
walk AS (
  SELECT sid, last_ts, 1 AS step, {exact("p[6]", 2)} AS yhat, list_avg(p) AS mu,
         date_diff('day', last_ts, TIMESTAMP '2024-03-08') - 1 AS steps FROM recent
  UNION ALL
  SELECT sid, last_ts, step + 1, {exact("yhat * 0.7 + mu * 0.3", 2)}, mu, steps FROM walk WHERE step < steps)"""

FOREST_ROLL = f"""{FILLED},
{last_rows(25)},
roll AS (
  SELECT sid, last_ts, 0 AS step, p AS h, q, CAST(NULL AS DOUBLE) AS yhat FROM recent
  UNION ALL
  SELECT sid, last_ts, step + 1, list_append(h[2:25], v), list_append(q[2:25], q[25]), v
  FROM (SELECT *, (CASE WHEN h[24] <= 60 THEN CASE WHEN list_avg(h[19:24]) <= 55 THEN 51.5 ELSE 57 END
                        ELSE CASE WHEN h[1] <= 65 THEN 62 ELSE 71.5 END END
                 + CASE WHEN q[24] <= 3 THEN 48.5
                        WHEN sin(2 * pi() * hour(last_ts + to_hours(step)) / 24) <= 0.1 THEN 66 ELSE 58.5 END
                  ) / 2.0 AS v FROM roll WHERE step < 72))"""


def all_sql() -> dict[str, str]:
    sql = {
        "scan_panel": f"WITH {SHIP} SELECT sid, ts, {', '.join(r(c, digits=3) for c in ('P', 'Q', 'discount', 'tax'))} FROM panel",
        "scan_glob": "SELECT 'events.parquet' AS sid, event_type, count(*) AS rows,"
        " round(sum(value), 2) AS P FROM events GROUP BY ALL",
        "detect_columns": "SELECT event_type AS sid, ts, value AS P, CAST(user_id AS DOUBLE) AS Q FROM events",
        "project_rename": "SELECT l_returnflag AS sid, l_shipdate AS ts, l_extendedprice AS P,"
        " l_quantity AS Q, l_discount, l_tax FROM lineitem",
        "parse_time": """SELECT o_orderstatus, count(*) AS rows, count(*) - count(ts) AS rejected,
          min(ts) AS first_ts, max(ts) AS last_ts
        FROM (SELECT o_orderstatus, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN '2024-13-01'
                ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS ts FROM orders)
        GROUP BY ALL""",
        "tz_localize": "SELECT event_id, ts, (ts AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC'"
        " AS ts_utc FROM events",
        "coerce_numeric": """SELECT o_orderpriority,
          count(*) - count(TRY_CAST(o_orderpriority AS DOUBLE)) AS bad_nulls,
          round(sum(TRY_CAST(o_orderpriority[1:1] AS DOUBLE)), 2) AS level_sum,
          round(sum(o_totalprice), 2) AS price_sum FROM orders GROUP BY ALL""",
        "sort_time": "SELECT event_type AS sid, ts, event_id FROM events ORDER BY 1, 2",
        "gen_panel": f"""SELECT sid, ts, {r("P")}, {r("50 + 0.4 * (P - 100)", "Q")} FROM (
          SELECT sid, ts, greatest(0, 100 + 30 * sin(2 * pi() * hour(ts) / 24)
                 - CASE WHEN isodow(ts) >= 6 THEN 10 ELSE 0 END) AS P
          FROM (SELECT CAST(c_custkey AS VARCHAR) AS sid,
                       unnest(generate_series(TIMESTAMP '2023-01-01 00:00:00',
                         TIMESTAMP '2023-01-30 23:00:00', INTERVAL 1 HOUR)) AS ts FROM customer))""",
        "grid_asfreq": f"WITH {GRID} SELECT sid, ts, P, Q FROM grid",
        "grid_users": f"WITH {USERS}, {grid_of(step='1 day')} SELECT sid, ts, P, Q FROM grid",
        "coverage": f"""WITH {PANEL} SELECT sid, min(ts) AS first_ts, max(ts) AS last_ts,
          date_diff('hour', min(ts), max(ts)) + 1 AS expected, count(*) AS found,
          date_diff('hour', min(ts), max(ts)) + 1 - count(*) AS missing FROM panel GROUP BY sid""",
        "gap_list": f"""WITH {PANEL}, g AS (
          SELECT sid, lag(ts) OVER (PARTITION BY sid ORDER BY ts) AS gap_start, ts AS gap_end FROM panel),
        big AS (SELECT *, date_diff('second', gap_start, gap_end) AS gap_seconds FROM g
                WHERE date_diff('second', gap_start, gap_end) > 3600)
        SELECT sid, count(*) OVER s AS n_gaps, max(gap_seconds) OVER s AS max_gap_seconds,
               row_number() OVER (PARTITION BY sid ORDER BY gap_end) AS gap_no, gap_start, gap_end,
               gap_seconds
        FROM big WINDOW s AS (PARTITION BY sid) QUALIFY gap_no <= 5""",
        "null_counts": f"WITH {GRID} SELECT sid, count(*) AS rows, count(*) - count(P) AS P_nulls,"
        " count(*) - count(Q) AS Q_nulls FROM grid GROUP BY sid",
        "missing_map": f"WITH {GRID} SELECT sid, ts, 'P' AS \"column\", CAST(P IS NULL AS INTEGER) AS"
        " is_missing FROM grid UNION ALL SELECT sid, ts, 'Q', CAST(Q IS NULL AS INTEGER) FROM grid",
        "nonfinite_counts": """SELECT sid, count(*) FILTER (isnan(P)) AS P_nan,
          count(*) FILTER (isnan(Q)) AS Q_nan, count(*) FILTER (isinf(P)) AS P_inf,
          count(*) FILTER (isinf(Q)) AS Q_inf
        FROM (SELECT l_returnflag AS sid,
                CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE l_discount / nullif(l_tax, 0) END AS P,
                CASE WHEN l_discount = 0 THEN 'nan'::DOUBLE ELSE l_tax END AS Q FROM lineitem)
        GROUP BY sid""",
    }
    sql["impute_diff"] = f"WITH {FILLED}, cells AS (" + " UNION ALL ".join(
        f"SELECT g.sid, '{c}' AS \"column\", g.{c} AS raw, f.{c} AS val"
        " FROM grid g JOIN filled f USING (sid, ts)"
        for c in PQ
    ) + ') SELECT sid, "column", count(*) - count(raw) AS was_null, ' + ", ".join(
        r(f"{fn}({side})", f"{when}_{name}")
        for when, side in (("before", "raw"), ("after", "val"))
        for name, fn in (("min", "min"), ("mean", "avg"), ("max", "max"))
    ) + " FROM cells GROUP BY ALL"
    sql["impute_count"] = f"""WITH {every_strategy()}
SELECT strategy, e.sid, count(*) FILTER (g.P IS NULL AND e.P IS NOT NULL) AS P_filled,
       count(*) FILTER (g.Q IS NULL AND e.Q IS NOT NULL) AS Q_filled,
       count(*) FILTER ((g.P IS NULL AND e.P IS NOT NULL) OR (g.Q IS NULL AND e.Q IS NOT NULL))
         AS rows_filled
FROM every e JOIN grid g ON g.sid = e.sid AND g.ts = e.ts GROUP BY ALL"""
    for s in STRATEGIES:
        sql[f"impute_{s}"] = filled_sql(s)
    sql["impute_interpolate_both"] = (
        f"WITH {GRID}, {interpolated(both=True)} SELECT sid, ts, {r('P')}, {r('Q')} FROM filled"
    )
    level = ", ".join(
        r(f"coalesce(g.{c}, t.{c}_trend + s.{c}_seasonal, t.{c})", c) for c in PQ
    )
    sql["impute_seasonal_level"] = f"""WITH {GRID}, {seasonal_parts()}
SELECT g.sid, g.ts, {level} FROM grid g JOIN trended t USING (sid, ts)
LEFT JOIN shape s ON s.sid = g.sid AND s.phase = g.rn % 24"""
    sql["seasonal_decompose"] = f"""WITH {GRID}, {seasonal_parts(("P",))}
SELECT t.sid, t.ts, {r("P_trend", "trend", 7)}, {r("P_seasonal", "seasonal", 7)},
       {r("P - P_trend - P_seasonal", "resid", 7)}
FROM trended t LEFT JOIN shape s ON s.sid = t.sid AND s.phase = t.rn % 24"""
    sql["impute_users"] = (
        f"WITH {USERS}, {grid_of(step='1 day')}, {interpolated()}"
        f" SELECT sid, ts, {r('P')}, {r('Q')} FROM filled"
    )
    sql["strategy_compare"] = compare_sql(every_strategy(), 50, 24)
    two = f"""{USERS}, {grid_of(step='1 day')}, {method("interpolate")[0]}, every AS (
  SELECT 'forward' AS strategy, * FROM ({method("forward")[1]})
  UNION ALL SELECT 'interpolate', * FROM ({method("interpolate")[1]}))"""
    sql["strategy_compare_users"] = compare_sql(two, 5, 7)
    for name in STRATEGIES:
        ctes, body = method(name)
        sql[f"impute_{name}_orders"] = (
            with_cells(ORDERS, grid_of(step="1 day"), ctes)
            + f"SELECT sid, ts, {r('P')}, {r('Q')} FROM ({body})"
        )
    sql["grid_raw"] = f"""WITH panel AS (
  SELECT event_type AS sid, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS P
  FROM events GROUP BY 1, 2), {grid_of(("P",))} SELECT sid, ts, {r("P")} FROM grid"""

    lags = [f"lag({c}, {k}) OVER o AS {c}_lag_{k}" for c in PQ for k in range(1, 25)]
    sql["lag_features"] = (
        f"WITH {GRID} SELECT sid, ts, P, Q, {', '.join(lags)} FROM grid"
        " WINDOW o AS (PARTITION BY sid ORDER BY rn)"
    )
    for stat in ("mean", "std", "min", "max"):
        sql[f"rolling_{stat}"] = rolling_sql(stat)
    sql["calendar_features"] = (
        f"WITH {GRID} SELECT sid, ts, {', '.join(r(e, n) for n, e in CALENDAR)} FROM grid"
    )
    sql["feature_matrix"] = matrix_sql()
    sql["sequence_windows"] = f"""WITH {FILLED}, ranked AS (
  SELECT sid, ts, P, Q, row_number() OVER (PARTITION BY sid ORDER BY ts) - 1 AS rn
  FROM filled WHERE P IS NOT NULL AND Q IS NOT NULL)
SELECT a.sid, a.ts, CAST(st.step AS INTEGER) AS step, {r("x.P", "P")}, {r("x.Q", "Q")}, {r("t.P", "y")}
FROM ranked a, (SELECT unnest(range(24)) AS step) st, ranked x, ranked t
WHERE x.sid = a.sid AND x.rn = a.rn - 23 + st.step AND a.rn >= 23 AND t.sid = a.sid AND t.rn = a.rn + 2"""
    sql["horizon_target"] = f"""WITH {SAMPLES} SELECT a.sid, a.ts, {r("a.P", "P")},
  {r("b.P", "P_h12")}, {r("b.Q", "Q_h12")}
FROM samples a JOIN samples b ON b.sid = a.sid AND b.rn = a.rn + 12"""
    sql["multi_horizon_targets"] = f"""WITH {SAMPLES} SELECT a.sid, a.ts, {r("b.P", "P_h1")},
  {r("c.P", "P_h12")}, {r("d.P", "P_h24")} FROM samples a
JOIN samples b ON b.sid = a.sid AND b.rn = a.rn + 1 JOIN samples c ON c.sid = a.sid AND c.rn = a.rn + 12
JOIN samples d ON d.sid = a.sid AND d.rn = a.rn + 24"""
    sql["sequence_standardize"] = f"""WITH {FILLED}, ranked AS (
  SELECT sid, ts, P, Q, row_number() OVER (PARTITION BY sid ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY sid) AS n
  FROM filled WHERE P IS NOT NULL AND Q IS NOT NULL),
cells AS (
  SELECT x.sid, x.P, x.Q FROM ranked x, (SELECT unnest(range(24)) AS back) b
  WHERE x.rn - b.back >= 0 AND x.rn - b.back < x.n - 24 - 150),
scaler AS (
  SELECT sid, avg(P) AS mp, stddev_pop(P) + 1e-8 AS dp, avg(Q) AS mq, stddev_pop(Q) + 1e-8 AS dq
  FROM cells GROUP BY sid)
SELECT sid, ts, {r("(P - mp) / dp", "P")}, {r("(Q - mq) / dq", "Q")} FROM ranked JOIN scaler USING (sid)"""
    sql["rolling_origin_folds"] = f"WITH {FOLDS} SELECT * FROM folds"
    sql["fold_assignment"] = f"WITH {FOLDS} SELECT sid, ts, rn, fold, role FROM assigned"
    sql["leak_check"] = f"""WITH {FOLDS}, edges AS (
  SELECT sid, fold, max(ts) FILTER (role = 'train') AS train_last,
         min(ts) FILTER (role = 'test') AS test_first FROM assigned GROUP BY ALL)
SELECT *, train_last < test_first AS in_order FROM edges"""

    for m in ("rmse", "mae", "smape", "wape", "acc"):
        by = "sid, model, horizon, target"
        sql[f"metric_{m}"] = (
            f"WITH {PREDICTED}, {scored('predicted', by, [m.upper()])} {show('results', by, [m.upper()])}"
        )
    full = "sid, model, horizon, fold, target"
    sql["eval_metrics"] = f"WITH {PREDICTED}, {scored('predicted', full)} {show('results', full)}"
    sql["eval_baselines"] = (
        f"WITH {SAMPLES}, {baseline()}, {scored('simple', full)} {show('results', full)}"
    )
    sql["eval_baselines_textbook"] = (
        f"WITH {SAMPLES}, {baseline(rule='textbook', targets=('P',))}, {scored('simple', full)}"
        f" {show('results', full)}"
    )
    sql["ar1_direct"] = (
        f"WITH {SAMPLES}, {LINEAR} SELECT sid, horizon, fold, ts, {r('y')}, {r('yhat')} FROM linear"
    )
    ranked = f"""WITH {FILLED}, ranked AS (
  SELECT sid, ts, P, row_number() OVER (PARTITION BY sid ORDER BY rn) - 1 AS rn,
         count(*) OVER (PARTITION BY sid) AS n FROM filled)"""
    sql["naive_forecast"] = (
        f"{ranked} SELECT sid, CAST(unnest(range(1, 25)) AS INTEGER) AS step, {r('P', 'P_hat')}"
        " FROM ranked WHERE rn = n - 1"
    )
    for key, source in (
        ("seasonal_naive", "n - 24 + (step - 1) % 24"),
        ("seasonal_naive_wrapped", "(n - 24 + step - 1) % n"),
    ):
        sql[key] = f"""{ranked}, ask AS (
  SELECT sid, n, CAST(unnest(range(1, 73)) AS INTEGER) AS step FROM (SELECT DISTINCT sid, n FROM ranked))
SELECT a.sid, a.step, {r("s.P", "P_hat")} FROM ask a JOIN ranked s ON s.sid = a.sid AND s.rn = {source.replace("n", "a.n")}"""
    sql["forecast_spine"] = f"""WITH {GRID} SELECT sid, step, last_ts + to_hours(step) AS ts
FROM (SELECT sid, max(ts) AS last_ts, CAST(unnest(range(1, 73)) AS INTEGER) AS step FROM grid GROUP BY sid)"""
    sql["recursive_linear"] = (
        f"WITH RECURSIVE {ROLL} SELECT sid, step, last_ts + to_hours(step) AS ts,"
        f" {r('yhat', digits=2)} FROM roll WHERE step > 0"
    )
    walk = "SELECT sid, step, last_ts + to_hours(step) AS ts, yhat FROM walk"
    sql["mean_reverting"] = f"WITH RECURSIVE {WALK} {walk}"
    sql["write_forecast"] = sql["mean_reverting"]
    sql["forecast_range"] = f"""WITH RECURSIVE {WALK.replace("step < 72", "step < 400")}
SELECT sid, date_diff('hour', last_ts, TIMESTAMP '2024-02-01') - 1 AS gap, step,
       last_ts + to_hours(step) AS ts, yhat FROM walk
WHERE last_ts + to_hours(step) >= TIMESTAMP '2024-02-01' AND last_ts + to_hours(step) < TIMESTAMP '2024-02-03'"""
    sql["forecast_summary"] = f"""WITH RECURSIVE {WALK} SELECT sid, min(ts) AS first_ts,
  max(ts) AS last_ts, count(yhat) AS n, {r("avg(yhat)", "mean")}, {r("median(yhat)", "median")},
  {r("stddev_samp(yhat)", "std")}, {r("min(yhat)", "min")}, {r("max(yhat)", "max")}
FROM ({walk}) GROUP BY sid"""
    sql["head_tail"] = f"""{ranked.replace("FROM filled)", "FROM filled WHERE P IS NOT NULL AND Q IS NOT NULL)")}
SELECT sid, strftime(ts, '%Y-%m-%d %H:%M') AS time, {r("P", "value", 2)}
FROM ranked WHERE n <= 100 OR rn < 50 OR rn >= n - 50"""

    keys = "model, horizon, fold, target"
    sql["metrics_roundtrip"] = (
        f"WITH {RESULTS} {show('results', keys).replace(keys, keys + ', ' + chr(39) + 'interpolate' + chr(39) + ' AS strategy', 1)}"
    )
    sql["metrics_agg"] = f"WITH {AVERAGED} {show('averaged', 'model, horizon, target')}"
    sql["metrics_pivot"] = f"WITH {AVERAGED} SELECT model, " + ", ".join(
        r(f"max(RMSE) FILTER (horizon = {h})", f"h{h}") for h in (1, 12, 24)
    ) + " FROM averaged WHERE target = 'P' GROUP BY model"
    sql["best_per_horizon"] = f"""WITH {LONG} SELECT target, metric, horizon, model,
  printf('%.4f', value) AS shown FROM long
QUALIFY rank() OVER (PARTITION BY target, metric, horizon ORDER BY {COST}) = 1"""
    sql["best_model"] = f"""WITH {AVERAGED}, overall AS (
  SELECT target, model, avg(RMSE) AS value FROM averaged GROUP BY ALL)
SELECT target, 'all' AS horizon, model, {r("value")} FROM overall
QUALIFY row_number() OVER (PARTITION BY target ORDER BY value, model) = 1
UNION ALL (SELECT target, CAST(horizon AS VARCHAR), model, {r("RMSE", "value")} FROM averaged
QUALIFY row_number() OVER (PARTITION BY target, horizon ORDER BY RMSE, model) = 1)"""
    order = "list_position(['" + "', '".join(METRICS) + "'], metric)"
    sql["recommend_model"] = f"""WITH {LONG}, means AS (
  SELECT target, metric, model, avg(value) AS value FROM long GROUP BY ALL),
winners AS (SELECT *, {order} AS place FROM means
  QUALIFY row_number() OVER (PARTITION BY target, metric ORDER BY {COST}, model) = 1),
votes AS (SELECT target, model, count(*) AS votes, min(place) AS place FROM winners GROUP BY ALL)
SELECT target, model, votes FROM votes
QUALIFY row_number() OVER (PARTITION BY target ORDER BY votes DESC, place) = 1"""
    sql["error_by_horizon"] = f"WITH {AVERAGED} {show('averaged', 'target, model, horizon', ['RMSE'])}"
    sql["metrics_long"] = f"WITH {LONG} SELECT model, horizon, target, metric, {r('value')} FROM long"
    sql["pred_vs_actual"] = f"""WITH {PREDICTED} SELECT sid, model, horizon, fold, ts, target, {r("y")},
  {r("yhat")}, {r("yhat - y", "error")},
  {r("CASE WHEN abs(y) > 1e-8 THEN abs(yhat - y) / abs(y) END", "rel_error")} FROM predicted"""
    sql["distinct_models"] = f"WITH {RESULTS} SELECT DISTINCT target, model FROM results"
    sql["model_metadata"] = (
        f"WITH {RESULTS} SELECT model, {r('avg(RMSE)', 'avg_rmse')}, {r('avg(MAE)', 'avg_mae')}"
        " FROM results GROUP BY model"
    )
    sql["skill_vs_naive"] = f"""WITH {AVERAGED} SELECT a.target, a.horizon, a.model, {r("a.RMSE", "value")},
  {r("1 - a.RMSE / n.RMSE", "skill")} FROM averaged a
JOIN averaged n ON n.model = 'Naive' AND n.target = a.target AND n.horizon = a.horizon"""

    for strategy in ("direct", "multi_output"):
        sql[f"seq_{strategy}_two"] = (
            f"WITH {two_inputs(strategy)} SELECT sid, horizon, fold, target, ts, {r('y')}, {r('yhat')} FROM two"
        )
    by = "sid, model, horizon, fold, target"
    sql["model_reload_eval"] = f"WITH {two_inputs('direct')}, {scored('two', by)} {show('results', by)}"
    sql["fold_scalers"] = f"""WITH {FILLED}, {COMPLETE},
cells AS (
  SELECT x.sid, f.fold, x.P, x.Q
  FROM ranked x, (SELECT unnest(range(24)) AS back) b, (SELECT unnest(range(3)) AS fold) f
  WHERE x.rn - b.back >= 0 AND x.rn - b.back < x.n - 24 - 150 + 50 * f.fold)
SELECT sid, 1 AS horizon, CAST(fold AS INTEGER) AS fold, {r("avg(P)", "P_mean")}, {r("stddev_pop(P) + 1e-8", "P_std")},
       {r("avg(Q)", "Q_mean")}, {r("stddev_pop(Q) + 1e-8", "Q_std")} FROM cells GROUP BY sid, fold"""
    sql["search_ar_lags_two"] = f"WITH {AR_TWO}, {scored('two', 'sid, lag')} {show('results', 'sid, lag')}"
    sql["recursive_models"] = f"""WITH RECURSIVE {USER_ROLL}
SELECT sid, step, last_ts + to_days(step) AS ts, {r("value", "yhat", 2)} FROM roll WHERE step > 0"""
    sql["forecast_range_users"] = f"""WITH RECURSIVE {USER_RANGE}
SELECT sid, date_diff('day', last_ts, TIMESTAMP '2024-03-01') - 1 AS gap, step, last_ts + to_days(step) AS ts, yhat
FROM walk WHERE last_ts + to_days(step) >= TIMESTAMP '2024-03-01'"""
    sql["recursive_forest"] = f"""WITH RECURSIVE {FOREST_ROLL}
SELECT sid, step, last_ts + to_hours(step) AS ts, {r("yhat", digits=2)} FROM roll WHERE step > 0"""

    sql["sequence_windows_time"] = f"""WITH {ISLANDS}
SELECT a.sid, a.ts, CAST(st.step AS INTEGER) AS step, {r("x.P", "P")}, {r("x.Q", "Q")}, {r("t.P", "y")}
FROM samples a, (SELECT unnest(range(6)) AS step) st, samples x, samples t
WHERE x.sid = a.sid AND x.island = a.island AND x.rn = a.rn - 5 + st.step AND a.rn >= 5
  AND t.sid = a.sid AND t.island = a.island AND t.rn = a.rn + 2"""
    sql["baselines_time"] = (
        f"WITH {ISLANDS}, {baseline(by='sid, island', horizons=(1,), tw=3, k=2, seasons=(4,), targets=('P',))},"
        f" {scored('simple', full)} {show('results', full)}"
    )
    sql["stump_forecast"] = f"""WITH {STUMPS}
SELECT sid, ts, model, horizon, fold, target, {r("y")}, {r("yhat")} FROM stumps"""
    sql["eval_stumps"] = f"""WITH {STUMPS},
shown AS (SELECT model, horizon, fold, target, {r("y")}, {r("yhat")} FROM stumps),
{scored("shown", "model, horizon, fold, target")} {show("results", "model, horizon, fold, target")}"""
    two = f"""{GRID}, {method("interpolate")[0]}, every AS (
  SELECT 'forward' AS strategy, * FROM ({method("forward")[1]})
  UNION ALL SELECT 'interpolate', * FROM ({method("interpolate")[1]}))"""
    keys = "strategy, model, horizon, fold, target"
    sql["strategy_run"] = f"""WITH {two},
samples AS (
  SELECT strategy, sid, ts, P, Q, row_number() OVER (PARTITION BY strategy, sid ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY strategy, sid) AS n FROM every WHERE P IS NOT NULL AND Q IS NOT NULL),
{baseline(by="strategy, sid", horizons=(1,), targets=("P",))}, {scored("simple", keys)},
shown AS ({show("results", keys)}),
status AS (SELECT * FROM (VALUES ('forward', 'done', 1), ('interpolate', 'done', 1), ('spline', 'failed', 2)) v(strategy, state, attempts))
SELECT strategy, state, CAST(attempts AS INTEGER) AS attempts, coalesce(rows, 0) AS rows,
       coalesce(model, '') AS model, coalesce(horizon, -1) AS horizon, coalesce(fold, -1) AS fold,
       coalesce(target, '') AS target, shown.* EXCLUDE (strategy, model, horizon, fold, target)
FROM status LEFT JOIN (SELECT strategy, count(*) AS rows FROM shown GROUP BY 1) USING (strategy)
LEFT JOIN shown USING (strategy)"""
    u = {base: mirrored("i", base) for base in (2, 3, 5, 7)}
    sql["search_space_random"] = f"""WITH points AS (
  SELECT i, [64, 128, 192, 256, 320][CAST(floor({u[2]} * 5) AS INTEGER) + 1] AS d_model,
         [4, 8, 12, 16][CAST(floor({u[3]} * 4) AS INTEGER) + 1] AS nhead,
         exp(ln(1e-5) + {u[5]} * (ln(1e-3) - ln(1e-5))) AS learning_rate, 0.05 + {u[7]} * (0.3 - 0.05) AS dropout
  FROM (SELECT unnest(range(1, 401)) AS i)),
accepted AS (SELECT *, CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS trial FROM points WHERE d_model % nhead = 0)
SELECT sid, trial, d_model, nhead, {r("learning_rate", digits=8)}, {r("dropout", digits=8)}
FROM (SELECT DISTINCT event_type AS sid FROM events), accepted WHERE trial < 50"""

    sql["search_space"] = """SELECT sid, d_model, nhead
FROM (SELECT DISTINCT event_type AS sid FROM events),
     (SELECT unnest([64, 128, 192, 256, 320]) AS d_model), (SELECT unnest([4, 8, 12, 16]) AS nhead)
WHERE d_model % nhead = 0"""
    sql["search_seasonal_length"] = f"WITH {SEARCH} {show('trials', 'sid, season')}"
    sql["best_trial"] = f"""WITH {SEARCH}, ordered AS (
  SELECT *, count(*) OVER (PARTITION BY sid) AS trials FROM trials)
SELECT sid, trials, season, {r("ACC_10", "score")}, ACC_10 >= 80 AS passed FROM ordered
QUALIFY row_number() OVER (PARTITION BY sid ORDER BY ACC_10 DESC, season) = 1"""
    return sql
