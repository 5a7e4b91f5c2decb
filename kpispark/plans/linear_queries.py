"""Registered queries of the least-squares operators (M8, M10, M16-M18) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import round_half_up, round_stat
from ..operators import features, linear, metrics
from ..operators.profile import info_frame
from ..session import cut_lineage
from ..sources.testtables import read_table, sales_fact
from . import sql as Q
from .catalog import HOLDOUT_CUT, KEYS, SCAFFOLD_HORIZON, _profile_sql, register

LAG = f"{S.REVENUE}_lag1"
FOLDS = 5


def _sums_sql(x: tuple[str, ...], ys: tuple[str, ...], where: str = "TRUE") -> str:
    """Aggregates n, s*, q* of ``operators.linear`` over columns, as doubles."""
    names = [Q.D(c) for c in (*x, *ys)]
    k = len(x)
    parts = [f"CAST(COUNT(*) FILTER ({where}) AS DOUBLE) AS n"] + [f"SUM({c}) FILTER ({where}) AS s{i}" for i, c in enumerate(names)]
    parts += [f"SUM({a} * {names[j]}) FILTER ({where}) AS q{i}_{j}" for i, a in enumerate(names)
              for j in range(i, len(names)) if i < k or i == j]
    return ", ".join(parts)


def _m(i: int, j: int) -> str:
    return f"(q{min(i, j)}_{max(i, j)} - s{i} * s{j} / n)"


def _solve2_sql(y: int, alpha: float = 0.0) -> dict[str, str]:
    """Weights of two features for the y-th column: pivots in order, spent ones skipped."""
    a, b, c = f"({_m(0, 0)} + {alpha!r})", f"({_m(1, 1)} + {alpha!r})", _m(0, 1)
    ok0 = f"({a} > 1e-10 * q0_0)"
    rest = f"(CASE WHEN {ok0} THEN {b} - {c} * {c} / {a} ELSE {b} END)"
    ok1 = f"({rest} > 1e-10 * q1_1)"
    w1 = f"(CASE WHEN {ok1} THEN (CASE WHEN {ok0} THEN {_m(1, y)} - {c} * {_m(0, y)} / {a} ELSE {_m(1, y)} END) / {rest} ELSE 0.0 END)"
    w0 = f"(CASE WHEN {ok0} THEN ({_m(0, y)} - {c} * {w1}) / {a} ELSE 0.0 END)"
    return {"w0": w0, "w1": w1, "rank": f"(CASE WHEN {ok0} THEN 1 ELSE 0 END + CASE WHEN {ok1} THEN 1 ELSE 0 END)"}


def _models_sql(keys: str, ys: tuple[str, ...], alpha: float = 0.0) -> str:
    """From a table ``sums``: target, n, rank, w0, w1, intercept, r2 per row and target, named ``models``."""
    parts = []
    for t, name in enumerate(ys):
        y = 2 + t
        w = _solve2_sql(y, alpha)
        parts.append(f"SELECT *, '{name}' AS target, {w['rank']} AS rank, {w['w0']} AS w0, {w['w1']} AS w1, s{y} AS sy, "
                     f"{_m(y, y)} AS vy, {_m(0, y)} AS c0, {_m(1, y)} AS c1, q{y}_{y} AS qy FROM sums")
    inner = f"w0 * w0 * {_m(0, 0)} + 2 * w0 * w1 * {_m(0, 1)} + w1 * w1 * {_m(1, 1)}"
    return f"""models AS (SELECT {keys}target, n, rank, w0, w1, (sy - w0 * s0 - w1 * s1) / n AS intercept,
  CASE WHEN vy <= 1e-10 * qy THEN 1.0 ELSE 1.0 - (vy - 2 * (w0 * c0 + w1 * c1) + {inner}) / vy END AS r2
  FROM ({' UNION ALL '.join(parts)}))"""


def _complete_sql(*cols: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


# ------------------------------------------------------------------ M18: a model per segment and target
SEGMENT_X, SEGMENT_Y = (S.PROMO, S.MARKETING), (S.REVENUE, S.COGS, S.VOLUME)


@register("segment_models", f"""WITH {Q.FACT_CTE[1:]},
sums AS (SELECT {Q.KEYS}, {_sums_sql(SEGMENT_X, SEGMENT_Y)} FROM fact GROUP BY {Q.KEYS}),
{_models_sql(Q.KEYS + ', ', SEGMENT_Y)}
SELECT {Q.KEYS}, target, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank, {Q.RS('intercept', 2)} AS intercept,
  {Q.RS('w0', 2)} AS w_promo, {Q.RS('w1')} AS w_marketing, {Q.RS('r2')} AS r2 FROM models""")
def segment_models(spark, sf_dir):
    got = linear.fit_groups(sales_fact(spark, sf_dir), KEYS, SEGMENT_X, SEGMENT_Y)
    return got.select(*KEYS, "target", "n", "rank", round_stat("intercept", 2).alias("intercept"),
                      round_stat(F.col("weights")[S.PROMO], 2).alias("w_promo"),
                      round_stat(F.col("weights")[S.MARKETING]).alias("w_marketing"), round_stat("r2").alias("r2"))


# ------------------------------------------------------------------ M17: expanding folds
CV_X, CV_Y = (LAG, S.MARKETING), (S.REVENUE, S.VOLUME)
_CV_SQL = f"""WITH {Q.FACT_CTE[1:]}{Q._lag_cte([1])},
rows AS (SELECT * FROM lagged WHERE {_complete_sql(LAG)}),
cuts AS (SELECT f AS fold, CAST(lo + CAST(FLOOR(days * f / {FOLDS + 1}) AS INTEGER) AS DATE) AS cut
  FROM (SELECT MIN("Date") AS lo, MAX("Date") - MIN("Date") + 1 AS days FROM rows), generate_series(1, {FOLDS}) AS g(f)),
sums AS (SELECT c.fold, c.cut, {_sums_sql(CV_X, CV_Y)} FROM cuts c JOIN rows r ON r."Date" < c.cut GROUP BY c.fold, c.cut),
{_models_sql('fold, cut, ', CV_Y, 1.0)}"""


def _cv(spark, sf_dir):
    rows = features.domain_lags(sales_fact(spark, sf_dir)).where(F.col(LAG).isNotNull())
    return linear.expanding_cv(rows, CV_X, CV_Y, S.DATE, linear.cut_points(rows, S.DATE, FOLDS))


@register("cv_models", f"""{_CV_SQL}
SELECT target, CAST(fold AS INTEGER) AS fold, cut, CAST(n AS BIGINT) AS n_train, CAST(rank AS INTEGER) AS rank,
  {Q.RS('intercept', 2)} AS intercept, {Q.RS('w0')} AS w_lag1, {Q.RS('w1')} AS w_marketing, {Q.RS('r2')} AS r2 FROM models""")
def cv_models(spark, sf_dir):
    models, _ = _cv(spark, sf_dir)
    return models.select("target", "fold", "cut", F.col("n").alias("n_train"), "rank", round_stat("intercept", 2).alias("intercept"),
                         round_stat(F.col("weights")[LAG]).alias("w_lag1"), round_stat(F.col("weights")[S.MARKETING]).alias("w_marketing"),
                         round_stat("r2").alias("r2"))


@register("cv_expanding", f"""{_CV_SQL},
spans AS (SELECT fold, cut, LEAD(cut) OVER (ORDER BY fold) AS until FROM cuts),
scored AS (SELECT m.target, m.fold, CASE m.target {' '.join(f"WHEN '{y}' THEN {Q.D('r.' + y)}" for y in CV_Y)} END AS actual,
    m.intercept + m.w0 * {Q.D('r.' + CV_X[0])} + m.w1 * {Q.D('r.' + CV_X[1])} AS predicted
  FROM rows r JOIN spans s ON r."Date" >= s.cut AND (s.until IS NULL OR r."Date" < s.until) JOIN models m ON m.fold = s.fold)
SELECT target, CAST(fold AS INTEGER) AS fold, COUNT(*) AS n, {Q.RS('AVG(ABS(actual - predicted))', 2)} AS mae,
  {Q.RS('SQRT(AVG((actual - predicted) * (actual - predicted)))', 2)} AS rmse,
  {Q.RS('1 - SUM((actual - predicted) * (actual - predicted)) / (COUNT(*) * VAR_POP(actual))')} AS r2,
  {Q.RS('AVG(predicted - actual)', 2)} AS bias FROM scored GROUP BY target, fold""")
def cv_expanding(spark, sf_dir):
    _, table = _cv(spark, sf_dir)
    return table.select("target", "fold", "n", *[round_stat(c, d).alias(c) for c, d in (("mae", 2), ("rmse", 2), ("r2", 4), ("bias", 2))])


# ------------------------------------------------------------------ M16: stacking on the naive candidates
BASES = {f"naive_lag{k}": [f"{S.REVENUE}_lag{k}"] for k in Q.CAND_LAGS}
_B = list(BASES)


def _stack_sql() -> str:
    lags = [f"{S.REVENUE}_lag{k}" for k in Q.CAND_LAGS]
    y = S.REVENUE
    cond = _complete_sql(*lags)

    def slope(i: str) -> str:
        return f"((sxy{i} - sx{i} * sy / n) / (sxx{i} - sx{i} * sx{i} / n))"
    one = ", ".join(f"SUM({Q.D(x)}) AS sx{i}, SUM({Q.D(x)} * {Q.D(x)}) AS sxx{i}, SUM({Q.D(x)} * {Q.D(y)}) AS sxy{i}"
                    for i, x in enumerate(lags))
    diff = ", ".join(f"w.{c}{i} - f.{c}{i} AS {c}{i}" for i in range(3) for c in ("sx", "sxx", "sxy"))
    base = ", ".join(f"{slope(str(i))} AS b{i}, (sy - {slope(str(i))} * sx{i}) / n AS a{i}" for i in range(3))
    preds = ", ".join(f"b.a{i} + b.b{i} * {Q.D('t.' + x)} AS p{i}" for i, x in enumerate(lags))

    def m(i, j):
        return f"(SUM(p{i} * p{j}) - SUM(p{i}) * SUM(p{j}) / COUNT(*){' + 1.0' if i == j else ''})"
    moments = ", ".join(f"{m(i, j)} AS m{i}{j}" for i in range(3) for j in range(i, 3))
    cross = ", ".join(f"SUM(p{i} * y) - SUM(p{i}) * SUM(y) / COUNT(*) AS c{i}, AVG(p{i}) AS e{i}" for i in range(3))
    return f"""WITH {Q.FACT_CTE[1:]}{Q._lag_cte(Q.CAND_LAGS)},
tr0 AS (SELECT "Date", {Q.KEYS}, {y}, {', '.join(lags)} FROM lagged WHERE "Date" < DATE '{HOLDOUT_CUT}' AND {cond}),
tr AS (SELECT *, NTILE({FOLDS}) OVER (ORDER BY "Date", {Q.KEYS}) - 1 AS fold FROM tr0),
each AS (SELECT fold, CAST(COUNT(*) AS DOUBLE) AS n, SUM({Q.D(y)}) AS sy, {one} FROM tr GROUP BY fold),
whole AS (SELECT SUM(n) AS n, SUM(sy) AS sy, {', '.join(f'SUM({c}{i}) AS {c}{i}' for i in range(3) for c in ('sx', 'sxx', 'sxy'))} FROM each),
sets AS (SELECT fold, w.n - f.n AS n, w.sy - f.sy AS sy, {diff} FROM each f, whole w
  UNION ALL SELECT -1, n, sy, {', '.join(f'{c}{i}' for i in range(3) for c in ('sx', 'sxx', 'sxy'))} FROM whole),
base AS (SELECT fold, {base} FROM sets),
oof AS (SELECT {Q.D('t.' + y)} AS y, {preds} FROM tr t JOIN base b ON b.fold = t.fold),
mo AS (SELECT {moments}, {cross}, AVG(y) AS ey FROM oof),
s1 AS (SELECT *, m11 - m01 * m01 / m00 AS a11, m12 - m01 * m02 / m00 AS a12, m22 - m02 * m02 / m00 AS a22,
  c1 - m01 * c0 / m00 AS d1, c2 - m02 * c0 / m00 AS d2 FROM mo),
s2 AS (SELECT *, (d2 - a12 * d1 / a11) / (a22 - a12 * a12 / a11) AS w2 FROM s1),
s3 AS (SELECT *, (d1 - a12 * w2) / a11 AS w1 FROM s2),
meta AS (SELECT w1, w2, (c0 - m01 * w1 - m02 * w2) / m00 AS w0, ey, e0, e1, e2 FROM s3),
te AS (SELECT "Date", {Q.KEYS}, {Q.D(y)} AS actual, {preds.replace('t.', 'l.')}
  FROM lagged l, (SELECT * FROM base WHERE fold = -1) b WHERE "Date" >= DATE '{HOLDOUT_CUT}' AND {cond}),
scored AS (SELECT actual, ey - w0 * e0 - w1 * e1 - w2 * e2 + w0 * p0 + w1 * p1 + w2 * p2 AS predicted FROM te, meta)
SELECT {', '.join(Q.RS(f'(SELECT w{i} FROM meta)') + f' AS w_{b}' for i, b in enumerate(_B))},
  {Q.RS('(SELECT ey - w0 * e0 - w1 * e1 - w2 * e2 FROM meta)', 1)} AS intercept, COUNT(*) AS n,
  {Q.RS('AVG(ABS(actual - predicted))', 2)} AS mae,
  {Q.RS('1 - SUM((actual - predicted) * (actual - predicted)) / (COUNT(*) * VAR_POP(actual))')} AS r2 FROM scored"""


@register("stacking_ridge", _stack_sql())
def stacking_ridge(spark, sf_dir):
    lags = [x for xs in BASES.values() for x in xs]
    rows = features.domain_lags(sales_fact(spark, sf_dir), targets=[S.REVENUE], lags=Q.CAND_LAGS)
    train, test = features.date_split(rows.select(S.DATE, *KEYS, S.REVENUE, *lags).na.drop(subset=lags), HOLDOUT_CUT)
    stack = cut_lineage(linear.stack_fit(train, BASES, S.REVENUE, [S.DATE, *KEYS], FOLDS))
    scored = linear.stack_predict(test, stack, BASES, S.REVENUE).select(
        F.col(S.REVENUE).cast("double").alias("actual"), F.col(f"predicted_{S.REVENUE}").alias("predicted"))
    table = scored.agg(*metrics.metric_exprs())
    weights = [round_stat(F.col("meta.weights")[b]).alias(f"w_{b}") for b in BASES]
    return table.crossJoin(F.broadcast(stack)).select(
        *weights, round_stat("meta.intercept", 1).alias("intercept"), "n", round_stat("mae", 2).alias("mae"), round_stat("r2").alias("r2"))


# ------------------------------------------------------------------ M8, M10: scoring from a coefficient table
PREDICT_X, PREDICT_Y = (LAG, S.COMPETITOR), (S.REVENUE, S.VOLUME)


def _coefficients_sql(source: str, x: tuple[str, str], ys: tuple[str, ...]) -> str:
    return f"""sums AS (SELECT {Q.KEYS}, {_sums_sql(x, ys)} FROM {source} GROUP BY GROUPING SETS (({Q.KEYS}), ())),
{_models_sql(Q.KEYS + ', ', ys)}"""


def _model_join(row: str, y: str, alias: str) -> str:
    on = " AND ".join(f"{alias}.{k} = {row}.{k}" for k in KEYS)
    return f"LEFT JOIN models {alias} ON {alias}.target = '{y}' AND {on} JOIN models p{alias} ON p{alias}.target = '{y}' AND p{alias}.{KEYS[0]} IS NULL"


def _value_sql(alias: str, x0: str, x1: str, digits: int) -> str:
    c = {k: f"CASE WHEN {alias}.target IS NULL THEN p{alias}.{k} ELSE {alias}.{k} END" for k in ("intercept", "w0", "w1")}
    return Q.R(f"{c['intercept']} + ({c['w0']}) * {x0} + ({c['w1']}) * {x1}", digits)


_AWAY = f"CASE WHEN DAYOFMONTH(\"Date\") % 10 = 0 THEN 'elsewhere' ELSE {KEYS[0]} END"


@register("generic_predict", f"""WITH {Q.FACT_CTE[1:]}{Q._lag_cte([1])},
tr AS (SELECT * FROM lagged WHERE "Date" < DATE '{HOLDOUT_CUT}' AND {_complete_sql(LAG)}),
{_coefficients_sql('tr', PREDICT_X, PREDICT_Y)},
te AS (SELECT "Date", {_AWAY} AS {KEYS[0]}, {', '.join(KEYS[1:])}, COALESCE({Q.D(LAG)}, 1000.0) AS x0, 1.0 AS x1
  FROM lagged WHERE "Date" >= DATE '{HOLDOUT_CUT}')
SELECT t."Date", {', '.join('t.' + k for k in KEYS)}, {', '.join(f"{_value_sql(f'm{i}', 't.x0', 't.x1', 1)} AS predicted_{y}" for i, y in enumerate(PREDICT_Y))}
FROM te t {' '.join(_model_join('t', y, f'm{i}') for i, y in enumerate(PREDICT_Y))}""")
def generic_predict(spark, sf_dir):
    """Rows of unseen countries take the pooled model; the second feature is absent when scoring."""
    rows = features.domain_lags(sales_fact(spark, sf_dir), targets=[S.REVENUE])
    train, test = features.date_split(rows, HOLDOUT_CUT)
    table = cut_lineage(linear.coefficient_table(linear.fit_groups(train, KEYS, PREDICT_X, PREDICT_Y, pooled=True), KEYS))
    test = test.withColumn(S.COUNTRY, F.when(F.dayofmonth(S.DATE) % 10 == 0, "elsewhere").otherwise(F.col(S.COUNTRY)))
    got = linear.predict_table(test.select(S.DATE, *KEYS, LAG), table, KEYS, PREDICT_X, PREDICT_Y)
    return got.select(S.DATE, *KEYS, *[round_half_up(f"predicted_{y}", 1).alias(f"predicted_{y}") for y in PREDICT_Y])


FORECAST_X = (S.MARKETING, "quarter")


@register("generic_forecast", f"""WITH {Q.FACT_CTE[1:]},
q AS (SELECT *, QUARTER("Date") AS quarter FROM fact),
{_coefficients_sql('q', FORECAST_X, PREDICT_Y)},
st AS (SELECT MAX("Date") + 1 AS s FROM fact),
days AS (SELECT CAST(g AS DATE) AS "Date" FROM st, generate_series(s, s + {SCAFFOLD_HORIZON - 1}, INTERVAL 1 DAY) AS t(g)),
grid AS (SELECT * FROM days CROSS JOIN (SELECT DISTINCT {Q.KEYS} FROM fact))
SELECT t."Date", {', '.join('t.' + k for k in KEYS)},
  {', '.join(f"{_value_sql(f'm{i}', '1000.0', 'QUARTER(t.' + chr(34) + 'Date' + chr(34) + ')', 1)} AS predicted_{y}" for i, y in enumerate(PREDICT_Y))}
FROM grid t {' '.join(_model_join('t', y, f'm{i}') for i, y in enumerate(PREDICT_Y))}""")
def generic_forecast(spark, sf_dir):
    fact = sales_fact(spark, sf_dir).withColumn("quarter", F.quarter(S.DATE))
    table = cut_lineage(linear.coefficient_table(linear.fit_groups(fact, KEYS, FORECAST_X, PREDICT_Y, pooled=True), KEYS))
    rows, _ = linear.forecast_table(fact, table, S.DATE, KEYS, FORECAST_X, PREDICT_Y, SCAFFOLD_HORIZON)
    return rows.select(S.DATE, *KEYS, *[round_half_up(f"predicted_{y}", 1).alias(f"predicted_{y}") for y in PREDICT_Y])


# ------------------------------------------------------------------ M15, M13
@register("naive_voting", f"""WITH {Q.CANDIDATES_CTE[1:]},
v AS (SELECT date, {Q.KEYS}, target, ANY_VALUE({Q.D('actual')}) AS actual,
  (MAX(CASE WHEN model = 'naive_lag1' THEN {Q.D('predicted')} END) + MAX(CASE WHEN model = 'naive_lag7' THEN {Q.D('predicted')} END)
   + MAX(CASE WHEN model = 'naive_lag30' THEN {Q.D('predicted')} END)) / 3.0 AS predicted
  FROM cands GROUP BY date, {Q.KEYS}, target)
SELECT target, COUNT(*) AS n, {Q.RS('AVG(ABS(actual - predicted))', 2)} AS mae,
  {Q.RS('1 - SUM((actual - predicted) * (actual - predicted)) / (COUNT(*) * VAR_POP(actual))')} AS r2 FROM v GROUP BY target""")
def naive_voting(spark, sf_dir):
    lags = list(metrics.CANDIDATES.values())
    rows = features.domain_lags(sales_fact(spark, sf_dir), lags=lags)
    rows = features.drop_incomplete(rows, [f"{c}_lag{k}" for c in S.DOMAIN_TARGETS.values() for k in lags])
    for t, c in S.DOMAIN_TARGETS.items():
        rows = linear.vote(rows, [f"{c}_lag{k}" for k in lags], f"predicted_{t}")
    scored = metrics.stack_targets(rows, {t: (c, f"predicted_{t}") for t, c in S.DOMAIN_TARGETS.items()})
    return metrics.accuracy(scored).select("target", "n", round_stat("mae", 2).alias("mae"), round_stat("r2").alias("r2"))


@register("linear_importance", f"""WITH {Q.FACT_CTE[1:]}{Q._lag_cte([1])},
rows AS (SELECT * FROM lagged WHERE {_complete_sql(LAG)}),
sums AS (SELECT {_sums_sql(CV_X, CV_Y)} FROM rows),
{_models_sql('', CV_Y, 1.0)},
l AS (SELECT target, '{CV_X[0]}' AS feature, ABS(w0) AS v FROM models UNION ALL SELECT target, '{CV_X[1]}', ABS(w1) FROM models)
SELECT target, feature, {Q.RS('v')} AS importance, CAST(ROW_NUMBER() OVER (PARTITION BY target ORDER BY v DESC, feature) AS INTEGER) AS rank FROM l""")
def linear_importance(spark, sf_dir):
    rows = features.domain_lags(sales_fact(spark, sf_dir))
    got = linear.importances(linear.fit_groups(rows, [], CV_X, CV_Y, 1.0))
    return got.withColumn("importance", round_stat("importance"))


# ------------------------------------------------------------------ M5
def _digest_sql() -> str:
    cols = ["STRFTIME(\"Date\", '%Y-%m-%d')", *KEYS]
    return "MD5('42'" + "".join(f" || '|' || LENGTH({c}) || ':' || {c}" for c in cols) + ")"


@register("random_split", f"""WITH {Q.FACT_CTE[1:]},
h AS (SELECT "Date", {Q.KEYS}, ROW_NUMBER() OVER (ORDER BY {_digest_sql()}) - 1 AS pos, COUNT(*) OVER () AS n FROM fact)
SELECT "Date", {Q.KEYS}, CASE WHEN pos < FLOOR(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM h""")
def random_split(spark, sf_dir):
    rows = sales_fact(spark, sf_dir).select(S.DATE, *KEYS)
    train, test = features.random_split(rows, 0.2, key_cols=[S.DATE, *KEYS])
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


# ------------------------------------------------------------------ P7
EVENT_COLS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def _info_sql() -> str:
    head = _profile_sql({c: c for c in EVENT_COLS}, "", "events")

    def listed(cond: str) -> str:
        return f"(SELECT COALESCE(STRING_AGG(column_name, ',' ORDER BY ord), '') FROM roles2 WHERE {cond})"
    base = head[:head.rindex("SELECT column_name, data_type")]
    keywords = " OR ".join(f"CONTAINS(LOWER(column_name), '{k}')" for k in S.TARGET_KEYWORDS)
    return f"""{base.rstrip()},
roles2 AS (SELECT *, role = 'numerical' AND ({keywords}) AS target FROM roles)
SELECT 'rows' AS item, CAST(COUNT(*) AS VARCHAR) AS value FROM events
UNION ALL SELECT 'columns', '{len(EVENT_COLS)}'
UNION ALL SELECT 'date_column', (SELECT ARG_MAX(column_name, ord) FROM roles2 WHERE role = 'date')
UNION ALL SELECT 'numerical', {listed("role = 'numerical'")}
UNION ALL SELECT 'categorical', {listed("role = 'categorical'")}
UNION ALL SELECT 'potential_targets', {listed('target')}
UNION ALL SELECT 'default_targets', (SELECT COALESCE(STRING_AGG(column_name, ',' ORDER BY ord), '')
  FROM (SELECT * FROM roles2 WHERE target ORDER BY ord LIMIT 3))"""


@register("dataset_info", _info_sql())
def dataset_info(spark, sf_dir):
    return info_frame(read_table(spark, sf_dir, "events"))
