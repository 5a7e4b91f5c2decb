"""Least squares from co-moments: grouped fits, expanding folds, stacking, coefficient tables.

A linear model needs only sums: n, sum(x_i), sum(x_i x_j), sum(x_i y).  They
add up over any partition of the rows, so

* one ``groupBy`` gives the models of all groups and all targets (``fit_groups``);
* an expanding fold is the running sum of its periods' rows (``expanding_cv``);
* what a fold leaves out is the total minus the fold (``stack_fit``).

No fit per fold, target or group, and the number of jobs depends on none of
them.  The k x k systems are solved inside Spark, one row per group, by a
symmetric sweep written with array functions: pivot after pivot in the order
of the features.  A pivot that is left with less than ``TOLERANCE`` of the
feature's raw second moment belongs to a constant feature or one that the
earlier ones explain; it is skipped, its weight is 0, and ``rank`` says how
many were used.  So singular groups have a defined answer.

Models are rows: the group's keys, target, intercept and a map of weights, or
the long ``coefficient_table``.  Scoring joins them to the rows by key; rows of
a group without a model take the pooled one (null keys).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from . import metrics as M
from .models import contiguous_folds
from .profile import feature_default, fill_missing_features

TOLERANCE = 1e-10
INTERCEPT = "(intercept)"


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose values in ``columns`` are all there and no NaN; these columns as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns}).na.drop(subset=list(columns))


def moment_columns(features: Sequence[str], targets: Sequence[str]) -> dict[str, Column]:
    """The sums that the fits need: ``n``, ``s<i>`` and ``q<i>_<j>`` over features, then targets.

    (k + t)(k + t + 3) / 2 sums, less the products of different targets.
    """
    names = [*features, *targets]
    k = len(features)
    out = {"n": F.count(F.lit(1))}
    out |= {f"s{i}": F.sum(c) for i, c in enumerate(names)}
    out |= {f"q{i}_{j}": F.sum(F.col(a) * F.col(names[j])) for i, a in enumerate(names)
            for j in range(i, len(names)) if i < k or i == j}
    return out


def co_moments(df: DataFrame, by: Sequence[str], features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One row of sums per group, over the complete rows."""
    sums = [c.alias(n) for n, c in moment_columns(features, targets).items()]
    return complete(df.select(*by, *features, *targets), [*features, *targets]).groupBy(*by).agg(*sums)


def _centred(i: int, j: int) -> Column:
    """n times the covariance of the i-th and j-th column."""
    return F.col(f"q{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")


def _swept(matrix: Column, least: Column, k: int) -> Column:
    """struct(m, rank): the augmented matrix reduced pivot by pivot, skipped pivots' rows set to 0."""
    start = F.struct(matrix.alias("m"), F.lit(0).alias("rank"))

    def step(state, p):
        own = F.get(state["m"], p)
        pivot = F.get(own, p)
        good = pivot > F.get(least, p)
        scaled = F.transform(own, lambda v: F.when(good, v / pivot).otherwise(0.0))
        rows = F.transform(state["m"], lambda row, i: F.when(i == p, scaled).otherwise(
            F.zip_with(row, scaled, lambda v, w: v - F.get(row, p) * w)))
        return F.struct(rows.alias("m"), (state["rank"] + good.cast("int")).alias("rank"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, step)


def solve(moments: DataFrame, by: Sequence[str], features: Sequence[str], targets: Sequence[str],
          alpha: float = 0.0, used: Sequence[str] | None = None) -> DataFrame:
    """One row per group and target: by, target, n, rank, intercept, weights, r2.

    Minimises the squared errors plus ``alpha`` times the squared weights
    (the intercept is free).  ``used`` picks some of the features that the
    moments cover.  A group without rows has null results; r2 of a target
    without spread is 1 if nothing is left to explain, as in A15.
    """
    at = {f: i for i, f in enumerate(features)}
    mine = [at[f] for f in (used or features)]
    k, first = len(mine), len(features)
    low, high = min, max
    matrix = F.array(*[F.array(*[_centred(low(i, j), high(i, j)) + (alpha if i == j else 0.0) for j in mine],
                               *[_centred(i, first + t) for t in range(len(targets))]) for i in mine])
    least = F.array(*[F.lit(TOLERANCE) * F.col(f"q{i}_{i}") for i in mine])
    fitted = moments.withColumn("_fit", _swept(matrix, least, k))
    names = F.array(*[F.lit(features[i]) for i in mine])

    def model(t: int) -> Column:
        weights = [F.get(F.get(F.col("_fit.m"), F.lit(r)), F.lit(k + t)) for r in range(k)]
        y = first + t
        intercept = (F.col(f"s{y}") - sum((w * F.col(f"s{i}") for w, i in zip(weights, mine)), F.lit(0.0))) / F.col("n")
        spread = _centred(y, y)
        cross = sum((w * _centred(i, y) for w, i in zip(weights, mine)), F.lit(0.0))
        inner = sum((weights[a] * weights[b] * _centred(low(i, j), high(i, j)) for a, i in enumerate(mine)
                     for b, j in enumerate(mine)), F.lit(0.0))
        sse = spread - 2.0 * cross + inner
        flat = spread <= F.lit(TOLERANCE) * F.col(f"q{y}_{y}")
        return F.struct(F.lit(targets[t]).alias("target"), F.col("n"), F.col("_fit.rank").alias("rank"),
                        intercept.alias("intercept"), F.map_from_arrays(names, F.array(*weights)).alias("weights"),
                        F.when(flat, 1.0).otherwise(1.0 - sse / spread).alias("r2"))
    return fitted.select(*by, F.inline(F.array(*[model(t) for t in range(len(targets))])))


def fit_groups(df: DataFrame, by: Sequence[str], features: Sequence[str], targets: Sequence[str],
               alpha: float = 0.0, pooled: bool = False) -> DataFrame:
    """Models of every group and target from one aggregate.

    With ``pooled`` one more model per target over all rows, its keys null,
    from the same pass (a grouping set; rows with a null key are left out
    then, as their group could not be told from it).
    """
    if not pooled:
        return solve(co_moments(df, by, features, targets), by, features, targets, alpha)
    sums = [c.alias(n) for n, c in moment_columns(features, targets).items()]
    rows = complete(df.select(*by, *features, *targets), [*features, *targets]).na.drop(subset=list(by))
    both = rows.groupingSets([[F.col(c) for c in by], []], *by).agg(*sums)
    return solve(both, by, features, targets, alpha)


def _dot(weights: Column, intercept: Column, features: Sequence[str], values: Mapping[str, Column] | None = None) -> Column:
    values = values or {}
    return sum((F.coalesce(F.try_element_at(weights, F.lit(f)), F.lit(0.0)) * values.get(f, F.col(f)).cast("double")
                for f in features), intercept)


# ------------------------------------------------------------------ coefficient tables
def coefficient_table(models: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Models as rows of by, target, feature, weight; the intercept is a feature of its own."""
    entries = F.concat(F.array(F.struct(F.lit(INTERCEPT).alias("feature"), F.col("intercept").alias("weight"))),
                       F.transform(F.map_entries("weights"), lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("weight"))))
    return models.select(*by, "target", F.inline(entries))


def predict_table(df: DataFrame, table: DataFrame, by: Sequence[str], features: Sequence[str], targets: Sequence[str],
                  limit_bytes: int | None = None) -> DataFrame:
    """Append ``predicted_<target>`` from a coefficient table to the original columns (M8).

    Each row meets its group's coefficients (one row with all targets) by a
    left join, broadcast if the table's size allows; a group without any takes
    the pooled ones (null keys), and without those the prediction is null.  An
    absent feature, or one that is null in a row, has its name-rule default
    (P22); features beyond the table's count nothing.
    """
    original = df.columns
    data = fill_missing_features(df, features, [])
    values = {f: F.coalesce(F.col(f).cast("double"), F.lit(feature_default(f))) for f in features}
    packed = table.groupBy(*by).agg(*[F.map_from_entries(F.collect_list(F.when(
        F.col("target") == t, F.struct("feature", "weight")))).alias(f"_m_{t}") for t in targets])
    names = [f"_m_{t}" for t in targets]
    own = packed.select(*[F.col(c).alias(f"_k_{c}") for c in by], *names)
    if by:
        pooled = own.where(" AND ".join(f"`_k_{c}` IS NULL" for c in by)).select(*[F.col(n).alias(f"_p{n}") for n in names])
        pooled = pooled.agg(*[F.any_value(f"_p{n}").alias(f"_p{n}") for n in names])  # one row, also without any
        joined = data.join(broadcast_if_small(own, limit_bytes), [F.col(c) == F.col(f"_k_{c}") for c in by], "left")
        joined = joined.crossJoin(F.broadcast(pooled))
        joined = joined.withColumns({n: F.coalesce(F.col(n), F.col(f"_p{n}")) for n in names})
    else:
        joined = data.crossJoin(F.broadcast(own.agg(*[F.any_value(n).alias(n) for n in names])))
    predicted = {f"predicted_{t}": _dot(F.col(f"_m_{t}"), F.try_element_at(F.col(f"_m_{t}"), F.lit(INTERCEPT)), features, values)
                 for t in targets}
    return joined.select(*original, *[c.alias(n) for n, c in predicted.items()])


def forecast_table(history: DataFrame, table: DataFrame, date_col: str, by: Sequence[str], features: Sequence[str],
                   targets: Sequence[str], horizon: int = 30, **scaffold) -> tuple[DataFrame, DataFrame]:
    """(forecast rows, totals): scaffold after the history's last date, scored by the table (M10 = M9, M8, A22)."""
    from .forecast import future_scaffold
    grid = future_scaffold(history, date_col, list(by), list(features), list(targets), horizon, **scaffold)
    rows = predict_table(grid, table, by, features, targets)
    return rows, M.forecast_totals(rows, date_col)


# ------------------------------------------------------------------ expanding folds
def cut_points(df: DataFrame, date_col: str, folds: int) -> DataFrame:
    """(fold, cut): ``folds`` cuts that divide the span of dates into equal stretches; one aggregate row."""
    day = F.col(date_col).cast("date")
    span = df.agg(F.min(day).alias("low"), (F.datediff(F.max(day), F.min(day)) + 1).alias("days"))
    return span.select("low", "days", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")).where("low IS NOT NULL").select(
        "fold", F.date_add("low", F.floor(F.col("days") * F.col("fold") / (folds + 1)).cast("int")).alias("cut"))


def expanding_cv(df: DataFrame, features: Sequence[str], targets: Sequence[str], date_col: str, cuts: DataFrame,
                 alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(models, metrics) of expanding-window validation: fold i fits on dates before cut i, scores up to the next cut.

    ``cuts`` holds (fold, cut), a row per fold, folds from 1 in date order.
    Every row gets its period (folds whose cut is not after its date).  The
    sums of the periods, added up over earlier periods by a window, are the
    folds' sums; their models are joined back to the rows of the fold's own
    period.  Two reads of the rows, whatever the number of folds or targets.
    A fold that has nothing before its cut has a null model and no metrics.
    """
    marks = cuts.agg(F.sort_array(F.collect_list(F.struct("fold", F.col("cut").cast("date").alias("cut")))).alias("_cuts"))
    rows = complete(df.select(date_col, *features, *targets), [*features, *targets]).crossJoin(F.broadcast(marks))
    rows = rows.withColumn("fold", F.size(F.filter("_cuts", lambda c: c["cut"] <= F.col(date_col).cast("date")))).drop("_cuts")
    names = list(moment_columns(features, targets))
    periods = rows.groupBy("fold").agg(*[c.alias(n) for n, c in moment_columns(features, targets).items()])
    earlier = cuts.select("fold", "cut").unionByName(cuts.sparkSession.createDataFrame([(0, None)], "fold int, cut date"))
    earlier = earlier.join(F.broadcast(periods), "fold", "left")     # a row per fold
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    sums = earlier.select("fold", "cut", *[F.sum(n).over(before).alias(n) for n in names]).where("fold > 0")
    models = cut_lineage(solve(sums, ["fold", "cut"], features, targets, alpha))
    scored = rows.join(F.broadcast(models.select("fold", "target", "intercept", "weights")), "fold")
    actual = F.element_at(F.create_map(*[x for t in targets for x in (F.lit(t), F.col(t))]), F.col("target"))
    scored = scored.select("fold", "target", actual.alias("actual"),
                           _dot(F.col("weights"), F.col("intercept"), features).alias("predicted"))
    return models, scored.groupBy("target", "fold").agg(*M.metric_exprs())


# ------------------------------------------------------------------ stacking
def stack_fit(df: DataFrame, bases: Mapping[str, Sequence[str]], target: str, order_cols: Sequence[str],
              folds: int = 5, alpha: float = 1.0, base_alpha: float = 0.0) -> DataFrame:
    """Stacked least squares as one row: ``bases`` (name -> intercept, weights) and the ``meta`` model's.

    Each base is a linear model on its own features.  Folds are contiguous
    runs of rows in the order of ``order_cols``; what a fold's bases are
    fitted on is the total of the sums minus the fold's.  Their predictions of
    the fold's rows, one pass, are what the ridge (``alpha``) learns from.
    The final bases come from the total.
    """
    features = list(dict.fromkeys(f for fs in bases.values() for f in fs))
    rows = complete(df, [*features, target])
    placed = cut_lineage(contiguous_folds(rows.select(*dict.fromkeys([*order_cols, *features, target])), folds, order_cols)
                         .select("_fold", *features, target))
    sums = moment_columns(features, [target])
    each = placed.groupBy("_fold").agg(*[c.alias(n) for n, c in sums.items()])
    whole = each.agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    rest = each.crossJoin(F.broadcast(whole)).select("_fold", *[(F.col(f"_t_{n}") - F.col(n)).alias(n) for n in sums])
    sets = rest.unionByName(whole.select(F.lit(-1).alias("_fold"), *[F.col(f"_t_{n}").alias(n) for n in sums]))
    sets = cut_lineage(sets)                                       # folds + 1 rows
    fitted = None
    for name, own in bases.items():
        one = solve(sets, ["_fold"], features, [target], base_alpha, own).select(
            "_fold", F.lit(name).alias("base"), "intercept", "weights")
        fitted = one if fitted is None else fitted.unionByName(one)
    fitted = cut_lineage(fitted.groupBy("_fold").agg(F.map_from_entries(F.collect_list(F.struct(
        "base", F.struct("intercept", "weights")))).alias("bases")))
    out = placed.join(F.broadcast(fitted), "_fold").select(target, *base_predictions("bases", bases))
    names = list(bases)
    meta = solve(co_moments(out, [], names, [target]), [], names, [target], alpha).select("n", "intercept", "weights")
    return fitted.where("_fold = -1").select("bases").crossJoin(meta.select(F.struct("n", "intercept", "weights").alias("meta")))


def base_predictions(column: str, bases: Mapping[str, Sequence[str]]) -> list[Column]:
    """Predictions of the bases that a map column holds, named like them."""
    at = {b: F.try_element_at(F.col(column), F.lit(b)) for b in bases}
    return [_dot(at[b]["weights"], at[b]["intercept"], own).alias(b) for b, own in bases.items()]


def stack_predict(df: DataFrame, stack: DataFrame, bases: Mapping[str, Sequence[str]], target: str) -> DataFrame:
    """``df`` with ``predicted_<target>`` of a stacked model; null features give null."""
    original = df.columns
    data = df.crossJoin(F.broadcast(stack.select(F.col("bases").alias("_bases"), F.col("meta").alias("_meta"))))
    data = data.withColumn("_base", F.struct(*base_predictions("_bases", bases)))
    values = {b: F.col(f"_base.`{b}`") for b in bases}
    return data.select(*original, _dot(F.col("_meta.weights"), F.col("_meta.intercept"), list(bases), values).alias(f"predicted_{target}"))


# ------------------------------------------------------------------ voting (M15), importances
def vote(df: DataFrame, columns: Sequence[str], output: str) -> DataFrame:
    """Mean of several predictions as a column; null where one of them is."""
    return df.withColumn(output, sum((F.col(c).cast("double") for c in columns), F.lit(0.0)) / F.lit(float(len(columns))))


def importances(models: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, target, feature, importance, rank): absolute weights, the largest first, ties by name."""
    long = models.select(*by, "target", F.explode("weights").alias("feature", "weight"))
    order = Window.partitionBy(*by, "target").orderBy(F.desc("importance"), "feature")   # a model's features
    return long.select(*by, "target", "feature", F.abs("weight").alias("importance")).withColumn("rank", F.row_number().over(order))
