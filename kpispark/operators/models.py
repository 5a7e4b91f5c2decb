"""Tree regressors per target with Spark ML.

The original fits gradient-boosted and random-forest regressors from
single-machine libraries; here the same pipeline shapes are MLlib stages:
``StringIndexer(keep) -> OneHotEncoder(dropLast) -> VectorAssembler
[-> StandardScaler]`` followed by ``GBTRegressor`` / ``RandomForestRegressor``.
Training is distributed (one pass over the data per tree level), accuracy
is computed with the same one-pass aggregation as ``metrics``.  Candidate
names say what they are; values differ from the original libraries, the
pipeline semantics do not.

Only model objects and tiny metric tables (targets x candidates rows) ever
reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import cut_lineage
from ..functions.calendar import add_basic_calendar, add_full_calendar
from . import metrics as M
from .features import drop_incomplete, global_positions, lag_features, random_split
from .profile import TableProfile, fill_missing_features, profile

SEED = 42


# ------------------------------------------------------------------ M1, M2
def preprocessing_stages(numerical: Sequence[str], categorical: Sequence[str], prefix: str,
                         scale: bool = False) -> tuple[list, str]:
    """Stages turning feature columns into one vector column (M1/M2).

    Unseen categories map to an all-zero one-hot block: ``keep`` indexes them
    last, and the encoder, which knows that index from the column's metadata,
    drops its slot (``dropLast``).  Every seen value keeps its own slot, in
    order of falling frequency.  Other columns are dropped by the assembler.
    """
    stages, parts = [], []
    if numerical:
        num_vec = f"{prefix}__num"
        stages.append(VectorAssembler(inputCols=list(numerical), outputCol=num_vec, handleInvalid="keep"))
        if scale:
            stages.append(StandardScaler(inputCol=num_vec, outputCol=f"{num_vec}_std", withMean=True,
                                         withStd=True))
            num_vec = f"{num_vec}_std"
        parts.append(num_vec)
    if categorical:
        idx = [f"{prefix}__{c}_idx" for c in categorical]
        ohe = [f"{prefix}__{c}_ohe" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
        parts.extend(ohe)
    out = f"{prefix}__features"
    stages.append(VectorAssembler(inputCols=parts, outputCol=out))
    return stages, out


# ---------------------------------------------------------------------- M3, M4
def domain_regressor(max_iter: int = 100) -> GBTRegressor:
    """The domain models: 100 boosted trees, learning rate 0.1, seed 42 (M3)."""
    return GBTRegressor(maxIter=max_iter, stepSize=0.1, maxDepth=6, seed=SEED)


def candidate_regressors(max_iter: int = 100, num_trees: int = 100) -> dict[str, Callable[[], object]]:
    """Candidate set of the generic engine (M4): two boosted-tree settings and a forest."""
    return {
        "gbt_d5": lambda: GBTRegressor(maxIter=max_iter, stepSize=0.1, maxDepth=5, seed=SEED),
        "gbt_d6": lambda: GBTRegressor(maxIter=max_iter, stepSize=0.3, maxDepth=6, seed=SEED),
        "rf": lambda: RandomForestRegressor(numTrees=num_trees, featureSubsetStrategy="all", seed=SEED),
    }


def target_pipeline(numerical: Sequence[str], categorical: Sequence[str], target: str, regressor,
                    scale: bool = False) -> Pipeline:
    prefix = f"_m_{target}"
    stages, feats = preprocessing_stages(numerical, categorical, prefix, scale)
    regressor = regressor.copy().setFeaturesCol(feats).setLabelCol(target).setPredictionCol(
        f"predicted_{target}")
    return Pipeline(stages=stages + [regressor])


def _internal_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_m_")]


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    out = model.transform(df)
    return out.drop(*_internal_cols(out))


# --------------------------------------------------------------------- M7
@dataclass
class PreparedData:
    data: DataFrame
    profile: TableProfile
    targets: list[str]
    numerical: list[str]
    categorical: list[str]
    date_column: str | None
    lags: list[int] = field(default_factory=lambda: list(S.DEFAULT_LAGS))
    group_cols: list[str] | None = None       # how the lags were grouped (default: by every categorical column)

    def schema_dict(self) -> dict:
        return {"numerical_features": self.numerical, "categorical_features": self.categorical,
                "target_columns": self.targets, "date_column": self.date_column,
                "total_features": len(self.numerical) + len(self.categorical)}


def prepare_data(df: DataFrame, targets: Sequence[str] | None = None, group_cols: Sequence[str] | None = None,
                 lags: Sequence[int] = S.DEFAULT_LAGS, prof: TableProfile | None = None) -> PreparedData:
    """Profile -> targets -> calendar -> lags -> drop NULL rows (M7).

    Lags group by every categorical column unless ``group_cols`` is given
    (Q14) and use the skew-proof positional strategy: the generic input has
    no bound on group size.  The input is written once
    (``session.cut_lineage``); profile and positions read that copy.
    """
    if prof is None:
        df = cut_lineage(df)
        prof = profile(df)
    targets = list(targets or prof.default_targets())
    numerical = [c for c in prof.numerical if c not in targets]
    categorical = list(prof.categorical)
    data = df
    if prof.date:
        data = add_full_calendar(data, prof.date)
        numerical += list(S.TIME_FEATURES)
        groups = list(group_cols) if group_cols is not None else categorical
        data = lag_features(data, targets, groups, prof.date, lags, strategy="positions")
        numerical += [f"{t}_lag{k}" for t in targets for k in lags]
    data = drop_incomplete(data)
    return PreparedData(data, prof, targets, numerical, categorical, prof.date, list(lags),
                        list(group_cols) if group_cols is not None else None)


# ---------------------------------------------------------------- M5
def split(prep: PreparedData, test_size: float = 0.2, method: str | None = None,
          cut: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train/test split (M5): 'positional' (original behaviour with a date
    column, Q5), 'date' (cut date, or the date quantile for ``test_size``),
    or 'random' (no date column)."""
    data = prep.data
    method = method or ("positional" if prep.date_column else "random")
    if method == "random":
        return random_split(data, test_size, SEED)
    if method == "date":
        d = F.col(prep.date_column).cast("date")
        if cut is None:
            q = data.agg(F.percentile_approx(F.unix_date(d), 1.0 - test_size).alias("q")).collect()[0]["q"]
            c = F.date_from_unix_date(F.lit(q))
        else:
            c = F.to_date(F.lit(cut))
        return data.filter(d < c), data.filter(d >= c)
    groups = list(prep.categorical) if prep.group_cols is None else prep.group_cols
    indexed = global_positions(data, [prep.date_column], groups)
    n = indexed.agg(F.count(F.lit(1)).alias("_n"))
    cut_idx = F.floor(F.col("_n").cast("double") * F.lit(1.0 - test_size))
    tagged = indexed.crossJoin(F.broadcast(n)).withColumn("_train", F.col("_pos") < cut_idx)
    train = tagged.filter("_train").drop("_pos", "_n", "_train")
    test = tagged.filter(~F.col("_train")).drop("_pos", "_n", "_train")
    return train, test


def fit_all(jobs: Mapping, train: DataFrame, parallelism: int = 4) -> dict:
    """Fit independent pipelines concurrently (key -> Pipeline => key -> model).

    Each fit is a sequence of small Spark jobs (a few per tree level); running
    several fits from a thread pool keeps the cluster busy, as
    ``CrossValidator(parallelism=...)`` does.  Results do not depend on the
    order of completion.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    keys = list(jobs)
    if parallelism <= 1 or len(keys) <= 1:
        return {k: jobs[k].fit(train) for k in keys}
    fit = inheritable_thread_target(train.sparkSession)(lambda k: jobs[k].fit(train))
    with ThreadPoolExecutor(max_workers=min(parallelism, len(keys))) as pool:
        fitted = list(pool.map(fit, keys))
    return dict(zip(keys, fitted))


ROWS_PER_PARTITION = 50_000
MOST_PARTITIONS = 16              # of a training frame, unless one had more than MOST_ROWS rows then
MOST_ROWS = 2_000_000


def training_frame(df: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION, most: int = MOST_PARTITIONS,
                   most_rows: int = MOST_ROWS) -> DataFrame:
    """``df`` persisted in as many partitions as its rows are worth.

    A tree level is one job over all partitions, so a small frame in many
    partitions spends its time on scheduling.  Every task of a job reports
    some 10 KB to the driver, whatever its rows, and 100 trees are some 600
    jobs: so a large frame has ``most`` partitions (its blocks may go to
    disk), and more only when they would exceed ``most_rows`` rows each.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows = kept.count()
    wanted = max(1, min(-(-rows // rows_per_partition), most), -(-rows // most_rows))
    if wanted >= kept.rdd.getNumPartitions():
        return kept
    packed = kept.coalesce(wanted).persist(StorageLevel.MEMORY_AND_DISK)
    packed.count()
    kept.unpersist()
    return packed


def fit_shared(train: DataFrame, numerical: Sequence[str], categorical: Sequence[str],
               jobs: Mapping[tuple[str, str], object], scale: bool, parallelism: int = 4) -> dict:
    """Fit one regressor per (target, name) on vectors that are built once.

    The preprocessing does not depend on the target, so it is fitted once;
    each result is still a whole pipeline (preprocessing + regressor).
    """
    stages, feats = preprocessing_stages(numerical, categorical, "_m_", scale)
    prep = Pipeline(stages=stages).fit(train)
    targets = sorted({t for t, _ in jobs})
    vectors = training_frame(prep.transform(train).select(feats, *[F.col(t).cast("double").alias(t) for t in targets]))
    try:
        fitted = fit_all({k: r.copy().setFeaturesCol(feats).setLabelCol(k[0]).setPredictionCol(f"predicted_{k[0]}")
                          for k, r in jobs.items()}, vectors, parallelism)
    finally:
        vectors.unpersist()
    return {k: PipelineModel(stages=[*prep.stages, m]) for k, m in fitted.items()}


# ---------------------------------------------------------------- M4, M6
@dataclass
class TrainResult:
    models: dict[str, PipelineModel]          # best model per target
    all_models: dict[tuple[str, str], PipelineModel]
    metrics: DataFrame                         # (target, model, model_order, n, mae, rmse, r2, mape, rank, is_best)
    best: dict[str, str]


def train_models(prep: PreparedData, test_size: float = 0.2, method: str | None = None,
                 candidates: Mapping[str, Callable[[], object]] | None = None, scale: bool = True,
                 cut: str | None = None, parallelism: int = 4) -> TrainResult:
    """Fit every candidate for every target, score the test split, keep the
    best R^2 per target (first candidate wins ties) (M4, M6, M18).

    One estimator *per target* (the original shares one object across
    targets, Q6).  Train/test frames are persisted once and reused by every
    fit and evaluation.
    """
    candidates = candidates or candidate_regressors()
    train, test = split(prep, test_size, method, cut)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    test = training_frame(test)
    scored = []
    try:
        models = fit_shared(train, prep.numerical, prep.categorical,
                            {(t, name): make() for t in prep.targets for name, make in candidates.items()},
                            scale, parallelism)
        for target in prep.targets:
            for order, name in enumerate(candidates):
                pred = score(test, models[(target, name)])
                scored.append(pred.select(F.lit(target).alias("target"), F.lit(name).alias("model"),
                                          F.lit(order).alias("model_order"),
                                          F.col(target).cast("double").alias("actual"),
                                          F.col(f"predicted_{target}").alias("predicted")))
        long = scored[0]
        for s in scored[1:]:
            long = long.unionByName(s)
        table = long.groupBy("target", "model", "model_order").agg(*M.metric_exprs()).select(
            "target", "model", "model_order", "n", "mae", "rmse", "r2", "mape")
        # targets x candidates rows
        rows = M.select_best(table).collect()
        table = train.sparkSession.createDataFrame(rows, M.select_best(table).schema)
        best = {r["target"]: r["model"] for r in rows if r["is_best"]}
    finally:
        train.unpersist()
        test.unpersist()
    ordered = {t: models[(t, best[t])] for t in prep.targets if t in best}
    return TrainResult(ordered, models, table, {t: best[t] for t in ordered})


# ---------------------------------------------------------------------- M8
def predict(df: DataFrame, models: Mapping[str, PipelineModel], prep: PreparedData) -> DataFrame:
    """Append ``predicted_<target>`` to the *original* columns (M8).

    Calendar features are recomputed from the date column, absent features
    get name-rule defaults (P22), then each target's pipeline runs as a
    column-wise transform - no join, no collect.
    """
    original = df.columns
    data = df
    if prep.date_column and prep.date_column in df.columns:
        data = add_full_calendar(data, prep.date_column)
    data = fill_missing_features(data, prep.numerical, prep.categorical)
    for target, model in models.items():
        data = score(data, model)
    return data.select(*original, *[f"predicted_{t}" for t in models])


# --------------------------------------------------------------------- M13
def slot_names(stages: Sequence) -> list[str]:
    """Names of the feature vector's slots, from the fitted stages.

    The vector is the numeric block (slot i is the assembler's i-th input,
    scaled or not) followed by one block per categorical column, whose slots
    are ``<column>_<value>`` in the indexer's order.
    """
    names = []
    for st in stages:
        if isinstance(st, VectorAssembler) and st.getOutputCol().endswith("__num"):
            names += st.getInputCols()
        elif isinstance(st, StringIndexerModel):
            for c, labels in zip(st.getInputCols(), st.labelsArray):
                names += [f"{c}_{v}" for v in labels]
    return names


def feature_importance(model: PipelineModel, sample: DataFrame) -> DataFrame:
    """(feature, importance) sorted descending.

    Slots are named by ``slot_names``.  Models without importances give zeros.
    """
    spark = sample.sparkSession
    reg = model.stages[-1]
    names = slot_names(model.stages)
    if hasattr(reg, "featureImportances"):
        imp = reg.featureImportances.toArray().tolist()
    elif hasattr(reg, "coefficients"):
        imp = [abs(x) for x in reg.coefficients.toArray().tolist()]
    else:
        imp = [0.0] * len(names)
    rows = list(zip(names, [float(x) for x in imp[:len(names)]]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


# ----------------------------------------------------------------- M15, M16
def voting_predict(df: DataFrame, models: Sequence[PipelineModel], target: str) -> DataFrame:
    """Mean of several regressors' predictions."""
    cols = []
    data = df
    for i, m in enumerate(models):
        data = score(data, m).withColumnRenamed(f"predicted_{target}", f"_vote_{i}")
        cols.append(F.col(f"_vote_{i}"))
    mean = sum(cols[1:], cols[0]) / F.lit(float(len(cols)))
    return data.withColumn(f"predicted_{target}", mean).drop(*[f"_vote_{i}" for i in range(len(cols))])


def contiguous_folds(data: DataFrame, folds: int, order_cols: Sequence[str]) -> DataFrame:
    """Add ``_fold``: ``folds`` contiguous runs of rows in the given order, of sizes that differ by one at most."""
    indexed = global_positions(data, list(order_cols))
    n = indexed.agg(F.count(F.lit(1)).alias("_n"))
    # the first n % folds runs have one row more
    small, more = F.floor(F.col("_n") / folds), F.col("_n") % folds
    head = more * (small + 1)
    fold = F.when(F.col("_pos") < head, F.floor(F.col("_pos") / (small + 1))).otherwise(
        more + F.floor((F.col("_pos") - head) / F.greatest(small, F.lit(1))))
    return indexed.crossJoin(F.broadcast(n)).withColumn("_fold", fold.cast("int")).drop("_pos", "_n")  # one row


@dataclass
class RidgeModel:
    """A fitted linear combination of columns."""
    columns: list[str]
    coefficients: list[float]
    intercept: float
    output: str

    def transform(self, df: DataFrame) -> DataFrame:
        terms = [F.col(c) * F.lit(w) for c, w in zip(self.columns, self.coefficients)]
        return df.withColumn(self.output, sum(terms, F.lit(self.intercept)))


def ridge(data: DataFrame, columns: Sequence[str], target: str, alpha: float = 1.0) -> RidgeModel:
    """Ridge regression: least squares + ``alpha`` times the squared weights, intercept free.

    The few columns' co-moments come from two aggregates (means, then centred
    products); the k x k system is solved on the driver.  Rows with a NULL in
    any of the columns are left out.
    """
    names = [*columns, target]
    x = data.select(*[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    means = x.agg(*[F.avg(c).alias(c) for c in names]).first()
    if means[target] is None:
        raise ValueError("no complete rows")
    centred = [F.col(c) - F.lit(means[c]) for c in names]
    got = x.agg(*[F.sum(centred[i] * centred[j]).alias(f"{i}_{j}") for i in range(len(names)) for j in range(i + 1)]).first()
    moment = np.array([[got[f"{max(i, j)}_{min(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    w = np.linalg.solve(moment[:-1, :-1] + alpha * np.eye(len(columns)), moment[:-1, -1])
    return RidgeModel(list(columns), [float(v) for v in w],
                      float(means[target] - sum(v * means[c] for v, c in zip(w, columns))), f"predicted_{target}")


def stacking_fit(train: DataFrame, prep: PreparedData, target: str,
                 candidates: Mapping[str, Callable[[], object]], folds: int = 5,
                 alpha: float = 1.0, scale: bool = True, parallelism: int = 4):
    """Stacking (M16): out-of-fold predictions of each base model feed a ridge meta-learner.

    Folds are contiguous runs of rows in date order (in the order of all
    columns without a date).  All fits (folds x candidates, and the final
    ones) are independent and run concurrently.  Returns (base models fitted
    on all rows, meta model).
    """
    order = [prep.date_column] if prep.date_column else list(train.columns)
    data = training_frame(contiguous_folds(train, folds, order))
    names = list(candidates)
    try:
        out, final = {}, {}
        for k in range(folds):
            part = data.filter(F.col("_fold") != k)
            fitted = fit_shared(part, prep.numerical, prep.categorical,
                                {(target, n): candidates[n]() for n in names}, scale, parallelism)
            for n in names:
                out[(k, n)] = fitted[(target, n)]
        final = fit_shared(data, prep.numerical, prep.categorical, {(target, n): candidates[n]() for n in names},
                           scale, parallelism)
        oof = None
        for k in range(folds):
            part = data.filter(F.col("_fold") == k)
            for i, n in enumerate(names):
                part = score(part, out[(k, n)]).withColumnRenamed(f"predicted_{target}", f"_base_{i}")
            part = part.select(target, *[f"_base_{i}" for i in range(len(names))])
            oof = part if oof is None else oof.unionByName(part)
        meta = ridge(oof.persist(StorageLevel.MEMORY_AND_DISK), [f"_base_{i}" for i in range(len(names))], target, alpha)
        oof.unpersist()
    finally:
        data.unpersist()
    return [final[(target, n)] for n in names], meta


def stacking_predict(df: DataFrame, bases: Sequence[PipelineModel], meta, target: str) -> DataFrame:
    data = df
    for i, m in enumerate(bases):
        data = score(data, m).withColumnRenamed(f"predicted_{target}", f"_base_{i}")
    return meta.transform(data).drop(*[f"_base_{i}" for i in range(len(bases))])


# --------------------------------------------------------------------- M17
def time_series_cv(prep: PreparedData, target: str, cut_dates: Sequence[str], make_regressor,
                   scale: bool = True) -> DataFrame:
    """Expanding-window validation (M17): fold i trains on date < cut_i and
    tests on cut_i <= date < cut_{i+1} (the last fold runs to the end)."""
    d = F.col(prep.date_column).cast("date")
    cuts = [F.to_date(F.lit(c)) for c in cut_dates]
    data = training_frame(prep.data)
    try:
        scored = None
        for i, c in enumerate(cuts):
            test = data.filter(d >= c)
            if i + 1 < len(cuts):
                test = test.filter(d < cuts[i + 1])
            model = fit_shared(data.filter(d < c), prep.numerical, prep.categorical, {(target, "cv"): make_regressor()},
                               scale)[(target, "cv")]
            part = score(test, model).select(F.lit(i + 1).alias("fold"), F.lit(cut_dates[i]).alias("cut"),
                                             F.col(target).cast("double").alias("actual"),
                                             F.col(f"predicted_{target}").alias("predicted"))
            scored = part if scored is None else scored.unionByName(part)
        table = scored.groupBy("fold", "cut").agg(*M.metric_exprs())
        # one row per fold
        return data.sparkSession.createDataFrame(table.collect(), table.schema)
    finally:
        data.unpersist()


# ------------------------------------------------------------- domain path
DOMAIN_CATEGORICAL = [S.COUNTRY, S.CHANNEL, S.PRODUCT]


def domain_feature_frame(fact: DataFrame) -> DataFrame:
    """Calendar (F12) + lag-1 of revenue, COGS, volume per segment (W1),
    rows with missing lags dropped (P14) - the training frame of M3."""
    from .features import domain_lags
    data = add_basic_calendar(fact, S.DATE)
    data = domain_lags(data)
    return drop_incomplete(data, [f"{t}_lag1" for t in (S.REVENUE, S.COGS, S.VOLUME)])


def check_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ordered projection with an arity check."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Feature mismatch: expected {len(cols)} features, missing {missing}")
    return df.select(*cols)


def train_domain_models(frame: DataFrame, cut: str, max_iter: int = 100,
                        parallelism: int = 3) -> dict[str, PipelineModel]:
    """Sales and COGS on the 18 features, volume on the 16 (M3), trained on date < cut."""
    train = training_frame(frame.filter(F.col(S.DATE) < F.to_date(F.lit(cut))))
    try:
        pipes = {}
        for key, target in S.DOMAIN_TARGETS.items():
            feats = S.VOLUME_FEATURES if key == "volume" else S.SALES_FEATURES
            num = [c for c in check_features(train, feats).columns if c not in DOMAIN_CATEGORICAL]
            pipes[key] = target_pipeline(num, DOMAIN_CATEGORICAL, target, domain_regressor(max_iter))
        out = fit_all(pipes, train, parallelism)
    finally:
        train.unpersist()
    return out


def domain_predict(rows: DataFrame, models: Mapping[str, PipelineModel]) -> DataFrame:
    """Score rows with the three domain models; adds predicted_<column>."""
    data = rows
    for key, model in models.items():
        data = score(data, model)
    return data
