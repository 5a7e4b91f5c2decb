"""Mixing documents to target domain weights by soft membership, by built-in functions only.

The labelled table splits its documents into domains: ``low`` quality, and
good ones in English or in ``other`` languages.  A naive Bayes classifier over
binned text features, counted from the labelled documents, gives every
document a posterior over the domains, kept on a grid of 1/``GRID`` (language
tags of unlabelled documents are not read).  A document of n tokens and
posterior p adds n * p to the domains' expected totals, so rates x >= 0 have
to solve

    least squares over least_rate <= x <= most_rate of  sum_d x_d n_d p_d  against  budget * weights

With tokens as the measure, the gradient with respect to a document's rate is
p_d . g, g being the residual as a share of all tokens.  So documents of equal
posterior have equal rates: tokens are summed per grid point first, and at
most (GRID + 1) (GRID + 2) / 2 rows take part from then on, whatever the input.
Projected-gradient steps are taken implicitly (backward), from x0 and longer
and longer (``STEPS``),

    x = clip(x0 - length * p . g(x)),   x0 = 1 within the bounds,

which is the exact minimum of the squared residual plus |x - x0|^2 / length; an
explicit step would have to be short and repeated many times.  A step is an
equation in the three numbers u = length * g alone, the derivative of a convex
function of u: Newton steps with a line search solve it, each evaluation one
distributed sum over the grid points.  The rates are a closed expression of
the posterior, so the driver holds three numbers, and the optimality
conditions hold to rates / length: p . g is 0 at rates within the bounds, >= 0
at the lower and <= 0 at the upper one.  The residual is never larger than that of the rates x0, and of equally
good rates those nearest to x0 are taken.  Rates have no upper bound unless
``most_rate`` is given.  What is left of the targets comes with every row
(``unmet_<domain>``) and is warned of.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh

DOMAINS = ("english", "other", "low")
TARGETS = {"english": 0.55, "other": 0.37, "low": 0.08}
SLACK = 1.05      # of the default budget over the least at which every domain has least_rate
GRID = 200
STEPS, CLOSE, ROUGH, MOST_TRIES = (1.0, 1e2, 1e4, 1e6, 1e8), 1e-9, 1e-3, 400
UNMET = 1e-3      # share of the mixed tokens that a domain may miss without a warning

_CUTS = {
    "upper": (0.0, 0.01, 0.02, 0.04, 0.08, 0.2, 0.5),      # capitals per character
    "symbol": (0.0, 0.001, 0.005, 0.02, 0.05, 0.1, 0.3),   # signs of markup and noise per character
    "digit": (0.0, 0.002, 0.01, 0.03, 0.1, 0.3),           # digits per character
    "width": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0),    # characters per token
    "tokens": (0.0, 4.0, 16.0, 64.0, 128.0, 256.0, 512.0, 1024.0, 4096.0),
    "repeat": (0.0, 0.02, 0.1, 0.25, 0.5, 0.75),           # share of lines that repeat an earlier one
    "accent": (0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.5),  # bytes beyond one per character
}
FEATURES = tuple(_CUTS)
BINS = {k: len(v) + 1 for k, v in _CUTS.items()}


def _bin(value: Column, cuts) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(value > c, 1).otherwise(0)
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, one bin per feature of whole texts (null: empty), and whether the tag says English."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    english = F.coalesce(F.col("lang") == "en", F.lit(False)) if "lang" in docs.columns else F.lit(False)
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("chars"),
        F.regexp_count(text, F.lit(r"\S+")).alias("tokens"), F.regexp_count(text, F.lit("[A-Z]")).alias("upper"),
        F.regexp_count(text, F.lit(r"[#$%&*|!@^~=<>{}\[\]\\]")).alias("symbol"),
        F.regexp_count(text, F.lit("[0-9]")).alias("digit"),
        (F.octet_length(text) - F.length(text)).alias("accent"), F.split(text, F.lit("\n"), -1).alias("lines"),
        english.alias("english"))
    chars = F.greatest(F.col("chars"), F.lit(1))
    value = {
        "upper": F.col("upper") / chars, "symbol": F.col("symbol") / chars, "digit": F.col("digit") / chars,
        "accent": F.col("accent") / chars,
        "width": chars / F.greatest(F.col("tokens"), F.lit(1)), "tokens": F.col("tokens").cast("double"),
        "repeat": 1.0 - F.size(F.array_distinct("lines")) / F.size("lines"),
    }
    return raw.select("doc_id", F.col("tokens").cast("long").alias("n_tokens"),
                      *[_bin(value[k], _CUTS[k]).alias(k) for k in _CUTS], "english")


def fit_classifier(feats: DataFrame, labels: DataFrame) -> dict:
    """Smoothed log counts per feature, bin and domain from all labelled documents.

    Rows without doc_id or quality are left out; conflicting rows of a doc_id
    count as low.  Without any label all domains are equally likely.
    """
    named = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality")))
    domain = F.when(F.col("quality") == 0, 2).when(F.col("english"), 0).otherwise(1)
    rows = feats.join(named, "doc_id").select(domain.alias("domain"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(k).alias("bin")) for i, k in enumerate(FEATURES)])).alias("f"))
    counts = {k: np.zeros((BINS[k], len(DOMAINS))) for k in FEATURES}
    for r in rows.groupBy("f.feature", "f.bin", "domain").count().collect():  # features x bins x domains rows at most
        counts[FEATURES[r["feature"]]][r["bin"], r["domain"]] = r["count"]
    size = counts[FEATURES[0]].sum(0)
    return {"prior": np.log((size + 1) / (size.sum() + len(DOMAINS))),
            "tables": {k: np.log((c + 0.5) / (c.sum(0) + 0.5 * len(c))) for k, c in counts.items()}}


def posterior(feats: DataFrame, model: dict) -> DataFrame:
    """``feats``' doc_id and n_tokens with p_<domain> on the grid (they sum to 1)."""
    def logit(k):
        terms = [F.element_at(F.array(*[F.lit(float(v)) for v in t[:, k]]), F.col(f) + 1) for f, t in model["tables"].items()]
        return sum(terms, F.lit(float(model["prior"][k])))
    logits = [F.col(f"_l{k}") for k in range(len(DOMAINS))]
    top = F.greatest(*logits)
    total = sum((F.exp(x - top) for x in logits[1:]), F.exp(logits[0] - top))
    cells = [F.floor(F.exp(x - top) / total * GRID + 0.5 / len(DOMAINS)).cast("int") for x in logits[:-1]]
    first = feats.select("doc_id", "n_tokens", *[logit(k).alias(f"_l{k}") for k in range(len(DOMAINS))])
    cut = first.select("doc_id", "n_tokens", *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    return cut.select("doc_id", "n_tokens", (F.col("c0") / GRID).alias("p_english"),
                      (F.least(F.col("c1"), GRID - F.col("c0")) / GRID).alias("p_other"),
                      (F.greatest(GRID - F.col("c0") - F.col("c1"), F.lit(0)) / GRID).alias("p_low"))


def _bounded(least_rate: float, most_rate: float | None, x: Column) -> Column:
    x = F.greatest(F.lit(float(least_rate)), x)
    return x if most_rate is None else F.least(F.lit(float(most_rate)), x)


def _start(least_rate: float, most_rate: float | None) -> float:
    """The rate nearest to 1 within the bounds."""
    x = max(1.0, float(least_rate))
    return x if most_rate is None else min(x, float(most_rate))


def rate(u, least_rate: float, most_rate: float | None) -> Column:
    """A row's rate for its posterior: x0 - p . u within the bounds."""
    move = sum((F.col(f"p_{d}") * F.lit(float(v)) for d, v in zip(DOMAINS, u)), F.lit(0.0))
    return _bounded(least_rate, most_rate, F.lit(_start(least_rate, most_rate)) - move)


def fit_rates(classes: DataFrame, targets: dict[str, float], budget: float | None, least_rate: float,
              most_rate: float | None = None) -> tuple[np.ndarray, dict[str, float]]:
    """(u, unmet): the step that takes the rates to the least-squares solution over ``classes`` (p_*, w).

    ``unmet`` is what the rates bring beyond each domain's target (negative:
    short of it) as a share of the mixed tokens.
    """
    k = len(DOMAINS)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    total = classes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    if not total:
        return np.zeros(k), dict.fromkeys(DOMAINS, 0.0)
    share = F.col("w") / F.lit(float(total))
    mean = np.array(classes.agg(*[F.sum(share * a) for a in p]).first(), float)
    weights = np.array([float(targets.get(d, 0.0)) for d in DOMAINS])
    weights = weights / weights.sum()
    if budget is None:  # room for every domain at least_rate and SLACK more, as posteriors are soft
        needed = max((least_rate * m / w for m, w in zip(mean, weights) if w > 0), default=0.0)
        scale = max(1.0, SLACK * needed)
    else:
        scale = budget / total
    want = scale * weights

    x0 = F.lit(_start(least_rate, most_rate))

    def look(u):
        """Residual at the rates of ``u``, its slope, and the function whose derivative it is, but for the |u|^2 term."""
        x = rate(u, least_rate, most_rate)
        z = sum((a * F.lit(float(v)) for a, v in zip(p, u)), F.lit(0.0))
        inside = x > F.lit(float(least_rate))
        inside = inside if most_rate is None else inside & (x < F.lit(float(most_rate)))
        got = classes.agg(*[F.sum(share * x * a) for a in p], F.sum(share * ((x0 * x0 - x * x) / 2.0 + x * (z - x0 + x))),
                          *[F.coalesce(F.sum(F.when(inside, share * a * b)), F.lit(0.0))
                            for i, a in enumerate(p) for j, b in enumerate(p) if j >= i]).first()
        slope, at = np.zeros((k, k)), k + 1
        for i in range(k):
            for j in range(i, k):
                slope[i, j] = slope[j, i] = got[at]
                at += 1
        return np.array(got[:k], float) - want, slope, float(want @ u) - got[k]

    u = np.zeros(k)
    (residual, slope, height), tries = look(u), 0
    for length in STEPS:  # longer and longer steps, each from the solution of the one before
        while tries < MOST_TRIES:
            miss = u / length - residual
            if np.abs(miss).max() < (CLOSE if length == STEPS[-1] else ROUGH) * max(1.0, scale):
                break
            turn = -np.linalg.solve(np.eye(k) / length + slope, miss)
            part, now = 1.0, height + u @ u / (2 * length)
            while True:
                there = u + part * turn
                ahead, tries = look(there), tries + 1
                if ahead[2] + there @ there / (2 * length) <= now + 1e-4 * part * (miss @ turn) + 1e-15 * abs(now) or part < 1e-12:
                    break
                part /= 4
            if part < 1e-12:
                break  # rounding: there is no lower point
            u, (residual, slope, height) = there, ahead
    return u, dict(zip(DOMAINS, (residual / scale).tolist()))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS,
                 budget: float | None = None, least_rate: float = 0.0, most_rate: float | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, p_english, p_other, p_low, domain, rate, copies, unmet_english, unmet_other, unmet_low.

    ``targets`` are the domains' shares of the mixed tokens (scaled to 1),
    ``budget`` the mixed tokens (default: as many as there are, or ``SLACK`` x
    what ``least_rate`` asks for), ``most_rate`` a bound of the rates if there
    is to be one.  ``unmet_`` columns hold the share of the mixed tokens that a
    domain has beyond its target (short of it: negative), the same in every
    row; more than ``UNMET`` is warned of, too.
    ``copies`` rounds the rate by the document's
    hash, so that it is right on average and the same in every run.  A null
    text has no tokens; a null doc_id is never labelled; repeated rows are
    documents of their own with equal rates; an empty table stays empty.
    """
    wanted = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    feats = cut_lineage(features(docs.select(*wanted)))
    probs = cut_lineage(posterior(feats, fit_classifier(feats, labels)))
    grid = [f"p_{d}" for d in DOMAINS]
    classes = cut_lineage(probs.groupBy(*grid).agg(F.sum("n_tokens").cast("double").alias("w"))
                          .coalesce(4))
    u, left = fit_rates(classes, targets, budget, least_rate, most_rate)
    if max(map(abs, left.values())) > UNMET:
        told = ", ".join(f"{d} {v:+.4f}" for d, v in left.items())
        warnings.warn(f"mixing targets not met: no rates come nearer; shares beyond the targets: {told}", stacklevel=2)
    rates = classes.select(*grid, F.round(rate(u, least_rate, most_rate), 9).alias("rate"))
    likeliest = F.when((F.col("p_english") >= F.col("p_other")) & (F.col("p_english") >= F.col("p_low")), "english").when(
        F.col("p_other") >= F.col("p_low"), "other").otherwise("low")
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("copies")), F.lit(1_000_000)) / 1e6
    # the classes are grid points: 20,301 rows at most
    return (probs.join(F.broadcast(rates), grid)
            .select("doc_id", "n_tokens", *grid, likeliest.alias("domain"), "rate",
                    F.floor(F.col("rate") + chance).cast("long").alias("copies"),
                    *[F.lit(float(v)).alias(f"unmet_{d}") for d, v in left.items()]))


def mix(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as ``mixing_rates`` says; columns unchanged.

    Rows without a doc_id are taken once.  Only documents that don't appear
    exactly once are matched against the texts: by broadcast while their
    checked number is small, else by a shuffle.
    """
    rates = mixing_rates(docs, labels, **options).where("doc_id IS NOT NULL AND copies <> 1")
    key, times, copy = fresh(docs.columns, "mixed", "copies", "copy")
    other = cut_lineage(rates.groupBy("doc_id").agg(F.max("copies").alias("copies")))
    other = F.broadcast(other) if other.count() <= 500_000 else other
    renamed = other.select(F.col("doc_id").alias(key), F.col("copies").alias(times))
    out = docs.join(renamed, F.col("doc_id") == F.col(key), "left").withColumn(
        times, F.coalesce(times, F.lit(1)).cast("int"))
    return out.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
