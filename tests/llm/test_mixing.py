"""Mixing rates against a dense solver, and the mixed documents' token totals."""

import random
import warnings

import numpy as np
import pytest

from kpispark.llm.mixing import SLACK, TARGETS, fit_rates, mix, mixing_rates

from .fixtures import EDGE, documents, empty, labels


def corpus(n=600):
    """Documents of three kinds; their texts tell the kind, ids divisible by 3 have no label."""
    rnd = random.Random(7)
    texts, lab = [], []
    for i in range(n):
        kind = rnd.choices([0, 1, 2], [0.55, 0.3, 0.15])[0]
        words = [rnd.choice(["alpha", "beta", "gamma", "of", "the"]) for _ in range(rnd.randint(5, 60))]
        if kind == 1:
            words = [w.replace("a", "é") for w in words]
        if kind == 2:
            words = [w + "%%%" for w in words]
        texts.append((" ".join(words), kind))
        if i % 3:
            lab.append((i, int(kind != 2), 0))
    return texts, lab


def tagged(spark, texts):
    rows = [(i, t, "fr" if k == 1 else "en", "s", len(t), "clash", 1) for i, (t, k) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int")


def solve(p, w, t, least, most=np.inf):
    """An independent solution: bounded least squares, coordinate by coordinate, on the distinct posteriors."""
    p, at = np.unique(np.round(p * 200).astype(int), axis=0, return_inverse=True)
    p, w = p / 200.0, np.bincount(at.ravel(), w) / w.sum()
    keep = w > 0
    a = p[keep] * w[keep, None]
    x = np.full(keep.sum(), min(max(1.0, least), most))
    g = a.T @ x - t
    for _ in range(20_000):
        before = g.copy()
        for i in np.random.default_rng(0).permutation(len(x)):
            new = np.clip(x[i] - (a[i] @ g) / (a[i] @ a[i]), least, most)
            g += a[i] * (new - x[i])
            x[i] = new
        if np.abs(g - before).max() < 1e-13:
            break
    return g


def left_of(got, t):
    p, w, x = got[["p_english", "p_other", "p_low"]].to_numpy(), got["n_tokens"].to_numpy(float), got["rate"].to_numpy()
    return (p * (w * x)[:, None]).sum(0) / w.sum() - t


def conditions(got, t, least, most=np.inf):
    """The largest violation of the optimality conditions."""
    g = left_of(got, t)
    slope, x = got[["p_english", "p_other", "p_low"]].to_numpy() @ g, got["rate"].to_numpy()
    at_low, at_high = x <= least + 1e-9, x >= most - 1e-9
    return max(np.abs(slope[~at_low & ~at_high]).max(initial=0), np.maximum(0, -slope[at_low]).max(initial=0),
               np.maximum(0, slope[at_high]).max(initial=0))


def test_rates_meet_targets(spark):
    texts, lab = corpus()
    for least, budget, targets in ((0.0, None, TARGETS), (1.0, None, {"english": 0.5, "other": 0.33, "low": 0.17}), (0.0, 5000.0, TARGETS)):
        got = mixing_rates(tagged(spark, texts), labels(spark, lab), targets, budget, least).toPandas()
        assert len(got) == len(texts) and (got["rate"] >= least).all()
        p, w, x = got[["p_english", "p_other", "p_low"]].to_numpy(), got["n_tokens"].to_numpy(float), got["rate"].to_numpy()
        assert np.allclose(p.sum(1), 1) and (p >= 0).all()
        total = (p * (w * x)[:, None]).sum(0)
        want = np.array(list(targets.values()))
        scale = budget / w.sum() if budget else max(1.0, SLACK * (least * (p * w[:, None]).sum(0) / w.sum() / want).max())
        left = solve(p, w, scale * want, least)
        assert np.abs(total / w.sum() - scale * want - left).max() < 1e-6
        assert conditions(got, scale * want, least) < 1e-6
        assert abs((got["copies"] * w).sum() - (w * x).sum()) < 0.1 * (w * x).sum()
        assert ((got["copies"] - x).abs() <= 1).all()


def test_posteriors_follow_labels(spark):
    texts, lab = corpus()
    got = mixing_rates(tagged(spark, texts), labels(spark, lab)).toPandas().set_index("doc_id")
    names = ("english", "other", "low")
    assert np.mean([got.loc[i, "domain"] == names[k] for i, (_, k) in enumerate(texts)]) > 0.97


def test_mix_repeats_rows_and_keeps_columns(spark):
    texts, lab = corpus()
    docs = tagged(spark, texts)
    rates = {r["doc_id"]: r["copies"] for r in mixing_rates(docs, labels(spark, lab), least_rate=1.0).collect()}
    out = mix(docs, labels(spark, lab), least_rate=1.0)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.where("n = 1").groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in rates.items() if i is not None} and min(counts.values()) >= 1


def test_edge_cases(spark):
    docs = documents(spark, EDGE)
    for lab in ([], [(0, 1, 1), (1, None, None), (None, 1, 0), (2, 0, None), (2, 1, 0)]):
        out = mixing_rates(docs, labels(spark, lab)).collect()
        assert len(out) == len(EDGE) + 2 and all(r["rate"] >= 0 and r["copies"] >= 0 for r in out)
    assert mixing_rates(empty(spark), labels(spark, [])).count() == 0
    assert mix(empty(spark), labels(spark, [])).count() == 0


def rare(n=3000):
    """A corpus with one low document in 1,000, all labelled."""
    rnd = random.Random(11)
    texts, lab = [], []
    for i in range(n):
        kind = 2 if i % 1000 == 7 else int(rnd.random() < 0.4)
        words = [rnd.choice(["alpha", "beta", "gamma", "of", "the"]) for _ in range(rnd.randint(20, 60))]
        words = [w.replace("a", "é") for w in words] if kind == 1 else [w + "%%%" for w in words] if kind == 2 else words
        texts.append((" ".join(words), kind))
        lab.append((i, int(kind != 2), 0))
    return texts, lab


def shares(got):
    w = (got["n_tokens"] * got["rate"]).to_numpy()
    total = (got[["p_english", "p_other", "p_low"]].to_numpy() * w[:, None]).sum(0)
    return total / got["n_tokens"].sum()


def test_a_rare_domain_meets_its_target(spark):
    texts, lab = rare()
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message="mixing targets")
        got = mixing_rates(tagged(spark, texts), labels(spark, lab)).toPandas()
    assert np.abs(shares(got) - np.array(list(TARGETS.values()))).max() < 1e-3
    assert got["rate"].max() > 16


def test_what_is_left_of_the_targets_is_told(spark):
    texts, lab = rare()
    with pytest.warns(UserWarning, match="mixing targets not met.*low -0"):
        got = mixing_rates(tagged(spark, texts), labels(spark, lab), most_rate=16.0).toPandas()
    assert got["rate"].max() <= 16


@pytest.mark.parametrize("least,most,targets,budget", [
    (1.0, None, {"english": 0.05, "other": 0.05, "low": 0.9}, 3000.0), (0.0, 2.0, {"english": 0.05, "other": 0.05, "low": 0.9}, None),
    (1.0, 1.5, {"english": 0.9, "other": 0.05, "low": 0.05}, 90_000.0), (0.5, 0.75, {"low": 1.0}, None), (0.0, None, {"low": 1.0}, None)])
def test_targets_out_of_reach(spark, least, most, targets, budget):
    """As near as any rates come, never further than the rates of 1, and the rest is told per domain."""
    texts, lab = corpus()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = mixing_rates(tagged(spark, texts), labels(spark, lab), targets, budget, least, most).toPandas()
    p, w = got[["p_english", "p_other", "p_low"]].to_numpy(), got["n_tokens"].to_numpy(float)
    want = np.array([targets.get(d, 0.0) for d in ("english", "other", "low")])
    mean = (p * w[:, None]).sum(0) / w.sum()
    scale = budget / w.sum() if budget else max(1.0, SLACK * max(least * m / t for m, t in zip(mean, want) if t > 0))
    t, upper = scale * want, np.inf if most is None else most
    assert got["rate"].between(least, upper).all()
    start = mean * np.clip(1.0, least, upper) - t
    mine, best = left_of(got, t), solve(p, w, t, least, upper)
    assert (mine ** 2).sum() <= (start ** 2).sum() + 1e-9
    assert (mine ** 2).sum() == pytest.approx((best ** 2).sum(), abs=1e-6) and conditions(got, t, least, upper) < 1e-6
    assert got[["unmet_english", "unmet_other", "unmet_low"]].drop_duplicates().to_numpy()[0] == pytest.approx(mine / scale, abs=1e-6)


def test_random_posteriors_against_the_independent_solver(spark):
    rng = np.random.default_rng(12)
    for trial in range(3):
        cells = np.unique(rng.multinomial(200, rng.dirichlet([1, 1, 1]), 12) / 200.0, axis=0)
        w = rng.integers(1, 1000, len(cells)).astype(float)
        classes = spark.createDataFrame([(*map(float, c), float(v)) for c, v in zip(cells, w)], "p_english double, p_other double, p_low double, w double")
        for least in (0.0, 1.0):
            targets = dict(zip(("english", "other", "low"), rng.dirichlet([0.3, 0.3, 0.3]).tolist()))
            u, left = fit_rates(classes, targets, w.sum() * 0.8, least)
            x = np.maximum(least, 1.0 - cells @ u)
            t = 0.8 * np.array(list(targets.values()))
            mine = (cells * (w * x)[:, None]).sum(0) / w.sum() - t
            assert (mine ** 2).sum() == pytest.approx((solve(cells, w, t, least) ** 2).sum(), abs=1e-7)
            assert np.array(list(left.values())) == pytest.approx(mine / 0.8, abs=1e-7)


def test_columns_of_any_name_pass_by(spark):
    texts, lab = corpus(60)
    docs = tagged(spark, texts).selectExpr("*", "'a' AS mixed", "'b' AS copies", "'c' AS Copy", "'d' AS _copies")
    out = mix(docs, labels(spark, lab), least_rate=1.0)
    assert out.columns == docs.columns
    assert {(r["mixed"], r["copies"], r["Copy"], r["_copies"]) for r in out.collect()} == {("a", "b", "c", "d")}
