"""Neighbours against brute force: recall, exact scores, order, copies and unusable vectors."""

import numpy as np

from kpispark.llm import ann
from kpispark.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 5, "x") for i, v in rows], SCHEMA).repartition(4)


def brute(rows, k=20, step=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in ok])
    ids = np.array([i for i, _ in ok])
    out = {}
    for q in np.flatnonzero(ids % step == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def check(spark, rows, least):
    got = {}
    for r in nearest(frame(spark, rows), "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows)
    assert got.keys() == {q for q, w in want.items() if w}
    hits = total = 0
    for q, w in want.items():
        g = sorted(got.get(q, []))
        assert [x[0] for x in g] == list(range(1, len(w) + 1)) and q not in [x[1] for x in g]
        assert [(-x[2], x[1]) for x in g] == sorted((-x[2], x[1]) for x in g)
        hits += len({i for _, i, _ in g} & {i for i, _ in w})
        total += len(w)
    assert hits >= least * total
    return got, want


def test_recall_on_unstructured_vectors(spark):
    x = np.random.default_rng(0).normal(size=(3000, 32))
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(x)]
    got, want = check(spark, rows, 0.9)
    exact = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, g in got.items() for _, i, s in g if (q, i) in exact)


def test_different_norms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 16)) * rng.lognormal(size=(2500, 1))
    check(spark, list(enumerate(x)), 0.9)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[50:250] = x[50]  # two thirds of all rows are one vector
    got, want = check(spark, [(int(i), v) for i, v in enumerate(x)], 1.0)
    assert {q: [i for _, i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_unusable_vectors_and_few_rows(spark):
    nan = float("nan")
    rows = [(0, [1, 2]), (20, [2, 1]), (3, [1, 1]), (4, None), (40, None), (60, [0, 0]), (5, [nan, 1]), (6, [float("inf"), 1]),
            (7, [None, 1]), (80, []), (None, [1, 1]), (3, [1, 1])]
    got, _ = check(spark, rows[:-1], 1.0)
    assert got.keys() == {0, 20} and len(got[0]) == 2
    again = nearest(frame(spark, rows), "vec_id % 20 = 0").where("query_id = 0").collect()
    assert sorted(r["vec_id"] for r in again) == [3, 20]
    assert nearest(frame(spark, []), "vec_id % 20 = 0").count() == 0
    assert nearest(frame(spark, [(20, [1.0, 2.0])]), "vec_id % 20 = 0").count() == 0


def test_scan_alone_finds_neighbours_of_a_table_many_times_the_sample(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(60, 24))
    x = centers[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 24))
    rows = list(enumerate(x))
    want = brute(rows)
    got = {}
    for r in nearest(frame(spark, rows), "vec_id % 20 = 0", sample=240).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(g) == 20 for g in got.values())
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.95 * 20 * len(want)


def test_results_come_from_the_scan_only(spark, monkeypatch):
    nothing = (np.zeros(0, int), np.zeros(0, int))
    monkeypatch.setattr(ann, "scan_list", lambda *a, **b: nothing)
    x = np.random.default_rng(4).normal(size=(400, 8))
    assert nearest(frame(spark, list(enumerate(x))), "vec_id % 20 = 0").count() == 0
