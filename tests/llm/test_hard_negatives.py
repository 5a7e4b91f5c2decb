"""Hard negatives against brute force; bounds and trees against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpispark.llm import hard_negatives as H
from kpispark.llm.hard_negatives import CoverTree, hard_negatives, quantised

SCHEMA = "vec_id long, embedding array<double>, label int, key string"


def plain(rows, step=50, positives=5, negatives=3, low=50, high=95):
    """rows: (id, label, integer vector)."""
    out = []
    for a, la, va in rows:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, l) for i, l, v in rows if i != a)
        for s, p, l in [r for r in scored if r[2] == la][:positives]:
            fit = [(n, t) for t, n, m in scored if m != la and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "clash") for i, l, v in rows], SCHEMA)


def floored(rows, scale=256):
    return [(i, l, [int(np.floor(scale * x)) for x in v]) for i, l, v in rows]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(rng, n, width=12, labels=6):
    centers = rng.normal(size=(9, width))
    return [(i, int(rng.integers(labels)), (centers[i % 9] * rng.uniform(0.2, 1.5) + 0.2 * rng.normal(size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_rows_equal_brute_force(spark, seed, monkeypatch):
    if seed:  # many small trees and questions
        monkeypatch.setattr(H, "SHARD", 60)
        monkeypatch.setattr(H, "ASKED", 3)
        monkeypatch.setattr(H, "SAMPLE", 20)
    rows = clustered(np.random.default_rng(seed), 700)
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(150)]     # one common vector
    rows += [(2000 + i, 1, [0.0] * 12) for i in range(50)]          # zero vectors: scores of 0
    got = hard_negatives(frame(spark, rows), "id % 50 = 0")
    want = plain(floored(rows))
    assert len(want) > 100 and rows_of(got) == want


def test_other_parameters(spark):
    rows = clustered(np.random.default_rng(4), 300, 5, 2)
    got = hard_negatives(frame(spark, rows), F.col("id") % 20 == 0, positives=2, negatives=7, low=10, high=120, scale=64)
    assert rows_of(got) == plain(floored(rows, 64), 20, 2, 7, 10, 120)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    good = clustered(rng, 200, 4, 3)
    bad = [(None, 1, [1.0] * 4), (500, None, [1.0] * 4), (550, 1, None), (600, 1, [1.0, None, 1.0, 1.0]), (650, 1, [float("nan")] * 4),
           (700, 1, [float("inf"), 0, 0, 0]), (750, 1, [1.0]), (800, 1, []), (850, 2, [1e30, 0, 0, 0]), (900, 2, [3e6] * 4)]
    again = [(0, 99, [5.0] * 4), (0, good[0][1], good[0][2]), (7, good[7][1], good[7][2])]  # repeated ids: the least label counts
    got = hard_negatives(frame(spark, good + bad + again), "id % 50 = 0")
    assert rows_of(got) == plain(floored(good))


def test_nothing_to_mine(spark):
    assert hard_negatives(frame(spark, []), "id % 50 = 0").count() == 0
    assert hard_negatives(frame(spark, [(0, 1, []), (50, 2, [])]), "id % 50 = 0").count() == 0
    assert hard_negatives(frame(spark, [(0, 1, [1.0]), (50, 2, [1.0])]), "id % 50 = 0").count() == 0  # no positive
    assert hard_negatives(frame(spark, [(0, 1, [1.0]), (1, 1, [1.0])]), "id % 50 = 0").count() == 0   # no negative
    negative = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.7])]                                        # no window below 0
    assert rows_of(hard_negatives(frame(spark, negative), "id % 50 = 0")) == plain(floored(negative)) == []


def test_windows_at_their_ends(spark):
    """50 * positive <= 100 * negative <= 95 * positive, both ends taken; ties to smaller ids."""
    rows = [(0, 1, [1 / 256]), (1, 1, [20 / 256])] + [(10 + n, 2, [n / 256]) for n in range(8, 22)] + [(99, 3, [19 / 256])]
    got = rows_of(hard_negatives(frame(spark, rows), "id = 0"))
    assert [(r[3], r[5]) for r in got] == [(29, 19), (99, 19), (28, 18)]
    low = hard_negatives(frame(spark, [r for r in rows if r[0] < 20 or r[0] > 90 and r[0] != 99]), "id = 0")
    assert [(r.negative_id, r.negative_score) for r in low.orderBy("rank").collect()] == []  # 8 and 9 are under 50 %


def test_quantised_floors(spark):
    got = quantised(frame(spark, [(1, 1, [-0.001, 0.001, 1.0]), (2, 1, [0.5, -1.0, 0.0])])).orderBy("id").collect()
    assert [r.v for r in got] == [[-1, 0, 256], [128, -256, 0]]


def test_tree_covers_and_bounds():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(600, 6)) * 100)
    x[100:180] = x[3]
    tree = CoverTree(np.arange(600), rng.integers(0, 3, 600), x)
    seen = sorted(i for rows, below in zip(tree.inside, tree.below) if rows is not None for i in rows.tolist())
    assert seen == list(range(600))  # every row in one leaf

    def inside(node):
        return tree.inside[node].tolist() if tree.inside[node] is not None else [i for b in tree.below[node] for i in inside(b)]
    for q in np.floor(rng.normal(size=(20, 6)) * 300):
        scores = x @ q
        lower, upper = H._bounds(tree.centers @ q, tree.radii, float(q @ q) + tree.ceiling)
        for node in range(len(tree.radii)):
            mine = scores[tree.ids[inside(node)]]
            assert lower[node] <= mine.min() and mine.max() <= upper[node]
