"""Hard negatives by cover trees over norm-augmented candidates.

Vectors are integers (floor of ``SCALE`` times a component) and a score is an
inner product.  A candidate x gets one more coordinate, sqrt(M^2 - |x|^2), so
that all candidates have norm M; for a query q (whose added coordinate is 0)

    score = (|q|^2 + M^2 - distance^2) / 2.

So a ball with centre c and covering radius r around candidates bounds their
scores from both sides:

    (|q|^2 + M^2 - (d + r)^2) / 2  <=  score  <=  (|q|^2 + M^2 - max(d - r, 0)^2) / 2,   d = |q - c|.

Candidates are spread over pivots (a farthest-first net of a bounded sample,
the tree's top level), those of a pivot over shards of about ``SHARD`` rows by
their ids, and every shard gets a cover tree: a node's children are a net whose
centres lie more than radius / ``BASE`` apart and cover its rows within that,
down to leaves of ``LEAF`` rows; covering radii are the true ones.

A search descends best-first by upper bounds, for a block of anchors at once.
It skips nodes outside all windows of scores and those that can't beat what a
window has found; leaves are scored exactly.  First come the positives (one
window without an upper end), then the negatives, a window per positive.  A
window visits only pivots whose ball may hold what it looks for; the best of
the sample tell from the start what has to be beaten, and give no results.

Exactness: vectors with a squared norm of 2^53 or more take no part, so every
partial sum of a score is an integer that a double holds.  Bounds get a margin
over rounding (``MARGIN``).
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import binary_column, shuffle_width

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95    # percent of a positive's score that a negative's lies between
SAMPLE = 4096         # candidates that pivots and first bounds are taken from
PIVOTS = 256          # at most
SHARD = 1024          # rows of a tree, about
LEAF, BASE, FEW = 48, 1.3, 8
ASKED = 256           # anchors that one row of questions holds
MOST_NORM = 1 << 53
MARGIN = 1e-12


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str | Column = "label",
              scale: int = SCALE) -> DataFrame:
    """(id, label, v array<int>) of the vectors that take part.

    Rows without id, label or vector, or with a null or non-finite component,
    take no part, nor do vectors of another length than most (ties: the
    larger) or with a quantised squared norm of 2^53 or more.  Of rows that
    repeat an id, the one of least label, then vector, counts.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(
        F.col(column), lambda x: x.cast("double") * F.lit(float(scale))).alias("x")).where(
        "id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    far = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(1 << 31)))
    rows = rows.where(~F.coalesce(far, F.lit(True)))
    rows = rows.select("id", "label", F.transform("x", lambda x: F.floor(x).cast("int")).alias("v"))
    rows = rows.where(_square() < float(MOST_NORM))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("v") == (size["n"] if size else 0))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def _square() -> Column:
    return F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of equal lengths."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), width)


def _lift(x: np.ndarray, ceiling: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(ceiling - (x * x).sum(1), 0))[:, None]))


def _bounds(ip: np.ndarray, radius: np.ndarray, whole):
    """(lower, upper) bounds of scores in balls; ``ip`` of query and centre, ``whole`` = |q|^2 + M^2."""
    d = np.sqrt(np.maximum(whole - 2 * ip, 0))
    slack = MARGIN * whole + 1e-6
    return (whole - (d + radius) ** 2) / 2 - slack, (whole - np.maximum(d - radius, 0) ** 2) / 2 + slack


@dataclass
class Asked:
    """Anchors and their windows of scores; window i belongs to anchor ``of[i]`` and is its ``number[i]``-th."""
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    of: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def part(self, windows: np.ndarray) -> bytes:
        """Some of the windows with their anchors, packed."""
        anchors, of = np.unique(self.of[windows], return_inverse=True)
        return pickle.dumps((self.ids[anchors], self.labels[anchors], self.q[anchors], of, self.number[windows],
                             self.low[windows], self.high[windows]))


class CoverTree:
    """A cover tree over integer vectors; its attributes are plain lists and arrays, so that it travels as bytes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.ceiling = float((x * x).sum(1).max())
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.inside: list[np.ndarray | None] = []    # rows of a leaf
        self.below: list[list[int]] = []
        self.only: list[int | None] = []             # the label of all rows, if they share one
        lifted = _lift(self.x, self.ceiling)
        self._grow(lifted, np.arange(len(ids)), lifted[0])
        self.centers, self.radii = np.array(self.center)[:, :-1], np.array(self.radius)
        del self.center, self.radius

    def _grow(self, lifted: np.ndarray, rows: np.ndarray, center: np.ndarray) -> int:
        gaps = np.sqrt(((lifted[rows] - center) ** 2).sum(1))
        me, radius = len(self.center), float(gaps.max())
        labels = np.unique(self.labels[rows])
        self.center.append(center)
        self.radius.append(radius * (1 + 1e-12))
        self.only.append(int(labels[0]) if len(labels) == 1 else None)
        self.below.append([])
        self.inside.append(rows if len(rows) <= LEAF or radius == 0 else None)
        if self.inside[me] is not None:
            return me
        near, owner, n = gaps.copy(), np.zeros(len(rows), np.int64), 1
        centers = [center]
        while near.max() > radius / BASE:  # a farthest-first net: its centres are further apart than it covers
            centers.append(lifted[rows[int(near.argmax())]])
            gaps = np.sqrt(((lifted[rows] - centers[-1]) ** 2).sum(1))
            closer = gaps < near
            near[closer], owner[closer] = gaps[closer], n
            n += 1
        size = np.bincount(owner, minlength=n)
        strays = size[owner] < FEW
        for i in np.flatnonzero(size >= FEW):
            self.below[me].append(self._grow(lifted, rows[owner == i], centers[i]))
        if strays.all():
            self.inside[me] = rows  # nothing here lies close together
        elif strays.any():
            self.below[me].append(self._stray(lifted, rows[strays], center))
        return me

    def _stray(self, lifted: np.ndarray, rows: np.ndarray, center: np.ndarray) -> int:
        """A leaf of the rows that are too few around their own centres."""
        self.center.append(center)
        self.radius.append(float(np.sqrt(((lifted[rows] - center) ** 2).sum(1)).max()) * (1 + 1e-12))
        labels = np.unique(self.labels[rows])
        self.only.append(int(labels[0]) if len(labels) == 1 else None)
        self.below.append([])
        self.inside.append(rows)
        return len(self.inside) - 1

    def search(self, asked: Asked, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, id, score) of the ``k`` best rows in each of the windows; ties to smaller ids.

        Rows of the same label as the anchor's, without itself, or of other
        labels.  All anchors descend together: the node that promises most to
        any open window comes first, and it is looked at for those anchors
        only that have a window open there.
        """
        q, of, high = asked.q, asked.of, asked.high
        whole = (q * q).sum(1) + self.ceiling
        floor, best = asked.low.copy(), np.full((len(of), k), -np.inf)
        todo: list = []
        found: list = []

        def push(nodes: list[int]) -> None:
            lower, upper = _bounds(self.centers[nodes] @ q.T, self.radii[nodes][:, None], whole)
            for node, lo, up in zip(nodes, lower, upper):
                if self.only[node] is not None:
                    up = np.where((asked.labels == self.only[node]) == same, up, -np.inf)
                open_ = (up[of] >= floor) & (lo[of] <= high)
                if open_.any():
                    heapq.heappush(todo, (-float(up[of[open_]].max()), node, lo, up))
        push([0])
        while todo:
            _, node, lo, up = heapq.heappop(todo)
            open_ = np.flatnonzero((up[of] >= floor) & (lo[of] <= high))
            if not len(open_):
                continue
            rows = self.inside[node]
            if rows is None:
                push(self.below[node])
                continue
            anchors, mine = np.unique(of[open_], return_inverse=True)
            fits = (self.labels[rows] == asked.labels[anchors][:, None]) == same
            if same:
                fits &= self.ids[rows] != asked.ids[anchors][:, None]
            scores = np.where(fits, q[anchors] @ self.x[rows].T, -np.inf)[mine]
            hit = (scores >= floor[open_][:, None]) & (scores <= high[open_][:, None])
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                continue
            at, row = np.nonzero(hit)
            found.append((open_[at], self.ids[rows[row]], scores[at, row]))
            here = open_[some]
            merged = np.hstack((best[here], np.where(hit[some], scores[some], -np.inf)))
            best[here] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
            floor[here] = np.maximum(floor[here], best[here].min(1))  # equal scores may still bring a smaller id
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        win, ids, scores = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((ids, -scores, win))
        win, ids, scores = win[order], ids[order], scores[order]
        rank = np.arange(len(win)) - np.searchsorted(win, win)
        return win[rank < k], ids[rank < k], scores[rank < k]


class Pivots:
    """The tree's top level, fitted on the driver from the bounded sample."""

    def __init__(self, ids, labels, x, ceiling: float, count: int):
        self.ids, self.labels, self.x, self.ceiling = ids, labels, x, ceiling
        lifted = _lift(x, ceiling)
        most = min(PIVOTS, max(1, round(math.sqrt(count / SHARD) * 4)), len(x))
        chosen, near = [0], ((lifted - lifted[0]) ** 2).sum(1)
        while len(chosen) < most and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
        self.centers = lifted[chosen]
        self.radii = np.zeros(len(chosen))
        self.there = np.zeros(len(chosen), bool)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance to it) of every row."""
        lifted = _lift(x, self.ceiling)
        gaps = (self.centers ** 2).sum(1) - 2 * lifted @ self.centers.T
        at = gaps.argmin(1)
        return at, np.sqrt(((lifted - self.centers[at]) ** 2).sum(1))

    def visits(self, asked: Asked) -> np.ndarray:
        """Which pivots may hold scores of each window (windows x pivots)."""
        whole = (asked.q * asked.q).sum(1)[:, None] + self.ceiling
        lower, upper = _bounds(asked.q @ self.centers[:, :-1].T, self.radii, whole)
        return (upper[asked.of] >= asked.low[:, None]) & (lower[asked.of] <= asked.high[:, None]) & self.there


def _place(pivots: Pivots, width: int):
    def run(batches):
        for rb in batches:
            if rb.num_rows:
                at, gap = pivots.place(_matrix(rb.column("v"), width))
                yield pa.RecordBatch.from_arrays(
                    [*rb.columns, pa.array(at.astype(np.int32)), pa.array(gap)], [*rb.schema.names, "pivot", "gap"])
    return run


def _plant(width: int):
    def run(table: pa.Table) -> pa.Table:
        tree = CoverTree(table["id"].to_numpy(), table["label"].to_numpy(), _matrix(table["v"].combine_chunks(), width))
        return pa.table({"pivot": table["pivot"].slice(0, 1), "sub": table["sub"].slice(0, 1),
                         "tree": binary_column([pickle.dumps(vars(tree))])})
    return run


def _ask(pivots: Pivots, width: int, same: bool, k: int, low: int, high: int):
    """Questions by pivot: rows (pivot, asked) with up to ``ASKED`` anchors each.

    An anchor's windows: all scores for positives, else one per positive
    score.  The sample's ``k``-th best in a window is the least that counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for start in range(0, rb.num_rows, ASKED):
                part = rb.slice(start, ASKED)
                q = _matrix(part.column("v"), width)
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                if same:
                    of, number = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                    lows, highs = np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
                else:  # low% .. high% of each positive's score, in whole numbers
                    told = [(i, n, -(-low * p["score"] // 100), high * p["score"] // 100)
                            for i, positives in enumerate(part.column("found").to_pylist()) for n, p in enumerate(positives)]
                    of, number = np.array([t[0] for t in told], np.int64), np.array([t[1] for t in told], np.int64)
                    lows, highs = np.array([t[2] for t in told], np.float64), np.array([t[3] for t in told], np.float64)
                scores = q @ pivots.x.T
                scores[(pivots.labels[None, :] == labels[:, None]) != same] = np.nan
                scores[pivots.ids[None, :] == ids[:, None]] = np.nan
                for w in range(len(of)):
                    mine = scores[of[w]]
                    fit = mine[(mine >= lows[w]) & (mine <= highs[w])]
                    if len(fit) >= k:
                        lows[w] = np.partition(fit, len(fit) - k)[len(fit) - k]
                asked = Asked(ids, labels, q, of, number, lows, highs)
                seen = pivots.visits(asked) & (lows <= highs)[:, None]
                for p in np.flatnonzero(seen.any(0)):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), binary_column([asked.part(np.flatnonzero(seen[:, p]))])],
                                                     ["pivot", "asked"])
    return run


def _search(same: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for rb in batches:
            for p, s, packed, asked in zip(rb.column("pivot").to_pylist(), rb.column("sub").to_pylist(),
                                           rb.column("tree"), rb.column("asked")):
                if (p, s) != last:
                    last, tree = (p, s), CoverTree.__new__(CoverTree)
                    vars(tree).update(pickle.loads(packed.as_buffer()))
                block = Asked(*pickle.loads(asked.as_buffer()))
                win, other, score = tree.search(block, same, k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.ids[block.of[win]]), pa.array(block.number[win].astype(np.int32)), pa.array(other),
                    pa.array(score.astype(np.int64))], ["id", "win", "other", "score"])
    return run


def hard_negatives(vectors: DataFrame, anchors: str | Column, id_column: str = "vec_id", column: str = "embedding",
                   label: str | Column = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the column ``id`` (the id).  An anchor's
    positives are its ``positives`` best other rows of the same label; for
    each of them the ``negatives`` best rows of other labels come whose score
    is ``low`` to ``high`` percent of the positive's (none for a negative
    score).  Higher scores come first, ties by smaller id.  An anchor without
    positives, or a positive without negatives, gives no rows.  See
    ``quantised`` for the rows that take part; other columns are ignored, and
    an empty table gives an empty result.  Every row is a candidate.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(quantised(vectors, id_column, column, label, scale))
    count, ceiling, width = rows.agg(F.count("*"), F.max(_square()), F.max(F.size("v"))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count or not width:
        return spark.createDataFrame([], out)
    told = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    pivots = Pivots(told["id"].to_numpy(), told["label"].to_numpy(), np.array(told["v"].tolist(), np.float64), ceiling, count)
    placed = cut_lineage(rows.mapInArrow(_place(pivots, width),
                                         "id long, label long, v array<int>, pivot int, gap double"))
    held = placed.groupBy("pivot").agg(F.max("gap").alias("gap"), F.ceil(F.count("*") / SHARD).cast("int").alias("subs"))
    for r in held.collect():  # at most PIVOTS rows
        pivots.radii[r["pivot"]], pivots.there[r["pivot"]] = r["gap"] * (1 + 1e-12) + 1e-9, True
    shards = placed.join(F.broadcast(held.select("pivot", "subs")), "pivot").select(
        "id", "label", "v", "pivot", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int").alias("sub"))
    tasks = shuffle_width(spark, count / (4 * SHARD))
    trees = cut_lineage(shards.repartition(tasks, "pivot", "sub").groupBy("pivot", "sub").applyInArrow(
        _plant(width), "pivot int, sub int, tree binary"))

    def found(asking: DataFrame, same: bool, k: int) -> DataFrame:
        asked = asking.mapInArrow(_ask(pivots, width, same, k, low, high), "pivot int, asked binary")
        asked = asked.join(F.broadcast(held.select("pivot", "subs")), "pivot").select(
            "pivot", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "asked")
        met = trees.join(asked, ["pivot", "sub"]).select("pivot", "sub", "tree", "asked")
        hits = met.mapInArrow(_search(same, k), "id long, win int, other long, score long")
        first = Window.partitionBy("id", "win").orderBy(F.desc("score"), "other")
        return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)

    asking = rows.where(anchors)
    close = cut_lineage(found(asking, True, positives).select("id", F.col("other").alias("positive"), "score", "rank"))
    listed = close.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive", "score"))).alias("found"))
    hard = found(asking.join(listed, "id"), False, negatives)
    return hard.join(close.withColumnsRenamed({"rank": "win", "score": "positive_score"}).withColumn(
        "win", F.col("win") - 1), ["id", "win"]).select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
