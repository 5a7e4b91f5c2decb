"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors get one more coordinate that makes all norms equal (the largest norm's
rest), so the largest inner product is the least Euclidean distance, and are
rotated by a random orthogonal matrix.  They are spread over lists around
centroids; a query probes the lists nearest to it.  Within a probed list the
rotated coordinates are scanned in column blocks: after d of D coordinates the
scaled partial distance is an estimate of the whole, and a candidate is
abandoned once sqrt(D / d) times it exceeds (1 + EPSILON / sqrt(d)) times the
distance to beat - the test of the hypothesis that it is still near enough.
What survives all blocks is scored exactly on the original vectors.

Bounded, documented choices: centroids are fitted on at most ``SAMPLE``
vectors of smallest hash, without the ``HELD`` first of them; these are asked
for their neighbours in the whole table, and the number of lists to probe is
the least that finds ``TARGET`` of those.  The (k + 1)-th best distance within
the sample bounds every query's distance to beat from the start.  All results
come from the scan of probed lists: a query for which it finds fewer than
k + 1 vectors within that bound, though the sample has as many, probes
``WIDER`` times the lists, and in the end all of them without early tests.
Every vector is indexed.

Copies are found once: equal vectors are one candidate that keeps its k + 1
least ids (no other copy can be in a result, as ties go to smaller ids), and
equal queries are searched once.  Lists are dealt over shards of bounded size,
large lists over several, and queries visit shards in chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

K = 20
SAMPLE = 8192        # vectors that centroids and probes are fitted on
LISTS = 1024         # lists at most
HELD = 512           # sample vectors kept from the centroids, at most a quarter
TARGET = 0.985       # share of the held-out vectors' neighbours that probing has to find
WIDER = 4            # times the lists of the round before, for queries that found too few
EPSILON = 2.1
BLOCK = 16           # coordinates between two tests
SHARD, CHUNK = 2048, 2048


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part: not null, finite throughout, not zero, with an id; of equal length.

    Vectors of another length than most have no inner product with them and
    take no part (ties between lengths: the larger).
    """
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors (v, key) with their k + 1 least ids; in two steps, so that no task gets all copies of one."""
    salted = rows.select("v", "id", F.pmod(F.xxhash64("id"), F.lit(32)).alias("salt"))
    some = Window.partitionBy("v", "salt").orderBy("id")
    few = salted.withColumn("r", F.row_number().over(some)).where(F.col("r") <= k + 1)
    whole = Window.partitionBy("v").orderBy("id")
    few = few.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.xxhash64("v").alias("key"), "v", "ids")


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in coordinate order (the same for every batch shape)."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


class Plan:
    """What the driver fits on the bounded sample; shipped to the workers."""

    def __init__(self, sample: np.ndarray, sample_keys: np.ndarray, ceiling: float, count: int, k: int):
        rng = np.random.default_rng(17)
        self.k, self.ceiling, d = k, ceiling, sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(d + 1, d + 1)))[0]
        self.sample_lifted = self.lift(sample)
        held = min(HELD, len(sample) // 4)  # a sample of three or less is asked as it is
        self.held, self.held_keys = sample[:held or len(sample)], sample_keys[:held or len(sample)]
        lifted = self.sample_lifted[held:]
        n_lists = int(min(LISTS, max(1, round(math.sqrt(count))), len(lifted)))
        centers = lifted[rng.choice(len(lifted), n_lists, replace=False)]
        for _ in range(12):
            near = self._nearest(lifted, centers, 1)[:, 0]
            sums = np.zeros_like(centers)
            np.add.at(sums, near, lifted)
            size = np.bincount(near, minlength=n_lists)
            centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centers)
        self.centers = centers

    def probes(self, at: np.ndarray, lists: np.ndarray) -> int:
        """Lists to probe, from the (held-out vector, list) of neighbours in the whole table."""
        order = np.argsort(self._gaps(self.lift(self.held, True), self.centers), axis=1)
        needed = np.sort(np.argsort(order, axis=1)[at, lists])
        return int(needed[min(len(needed) - 1, math.ceil(TARGET * len(needed)))]) + 1 if len(needed) else 1

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors with the coordinate that makes norms equal (0 for queries)."""
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.ceiling - (x * x).sum(1), 0))
        return np.hstack((x, last[:, None])) @ self.rotation

    @staticmethod
    def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return (centers * centers).sum(1) - 2 * (x @ centers.T)

    def _nearest(self, x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
        gaps = self._gaps(x, centers)
        return gaps.argmin(1)[:, None] if n == 1 else np.argsort(gaps, axis=1, kind="stable")[:, :n]

    def first_bound(self, lifted: np.ndarray) -> np.ndarray:
        """A distance (squared) that the k-th neighbour can't exceed: the (k + 1)-th within the sample."""
        gaps = (lifted * lifted).sum(1)[:, None] + (self.sample_lifted ** 2).sum(1) - 2 * lifted @ self.sample_lifted.T
        if gaps.shape[1] <= self.k:
            return np.full(len(lifted), np.inf)
        return np.partition(gaps, self.k, axis=1)[:, self.k] * (1 + 1e-9) + 1e-9 * self.ceiling


def _rows(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def scan_list(plan: Plan, q, ql, x, xl, bound, block: int = BLOCK):
    """Pairs (query, candidate) of one list that survive every test, by blocks of coordinates."""
    dims = xl.shape[1]
    alive_q, alive_x, partial = None, None, None
    for at in range(0, dims, block):
        to = min(dims, at + block)
        a, b = ql[:, at:to], xl[:, at:to]
        slack = (1 + EPSILON / math.sqrt(to)) ** 2 if to < dims else 1 + 1e-9
        if alive_q is None:
            gaps = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
            keep = gaps * (dims / to) <= bound[:, None] * slack
            alive_q, alive_x = np.nonzero(keep)
            partial = gaps[alive_q, alive_x]
        else:
            diff = a[alive_q] - b[alive_x]
            partial = partial + (diff * diff).sum(1)
            keep = partial * (dims / to) <= bound[alive_q] * slack
            alive_q, alive_x, partial = alive_q[keep], alive_x[keep], partial[keep]
    return alive_q, alive_x


def _probes(listed: DataFrame, shared, k: int) -> int:
    """Lists to probe: the held-out vectors' k nearest in the whole table, by one pass over it."""
    def ask(batches):
        p = shared.value
        score = np.full((len(p.held), k), -np.inf)
        home = np.zeros((len(p.held), k), np.int32)
        for pdf in batches:
            if len(pdf):
                product = p.held @ _rows(pdf["v"]).T
                product[p.held_keys[:, None] == pdf["key"].to_numpy()] = -np.inf
                score = np.hstack((score, product))
                home = np.hstack((home, np.broadcast_to(pdf["list"].to_numpy(np.int32), product.shape)))
                best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, home = np.take_along_axis(score, best, 1), np.take_along_axis(home, best, 1)
        at, place = np.nonzero(score > -np.inf)
        yield pd.DataFrame({"at": at.astype(np.int32), "list": home[at, place], "score": score[at, place]})
    best = Window.partitionBy("at").orderBy(F.desc("score"), "list")
    found = (listed.select("key", "v", "list").mapInPandas(ask, "at int, list int, score double")
             .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("at", "list").toPandas())  # HELD * k rows
    return shared.value.probes(found["at"].to_numpy(int), found["list"].to_numpy(int))


def nearest(vectors: DataFrame, queries, k: int = K, id_column: str = "vec_id", column: str = "embedding",
            sample: int = SAMPLE) -> DataFrame:
    """The k nearest by inner product: query_id, rank (from 1), vec_id, score.

    ``queries`` is a condition on the id column (say ``"vec_id % 20 = 0"``); a
    query's own row is no candidate.  Equal scores go to smaller ids.  Null,
    zero or non-finite vectors take no part, neither do null ids; of rows that
    repeat an id with the same vector one takes part; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors, id_column, column).distinct())
    empty = "query_id long, rank int, vec_id long, score double"
    found = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not found[0]:
        return spark.createDataFrame([], empty)
    base = cut_lineage(_distinct(rows, k))
    picked = base.orderBy(F.xxhash64("key", F.lit(5)), "key").limit(sample).select("v", "key").toPandas()
    plan = Plan(_rows(picked["v"]), picked["key"].to_numpy(), float(found[1]), int(found[0]), k)
    shared = spark.sparkContext.broadcast(plan)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                p = shared.value
                v = _rows(pdf["v"])
                pdf["list"] = p._nearest(p.lift(v), p.centers, 1)[:, 0].astype(np.int32)
                yield pdf
    listed = cut_lineage(base.mapInPandas(assign, "key long, v array<double>, ids array<long>, list int"))
    # lists dealt over shards of bounded size; one row per list
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}
    first, parts, shard, room = {}, {}, -1, 0
    for name in sorted(sizes):
        n = sizes[name]
        if n > SHARD:
            parts[name] = math.ceil(n / SHARD)
            first[name], shard, room = shard + 1, shard + parts[name], 0
        else:
            if n > room:
                shard, room = shard + 1, SHARD
            first[name], parts[name] = shard, 1
            room -= n
    table = pd.DataFrame({"list": list(first), "first": [first[x] for x in first], "parts": [parts[x] for x in first]})
    dealt = F.broadcast(spark.createDataFrame(table.astype("int32"), "list int, first int, parts int"))  # LISTS rows

    asked = rows.where(F.expr(queries.replace(id_column, "id"))).select("v", F.col("id"))
    wanted = asked.groupBy("v").agg(F.count("*").alias("c")).select(F.xxhash64("v").alias("key"), "v")
    wanted = cut_lineage(wanted)
    probes, n_lists, least = _probes(listed, shared, k), len(plan.centers), min(k + 1, base.count())
    hits, short, left = None, wanted, wanted.count()
    while left or hits is None:
        got = cut_lineage(_scan(short, max(1, math.ceil(left / CHUNK)), shared, listed, dealt, first, parts, probes))
        hits = got if hits is None else hits.unionByName(got)
        if probes >= n_lists:
            break
        enough = got.groupBy("key").count().where(F.col("count") >= least)
        short = cut_lineage(short.join(enough, "key", "left_anti").select("key", "v"))
        left, probes = short.count(), min(n_lists, WIDER * probes)
    # k + 1 best rows of every distinct query, then its own id goes
    each = hits.select("key", F.explode("ids").alias("vec_id"), "score").distinct()
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    top = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    named = asked.select(F.xxhash64("v").alias("key"), F.col("id").alias("query_id"))
    mine = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (named.join(top, "key").select("query_id", F.posexplode(mine).alias("pos", "hit"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                    F.col("hit.score").alias("score")))


def _scan(wanted: DataFrame, chunks: int, shared, listed: DataFrame, dealt: DataFrame, first: dict, parts: dict,
          probes: int) -> DataFrame:
    """Per query and shard the best k + 1 vectors (and ties) of the lists nearest to it: key, ids, score.

    With all lists probed all coordinates are one block: nothing is abandoned on a part of them.
    """
    def visit(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            p = shared.value
            v = _rows(pdf["v"])
            lifted = p.lift(v, True)
            bound = p.first_bound(lifted)
            out = {"shard": [], "row": [], "lists": []}
            for i, lists in enumerate(p._nearest(lifted, p.centers, max(2, probes))[:, :probes]):
                by: dict[int, list[int]] = {}
                for name in lists.tolist():
                    for s in range(first.get(name, 0), first.get(name, 0) + parts.get(name, 0)):
                        by.setdefault(s, []).append(name)
                for s, names in by.items():
                    out["shard"].append(s)
                    out["row"].append(i)
                    out["lists"].append(names)
            r = np.array(out["row"], int)
            yield pd.DataFrame({"shard": np.array(out["shard"], np.int32), "chunk": (pdf["key"].to_numpy()[r] % chunks).astype(np.int32),
                                "key": pdf["key"].to_numpy()[r], "v": pdf["v"].iloc[r].to_numpy(),
                                "bound": bound[r], "lists": out["lists"]})
    visits = wanted.mapInPandas(visit, "shard int, chunk int, key long, v array<double>, bound double, lists array<int>")
    shards = (listed.join(dealt, "list")
              .withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int"))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
              .select("shard", "chunk", "list", "v", "ids"))

    def search(left, right):
        cols = {"key": [], "ids": [], "score": []}
        if len(left) and len(right):
            p = shared.value
            q, x = _rows(left["v"]), _rows(right["v"])
            ql, xl = p.lift(q, True), p.lift(x)
            bound = left["bound"].to_numpy().copy()
            block = BLOCK if probes < p.centers.shape[0] else ql.shape[1]
            probed = np.zeros((len(left), p.centers.shape[0]), bool)
            for i, names in enumerate(left["lists"]):
                probed[i, list(names)] = True
            list_of = right["list"].to_numpy()
            got_q, got_x, got_s = [], [], []
            for name in np.unique(list_of):
                qi, xi = np.flatnonzero(probed[:, name]), np.flatnonzero(list_of == name)
                if not len(qi):
                    continue
                a, b = scan_list(p, q[qi], ql[qi], x[xi], xl[xi], bound[qi], block)
                got_q.append(qi[a])
                got_x.append(xi[b])
                got_s.append(_dot(q[qi[a]], x[xi[b]]))
            a, b, s = (np.concatenate(z) if z else np.zeros(0, int) for z in (got_q, got_x, got_s))
            order = np.lexsort((-s, a))
            a, b, s = a[order], b[order], s[order]
            start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
            place = np.arange(len(a)) - np.repeat(start, np.diff(np.concatenate((start, [len(a)]))))
            # the best k + 1 and all that tie with the last of them
            last = np.full(len(q), -np.inf)
            at = place == p.k
            last[a[at]] = s[at]
            keep = s >= last[a]
            cols = {"key": left["key"].to_numpy()[a[keep]], "ids": right["ids"].to_numpy()[b[keep]], "score": s[keep]}
        return pd.DataFrame(cols)
    return (visits.groupBy("shard", "chunk").cogroup(shards.groupBy("shard", "chunk"))
            .applyInPandas(search, "key long, ids array<long>, score double"))
