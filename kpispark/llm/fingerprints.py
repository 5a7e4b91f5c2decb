"""Document fingerprints of improbable features.

Every window of 64 bytes has an entropy (kept on a scale of 0 to 1000).  The
rarer an entropy is among all windows of the corpus, the better its windows
rank; windows of next to no entropy are left out.  Within any 64 neighbouring
windows the best-ranked one (the first of equals) gains a point, and windows
with ``MIN_POINTS`` or more points are a text's features (at least its best
one; a text shorter than a window is one feature).  A feature sets five bits
of a Bloom filter of 256 bytes; a filter takes 160 features, then the next one
of the chain begins.

Two fingerprints are compared filter by filter: common bits, less those that
chance would give, as a share of the most that could be common.  Each filter
of the shorter chain takes its best partner, and the mean is the likeness.

All windows of a batch of texts are worked on at once: counts of equal bytes
within 64 places by 63 shifted comparisons, entropies by an exact integer
running sum, best windows by six doubling minima.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, slices
from .wordhash import mix64, string_buffer

WINDOW, SCALE = 64, 1000
LEAST_ENTROPY = 100      # of SCALE
MIN_POINTS = 16
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
WORK_BYTES = 1 << 18     # text bytes that one step works on
BUCKET_ROWS = 50_000

_F = np.concatenate(([0], np.round(np.arange(1, WINDOW + 2) * np.log2(np.arange(1, WINDOW + 2)) * (1 << 16)))).astype(np.int64)
_STEP = np.concatenate(([0], np.diff(_F)))  # change of a byte's share when its count rises to n
_NONE = np.iinfo(np.int32).max


def entropies(buf: np.ndarray) -> np.ndarray:
    """Scaled entropy of every window of a buffer."""
    n = len(buf)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for s in range(1, WINDOW):
        same = (buf[:-s] == buf[s:]).view(np.uint8)
        ahead[:-s] += same
        behind[s:] += same
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = _F[np.bincount(buf[:WINDOW], minlength=256)].sum()
    leave, enter = ahead[:n - WINDOW].astype(np.intp), behind[WINDOW:].astype(np.intp)
    sums[1:] = _STEP[enter + 1] - _STEP[leave + 1]
    np.cumsum(sums, out=sums)
    top = int(_F[WINDOW])
    return ((top - sums) * SCALE // top).astype(np.int32)


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Windows that lie within one text."""
    ok = np.ones(max(0, n - WINDOW + 1), bool)
    for end in offsets[1:-1]:
        ok[max(0, end - WINDOW + 1):end] = False
    return ok


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SCALE + 1, np.int64)
    for rb in slices(batches, "text", WORK_BYTES):
        buf, offsets = string_buffer(rb.column("text"))
        if len(buf) >= WINDOW:
            total += np.bincount(entropies(buf)[_inside(offsets, len(buf))], minlength=SCALE + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SCALE + 1, dtype=np.int32)), pa.array(total)], ["entropy", "n"])


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of every entropy, the rarest among all windows of the corpus first (equals: the smaller entropy)."""
    got = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_histogram, "entropy int, n long")
           .groupBy("entropy").agg(F.sum("n").alias("n")).toPandas())
    n = np.zeros(SCALE + 1, np.int64)
    n[got["entropy"].to_numpy(int)] = got["n"].to_numpy(np.int64)
    ranks = np.empty(SCALE + 1, np.int32)
    ranks[np.argsort(n, kind="stable")] = np.arange(SCALE + 1)
    ranks[:LEAST_ENTROPY] = _NONE
    return ranks


def _best(rank: np.ndarray) -> np.ndarray:
    """Points of every window: how many runs of 64 windows it leads."""
    n = len(rank)
    wide = n + 2 * WINDOW >= 1 << 20
    kind, shift = (np.int64, 40) if wide else (np.int32, 20)
    key = np.full(n + 2 * (WINDOW - 1), np.iinfo(kind).max, kind)
    ok = np.flatnonzero(rank != _NONE)
    key[ok + WINDOW - 1] = (rank[ok].astype(kind) << shift) + ok.astype(kind)
    for w in (1, 2, 4, 8, 16, 32):
        key = np.minimum(key[:-w], key[w:])
    led = key[key != np.iinfo(kind).max] & ((1 << shift) - 1)
    return np.bincount(led, minlength=n)


def _feature_bits(windows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(windows).view("<u8")
    h = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[:, j] + np.uint64(j + 1))
    return h


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The chain of filters (rows of 32 words) of every text; an empty text has none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    owner, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(buf) >= WINDOW:
        rank = ranks[entropies(buf)]
        rank[~_inside(offsets, len(buf))] = _NONE
        points = _best(rank)
        chosen = np.flatnonzero(points >= MIN_POINTS)
        home = np.searchsorted(offsets, chosen, side="right") - 1
        without = np.setdiff1d(np.flatnonzero(sizes >= WINDOW), home)
        extra = [int(offsets[t] + points[offsets[t]:offsets[t + 1] - WINDOW + 1].argmax()) for t in without]
        at = np.sort(np.concatenate((chosen, np.array(extra, np.int64))))
        owner = np.searchsorted(offsets, at, side="right") - 1
        hashes = _feature_bits(np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[at]) if len(at) else hashes
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    if len(short):
        block = np.zeros((len(short), WINDOW), np.uint8)
        for i, t in enumerate(short):
            block[i, :sizes[t]] = np.frombuffer(texts[t], np.uint8)
            block[i, -1] = sizes[t]
        owner = np.concatenate((owner, short))
        hashes = np.concatenate((hashes, _feature_bits(block)))
        by = np.argsort(owner, kind="stable")
        owner, hashes = owner[by], hashes[by]
    # the first of equal features of a text stays
    by = np.lexsort((hashes, owner))
    again = np.zeros(len(owner), bool)
    again[1:] = (owner[by][1:] == owner[by][:-1]) & (hashes[by][1:] == hashes[by][:-1])
    keep = np.ones(len(owner), bool)
    keep[by[again]] = False
    owner, hashes = owner[keep], hashes[keep]
    count = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    chains = -(-count // PER_FILTER)
    first = np.cumsum(chains) - chains
    bits = np.zeros((int(chains.sum()), FILTER_BITS), bool)
    row = first[owner] + place // PER_FILTER
    for j in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * j)) & np.uint64(FILTER_BITS - 1)).astype(np.intp)] = True
    packed = np.packbits(bits, axis=1).view("<u8")
    return [packed[i:i + c] for i, c in zip(first, chains)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised overlap of two chains: 1 for equal ones (also two empty ones), 0 if only one is empty."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    best = 0.0
    for f, n in zip(a, na):
        common = np.bitwise_count(f & b).sum(1)
        chance = n * nb / FILTER_BITS
        room = np.maximum(np.minimum(n, nb) - chance, 1e-9)
        best += float(np.clip((common - chance) / room, 0, 1).max())
    return best / len(a)


def written(chain: np.ndarray) -> str:
    return f"{len(chain)}:" + base64.b64encode(chain.tobytes()).decode()


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _compare(ranks: np.ndarray):
    """Rows of a partition come by bucket, own rows before the carried one, in descending order of doc_id."""
    def pairs(now, following):
        edited = [t[:len(t) - len(t) // 2] + s[:len(t) // 2] for (_, t), s in zip(now, following)]
        raw = [x.encode("utf-8", "surrogatepass") for x in [t for _, t in now] + following + edited]
        prints, at = [], 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= WORK_BYTES):
                size += len(raw[to])
                to += 1
            prints += fingerprints(raw[at:to], ranks)
            at = to
        n = len(now)
        own, nxt, cut = prints[:n], prints[n:2 * n], prints[2 * n:]
        return pd.DataFrame({
            "doc_id": pd.array([d for d, _ in now], "Int64"), "n_chars": [len(t) for _, t in now],
            "edited_sha256": [hashlib.sha256(x).hexdigest() for x in raw[2 * n:]],
            "fingerprint": [written(x) for x in own], "edited_fingerprint": [written(x) for x in cut],
            "near_edited": [likeness(x, y) for x, y in zip(own, cut)],
            "near_next": [likeness(x, y) for x, y in zip(own, nxt)]})

    def run(batches):
        last = None
        for rb in slices(batches, "text", WORK_BYTES):
            rows = list(zip(rb.column("bucket").to_pylist(), rb.column("carried").to_pylist(),
                            rb.column("doc_id").to_pylist(), (t or "" for t in rb.column("text").to_pylist())))
            if last is not None:
                rows = [last, *rows]
            last = rows[-1]
            got = [((d, t), rows[i + 1][3]) for i, (b, c, d, t) in enumerate(rows[:-1]) if not c and rows[i + 1][0] == b]
            if got:
                yield pa.RecordBatch.from_pandas(pairs([x for x, _ in got], [s for _, s in got]), schema=_SCHEMA,
                                                 preserve_index=False)
    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                     ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                     ("near_next", pa.float64())])


def compare_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like they and the next document's are.

    The next document follows in descending doc_id (rows of one doc_id by
    text; rows without doc_id last); the last one's next is the first.  The
    edited text has its last floor(n_chars / 2) code points replaced by the
    next text's first.  Null texts are empty.  One document is its own next;
    an empty table stays empty.

    Documents are cut into buckets at quantiles of doc_id; the first rows of a
    bucket also go, as carried rows, to the bucket that comes before it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("o"))
    ids = rows.select("o")
    count = ids.count()
    if not count:
        return spark.createDataFrame([], _OUT)
    ranks = entropy_ranks(rows)
    n = shuffle_width(spark, count / BUCKET_ROWS)
    shares = [(i + 1) / n for i in range(n - 1)]
    cuts = sorted(set(ids.agg(F.percentile_approx("o", shares, 10_000)).first()[0])) if shares else []
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(o: pd.Series) -> pd.Series:  # buckets in descending order of doc_id
        return pd.Series((len(bounds) - np.searchsorted(bounds, o.to_numpy(np.int64))).astype(np.int32))
    firsts = ids.withColumn("bucket", bucket("o")).groupBy("bucket").agg(F.max("o").alias("o")).collect()  # one per bucket
    order = [r["bucket"] for r in sorted(firsts, key=lambda r: r["bucket"])]
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first bucket's rows go to the last one
    heads = {r["o"]: before[r["bucket"]] for r in firsts}
    head_ids, head_to = np.array(sorted(heads), np.int64), np.array([heads[o] for o in sorted(heads)], np.int32)

    @F.pandas_udf("array<struct<bucket:int,carried:int>>")
    def placed(o: pd.Series) -> pd.Series:
        x = o.to_numpy(np.int64)
        own = len(bounds) - np.searchsorted(bounds, x)
        at = np.minimum(np.searchsorted(head_ids, x), len(head_ids) - 1)
        return pd.Series([[{"bucket": int(b), "carried": 0}] + ([{"bucket": int(head_to[p]), "carried": 1}] if head_ids[p] == v else [])
                          for b, p, v in zip(own, at, x)])
    dealt = (rows.withColumn("p", F.explode(placed("o"))).select("p.bucket", "p.carried", "doc_id", "o", "text")
             .repartition(n, "bucket").sortWithinPartitions("bucket", "carried", F.desc("o"), "text")
             .select("bucket", "carried", "doc_id", "text"))
    return dealt.mapInArrow(_compare(ranks), _OUT)
