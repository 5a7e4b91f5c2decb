"""N-gram Jaccard join by prefix filtering under several global token orders.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is at least 0.75.  For a set of n shingles and any total order of all
shingles, a partner must share one of the set's first n - ceil(0.75 n) + 1
("prefix") shingles.  All orders used here put rare shingles first (number of
distinct sets that hold them), and differ in how they break ties, by hash.

1. Each document's set is hashed (64 bits a shingle) and named by a 64-bit
   key over the whole set, so exact copies share one key and are compared
   once.  Shingles that fill a share of a batch ("heavy") are listed; at most
   ``HEAVY_SHARE`` x the mean set size of them can exist, whatever the input.
2. Shingles travel to hash buckets as packed numbers and are counted there.
   A shingle that only one set holds can't be shared: as such shingles head
   every order, a set with more of them than its prefix is long has no
   partner.  Usually this leaves little but near copies.
3. The rest are grouped by shared prefix shingles of the first order (each
   shingle ties its sets to the least of them: linear, no pairs), and the
   groups are cut into square tiles of bounded size.
4. Within a tile a pair becomes a candidate only if the prefixes of *every*
   order intersect and the sizes allow it; candidates are verified exactly.
   A tile gives a spanning forest of its links and each set's number of links.

Heavy shingles skip the buckets of step 2 (a third of all sets might hold
one) and keep their listed counts.  Everything is a function of the row, so
lost tasks are recomputed alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import binary_column, fresh, shuffle_width, slices
from .components import connected
from .wordhash import mix64, shingle_hashes, string_buffer, word_hashes

WIDTH = 5            # words in a shingle
PERCENT = 75         # least similarity, in hundredths
ORDERS = 3           # global token orders whose filters are intersected
HEAVY_SHARE = 512    # heavy: in at least 1/512 of a batch's documents (and in 8)
BUCKET_TOKENS = 2_000_000
TILE_SETS = 1024     # sets on a side of a verification tile
HOT_SETS = 512       # a set with this part of all documents has its result broadcast
BROADCAST_ROWS = 500_000  # of (key, label) pairs: 8 MB of data; larger tables are joined by shuffle

_RUN = np.dtype([("key", "<i8"), ("run", "<u4")])


def prefix_length(n, percent: int = PERCENT):
    """Shingles of a set of n that any partner must share one of."""
    return n - (percent * n + 99) // 100 + 1


def _sets(rb: pa.RecordBatch, width: int):
    buf, offsets = string_buffer(rb.column("text"))
    tokens, sizes = shingle_hashes(*word_hashes(buf, offsets), width)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(tokens ^ np.uint64(0xA24BAED4963EE407)))))
    ends = np.cumsum(sizes)
    keys = mix64(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
    return tokens, sizes, keys


def _members(width: int):
    """Rows of kind 0: document, set size, set key; of kind 1: a heavy shingle and its documents."""
    def run(batches):
        for rb in slices(batches, "text"):
            tokens, sizes, keys = _sets(rb, width)
            least = max(8, len(sizes) // HEAVY_SHARE)
            heavy, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if len(tokens):
                ordered = np.sort(tokens)
                at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                times = np.diff(np.concatenate((at, [len(ordered)])))
                heavy, times = ordered[at][times >= least], times[times >= least]
            n = rb.num_rows
            ids = rb.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([0, 1], np.int32), [n, len(heavy)])),
                 pa.concat_arrays([ids, pa.nulls(len(heavy), pa.int64())]),
                 pa.array(np.concatenate((sizes, times))),
                 pa.array(np.concatenate((keys, heavy.view(np.int64))))], ["kind", "doc_id", "n", "key"])
    return run


def _to_buckets(width: int, buckets: int, doc_buckets: int, heavy: np.ndarray):
    """Pack each slice's shingles by hash bucket: runs of (set, number) and 5 bytes a shingle.

    Buckets from ``buckets`` on take heavy shingles, by set, as places in ``heavy``;
    there every set has a run of its size first, under the name -1 - bucket.
    """
    def run(batches):
        for rb in slices(batches, "text"):
            tokens, sizes, keys = _sets(rb, width)
            if not len(tokens):
                continue
            # one row for a set and slice is enough: copies bring nothing new
            _, pick = np.unique(keys, return_index=True)
            once = np.zeros(len(keys), bool)
            once[pick] = True
            once &= sizes > 0
            owner = np.repeat(np.arange(len(keys)), sizes)
            keep = once[owner]
            tokens, owner = tokens[keep], owner[keep]
            bucket = (((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint32)
            value = tokens & np.uint64(0xFFFFFFFFFF)
            if len(heavy):
                place = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
                is_heavy = heavy[place] == tokens
                home = buckets + (keys[owner].view(np.uint64) % np.uint64(doc_buckets)).astype(np.uint32)
                bucket[is_heavy] = home[is_heavy]
                value[is_heavy] = place[is_heavy].astype(np.uint64)
            bucket = bucket.astype(np.uint16 if buckets + doc_buckets < 65536 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, owner = bucket[order], owner[order]
            packed = value[order].view(np.uint8).reshape(-1, 8)[:, :5]
            new = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]))))
            runs = np.zeros(len(new), _RUN)
            runs["key"] = keys[owner[new]]
            runs["run"] = np.diff(np.concatenate((new, [len(owner)])))
            at = np.flatnonzero(np.concatenate(([True], bucket[new][1:] != bucket[new][:-1])))
            to = np.concatenate((at[1:], [len(new)]))
            ends = np.concatenate((new, [len(owner)]))
            names = bucket[new][at].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names),
                 binary_column([runs[i:j].tobytes() for i, j in zip(at, to)]),
                 binary_column([packed[ends[i]:ends[j]].tobytes() for i, j in zip(at, to)])],
                ["bucket", "runs", "tokens"])
    return run


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype)


_SHARED = pa.schema([("home", pa.int32()), ("runs", pa.binary()), ("tokens", pa.binary()), ("freqs", pa.binary())])


def _shared(buckets: int, doc_buckets: int, heavy_times: np.ndarray):
    """Shingles of one bucket that several sets hold, sent to the sets' own buckets."""
    def run(t: pa.Table) -> pa.Table:
        name = t.column("bucket")[0].as_py()
        runs = _joined(t.column("runs"), _RUN)
        raw = _joined(t.column("tokens"), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        tokens = wide.view("<u8").ravel()
        # each copy of a set brings the same run: keep one
        _, first = np.unique(runs["key"], return_index=True)
        kept = np.zeros(len(runs), bool)
        kept[first] = True
        keep = np.repeat(kept, runs["run"])
        tokens, runs = tokens[keep], runs[kept]
        keys = np.repeat(runs["key"], runs["run"])
        if name >= buckets:
            freq = heavy_times[tokens.astype(np.int64)]
            tokens = tokens | np.uint64(0xFFFF << 40)
        else:
            order = np.argsort(tokens)
            ordered = tokens[order]
            at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            times = np.diff(np.concatenate((at, [len(ordered)])))
            freq = np.empty(len(tokens), np.int64)
            freq[order] = np.repeat(times, times)
            tokens = tokens | np.uint64((name % 0xFFFF) << 40)
        many = freq >= 2
        tokens, keys, freq = tokens[many], keys[many], freq[many]
        home = (keys.view(np.uint64) % np.uint64(doc_buckets)).astype(np.int32)
        order = np.lexsort((keys, home))
        tokens, keys, freq, home = tokens[order], keys[order], freq[order].astype("<u4"), home[order]
        rows = []
        at = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(home) else np.zeros(0, int)
        for i, j in zip(at, np.concatenate((at[1:], [len(home)])).astype(int)):
            k = keys[i:j]
            new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            r = np.zeros(len(new), _RUN)
            r["key"], r["run"] = k[new], np.diff(np.concatenate((new, [len(k)])))
            rows.append((int(home[i]), r.tobytes(), tokens[i:j].astype("<u8").tobytes(), freq[i:j].tobytes()))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, _SHARED)], schema=_SHARED)
    return run


_ALIVE = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("weight", pa.int64()), ("tokens", pa.binary()),
                    ("freqs", pa.binary())])


def _alive(percent: int):
    """Sets of one bucket that may have a partner, with the shingles that they share with others.

    Rows without shingles name the sets: runs of (key, size) and, in tokens, their documents.
    """
    def run(t: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], f.type) for f in _ALIVE], schema=_ALIVE)
        named = t.column("freqs").is_null().to_numpy()
        if named.all():
            return empty
        sizes = t.filter(pa.array(named))
        rows = t.filter(pa.array(~named))
        info = _joined(sizes.column("runs"), _RUN)
        weights = _joined(sizes.column("tokens"), "<i8")
        runs = _joined(rows.column("runs"), _RUN)
        tokens, freqs = _joined(rows.column("tokens"), "<u8"), _joined(rows.column("freqs"), "<u4")
        keys = np.repeat(runs["key"], runs["run"])
        order = np.lexsort((tokens, keys))
        tokens, freqs, keys = tokens[order], freqs[order], keys[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        to = np.concatenate((at[1:], [len(keys)]))
        by = np.argsort(info["key"])
        place = by[np.searchsorted(info["key"][by], keys[at])]
        n = info["run"][place].astype(np.int64)
        ok = np.flatnonzero(n - (to - at) < prefix_length(n, percent))
        return pa.table([pa.array(keys[at][ok]), pa.array(n[ok]), pa.array(weights[place][ok]),
                         binary_column([tokens[at[i]:to[i]].tobytes() for i in ok]),
                         binary_column([freqs[at[i]:to[i]].tobytes() for i in ok])], schema=_ALIVE)
    return run


def _sizes_rows(batches):
    """(home, key, n, documents) rows packed like the shingles' rows."""
    for rb in batches:
        home = rb.column("home").to_numpy()
        order = np.argsort(home, kind="stable")
        runs = np.zeros(len(home), _RUN)
        runs["key"], runs["run"] = rb.column("key").to_numpy()[order], rb.column("n").to_numpy()[order]
        weights = rb.column("weight").to_numpy()[order].astype("<i8")
        home = home[order]
        at = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(home) else np.zeros(0, int)
        to = np.concatenate((at[1:], [len(home)])).astype(int)
        yield pa.RecordBatch.from_arrays(
            [pa.array(home[at], pa.int32()), binary_column([runs[i:j].tobytes() for i, j in zip(at, to)]),
             binary_column([weights[i:j].tobytes() for i, j in zip(at, to)]), pa.nulls(len(at), pa.binary())],
            schema=_SHARED)


def prefix_tokens(tokens: np.ndarray, freqs: np.ndarray, n: int, order: int, percent: int = PERCENT) -> np.ndarray:
    """A set's shared prefix shingles under one order (those that no other set holds come before them)."""
    left = prefix_length(n, percent) - (n - len(tokens))
    if left <= 0:
        return tokens[:0]
    tie = mix64(tokens ^ np.uint64(0x632BE59BD9B4E019 * (order + 1) & 0xFFFFFFFFFFFFFFFF))
    return tokens[np.lexsort((tie, freqs))[:left]]


def _first_order(percent: int):
    def run(batches):
        for rb in batches:
            keys, n = rb.column("key").to_numpy(), rb.column("n").to_numpy()
            got = [prefix_tokens(np.frombuffer(t.as_py(), "<u8"), np.frombuffer(f.as_py(), "<u4"), int(n[i]), 0, percent)
                   for i, (t, f) in enumerate(zip(rb.column("tokens"), rb.column("freqs")))]
            if got:
                flat = np.concatenate(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.view(np.int64)), pa.array(np.repeat(keys, [len(x) for x in got]))], ["token", "key"])
    return run


def _verify(n, tokens, freqs, left, right, percent: int, orders: int):
    """Linked pairs (i, j), i from ``left`` and j from ``right`` (places; the same range for a diagonal tile)."""
    same = left is right
    rows, cols = len(left), len(right)
    cand = np.ones((rows, cols), bool)
    nl, nr = n[left], n[right]
    cand &= 100 * np.minimum.outer(nl, nr) >= percent * np.maximum.outer(nl, nr)
    for order in range(orders):
        if not cand.any():
            break
        pl = [prefix_tokens(tokens[i], freqs[i], int(n[i]), order, percent) for i in left]
        pr = pl if same else [prefix_tokens(tokens[i], freqs[i], int(n[i]), order, percent) for i in right]
        cand &= _product(pl, pr, same) > 0
    if same:
        cand &= np.triu(np.ones((rows, cols), bool), 1)
    li, rj = np.flatnonzero(cand.any(1)), np.flatnonzero(cand.any(0))
    if not len(li):
        return np.zeros((0, 2), int)
    inter = _product([tokens[left[i]] for i in li], [tokens[right[j]] for j in rj], False).astype(np.int64)
    union = nl[li][:, None] + nr[rj][None, :] - inter
    i, j = np.nonzero(cand[np.ix_(li, rj)] & (100 * inter >= percent * union))
    return np.stack((li[i], rj[j]), 1)


def _product(a: list[np.ndarray], b: list[np.ndarray], same: bool, block: int = 2048) -> np.ndarray:
    """Common members of every set of ``a`` with every set of ``b``, by dense blocks of members."""
    fa = np.concatenate(a) if a else np.zeros(0, np.uint64)
    fb = fa if same else (np.concatenate(b) if b else np.zeros(0, np.uint64))
    names, place = np.unique(np.concatenate((fa, fb)), return_inverse=True)
    pa_, pb_ = place[:len(fa)], place[len(fa):]
    oa = np.repeat(np.arange(len(a)), [len(x) for x in a])
    ob = oa if same else np.repeat(np.arange(len(b)), [len(x) for x in b])
    if same:
        pb_ = pa_
    both = np.bincount(pa_, minlength=len(names)) * np.bincount(pb_, minlength=len(names))
    useful = both > (1 if same else 0)
    slot = np.cumsum(useful) - 1
    out = np.zeros((len(a), len(b)), np.float32)
    ka, kb = useful[pa_], useful[pb_]
    sa, oa, sb, ob = slot[pa_[ka]], oa[ka], slot[pb_[kb]], ob[kb]
    ia, ib = np.argsort(sa, kind="stable"), np.argsort(sb, kind="stable")
    sa, oa, sb, ob = sa[ia], oa[ia], sb[ib], ob[ib]
    for at in range(0, int(useful.sum()), block):
        i, j = np.searchsorted(sa, (at, at + block))
        x = np.zeros((len(a), block), np.float32)
        x[oa[i:j], sa[i:j] - at] = 1
        if same:
            y = x
        else:
            i, j = np.searchsorted(sb, (at, at + block))
            y = np.zeros((len(b), block), np.float32)
            y[ob[i:j], sb[i:j] - at] = 1
        out += x @ y.T
    return out


def _tile(percent: int, orders: int):
    """Verify the tiles of one pack: per set its links' documents and a root of its linked sets."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, one, two), g in pdf.groupby(["label", "one", "two"], sort=False):
            keys, n, weight = g["key"].to_numpy(), g["n"].to_numpy(), g["weight"].to_numpy()
            tokens = [np.frombuffer(t, "<u8") for t in g["tokens"]]
            freqs = [np.frombuffer(f, "<u4") for f in g["freqs"]]
            if one == two:
                left = right = np.arange(len(keys))
            else:
                side = g["block"].to_numpy()
                left, right = np.flatnonzero(side == one), np.flatnonzero(side == two)
            pairs = _verify(n, tokens, freqs, left, right, percent, orders)
            if not len(pairs):
                continue
            i, j = left[pairs[:, 0]], right[pairs[:, 1]]
            links = np.bincount(i, weight[j], len(keys)) + np.bincount(j, weight[i], len(keys))
            root = np.arange(len(keys))
            while True:  # least place of the linked sets, by repeated minima
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            got = np.flatnonzero(links)
            out.append(pd.DataFrame({"key": keys[got], "root": keys[root[got]], "links": links[got].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "root": [], "links": []}).astype("int64")
    return run


def ngram_classes(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, orders: int = ORDERS,
                  tile_sets: int = TILE_SETS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, n_links, and the key of its set and of its class (null without words)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = cut_lineage(docs.mapInArrow(_members(width), "kind int, doc_id long, n long, key long"))
    members = seen.where("kind = 0").select("doc_id", "n", "key")
    total, count = seen.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    listed = (seen.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n"))
              .where(F.col("n") >= count / (2 * HEAVY_SHARE)).toPandas())
    heavy = listed["key"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(heavy)
    heavy, times = heavy[by], listed["n"].to_numpy(np.int64)[by]

    buckets = shuffle_width(spark, total / BUCKET_TOKENS)
    sets = cut_lineage(members.where("n > 0").groupBy("key").agg(
        F.first("n").alias("n"), F.count("*").alias("weight"), F.min("doc_id").alias("least")))
    homes = (sets.select(F.expr(f"int(pmod(pmod(key, {buckets}) + if(key < 0, {pow(2, 64, buckets)}, 0), {buckets}))")
                         .alias("home"), "key", "n", "weight").mapInArrow(_sizes_rows, _ddl(_SHARED)))
    shared = (docs.mapInArrow(_to_buckets(width, buckets, buckets, heavy), "bucket int, runs binary, tokens binary")
              .groupBy("bucket").applyInArrow(_shared(buckets, buckets, times), _ddl(_SHARED)))
    alive = cut_lineage(shared.unionByName(homes).groupBy("home").applyInArrow(_alive(percent), _ddl(_ALIVE)))

    posted = alive.mapInArrow(_first_order(percent), "token long, key long")
    hubs = posted.groupBy("token").agg(F.min("key").alias("hub"), F.count("*").alias("c")).where("c > 1")
    ties = posted.join(hubs, "token").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    labels = cut_lineage(connected(ties.distinct()).select(F.col("node").alias("key"), "label"))
    groups = labels.groupBy("label").agg(F.count("*").alias("c"))
    packs = max(1, math.ceil(labels.count() / tile_sets))
    blocks = f"int(ceil(c / {tile_sets}))"
    placed = labels.join(groups, "label").selectExpr(
        "key", "label", f"{blocks} AS blocks", f"int(pmod(xxhash64(key), {blocks})) AS block")
    placed = F.broadcast(placed) if packs * tile_sets <= BROADCAST_ROWS else placed
    tiles = (alive.join(placed, "key")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
             .withColumn("pack", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(packs)))
                         .otherwise(F.xxhash64("label", "one", "two"))))
    links = cut_lineage(tiles.groupBy("pack").applyInPandas(_tile(percent, orders), "key long, root long, links long"))
    classes = connected(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("key").agg(F.sum("links").alias("links"))
    linked = classes.select(F.col("node").alias("key"), "label")
    # the least document of every class, over the classes' sets only
    of_class = sets.join(linked, "key")
    least = of_class.groupBy("label").agg(F.min("least").alias("component"))
    joined = linked.join(least, "label").join(degree, "key", "left").select(
        "key", "label", "component", F.coalesce("links", F.lit(0)).alias("links"))
    info = cut_lineage(sets.join(joined, "key", "left").select(
        "key", "weight", F.coalesce("label", "key").alias("class"), F.coalesce("component", "least").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")))
    # sets with 1/HOT_SETS of all documents or more (at most HOT_SETS of them) come to their many copies, the rest by shuffle
    hot = F.broadcast(info.where(F.col("weight") * HOT_SETS >= count).withColumn("hot", F.lit(True)))
    tried = members.where("n > 0").join(hot, "key", "left")
    full = tried.where("hot").unionByName(
        tried.where("hot IS NULL").select("doc_id", "n", "key").join(info, "key"), allowMissingColumns=True).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"), "key", "class")
    none = members.where("n = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("class"))
    return full.unionByName(none)


def ngram_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, orders: int = ORDERS,
                     tile_sets: int = TILE_SETS) -> DataFrame:
    """Classes of documents linked by shingle similarity.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Returns
    one row per input row: doc_id, n_shingles, component_id (least doc_id
    reachable over links) and n_links (other documents it links with).

    A null text counts as empty: no shingles, no links, its own component.
    Fewer than ``width`` words make one shingle.  Repeated rows are documents
    of their own that link as copies; a null doc_id takes part but never names
    a component unless no other id does (then null).  An empty table gives an
    empty result.  Two different sets share a 64-bit key with odds of 2**-64.
    """
    return ngram_classes(docs, percent, width, orders, tile_sets).select("doc_id", "n_shingles", "component_id", "n_links")


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _keyed(width: int):
    """The key of each text's set; null for texts without words."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            keys = []
            for rb in slices([pa.RecordBatch.from_arrays([col], ["text"])], "text"):
                _, sizes, own = _sets(rb, width)
                keys.append(pa.array(own, mask=sizes == 0))
            yield pa.chunked_array(keys, pa.int64()).combine_chunks() if keys else pa.array([], pa.int64())
    return run


def drop_near_copies(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """``docs`` without all but one row of each class, that of the least doc_id; columns unchanged.

    Rows without a doc_id or without words stay.  Of rows of one class that
    repeat the least doc_id, the one with the least text (then columns) stays;
    rows of one doc_id with texts of different classes are told apart by their
    sets and stay for each class that they lead.  Only the ids that go, or
    that repeat, are matched against the texts: by broadcast while their
    checked number is small, else by a shuffle.
    """
    width = options.get("width", WIDTH)
    result = cut_lineage(ngram_classes(docs, **options).select("doc_id", "component_id", "key", "class").where("doc_id IS NOT NULL"))

    def known(ids):
        ids = cut_lineage(ids)
        return F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    again = cut_lineage(result.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    gone = result.where("doc_id <> component_id").select("doc_id").distinct()
    if again.isEmpty():
        return docs.join(known(gone), "doc_id", "left_anti").select(*docs.columns)
    leaves = known(gone.unionByName(again).distinct())
    once = docs.join(leaves, "doc_id", "left_anti").select(*docs.columns)
    # rows of repeated ids: by id and set
    key, led, row = fresh(docs.columns, "key", "class", "row")
    rest = docs.join(known(again), "doc_id", "left_semi").withColumn(
        key, F.arrow_udf(_keyed(width), "long")(F.col("text").cast("string")))
    leads = result.join(again, "doc_id").where("key IS NOT NULL AND doc_id = component_id").select(
        "doc_id", F.col("key").alias(key), F.col("class").alias(led)).distinct()
    empty = rest.where(F.col(key).isNull()).select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = rest.join(leads, ["doc_id", key]).groupBy("doc_id", led).agg(F.min(F.struct("text", *others)).alias(row)).select(
        *[F.col("doc_id") if c == "doc_id" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])
    return once.unionByName(empty).unionByName(kept)
