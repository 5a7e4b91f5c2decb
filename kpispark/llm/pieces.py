"""SentencePiece encoding and decoding in batches of numpy Viterbi.

Texts are cut where no piece can span (before a run of blanks, around line
ends), and every distinct chunk is encoded once per batch.  Chunks of equal
length advance together: for each end position the hashes of all substrings
that end there are probed in the sorted hashes of the pieces, the best score
is a maximum over the lengths, and the winner's length and piece are stored
as back pointers.

For a unigram model that is the encoding.  A BPE model is defined by its
merges instead, and the path of best score is not always the merges' result.
There a path only counts if merging would leave each two neighbours apart
(this is checked once per pair of pieces, by merging the pair's characters);
a path whose neighbours all stay apart is exactly the merges' result.  The
other chunks are merged, again in batches of equal length: per step one merge
in every chunk, its place found by a vectorised minimum of ranks.  Ids equal
the sentencepiece library's.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 80_000      # chunks that a worker remembers
LONG = 48            # longer chunks are merged one by one with a heap
ROWS = 4096          # chunks that advance together

_SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = np.iinfo(np.int32).max


class _Index:
    """Sorted 64-bit keys with the place of the first key of each value of their top bits."""

    def __init__(self, keys: np.ndarray, bits: int = 18):
        self.keys = np.append(keys, np.uint64(0) if not len(keys) else keys[-1])
        self.shift = np.uint64(64 - bits)
        tops = (keys >> self.shift).astype(np.int64)
        self.start = np.searchsorted(tops, np.arange(1 << bits)).astype(np.int32)
        self.deep = int(np.bincount(tops, minlength=1).max()) if len(keys) else 0

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the key is there)."""
        first = self.start[key >> self.shift]
        found = self.keys[first] == key
        place = first
        for d in range(1, self.deep):
            nxt = np.minimum(first + d, len(self.keys) - 1)
            hit = self.keys[nxt] == key
            place = np.where(hit, nxt, place)
            found |= hit
        return np.minimum(place, len(self.keys) - 2), found


class Pieces:
    """A model's pieces as arrays; built on the driver from the model file and shipped to the workers (about 2 MB)."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.unk = model.unk_id()
        names = [model.id_to_piece(i) for i in range(self.size)]
        scores = np.array([model.get_score(i) for i in range(self.size)])
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
                            for i in range(self.size)])
        self.byte_ids = np.zeros(256, np.int32)
        out = [b""] * self.size
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                out[i] = bytes([int(name[3:5], 16)])
            elif not special[i]:
                out[i] = name.replace(_SPACE, " ").encode()
        out[self.unk] = " ⁇ ".encode()
        self.has_bytes = bool(self.byte_ids.any())
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_sizes = np.array([len(x) for x in out], np.int64)
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        self.prefix = names[model.encode("a")[0]].startswith(_SPACE)
        normal = np.flatnonzero(~special)
        self.longest = max((len(names[i]) for i in normal), default=1)
        # whole non-positive scores are places in the order of merges: a BPE model
        ranks = np.unique(-scores[normal], return_inverse=True)[1].astype(np.int32)
        self.bpe = bool((scores[normal] == np.round(scores[normal])).all() and scores.min() < -99)
        self.score = np.where(special, -np.inf, scores)
        if self.bpe:  # ranks as Zipf-like log probabilities
            self.score[normal] = -np.log(20.0 + ranks)
        self.unseen = float(self.score[normal].min() - 10)
        self.names = names
        ids = {names[i]: i for i in normal}
        ones = sorted((ord(names[i]), i) for i in normal if len(names[i]) == 1)
        self.chars = np.array([c for c, _ in ones], np.uint32)
        self.char_ids = np.array([i for _, i in ones], np.int32)
        hashes = self._mixed(np.array([self._hash(names[i]) for i in normal], np.uint64))
        by = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[by], normal[by].astype(np.int32)
        self.hash_index = _Index(self.hashes)
        pairs, merged = [], []
        if self.bpe:
            for i in normal:
                for cut in range(1, len(names[i])):
                    a, b = ids.get(names[i][:cut]), ids.get(names[i][cut:])
                    if a is not None and b is not None:
                        pairs.append(a * (self.size + 1) + b)
                        merged.append(i)
        by = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.merged = np.array(pairs, np.int64)[by], np.array(merged, np.int32)[by]
        keys = np.sort(self._mixed(self.pairs))
        self.merged = self.merged[np.argsort(self._mixed(self.pairs))]
        self.pair_index = _Index(keys)
        self.rank = np.full(self.size + 1, _NONE, np.int32)
        self.rank[normal] = ranks
        spans = [n for n in ids if "\n" in n or _SPACE in n.lstrip(_SPACE)]
        self.chunk = None if spans else re.compile(f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n")

    @staticmethod
    def _mixed(keys: np.ndarray) -> np.ndarray:
        """Keys spread over 64 bits (a bijection)."""
        x = keys.astype(np.uint64) * _BASE
        return (x ^ (x >> np.uint64(32))) * _BASE

    @staticmethod
    def _hash(text: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in text:
                h = h * _BASE + np.uint64(ord(c) + 1)
        return h

    # ---- Viterbi ---------------------------------------------------------
    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of equally long chunks (rows of code points): (ids, ids per chunk); -1 for an unknown character."""
        m, n = codes.shape
        sums = np.zeros((m, n + 1), np.uint64)
        for j in range(n):
            sums[:, j + 1] = sums[:, j] * _BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
        powers = np.cumprod(np.full(self.longest + 1, _BASE)) * np.uint64(pow(int(_BASE), -1, 1 << 64))
        best = np.zeros((m, n + 1))
        size = np.ones((m, n + 1), np.int16)
        piece = np.full((m, n + 1), -1, np.int32)
        rows = np.arange(m)
        for j in range(1, n + 1):
            lengths = np.arange(1, min(self.longest, j) + 1)
            h = sums[:, j, None] - sums[:, j - lengths] * powers[lengths]
            place, found = self.hash_index.find(self._mixed(h))
            ids = self.hash_ids[place]
            score = np.where(found, self.score[ids], -np.inf)
            score[:, 0] = np.where(found[:, 0], score[:, 0], self.unseen)
            score += best[:, j - lengths]
            pick = score.argmax(1)
            best[:, j] = score[rows, pick]
            size[:, j] = pick + 1
            piece[:, j] = np.where(found[rows, pick], ids[rows, pick], -1)
        path = np.full((m, n), _NONE, np.int32)  # from the right
        at, slot = np.full(m, n), n
        while (live := np.flatnonzero(at > 0)).size:
            slot -= 1
            path[live, slot] = piece[live, at[live]]
            at[live] -= size[live, at[live]]
        return self._left(path)

    @staticmethod
    def _left(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids with gaps (``_NONE``), made flat: (ids, ids per row)."""
        full = path != _NONE
        return path[full], full.sum(1)

    # ---- merges ----------------------------------------------------------
    def _char_ids(self, codes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[place] == codes, self.char_ids[place], self.size)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of the piece that two pieces merge to; ids of ``size`` never merge."""
        place, hit = self.pair_index.find(self._mixed(a.astype(np.int64) * (self.size + 1) + b))
        got = np.where(hit, self.merged[place], self.size)
        return np.where(hit, self.rank[got], _NONE), got

    def merge(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The BPE results of equally long chunks: (ids, ids per chunk); -1 for an unknown character."""
        ids = self._char_ids(codes).astype(np.int32)
        out = np.full(ids.shape, _NONE, np.int32)
        owner = np.arange(len(ids))
        rank, got = (self._pair(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else (ids[:, :0], ids[:, :0]))
        while len(owner):
            if rank.shape[1]:
                at = rank.argmin(1)
                go = rank[np.arange(len(owner)), at] != _NONE
            else:
                at, go = np.zeros(len(owner), int), np.zeros(len(owner), bool)
            done = ids[~go]
            out[owner[~go], :done.shape[1]] = np.where(done == self.size, -1, done)
            ids, rank, got, owner, at = ids[go], rank[go], got[go], owner[go], at[go]
            if not len(owner):
                break
            rows = np.arange(len(owner))
            ids[rows, at] = got[rows, at]
            w = ids.shape[1] - 1
            cols = np.arange(w)
            ids = np.take_along_axis(ids, cols + (cols[None, :] > at[:, None]), 1)
            cols = cols[:-1]
            shift = cols + (cols[None, :] >= at[:, None])
            rank, got = np.take_along_axis(rank, shift, 1), np.take_along_axis(got, shift, 1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < w - 1))
                rank[ok, side[ok]], got[ok, side[ok]] = self._pair(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        return self._left(out)

    def merge_long(self, codes: np.ndarray) -> np.ndarray:
        """The BPE result of one long chunk, by a heap of merges."""
        ids = self._char_ids(codes).astype(np.int64)
        n = len(ids)
        nxt, prv = np.arange(1, n + 1).tolist(), np.arange(-1, n - 1).tolist()
        rank, got = self._pair(ids[:-1], ids[1:])
        cur = ids.tolist()
        heap = [(int(rank[i]), int(i), cur[i], cur[i + 1], int(got[i])) for i in np.flatnonzero(rank != _NONE)]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i, j):
            r, g = self._pair(np.array([cur[i]]), np.array([cur[j]]))
            if r[0] != _NONE:
                heapq.heappush(heap, (int(r[0]), i, cur[i], cur[j], int(g[0])))
        while heap:
            _, i, a, b, g = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or cur[i] != a or cur[j] != b:
                continue
            cur[i], alive[j], nxt[i] = g, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                push(i, nxt[i])
            if prv[i] >= 0:
                push(prv[i], i)
        return np.array([-1 if c == self.size else c for c, a in zip(cur, alive) if a], np.int32)

    # ---- chunks ----------------------------------------------------------
    def encode_chunks(self, chunks: list[str], apart: dict[int, bool]) -> list[bytes]:
        """Ids (packed, 4 bytes each) of every chunk; ``apart`` remembers which pairs of pieces merging leaves alone."""
        out: list = [None] * len(chunks)
        sizes = np.array([len(c) for c in chunks])
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        for n in np.unique(sizes):
            where = np.flatnonzero(sizes == n)
            step = max(1, min(ROWS, (1 << 17) // int(n)))
            for at in range(0, len(where), step):
                part = where[at:at + step]
                flat, counts = self._encode_block(codes[starts[part][:, None] + np.arange(n)], apart)
                ends = np.cumsum(counts)
                unknown = np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), side="right"))
                raw, cut = flat.astype("<i4").tobytes(), (ends * 4).tolist()
                begin = 0
                for i, end in zip(part.tolist(), cut):
                    out[i] = raw[begin:end]
                    begin = end
                for r in unknown.tolist():
                    i = int(part[r])
                    out[i] = self._spell(chunks[i], flat[ends[r] - counts[r]:ends[r]]).astype("<i4").tobytes()
        return out

    def _encode_block(self, block: np.ndarray, apart: dict[int, bool]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = self.viterbi(block)
        if not self.bpe:
            return flat, counts
        owner = np.repeat(np.arange(len(counts)), counts)
        wide = flat.astype(np.int64)
        inner = (owner[1:] == owner[:-1]) & (wide[1:] >= 0) & (wide[:-1] >= 0)
        keys = (wide[:-1] * (self.size + 1) + wide[1:])[inner]
        names, back = np.unique(keys, return_inverse=True)
        names = names.tolist()
        self._learn([k for k in names if k not in apart], apart)
        good = np.array([apart[k] for k in names], bool)
        bad = np.zeros(len(counts), bool)
        if names:
            bad[owner[1:][inner][~good[back]]] = True
        if not bad.any():
            return flat, counts
        rows = np.flatnonzero(bad)
        if block.shape[1] > LONG:
            again = [self.merge_long(block[r]) for r in rows]
            more, sizes = np.concatenate(again), np.array([len(x) for x in again])
        else:
            more, sizes = self.merge(block[rows])
        total = counts.copy()
        total[rows] = sizes
        result = np.empty(int(total.sum()), np.int32)
        kept = np.repeat(~bad, total)
        result[kept] = flat[~bad[owner]]
        result[~kept] = more
        return result, total

    def _learn(self, keys: list[int], apart: dict[int, bool]) -> None:
        """Merge the characters of unseen pairs and note whether the pair comes out as it was."""
        by_size: dict[int, list[int]] = {}
        for k in keys:
            a, b = divmod(k, self.size + 1)
            by_size.setdefault(len(self.names[a]) + len(self.names[b]), []).append(k)
        for group in by_size.values():
            text = "".join(self.names[k // (self.size + 1)] + self.names[k % (self.size + 1)] for k in group)
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(group), -1)
            flat, counts = self.merge(codes)
            at = np.cumsum(counts) - counts
            two = np.flatnonzero(counts == 2)
            same = np.zeros(len(group), bool)
            first, second = flat[at[two]].astype(np.int64), flat[at[two] + 1]
            same[two] = first * (self.size + 1) + second == np.array(group, np.int64)[two]
            apart.update(zip(group, same.tolist()))

    def _spell(self, chunk: str, ids: np.ndarray) -> np.ndarray:
        """Replace unknown characters by their bytes' pieces (or the unknown piece)."""
        out, at = [], 0
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
                at += len(self.names[i])
            else:
                raw = chunk[at].encode("utf-8", "surrogatepass")
                out.extend(self.byte_ids[list(raw)].tolist() if self.has_bytes else [self.unk])
                at += 1
        return np.array(out, np.int32)

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = (_SPACE if self.prefix else "") + text.replace(" ", _SPACE)
        return self.chunk.findall(text) if self.chunk else [text]

    def encode(self, texts: list[str], memory: "Memory") -> list[np.ndarray]:
        """Ids of every text; ``memory`` holds chunks of earlier batches."""
        parts = [self.split(t) for t in texts]
        ids = memory.ids_of({c for p in parts for c in p}, self)
        return [np.frombuffer(b"".join([ids[c] for c in p]), "<i4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of an id sequence; ids outside the model are skipped."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        sizes = self.out_sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or not ends[-1]:
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.out_starts[ids] - (ends - sizes), sizes)
        text = self.out_bytes[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Memory:
    """Chunks that a worker has encoded: two generations of ``CACHE`` entries, so that frequent chunks stay."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}

    def ids_of(self, chunks: set[str], pieces: Pieces) -> dict[str, bytes]:
        """Packed ids of (at least) the given chunks."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        if len(self.apart) > 4 * CACHE:
            self.apart.clear()
        young, old, new = self.young, self.old, []
        for c in chunks:
            if c not in young:
                got = old.get(c)
                if got is None:
                    new.append(c)
                else:
                    young[c] = got
        if new:
            young.update(zip(new, pieces.encode_chunks(new, self.apart)))
        return young


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def add_ids(docs: DataFrame, pieces: Pieces, column: str = "ids") -> DataFrame:
    """``docs`` with an array of piece ids of its text; other columns pass by untouched.

    Null and empty texts get an empty array; every row is encoded by itself.
    """
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = Memory()
        for col in batches:
            rows = []
            for rb in slices([pa.RecordBatch.from_arrays([col], ["t"])], "t", 2 << 20):
                rows += pieces.encode([t or "" for t in rb.column(0).to_pylist()], memory)
            yield _lists(rows)
    return docs.withColumn(column, encode(F.col("text").cast("string")))


def add_text(tokens: DataFrame, pieces: Pieces, column: str = "text", ids: str = "ids") -> DataFrame:
    """``tokens`` with the text that its ids stand for (null ids: null)."""
    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            offsets, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            yield pa.array([None if null else pieces.decode(flat[offsets[i]:offsets[i + 1]])
                            for i, null in enumerate(col.is_null().to_pylist())], pa.string())
    return tokens.withColumn(column, decode(F.col(ids)))


def sentencepiece_ids(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, and decoded_sha256, the digest of the text decoded from the ids again.

    Every row is encoded by itself (repeated rows alike; null and empty texts
    to no ids); an empty table stays empty; other columns are ignored.
    """
    pieces = Pieces(model)
    ids = add_ids(docs.select("doc_id", "text"), pieces).select("doc_id", "ids")
    back = add_text(ids, pieces, "_back")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       F.sha2("_back", 256).alias("decoded_sha256"))


def text_sha256(text: str | None) -> str:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
