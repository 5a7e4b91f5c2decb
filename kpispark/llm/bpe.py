"""Byte-level BPE encoding by backtracking over longest matches, decoding by an offset table.

Merging pairs by rank splits a chunk in exactly one way, and a split is that
one if and only if every two neighbours would stay apart when merged alone.
So a chunk needs no merging: an Aho-Corasick automaton over the tokens gives
the longest one that begins at a byte (those of a whole chunk, one after the
other, in one pass); the encoder takes it, checks it against the last one in
the table of compatible pairs, goes on to shorter tokens and, where none fits,
marks the byte as no boundary and steps back.  As the split of a prefix is
unique too, a byte is marked once at most, so the time is linear.

Two tokens are compatible if no merge joins them across their border: a right
end a of the first and a left end b of the second, as they are while either
token is built, are merged at rank r only if neither has been taken into its
own token before r.  (Of equal ranks the left one goes first.)  The table is
filled as pairs are met.

Decoding gathers the tokens' bytes from one array by their offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import slices

MODEL = "byte_bpe_50k.json"
CACHE = 100_000      # chunks that a worker remembers, twice
LONG = 64            # longer chunks (characters) are not remembered
HUGE = 1 << 20       # texts (characters) whose chunks are not listed at once
PAIRS = 400_000      # pairs of tokens that a worker remembers
NEVER = 1 << 60

# The pre-tokenizer's pattern, and the bytes that its alphabet writes as themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""  # the same, for ASCII texts
PLAIN_BYTES = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary; the others follow from 256 on."""
    plain = [b for low, high in PLAIN_BYTES for b in range(low, high + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary with its merges, its automaton and its offset table.

    ``path`` is a tokenizers file whose pre-tokenizer is the byte-level one
    with its pattern and without a prefix space, without a normaliser; other
    kinds raise, as does a merge whose parts come from later merges.
    """

    def __init__(self, path: str | None = None):
        with open(path or public_tokenizers.path(MODEL), encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if (model["type"], pre.get("type")) != ("BPE", "ByteLevel") or odd or model.get("ignore_merges") \
                or spec["normalizer"] or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE file")
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens with options of their own are not read")
        self.added = {t["content"]: t["id"] for t in added}
        alphabet = byte_alphabet()
        of = {bytes(map(alphabet.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.added}
        self._merges(model["merges"], of, alphabet)
        texts = {i: b for b, i in of.items()} | {i: t.encode() for t, i in self.added.items()}
        self._offset_table(texts)
        self.ids = {b: i for b, i in of.items() if self.whole[i]}
        self.shorter = [-1] * self.size
        for b, i in self.ids.items():
            self.shorter[i] = next((self.ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ids), -1)
        self.lengths = self.sizes.tolist()
        self.reach = max(map(len, self.ids))  # bytes of the longest token
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()

    def _merges(self, merges: list, of: dict[bytes, int], alphabet: dict[str, int]) -> None:
        """Ranks of pairs; per token the parts it is made of and its rank, if its own bytes merge to it."""
        self.size = 1 + max([*of.values(), *self.added.values()])
        self.rank: dict[int, int] = {}
        self.left, self.right = [-1] * self.size, [-1] * self.size
        self.made = [NEVER] * self.size      # rank of the merge that makes a token; bytes are there from the start
        self.whole = bytearray(self.size)
        for b, i in of.items():
            if len(b) == 1:
                self.made[i], self.whole[i] = -1, 1
        if sum(self.whole) < 256:
            raise ValueError("a byte has no token")
        for r, pair in enumerate(merges):
            one, two = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (bytes(map(alphabet.__getitem__, t)) for t in (one, two))
            i, j, out = of[a], of[b], of[a + b]
            if self.made[i] > r or self.made[j] > r:
                raise ValueError(f"merge {r} has a part that later merges make")
            self.rank.setdefault(i * self.size + j, r)
            if not self.whole[out] and self.whole[i] and self.whole[j] and self._apart(i, j, but=r):
                self.left[out], self.right[out], self.whole[out] = i, j, 1
                self.made[out] = r
            self.made[out] = min(self.made[out], r)

    def _apart(self, u: int, v: int, but: int = -1) -> bool:
        """Whether merging leaves tokens ``u`` and ``v`` side by side (but for the merge of rank ``but``)."""
        rank, size, made = self.rank, self.size, self.made
        b, taken_b = v, NEVER
        while b >= 0:
            a, taken_a = u, NEVER
            while a >= 0:
                r = rank.get(a * size + b)
                if r is not None and r != but and r < taken_a and r <= taken_b:
                    return False
                a, taken_a = self.right[a], made[a]
            b, taken_b = self.left[b], made[b]
        return True

    def _offset_table(self, texts: dict[int, bytes]) -> None:
        parts = [texts.get(i, b"") for i in range(self.size)]
        self.sizes = np.fromiter(map(len, parts), np.int64, self.size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def encode_chunk(self, chunk: bytes, pairs: dict[int, bool]) -> list[int]:
        """Token ids of one pre-token; ``pairs`` is the table of compatible pairs."""
        one = self.ids.get(chunk)
        if one is not None:
            return [one]
        n, size, lengths, shorter = len(chunk), self.size, self.lengths, self.shorter
        text, match = chunk.decode("latin-1"), self.automaton.iter_long
        longest = [-1] * n
        for end, t in match(text):  # longest matches one after the other: the path if all neighbours fit
            longest[end + 1 - lengths[t]] = t
        closed = bytearray(n + 1)
        path: list[int] = []
        at, t = 0, longest[0]
        while at < n:
            while t >= 0:
                if not closed[at + lengths[t]]:
                    if not path:
                        break
                    key = path[-1] * size + t
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self._apart(path[-1], t)
                    if ok:
                        break
                t = shorter[t]
            if t >= 0:
                path.append(t)
                at += lengths[t]
                if at < n:
                    t = longest[at]
                    if t < 0:
                        t = longest[at] = next(match(text[at:at + self.reach]))[1]
            else:
                closed[at] = 1
                t = path.pop()
                at -= lengths[t]
        return path

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of an id sequence; ids outside the vocabulary are skipped."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or not ends[-1]:
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)].tobytes()


class Encoder(dict):
    """Packed ids of chunks as a worker meets them: two generations of ``CACHE`` entries, so that frequent ones stay."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old, self.pairs = bpe, {}, {}
        self.pattern, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)
        longest_first = sorted(bpe.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            got = np.array(self.bpe.encode_chunk(chunk.encode(), self.pairs), "<u4").tobytes()
        if len(chunk) <= LONG:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = got
        return got

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; added tokens' strings are their tokens."""
        parts = self.special.split(text) if self.special else [text]
        return b"".join([np.array([self.bpe.added[p]], "<u4").tobytes() if i % 2 else self._plain(p)
                         for i, p in enumerate(parts)])

    def _plain(self, text: str) -> bytes:
        look, pattern = self.__getitem__, self.ascii if text.isascii() else self.pattern
        if len(text) > HUGE:  # chunk by chunk: a list of all of them would be many times the text
            return b"".join([look(m[0]) for m in pattern.finditer(text)])
        return b"".join(map(look, pattern.findall(text)))


def add_ids(docs: DataFrame, bpe: Bpe, column: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids of its text; other columns pass by untouched.

    Null and empty texts get an empty array; every row is encoded by itself,
    whole, so repeated rows are alike and an empty table stays empty.  A
    column of that name is replaced.
    """
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(bpe)
        for col in batches:
            rows = []
            for rb in slices([pa.RecordBatch.from_arrays([col], ["t"])], "t"):
                rows += [encoder.packed(t) if t else b"" for t in rb.column(0).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))
    return docs.withColumn(column, encode(F.col("text").cast("string")))


def _rows(col: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's ids; null rows as None, null ids left out."""
    offsets, values = col.offsets.to_numpy(), col.values
    for i, null in enumerate(col.is_null().to_pylist()):
        yield None if null else values[offsets[i]:offsets[i + 1]].drop_null().to_numpy(zero_copy_only=False)


def add_text(tokens: DataFrame, bpe: Bpe, column: str = "text", ids: str = "ids") -> DataFrame:
    """``tokens`` with the text that its ids stand for (null ids: null); broken UTF-8 becomes U+FFFD."""
    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array([None if r is None else bpe.decode(r).decode("utf-8", "replace") for r in _rows(col)],
                           pa.string())
    return tokens.withColumn(column, decode(F.col(ids)))


@F.arrow_udf(StringType())
def ids_sha256(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Hex digest of ids as little-endian unsigned 32-bit integers."""
    for col in batches:
        yield pa.array([None if r is None else hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in _rows(col)],
                       pa.string())


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, and decoded_sha256, the digest of the text decoded from the ids."""
    bpe = Bpe(path)
    ids = add_ids(docs.select("doc_id", "text"), bpe).select("doc_id", "ids")
    back = add_text(ids, bpe, "_back")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"),
                       F.sha2("_back", 256).alias("decoded_sha256"))
