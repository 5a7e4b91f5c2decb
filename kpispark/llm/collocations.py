"""Phrase collocation mining by mergeable Misra-Gries summaries and an exact second pass.

Texts are split into pieces at sentence signs and line ends, pieces into
words.  Everything is counted per language.

First pass: every task counts the n-grams of about ``WORDS`` words at a time by
their hashes, which it sorts in place, and sends hashes with counts to the
n-gram's hash partition, few partitions in a batch.
There they are merged into one Misra-Gries summary: counters are added, and
once there are more than the capacity k, the (k + 1)-th largest count is taken
from all of them.  Each such step takes at least k + 1 times as much from the
partition's mass as it takes from a counter, so with

    k > mass / threshold

all steps together take less than the threshold from any counter, and every
n-gram of at least that count survives.  (n-grams that share a hash only add
up.)  The mass is known before the first merge, as the rows that carry it are
sorted first.

Second pass: survivors set bits of a bitmap of fixed size (``FILTER_BITS``),
of which the driver only passes on compressed slices, and the texts are read
again.  n-grams whose bit is set are counted exactly, by their words (numbered
by a dictionary) and in the end by their strings; places of others are let go
before anything is sorted.  The bitmap only spares work: an n-gram whose bit
another one has set is counted too and fails the threshold then.

Scoring: parts of a phrase are at least as frequent as the phrase, so the
counts of all its parts are among those that survive.  Parts that many phrases
share are looked up by broadcast: those of a 1/``HOT`` of all occurrences,
hence at most ``HOT`` of each length; the others by a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import binary_column, slices
from .wordhash import mix64, string_buffer, word_hashes

LEAST = 10            # occurrences of a phrase
MOST_WORDS = 3
TOP = 2000
COVERED = 50          # percent of a phrase's occurrences inside one longer phrase that drop it
WORDS = 1 << 20       # words that are counted at a time
STEP = 1 << 16        # of them, those that one numpy step hashes
STEP_BYTES = 1 << 18  # text that one numpy step splits; about what a row of numbers for STEP words takes
BATCH_BYTES = 1 << 20  # hashes and counts that a task hands over at a time, about
PART_MASS = 1 << 21   # n-gram occurrences of a hash partition, about
FILTER_BITS = 27      # the bitmap has 2**27 bits: 16 MB
HOT = 1024
SALTS = (256, 16, 1)  # steps in which a language's best phrases are found

_KIND = np.zeros(256, np.uint8)   # 0: of a word
_KIND[[0x20, 0x09]] = 1           # between words
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2   # between pieces
_MULTIPLY = np.uint64(0xD1342543DE82EF95)


def words_of(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lower-case words, number of the text of each, number of its piece) of a string column; nulls are empty."""
    buf, offsets = string_buffer(col)
    low = buf + (((buf >= 65) & (buf <= 90)).view(np.uint8) << 5)
    kind = _KIND[low]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(buf)]
    begins[at] = inside[at]  # a text's first byte opens a word
    starts = np.flatnonzero(begins)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:]
    cuts = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [
        None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low[inside]))])
    text = np.searchsorted(offsets, starts, side="right") - 1
    signs = np.searchsorted(np.flatnonzero(kind == 2), starts)
    return words, text, signs + text  # neither ever falls, so equal sums mean equal pieces


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, taken of about ``STEP_BYTES`` at a time."""
    column = pa.RecordBatch.from_arrays([words], ["word"])
    parts = [word_hashes(*string_buffer(rb.column(0)))[0] for rb in slices([column], "word", STEP_BYTES)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class Stretch:
    """Consecutive words; n-grams that start at the first ``starts`` of them are counted.

    Of each word there is a hash (of the word and its language) and its
    piece; for exact counts also numbers of the word and of its language.
    """

    def __init__(self, hashes: np.ndarray, piece: np.ndarray, starts: int, word: np.ndarray | None, lang: np.ndarray | None,
                 dictionary: pa.Array | None, langs: list[str]):
        self.hashes, self.piece, self.starts = hashes, piece, starts
        self.word, self.lang, self.dictionary, self.langs = word, lang, dictionary, langs

    def hashed(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hashes) of all n-grams, for n up to ``most`` and about ``STEP`` places at a time."""
        for at in range(0, self.starts, STEP):
            size = min(STEP, self.starts - at)
            reach = slice(at, at + size + most - 1)
            piece, one = self.piece[reach], self.hashes[reach]
            hashes = one[:size]
            yield 1, np.arange(at, at + size), hashes
            for n in range(2, most + 1):
                size = max(min(size, len(piece) - n + 1), 0)
                hashes = mix64(hashes[:size] * _MULTIPLY + one[n - 1:n - 1 + size])
                same = np.flatnonzero(piece[:size] == piece[n - 1:n - 1 + size])
                yield n, at + same, hashes[same]

    def sorted_hashes(self, most: int) -> np.ndarray:
        """The hashes of all n-grams of up to ``most`` words, as often as they occur."""
        out, size = np.empty(most * self.starts, np.uint64), 0
        for _, places, hashes in self.hashed(most):
            out[size:size + len(places)] = hashes
            size += len(places)
        out = out[:size]
        out.sort()
        return out

    def grams(self, most: int, flags: np.ndarray | None = None, filter_bits: int = 0) -> Iterator[
            tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, hashes, counts, a place of each) of the n-grams, for n up to ``most``; by a bitmap only those whose bit is set.

        An n-gram that shares its hash with another one may come more than
        once, with parts of its count.  n-grams that begin alike come
        together, as their strings are compressed when they are shuffled.
        """
        found: list = [[] for _ in range(most)]
        for n, places, hashes in self.hashed(most):
            if flags is not None:
                bit = (hashes >> np.uint64(64 - filter_bits)).astype(np.int64)
                seen = np.flatnonzero(flags[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
                places, hashes = places[seen], hashes[seen]
            found[n - 1].append((places.astype(np.int32), hashes))
        for n in range(1, most + 1):
            places, hashes = (np.concatenate([f[i] for f in found[n - 1]]) for i in (0, 1))
            found[n - 1] = None
            order = np.argsort(hashes)
            hashes = hashes[order]
            places = places[order]
            del order
            new = np.ones(len(places), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            for numbers in (self.lang, *(self.word[k:] for k in range(n))):  # of one hash, yet not one n-gram
                mine = numbers[places]
                new[1:] |= mine[1:] != mine[:-1]
            begins = np.flatnonzero(new)
            hashes, counts, places = hashes[begins], np.diff(np.append(begins, len(places))), places[begins]
            alike = np.lexsort([*(self.word[places + k] for k in range(n - 1, -1, -1)), self.lang[places]])
            yield n, hashes[alike], counts[alike], places[alike]

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The n-grams at the given places, words joined by blanks."""
        words = [self.dictionary.take(pa.array(self.word[first + k])) for k in range(n)]
        return words[0] if n == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))


def _stretches(batches: Iterator[pa.RecordBatch], most: int, size: int = WORDS, *, numbered: bool = True) -> Iterator[Stretch]:
    """The words of (lang, text) rows, about ``size`` starts at a time; long texts run over several stretches."""
    held: list = []
    total = pieces = 0
    codes: dict[str, int] = {}

    def cut():
        hashes, piece, lang = (np.concatenate([h[i] for h in held]) if held[0][i] is not None else None for i in (0, 1, 2))
        word = dictionary = None
        if numbered:
            coded = pa.chunked_array([h[3] for h in held]).unify_dictionaries()
            dictionary, word = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks])
            del coded
        held.clear()
        pa.default_memory_pool().release_unused()  # a dictionary is several times as large while it is made
        even = -(-total // max(round(total / size), 1))
        for at in range(0, total, even):
            to = at + even + most - 1
            yield Stretch(hashes[at:to], piece[at:to], min(even, total - at), word[at:to] if numbered else None,
                          lang[at:to] if numbered else None, dictionary, list(codes))

    for rb in slices(batches, "text", STEP_BYTES):
        words, text, piece = words_of(rb.column("text"))
        langs = rb.column("lang").to_pylist()
        tags = _hashes(pa.array([f"<{x.encode().hex()}>" for x in langs], pa.string())) * _MULTIPLY
        numbers = np.array([codes.setdefault(x, len(codes)) for x in langs], np.int32) if numbered else None
        held.append((mix64(_hashes(words) ^ tags[text]), (piece + pieces).astype(np.int32),
                     numbers[text] if numbered else None, words.dictionary_encode() if numbered else None))
        pieces += int(piece[-1]) + 1 if len(piece) else 0
        total += len(words)
        if total >= size:
            yield from cut()
            total, pieces, codes = 0, 0, {}
    if total:
        yield from cut()


_PACKED = "part int, kind int, mass long, packed binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, mass, packed = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(mass, pa.int64()),
                                       binary_column(list(packed))], ["part", "kind", "mass", "packed"])


def _summarise(most: int, bits: int):
    """Rows of every hash partition and stretch: its mass (kind 0), and its hashes with their counts (kind 1)."""
    def run(batches):
        for stretch in _stretches(batches, most, numbered=False):
            hashes = stretch.sorted_hashes(most)
            del stretch
            starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
            cuts = np.append(np.searchsorted(hashes, starts), len(hashes))
            rows, size = [], 0
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                own = hashes[cuts[part]:cuts[part + 1]]
                new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                counts = np.diff(np.append(new, len(own))).astype(np.uint32)
                packed = own[new].tobytes() + counts.tobytes()
                rows += [(part, 0, len(own), None), (part, 1, 0, packed)]
                size += len(packed)
                if size >= BATCH_BYTES:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)
            del hashes, own  # before the next words are read
    return run


class MisraGries:
    """A summary of at most ``capacity`` counters; ``taken`` is what its counters may lack."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Merge counters (another summary's, or exact ones); done in lots of about the capacity."""
        self.waiting.append((hashes, counts))
        self.size += len(hashes)
        if self.size > max(self.capacity, 1 << 14):
            self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        hashes = np.concatenate([self.hashes, *[h for h, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c.astype(np.int64) for _, c in self.waiting]])
        self.waiting, self.size = [], 0
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        hashes, counts = hashes[new], np.add.reduceat(counts, new)
        if len(hashes) > self.capacity:
            least = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.taken += least
            hashes, counts = hashes[counts > least], counts[counts > least] - least
        self.hashes, self.counts = hashes, counts

    def survivors(self, threshold: int) -> np.ndarray:
        """Hashes that may stand for ``threshold`` occurrences or more (all that do are among them)."""
        self.fold()
        return self.hashes[self.counts + self.taken >= threshold]


def _survivors(threshold: int, bits: int, filter_bits: int):
    """Each hash partition's slice of the bitmap, compressed; rows come sorted by (part, kind)."""
    def run(batches):
        part, mass, summary = None, 0, None

        def done():
            mine = filter_bits - bits
            place = (summary.survivors(threshold) >> np.uint64(64 - filter_bits)).astype(np.int64) - (part << mine)
            flags = np.zeros(1 << mine, np.uint8)
            flags[place] = 1
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()),
                                               "packed": binary_column([zlib.compress(np.packbits(flags), 1)])})
        for rb in batches:
            for p, kind, m, packed in zip(*(rb.column(c).to_pylist() for c in ("part", "kind", "mass")), rb.column("packed")):
                if p != part:
                    if part is not None:
                        yield done()
                    part, mass, summary = p, 0, None
                if kind == 0:
                    mass += m
                    continue
                summary = summary or MisraGries(mass // threshold + 1)
                got = np.frombuffer(packed.as_buffer(), np.uint8)
                n = len(got) // 12
                summary.add(got[:8 * n].copy().view(np.uint64), got[8 * n:].copy().view(np.uint32))
        if part is not None:
            yield done()
    return run


def frequent_bits(docs: DataFrame, threshold: int = LEAST, most: int = MOST_WORDS, filter_bits: int = FILTER_BITS,
                  part_mass: int = PART_MASS) -> tuple[int, dict[int, bytes]]:
    """First pass over (lang, text): a bitmap with the bit of every n-gram of ``threshold`` occurrences or more set.

    An n-gram's bit is the first ``filter_bits`` bits of its hash.  The driver
    gets and passes on compressed slices by number, and how many bits number
    them; few bits are set, so they are far smaller than the bitmap, whose size
    is fixed.  Only tasks unpack them (``whole_bitmap``).
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(max(np.ceil(np.log2(max(size / 6 * most / part_mass, 1))), 0), filter_bits - 3))
    packed = docs.mapInArrow(_summarise(most, bits), _PACKED)
    slots = (packed.repartition(1 << bits, "part").sortWithinPartitions("part", "kind")
             .mapInArrow(_survivors(threshold, bits, filter_bits), "part int, packed binary"))
    return bits, {row["part"]: bytes(row["packed"]) for row in slots.collect()}


def whole_bitmap(bits: int, slots: dict[int, bytes], filter_bits: int) -> np.ndarray:
    """The bitmap of ``frequent_bits``; slices without a survivor's row are empty."""
    out = np.zeros(1 << (filter_bits - 3), np.uint8)
    width = len(out) >> bits
    for part, packed in slots.items():
        out[part * width:(part + 1) * width] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return out


def _exactly(most: int, bitmap, filter_bits: int):
    """Strings and counts of the n-grams whose bit is set, per stretch; with size 0 the words of a language."""
    def run(batches):
        flags = whole_bitmap(*bitmap.value, filter_bits)
        for stretch in _stretches(batches, most):
            names = pa.array(stretch.langs, pa.string())
            words = np.bincount(stretch.lang[:stretch.starts], minlength=len(names))
            yield pa.RecordBatch.from_arrays([
                names, pa.array(np.zeros(len(names), np.int32)), pa.array([""] * len(names)),
                pa.array(words.astype(np.int64))], ["lang", "size", "phrase", "count"])
            for n, _, counts, place in stretch.grams(most, flags, filter_bits):
                for at in range(0, len(place), 1 << 16):
                    k = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([
                        names.take(pa.array(stretch.lang[place[k]])), pa.array(np.full(len(place[k]), n, np.int32)),
                        stretch.phrases(place[k], n).cast(pa.string()), pa.array(counts[k].astype(np.int64))],
                        ["lang", "size", "phrase", "count"])
            del stretch, counts, place  # before the next words are read
    return run


def frequent_phrases(docs: DataFrame, threshold: int = LEAST, most: int = MOST_WORDS, filter_bits: int = FILTER_BITS,
                     part_mass: int = PART_MASS) -> DataFrame:
    """(lang, size, phrase, count) of all n-grams of 1 to ``most`` words with ``threshold`` occurrences or more.

    Rows of size 0 hold a language's words.  Null texts are empty, a null
    language is ``und``.  Counts are exact and cover whole texts.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    bitmap = docs.sparkSession.sparkContext.broadcast(frequent_bits(rows, threshold, most, filter_bits, part_mass))
    counted = rows.mapInArrow(_exactly(most, bitmap, filter_bits), "lang string, size int, phrase string, count long")
    return cut_lineage(counted.groupBy("lang", "size", "phrase").agg(F.sum("count").alias("count"))
                       .where(f"size = 0 OR count >= {int(threshold)}"))


def _part(start, n):
    return F.array_join(F.slice("words", start, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, top: int = TOP, covered: int = COVERED,
                 **options) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``most`` words: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, ``l`` and ``r`` the counts of its two sides at
    the cut of lowest score (of equal scores the first cut), ``n`` the
    language's words and ``score`` floor(10^6 a^2 / (l r)).  A phrase of which
    ``covered`` percent or more lie inside one longer phrase is left out.
    Ranks go by score, count (both falling) and phrase (bytes).  Other columns
    of ``docs`` than lang and text are ignored; an empty table, or one without
    any such phrase, gives an empty result; repeated rows count each time.
    """
    counts = frequent_phrases(docs, least, most, **options)
    total = counts.where("size = 0").select("lang", F.col("count").alias("n"))
    grams = counts.where("size > 0")
    phrases = grams.where("size > 1").select("lang", "phrase", F.col("count").alias("a"), "size", F.split("phrase", " ").alias("words"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: _part(at, n))))
    longer = (phrases.where("size > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("within")))
    kept = cut_lineage(phrases.join(longer, ["lang", "phrase"], "left").where(
        f"within IS NULL OR 100 * within < {int(covered)} * a").drop("within"))

    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), _part(F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(1).alias("side"), _part(k + 1, F.col("size") - k).alias("part")))))
    asked = kept.select("lang", "phrase", "a", F.explode(sides).alias("s")).select(
        "lang", "phrase", "a", "s.k", "s.side", "s.part")
    known = grams.where(f"size < {int(most)}").select("lang", F.col("phrase").alias("part"), "count")
    words = total.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = known.where(F.col("count") >= max(words / HOT, least))  # HOT of each length at most
    tried = asked.join(F.broadcast(hot), ["lang", "part"], "left")
    found = tried.where("count IS NOT NULL").unionByName(
        tried.where("count IS NULL").drop("count").join(known, ["lang", "part"]))

    def side(s):  # counts of one side by cut, from 1
        return F.transform(F.filter(F.array_sort("all"), lambda x: x["side"] == s), lambda x: x["count"])
    both = found.groupBy("lang", "phrase", "a").agg(F.collect_list(F.struct("k", "side", "count")).alias("all")).select(
        "lang", "phrase", "a", side(0).alias("ls"), side(1).alias("rs"))
    number = "CAST({} AS DECIMAL(15,0))"
    score = f"(1000000BD * {number} * {number}) div ({number} * {number})".format("a", "a", "x", "rs[i]")
    cuts = f"transform(ls, (x, i) -> struct({score} AS score, i AS k, x AS l, rs[i] AS r))"
    scored = both.select("lang", "phrase", "a", F.array_min(F.expr(cuts)).alias("best")).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score")
    ranked = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS[0])))
    for salts in SALTS:
        one = Window.partitionBy("lang", F.pmod("salt", F.lit(salts))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
