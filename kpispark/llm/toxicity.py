"""Toxicity by noisy-channel deobfuscation.

Writers hide words by look-alike characters (``1d10t``), spacing
(``i d i o t``, ``i.d.i.o.t``) and repetition (``idiooot``).  Such a token is
read as a lattice: every observed character offers the characters that it may
stand for (or nothing), runs offer one or two letters, and Viterbi decoding
picks the path that a character trigram model finds likeliest.  The model is
counted over the words of all documents.  The restored words join the plain
ones, and a document is scored by them.  A word of letters only with a doubled
one (``idioot``) is read so too, unless it is an ordinary spelling: one that
two clean training texts or more have, and as many as toxic ones.

Learning takes three passes: the character model over the whole corpus; words
of a bounded, hash-chosen sample of labelled documents (``max_train``), where
texts of one label whose three least shingles agree count once, so that groups
of copies don't vote many times; then scoring.  Features are words and, where several words share
them, beginnings of 4 to 6 letters, so that inflected forms are known too.  A feature's weight
is the lower end of the 90 % Wilson interval of the share of toxic texts among
those that have it; a document's score is the largest weight among its words,
or the toxic share of the training texts without any such feature.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, slices
from .wordhash import shingle_hashes, string_buffer, word_hashes

THRESHOLD = 0.7
MAX_TRAIN = 40_000    # labelled documents that the lexicon is learnt from
SKETCH = 3            # least shingles of 5 words that training texts of one label share to count once
MIN_TEXTS, MIN_WEIGHT = 5, 0.6
STEMS = (4, 5, 6)     # letters of a word's beginning that are a feature
HEAD = 3              # letters of a word's beginning that tell whether it can be or have a feature
ONE_WORD = 0.8        # a beginning whose texts mostly have one and the same word is none
Z = 1.645             # of the Wilson interval
ORDINARY = 2          # clean training texts that an ordinary spelling with a doubled letter has at least
CACHE = 100_000       # tokens that a worker remembers when it scores
LEARNT = 40_000       # and when it learns (with their words)
GRAM_BYTES = 1 << 18  # text whose trigrams are numbered at a time
GRAMS_HELD = 1 << 20  # trigrams that are counted at a time

# Characters and the letters that they stand for in disguised words.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
}
_ALIKE = frozenset(LOOKALIKES)
SEPARATORS = set(" .-_*~'`^,/\\|+:;#%\t\n")
INVISIBLE = [0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]
EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’…-_/\\"

_INVISIBLE = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")
_WORD = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_RUNS = re.compile(r"(.)\1*", re.S)
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){3,}\S(?!\S)")
_DECORATION = re.compile(r"^([^\w\s])\1\1+|([^\w\s])\2\2+$")
_LETTERS = frozenset(c for c in map(chr, range(0x61, 0x180)) if c.islower())

# Numbers of characters: 0 of blanks, from 1 of letters, then one of the signs at a word's edge and one of all others.
_SIGN, _OTHER = len(_LETTERS) + 1, len(_LETTERS) + 2
_CODE = np.full(0x3002, _OTHER, np.uint8)
_CODE[[i for i in range(len(_CODE) - 1) if chr(i).isspace()]] = 0
_CODE[list(map(ord, sorted(_LETTERS)))] = np.arange(1, _SIGN)
_CODE[list(map(ord, EDGE))] = _SIGN


class CharModel:
    """Character trigrams of words, blank at both ends; unseen ones back off to bigrams, then to a floor."""

    def __init__(self, grams: dict[str, int]):
        self.tri = grams
        self.pair_of: Counter = Counter()
        self.last_two: Counter = Counter()
        self.last: Counter = Counter()
        for g, n in grams.items():
            self.pair_of[g[:2]] += n
            self.last_two[g[1:]] += n
            self.last[g[1]] += n
        self.known: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        """Log probability of the third character after the first two."""
        got = self.known.get(gram)
        if got is None:
            two = (self.last_two[gram[1:]] + 0.05) / (self.last[gram[1]] + 2.0)
            got = self.known[gram] = math.log((self.tri.get(gram, 0) + 2.0 * two) / (self.pair_of[gram[:2]] + 2.0))
        return got


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """For every run of one character, what it may stand for and at what cost."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        n, i = j - i, j
        if c in _LETTERS:
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, -2.0)] if n == 2 else [(c, -1.0), (c * 2, -1.5)])
            continue
        arcs = [(x * k, -1.0 - 0.5 * (k > 1)) for x in LOOKALIKES.get(c, "") for k in range(1, min(n, 2) + 1)]
        if c in " \t\n":
            arcs += [("", -0.1), (" ", -0.5)]
        elif c in SEPARATORS or not arcs:
            # dropping a letter's place is cheap for the language model, so a look-alike has to be worth a letter
            arcs.append(("", -6.0 if arcs else -0.5 if c in SEPARATORS else -3.0))
        out.append(arcs)
    return out


def restore(token: str, model: CharModel) -> str:
    """The likeliest reading of a disguised (lower-case) token: words separated by blanks."""
    best = {"  ": (0.0, "")}
    for arcs in [*_lattice(token), [(" ", 0.0)]]:
        step: dict[str, tuple[float, str]] = {}
        for state, (score, text) in best.items():
            for emit, cost in arcs:
                s, st = score + cost, state
                for c in emit:
                    if c == " " and st[1] == " ":
                        continue
                    s += model.cost(st + c)
                    st = "  " if c == " " else st[1] + c
                if st not in step or s > step[st][0]:
                    step[st] = (s, text + emit)
        best = step
    return max(best.values())[1].strip()


def disguised(token: str) -> bool:
    """Whether a token has letters and something that may hide one."""
    if token.isalpha() and token.isascii():
        return bool(_TRIPLE.search(token))
    return bool(_WORD.search(token)) and (any(c in LOOKALIKES or c in SEPARATORS for c in token)
                                          or bool(_TRIPLE.search(token)))


def squeezed(word: str) -> str:
    """A word with runs of a letter taken once, marked as such."""
    return "~" + "".join(c for i, c in enumerate(word) if i == 0 or word[i - 1] != c)


def _letters_apart(token: str) -> str | None:
    """The characters of a token that alternates them with separators, else None."""
    odd = token[1::2]
    if len(token) < 5 or not all(c in SEPARATORS for c in odd) or any(c.isspace() for c in token[::2]):
        return None
    return token[::2]


def _doubled(words: set[str], model: CharModel, ordinary: frozenset[str], heads: frozenset[str] | None = None) -> set[str]:
    """Readings of the words that have a doubled letter and are no ordinary spellings, squeezed ones too.

    With ``heads`` words are left alone of which no reading begins like a
    feature: their readings could not count.
    """
    out: set[str] = set()
    for w in words:
        if len(w) > 3 and _DOUBLE.search(w) and w not in ordinary:
            if heads is not None and not _may_count(w, heads):
                continue
            readings = restore(w, model).split()
            out.update(x for x in readings if len(x) > 1)
            out.add(squeezed(w))
    return out


def heads_of(lexicon: dict[str, float]) -> frozenset[str]:
    """First ``HEAD`` letters of all words that have a weight: those of the features and of their plurals."""
    return frozenset((w.lstrip("^~") + end)[:HEAD] for w in lexicon for end in ("", "s"))


def _may_count(w: str, heads: frozenset[str]) -> bool:
    """Whether a spelling of ``w``, its doubled letters taken once or twice, begins like a feature."""
    if not _LETTERS.issuperset(w):
        return True  # a letter that may stand for another one
    head = w[:HEAD]
    if len(set(head)) == len(head):  # doubled letters come later
        return head in heads
    starts = {""}
    for run in _RUNS.finditer(w):
        some = [run[1], run[1] * 2] if len(run[0]) > 1 else [run[1]]
        starts = {(s + x)[:HEAD] for s in starts for x in some}
        if all(len(s) == HEAD for s in starts):
            break
    return not heads.isdisjoint(starts)


def words_of_token(token: str, model: CharModel | None, inside: int = 0,
                   ordinary: frozenset[str] | None = None, heads: frozenset[str] | None = None) -> set[str]:
    """Plain and restored words of one lower-case token; restored ones also ``squeezed``.

    With ``inside``, every run of 4 to that many letters within a token whose
    letters stand apart, as such a token may hold several words.  With
    ``ordinary``, words with a doubled letter that are not among them are
    restored too (those that ``heads`` rule out excepted).
    """
    bare = token.strip(EDGE)
    if bare.isalpha() and not _TRIPLE.search(bare):
        if bare.isascii() or _ALIKE.isdisjoint(bare):
            return {bare} if ordinary is None or model is None else {bare} | _doubled({bare}, model, ordinary, heads)
    out = set(_WORD.findall(token))
    if ordinary is not None and model is not None:
        out |= _doubled(out, model, ordinary, heads)
    if model is not None:
        core = _DECORATION.sub("", token).rstrip(EDGE).lstrip(EDGE.replace("!", ""))
        if core[:1] == "!" and not disguised(core[1:]):  # a sign before a plain word, or its first letter
            out.update(x for x in restore(core, model).split() if len(x) > 1)
            core = core.lstrip(EDGE)
        if disguised(core):
            readings = restore(core, model).split()
            if "1" in core or "|" in core:  # i and l look alike in either sign: the reading with l counts too
                readings += restore(core.replace("1", "l").replace("|", "l"), model).split()
            close = _letters_apart(" ".join(core.split()))
            if close is not None:
                whole = [close]
                if disguised(close):
                    whole = restore(close, model).split() + restore(close.replace("1", "l").replace("|", "l"), model).split()
                readings += whole
                if inside:
                    out.update(w[i:i + n] for w in whole for i in range(len(w) - 3) for n in range(4, inside + 1) if i + n <= len(w))
            out.update(x for x in readings if len(x) > 1)
            out.update(squeezed(x) for x in readings if len(x) > 3)
    return out


def weight_of(word: str, lexicon: dict[str, float]) -> float:
    """Largest weight among a word's features."""
    one = lexicon.get(word) or (lexicon.get(word[:-1], 0.0) if word.endswith("s") else 0.0)
    return max(one, *(lexicon.get("^" + word[:k], 0.0) for k in STEMS if len(word) > k), 0.0)


def tokens_of(text: str) -> set[str]:
    """Lower-case tokens of a text; a row of single characters is one token."""
    low = text.lower()
    if not low.isascii() and _INVISIBLE.search(low):
        low = _INVISIBLE.sub("", low)
    out = set(low.split())
    out.update(m.group() for m in _SPACED.finditer(low))
    return out


def _gram_codes(low: str) -> np.ndarray:
    """Numbers of the trigrams of the words of a lower-case text (several, joined by line ends)."""
    code = _CODE[np.minimum(np.frombuffer(f" {low} ".encode("utf-32-le"), np.uint32), len(_CODE) - 1)]
    place = np.flatnonzero(code != _SIGN).astype(np.int32)
    code = code[place]
    inside = code > 0
    word = np.cumsum(~inside, dtype=np.int32)  # every blank opens one, which may be empty
    # a word with anything but letters, or with a sign between its letters
    bad = code == _OTHER
    bad[1:] |= inside[1:] & inside[:-1] & (place[1:] - place[:-1] > 1)
    left_out = np.zeros(int(word[-1]) + 1, bool)
    left_out[word[bad]] = True
    last = np.append(code[~left_out[word]], 0).astype(np.int32)
    first, middle = np.zeros_like(last), np.zeros_like(last)
    middle[1:] = last[:-1]
    first[1:] = middle[:-1]
    first[middle == 0] = 0  # a word begins
    there = (last > 0) | (middle > 0)
    return ((first * _SIGN + middle) * _SIGN + last)[there]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character trigrams of the words of a partition's texts."""
    grams: Counter = Counter()
    held: list[np.ndarray] = []

    def fold():
        if held:
            seen, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            grams.update(dict(zip(seen.tolist(), counts.tolist())))

    for rb in slices(batches, "text", GRAM_BYTES):
        held.append(_gram_codes("\n".join(t for t in rb.column("text").to_pylist() if t).lower()))
        if sum(map(len, held)) > GRAMS_HELD:
            fold()
    fold()
    seen = np.array(list(grams), np.int64)
    letters = np.array([" ", *sorted(_LETTERS)], object)
    names = letters[seen // _SIGN ** 2] + letters[seen // _SIGN % _SIGN] + letters[seen % _SIGN]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(grams.values(), pa.int64())], ["gram", "n"])


def char_model(docs: DataFrame) -> dict[str, int]:
    """Trigram counts over all texts (at most letters**3 of them, whatever the input)."""
    got = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_grams, "gram string, n long")
           .groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    return dict(zip(got["gram"], got["n"].astype(int)))


def wilson_low(hits, n, z: float = Z):
    """Lower end of the Wilson interval of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _train_rows(grams: dict[str, int]):
    def run(batches):
        model = CharModel(grams)
        cache: dict[str, set] = {}
        for rb in slices(batches, "text"):
            words = []
            for t in rb.column("text").to_pylist():
                got: set[str] = set()
                for token in tokens_of(t or ""):
                    w = cache.get(token)
                    if w is None:
                        if len(cache) > LEARNT:
                            cache.clear()
                        w = cache[token] = words_of_token(token, model)
                    got |= w
                words.append(sorted(w for w in got if w[0] != "~"))
            shingles, sizes = shingle_hashes(*word_hashes(*string_buffer(rb.column("text"))))
            ends = np.cumsum(sizes)
            sketch = [",".join(map(str, shingles[e - n:e][:SKETCH].tolist())) for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(sketch, pa.string()), rb.column("toxic").cast(pa.int32()),
                                              pa.array(words, pa.list_(pa.string()))], ["sketch", "toxic", "words"])
    return run


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """Learn the character model from ``docs`` and the lexicon from ``labels`` (doc_id, toxic).

    Rows without label or doc_id are ignored; a doc_id labelled both ways
    counts as toxic; of more than ``max_train`` labelled ids those of smallest
    hash are taken (which bounds the broadcast).  Without labels nothing is
    toxic.
    """
    grams = char_model(docs)
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    rows = (texts.mapInArrow(_train_rows(grams), "sketch string, toxic int, words array<string>")
            .groupBy("sketch", "toxic").agg(F.min("words").alias("words")).select("toxic", "words"))
    rows = cut_lineage(rows)
    stems = F.flatten(F.transform("words", lambda w: F.concat(F.array(w), *[
        F.when(F.length(w) > k, F.array(F.concat(F.lit("^"), F.substr(w, F.lit(1), F.lit(k))))).otherwise(
            F.array().cast("array<string>")) for k in STEMS])))
    told = rows.select("toxic", F.explode(F.array_distinct(stems)).alias("feature"))
    # features of enough toxic texts: bounded by those texts, so by max_train
    hits = cut_lineage(told.where("toxic = 1").groupBy("feature").agg(F.count("*").alias("h")).where(f"h >= {MIN_TEXTS}"))
    single = hits.where("feature NOT LIKE '^%'").select("h", F.explode(F.array(*[
        F.concat(F.lit("^"), F.substr("feature", F.lit(1), F.lit(k))) for k in STEMS])).alias("feature"))
    single = single.groupBy("feature").agg(F.max("h").alias("one"))
    hits = hits.join(single, "feature", "left").where(
        f"feature NOT LIKE '^%' OR coalesce(one, 0) < {ONE_WORD} * h").drop("one")
    misses = told.where("toxic = 0").join(F.broadcast(hits.select("feature")), "feature").groupBy("feature").agg(
        F.count("*").alias("m"))
    counted = hits.join(misses, "feature", "left").selectExpr("feature", "double(h) AS h", "double(h + coalesce(m, 0)) AS n")
    z2 = Z * Z
    low = f"(h + {z2 / 2} - {Z} * sqrt(h * (n - h) / n + {z2 / 4})) / (n + {z2})"
    best = (counted.selectExpr("feature", f"{low} AS weight").where(f"weight >= {MIN_WEIGHT}")
            .orderBy(F.desc("weight"), "feature").toPandas())
    lexicon = dict(zip(best["feature"], best["weight"].astype(float)))
    known = {w for w in lexicon if w[0] != "^"}
    begin = {w[1:] for w in lexicon if w[0] == "^"}

    def has(w):
        out = w.isin(sorted(known)) if known else F.lit(False)
        for k in STEMS:
            own = sorted(x for x in begin if len(x) == k)
            out = out | ((F.length(w) > k) & F.substr(w, F.lit(1), F.lit(k)).isin(own)) if own else out
        return out
    rest = rows.where(~F.exists("words", has)).agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # spellings of at most max_train texts
    doubled = rows.select("toxic", F.explode("words").alias("w")).where(F.rlike("w", F.lit(r"(\p{L})\1")))
    plain = doubled.groupBy("w").agg(F.sum("toxic").alias("h"), F.count("*").alias("n")).where(
        f"n - h >= {ORDINARY} AND n - h >= h").select("w").toPandas()
    return {"grams": grams, "lexicon": lexicon, "base": min(0.5, (rest[1] + 0.05) / (rest[0] + 1.0)),
            "ordinary": frozenset(plain["w"])}


def _scorer(model: dict):
    lexicon, base = dict(model["lexicon"]), model["base"]
    lexicon |= {squeezed(w): p for w, p in lexicon.items() if w[0] != "^" and len(w) > 3}
    heads = heads_of(lexicon)
    ordinary = model["ordinary"]
    longest = max([12, *(len(w) for w in lexicon if w[0] not in "^~")])

    @F.pandas_udf("score double, evidence string")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chars = CharModel(model["grams"])
        cache: dict[str, tuple[float, str]] = {}
        plain: set[str] = set()  # tokens without any word that has a weight
        miss = (0.0, "")

        def look(token):
            got, bare = miss, token.strip(EDGE)
            if bare.isalpha() and (bare.isascii() or _ALIKE.isdisjoint(bare)) and (
                    not _DOUBLE.search(bare) or not _TRIPLE.search(bare) and (
                        len(bare) <= 3 or bare in ordinary or not _may_count(bare, heads))):
                words = (bare,) if bare[:HEAD] in heads else ()  # a plain word, and no other reading can count
            else:
                words = words_of_token(token, chars, longest, ordinary, heads)
            for w in words:
                # a word without a feature's beginning has no weight; the mark of a squeezed one is not of it
                p = weight_of(w, lexicon) if (w[1:HEAD + 1] if w[0] == "~" else w[:HEAD]) in heads else 0.0
                if p:
                    got = max(got, (p, w.removeprefix("~")))
            if len(cache) + len(plain) > CACHE:
                cache.clear()
                plain.clear()
            if got is miss:
                plain.add(token)
            else:
                cache[token] = got
            return got

        for series in texts:
            out = []
            for t in series:
                best = miss
                for token in tokens_of(t) - plain if t else ():
                    got = cache.get(token) or look(token)
                    if got > best:
                        best = got
                out.append(best)
            yield pd.DataFrame({"score": [p if p else base for p, _ in out], "evidence": [w for _, w in out]})
    return score


def add_toxicity(docs: DataFrame, model: dict, column: str = "_toxicity") -> DataFrame:
    """``docs`` with a struct (score, evidence) of its text; other columns pass by untouched.

    Null and empty texts get the base rate and no evidence; every row is
    scored by itself, so repeated rows score alike, and an empty table stays
    empty.
    """
    return docs.withColumn(column, _scorer(model)(F.col("text").cast("string")))


def held_out(doc_id="doc_id"):
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence (the word that decides)."""
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels.where(~held_out()))
    return add_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), F.col("_toxicity.score").alias("score"),
        F.when(F.col("_toxicity.score") >= threshold, 1).otherwise(0).alias("predicted"),
        F.col("_toxicity.evidence").alias("evidence"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; columns unchanged."""
    model = fit(docs, labels.where(~held_out()))
    got = fresh(docs.columns, "toxicity")[0]
    return add_toxicity(docs, model, got).where(F.col(f"{got}.score") < threshold).select(*docs.columns)
