"""Collocations against a plain count of everything; the summaries' guarantee against exact counts."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kpispark.llm import collocations as C
from kpispark.llm.collocations import MisraGries, collocations, frequent_phrases

from .fixtures import EDGE, documents, empty


def plain(rows, least=10, most=3, top=2000, covered=50):
    f, n, out = {}, Counter(), []
    for lang, text in rows:
        c = f.setdefault("und" if lang is None else lang, Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            c.update(tuple(w[i:i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        phrases = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i:i + k] for p, a in phrases.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                  if 100 * a >= covered * c[p[i:i + k]]}
        rows = []
        for p, a in phrases.items():
            if p not in inside:
                score, k = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def prose(rnd, n, words=60):
    vocabulary = [rnd.choice("abcdéß漢") * rnd.randint(1, 3) + str(i % 9) for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    text = []
    for w in rnd.choices(vocabulary, weights, k=n):
        text.append(w.upper() if rnd.random() < 0.1 else w)
        text.append(rnd.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", " ; "]))
    return "".join(text)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    return EDGE + [prose(rnd, rnd.randint(0, 400)) for _ in range(60)] + ["one passage of many words, often said. " * 40] * 3


@pytest.mark.parametrize("options", [{}, {"least": 2, "most": 4, "covered": 70, "top": 50}, {"least": 1, "most": 2}])
def test_rows_equal_a_plain_count(spark, texts, options):
    docs = documents(spark, texts)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert rows_of(collocations(docs, **options)) == plain(rows, **options)


def test_small_stretches_summaries_and_bitmap(spark, texts, monkeypatch):
    """Texts over several stretches, many hash partitions, and a bitmap so full that it spares nothing."""
    docs = documents(spark, texts)
    rows = [(r.lang, r.text) for r in docs.collect()]
    whole = rows_of(frequent_phrases(docs, 3))
    monkeypatch.setattr(C._stretches, "__defaults__", (50,))
    assert rows_of(frequent_phrases(docs, 3, part_mass=200)) == whole
    assert rows_of(collocations(docs, part_mass=100, filter_bits=8)) == plain(rows)


def test_every_frequent_key_survives():
    rnd = np.random.default_rng(3)
    for seed in range(20):
        threshold, mass = int(rnd.integers(2, 20)), 0
        keys = rnd.zipf(1.3, 20_000) % 5_000 if seed % 2 else rnd.integers(0, 8_000, 20_000)
        summary = MisraGries(len(keys) // threshold + 1)
        for part in np.array_split(keys, 37):
            h, c = np.unique(part, return_counts=True)
            summary.add(h.astype(np.uint64), c)
            summary.fold()
            assert len(summary.hashes) <= summary.capacity
            mass += len(part)
        h, c = np.unique(keys, return_counts=True)
        assert set(h[c >= threshold].tolist()) <= set(summary.survivors(threshold).tolist())
        assert summary.taken < threshold


def test_words_and_pieces():
    words, text, piece = C.words_of(pa.array(["A b.c", None, "", "  ", "D", "\te\t;f g", "é!"]))
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f", "g", "é"]
    assert text.tolist() == [0, 0, 0, 4, 5, 5, 5, 6]
    same = [piece[i] == piece[i + 1] for i in range(7)]
    assert same == [True, False, False, False, False, True, False]


def test_ties_cuts_and_exact_scores(spark):
    """Equal scores go by count, then by bytes; the lowest cut counts; products pass 64 bits without loss."""
    text = ["b a. " * 20, "é z. " * 20, "c d. " * 30, "p q r. " * 12, "p. " * 7, "r. " * 3]
    docs = spark.createDataFrame([(t, "x") for t in text], "text string, lang string")
    rows = [("x", t) for t in text]
    assert rows_of(collocations(docs)) == plain(rows)
    big = spark.range(1).selectExpr("CAST(99999999999 AS DECIMAL(15,0)) AS a", "CAST(999999999999 AS DECIMAL(15,0)) AS b")
    assert big.selectExpr("(1000000BD * a * a) div (b * b) AS s").first().s == 10 ** 6 * 99999999999 ** 2 // 999999999999 ** 2


def test_nothing_to_find(spark):
    assert collocations(empty(spark)).count() == 0
    none = spark.createDataFrame([(None, None), ("", "en"), ("... !", "en")], "text string, lang string")
    assert collocations(none).count() == 0
    clash = documents(spark, ["now and then. " * 12]).withColumn("phrase", F.lit(1)).withColumn("count", F.lit(2)).withColumn("part", F.lit(3))
    assert [(r.phrase, r.a) for r in collocations(clash).collect()] == [("now and then", 12)]


def test_the_driver_passes_on_a_small_part_of_the_bitmap(spark, texts):
    docs = documents(spark, texts).select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    for part_mass in (C.PART_MASS, 200):
        bits, slots = C.frequent_bits(docs, 3, part_mass=part_mass)
        assert bits == 0 if part_mass == C.PART_MASS else bits > 2
        assert sum(map(len, slots.values())) < 1 << (C.FILTER_BITS - 3 - 4)  # 16 MB, were it whole
        flags = np.unpackbits(C.whole_bitmap(bits, slots, C.FILTER_BITS))
        held = [(r.lang, r.text) for r in docs.collect()]
        stretch = next(C._stretches([pa.RecordBatch.from_pydict({"lang": [x for x, _ in held], "text": [x for _, x in held]})], 3))
        for _, hashes, counts, _ in stretch.grams(3):
            places = (hashes >> np.uint64(64 - C.FILTER_BITS)).astype(np.int64)
            assert flags[places[counts >= 3]].all() and not flags[places[counts < 3]].all()


class Passed:
    """What tasks read as the broadcast bitmap."""

    def __init__(self, value):
        self.value = value


def bitmap_of(batches, threshold, filter_bits, bits=2):
    """Both steps of the first pass, in this process."""
    by: dict = {}
    for rb in C._summarise(3, bits)(iter(batches)):
        for row in rb.to_pylist():
            by.setdefault(row["part"], []).append(row)
    rows = [r for part in sorted(by) for r in sorted(by[part], key=lambda r: r["kind"])]
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("packed", pa.binary())])
    out = C._survivors(threshold, bits, filter_bits)(iter([pa.RecordBatch.from_pylist(rows, schema)]))
    return Passed((bits, {r["part"]: r["packed"] for rb in out for r in rb.to_pylist()}))


def exact_counts(batches, bitmap, filter_bits):
    out = Counter()
    for rb in C._exactly(3, bitmap, filter_bits)(iter(batches)):
        for r in rb.to_pylist():
            out[r["lang"], r["size"], r["phrase"]] += r["count"]
    return out


def plain_counts(rows):
    out = Counter()
    for lang, text in rows:
        out[lang, 0, ""] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.lower()):
            w = re.findall(r"[^\x20\x09]+", piece)
            out[lang, 0, ""] += len(w)
            out.update((lang, k, " ".join(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return out


def test_tasks_hold_little_beside_their_words():
    rnd = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(20_000)])[np.minimum(rnd.zipf(1.2, 300_000), 20_000) - 1].reshape(1_000, 300)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 500, "text": [" ".join(w) for w in words]})
    bitmap = bitmap_of([batch], 10, 22)
    for run in (C._summarise(3, 8), C._exactly(3, bitmap, 22)):
        rows = 0
        tracemalloc.start()
        try:
            for rb in run(iter([batch])):
                assert rb.nbytes < 3 << 20
                rows += rb.num_rows
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert rows > 256 and peak < 80 * words.size, peak / words.size  # numpy's arrays


@pytest.mark.parametrize("kinds", [0, 3, 50])
def test_counts_are_exact_where_hashes_are_shared(monkeypatch, kinds):
    """n-grams with one hash, and texts that run over several stretches, are counted apart by their words."""
    rnd = random.Random(11)
    rows = [(rnd.choice(["en", "de", "und"]), prose(rnd, rnd.randint(0, 300), 25).lower()) for _ in range(40)]
    batches = [pa.RecordBatch.from_pydict({"lang": [x for x, _ in rows[i:i + 9]], "text": [t for _, t in rows[i:i + 9]]})
               for i in range(0, len(rows), 9)]
    whole = plain_counts(rows)
    if kinds:
        monkeypatch.setattr(C, "mix64", lambda x: x % np.uint64(kinds) << np.uint64(57))
    for size in (C.WORDS, 1000, 40):
        monkeypatch.setattr(C._stretches, "__defaults__", (size,))
        monkeypatch.setattr(C, "STEP", 64 if size == 40 else 1 << 16)
        monkeypatch.setattr(C, "STEP_BYTES", 500 if size == 40 else 1 << 18)
        monkeypatch.setattr(C, "BATCH_BYTES", 100 if size == 40 else 1 << 20)
        found = exact_counts(batches, bitmap_of(batches, 5, 12), 12)
        assert {k: v for k, v in found.items() if k[1] == 0 or v >= 5} == {k: v for k, v in whole.items() if k[1] == 0 or v >= 5}
        assert all(whole[k] == v for k, v in found.items())


def test_stretches_are_of_even_size():
    text = " ".join(f"w{i % 37}" for i in range(1010))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": [text, "a b c"]})
    sizes = [s.starts for s in C._stretches([batch], 3, 100)]
    assert sum(sizes) == 1013 and max(sizes) <= 150 and min(sizes) >= 50  # no leftover of a few words
