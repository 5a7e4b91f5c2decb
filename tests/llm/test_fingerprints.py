"""Fingerprints against a plain version, and the documents' order across buckets."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from kpispark.llm import fingerprints as fp

from .fixtures import EDGE, documents, empty


def test_entropies_equal_plain_counts():
    rnd = random.Random(1)
    buf = np.array([rnd.choice(b"aab\x00\xffcdefghij") for _ in range(700)] + [7] * 100 + list(range(256)), np.uint8)
    got = fp.entropies(buf)
    for i in range(0, len(buf) - 63, 13):
        w = buf[i:i + 64].tolist()
        h = -sum(w.count(c) / 64 * math.log2(w.count(c) / 64) for c in set(w))
        assert abs(got[i] - h / 6 * 1000) <= 1


def test_best_windows_equal_plain_minima():
    rnd = random.Random(2)
    rank = np.array([rnd.choice([3, 4, 5, 9, fp._NONE]) for _ in range(400)], np.int32)
    want = np.zeros(400, int)
    for s in range(-63, 400):
        part = [(rank[i], i) for i in range(max(0, s), min(400, s + 64)) if rank[i] != fp._NONE]
        if part:
            want[min(part)[1]] += 1
    assert fp._best(rank).tolist() == want.tolist()


def texts():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rnd.randint(2, 9))) for _ in range(500)]
    out = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 700))) for _ in range(40)]
    return out + [out[0], out[1] + " more", *EDGE, "x" * 64, "y" * 63]


def test_a_texts_fingerprint_does_not_depend_on_its_batch():
    rows = [(t or "").encode() for t in texts()]
    ranks = np.random.default_rng(1).permutation(fp.SCALE + 1).astype(np.int32)
    together = fp.fingerprints(rows, ranks)
    for t, got in zip(rows, together):
        alone = fp.fingerprints([t], ranks)[0]
        assert got.tolist() == alone.tolist()
        assert fp.likeness(got, alone) == 1.0 and (len(got) > 0) == (len(t) > 0)


def test_query_against_plain_order(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 7)  # several buckets
    rows = texts()
    docs = documents(spark, rows, extra=False).withColumn("bucket", F.lit(1)).withColumn("o", F.lit(2))
    got = {r["doc_id"]: r for r in fp.compare_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    ranks = fp.entropy_ranks(docs)
    order = sorted(range(len(rows)), reverse=True)
    for place, i in enumerate(order):
        t, nxt = rows[i] or "", rows[order[(place + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = fp.fingerprints([t.encode(), nxt.encode(), edited.encode()], ranks)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp.written(a), fp.written(c))
        assert (r["near_edited"], r["near_next"]) == (fp.likeness(a, c), fp.likeness(a, b))


def test_likeness_separates_edited_from_foreign_texts(spark):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(5000)]
    rows = [" ".join(rnd.choice(vocab) for _ in range(600)) for _ in range(30)]
    got = fp.compare_fingerprints(documents(spark, rows, extra=False)).toPandas()
    assert (got["near_edited"] > got["near_next"] + 0.2).all()


def test_edge_cases(spark):
    out = fp.compare_fingerprints(documents(spark, EDGE)).collect()
    assert len(out) == len(EDGE) + 2 and sum(r["doc_id"] is None for r in out) == 1
    assert fp.compare_fingerprints(empty(spark)).count() == 0
    one = fp.compare_fingerprints(documents(spark, ["abc" * 50], extra=False)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
