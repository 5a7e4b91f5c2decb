"""Encoding against the sentencepiece library and a plain best-path search; decoding as a round trip."""

import random

import numpy as np
import pytest
import sentencepiece

from kpispark.llm.pieces import MODEL, Memory, Pieces, add_text, sentencepiece_ids, text_sha256

from .fixtures import EDGE, documents, empty


@pytest.fixture(scope="module")
def pieces():
    return Pieces()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rnd = random.Random(4)
    parts = ["the", "Supercalifragilistic", "ing", " ", "  ", "\n", "é", "漢", "🙂", "0", "##", "tion", "$%", "def f(x):", "\t", "www.x.org/?a=b", "ñ"]
    return [t or "" for t in EDGE] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(300)] + [
        "ab" * 400, "日本語" * 200, "=" * 333, " " * 50, "trailing   ", "<s> </s> <unk> <0x41>"]


def test_ids_equal_the_library(pieces, library):
    memory = Memory()
    rows = texts()
    for got, text in zip(pieces.encode(rows, memory), rows):
        assert got.tolist() == library.encode(text), text
        assert pieces.decode(got) == library.decode(got.tolist()) == text


def test_viterbi_finds_the_best_path(pieces):
    word = "▁retention"
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)[None, :]
    flat, counts = pieces.viterbi(codes)
    ids = {n: i for i, n in enumerate(pieces.names)}

    def paths(at):
        if at == len(word):
            yield 0.0
        for to in range(at + 1, len(word) + 1):
            if word[at:to] in ids:
                for rest in paths(to):
                    yield pieces.score[ids[word[at:to]]] + rest
    assert counts[0] == len(flat) and "".join(pieces.names[i] for i in flat) == word
    assert abs(sum(pieces.score[i] for i in flat) - max(paths(0))) < 1e-9


def test_batched_and_heap_merges_agree(pieces):
    rnd = random.Random(9)
    rows = ["".join(rnd.choice("etaoinshr▁") for _ in range(30)) for _ in range(200)]
    codes = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32).reshape(200, 30)
    flat, counts = pieces.merge(codes)
    assert flat.tolist() == np.concatenate([pieces.merge_long(c) for c in codes]).tolist()
    assert counts.sum() == len(flat)


def test_query_rows_and_round_trip(spark, library):
    docs = documents(spark, EDGE)
    out = sentencepiece_ids(docs).collect()
    assert len(out) == len(EDGE) + 2
    want = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple(r["ids"]), r["decoded_sha256"]) for r in out) == sorted(
        (i is None, i or 0, tuple(library.encode(t or "")), text_sha256(t)) for i, t in want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)
    assert sentencepiece_ids(empty(spark)).count() == 0


def test_decode_of_null_and_foreign_ids(spark, pieces):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [99999, -1])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in add_text(rows, pieces).collect()} == {1: None, 2: "", 3: ""}
