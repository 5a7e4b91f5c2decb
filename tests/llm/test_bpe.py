"""Ids against the tokenizers library and against plain merging; decoding as an exact round trip."""

import hashlib
import itertools
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kpispark.llm.bpe import MODEL, Bpe, Encoder, add_ids, add_text, bpe_round_trip, byte_alphabet

from .fixtures import EDGE, documents, empty


@pytest.fixture(scope="module")
def bpe():
    return Bpe()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(MODEL))


def texts():
    rnd = random.Random(4)
    parts = ["the", "Supercalifragilistic", "ing", " ", "  ", "\n", "é", "漢", "🙂", "0", "##", "tion", "$%", "def f(x):",
             "\t", "www.x.org/?a=b", "ñ", "'s", "'LL", " ", "​", "<|endoftext|>"]
    return [t or "" for t in EDGE] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(300)] + [
        "ab" * 400, "日本語" * 200, "=" * 333, " " * 50, "trailing   ", "<|endoftext|><|endoftext|>", "<|endoftext", "a" * 99]


def ids(encoder, text):
    return np.frombuffer(encoder.packed(text), "<u4")


def test_ids_equal_the_library(bpe, library):
    encoder = Encoder(bpe)
    for text in texts():
        got = ids(encoder, text).tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text
        assert bpe.decode(np.array(got, np.int64)).decode() == library.decode(got, skip_special_tokens=False) == text


def test_a_small_memory_gives_the_same_ids(bpe, monkeypatch):
    monkeypatch.setattr("kpispark.llm.bpe.CACHE", 3)
    monkeypatch.setattr("kpispark.llm.bpe.PAIRS", 3)
    monkeypatch.setattr("kpispark.llm.bpe.HUGE", 5)
    small = Encoder(bpe)
    monkeypatch.undo()
    large = Encoder(bpe)
    assert [small.packed(t) for t in texts()] == [large.packed(t) for t in texts()]


def merged(word, ranks):
    """Plain merging: the pair of lowest rank, the leftmost first."""
    parts = list(word)
    while True:
        at = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
        if at is None:
            return parts
        i = at[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def toy(tmp_path, merges, name="toy.json"):
    chars = {b: c for c, b in byte_alphabet().items()}
    vocab = {chars[b]: b for b in range(256)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    spec = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
            "added_tokens": [], "model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}}
    path = tmp_path / name
    path.write_text(json.dumps(spec))
    return Bpe(str(path)), {i: t for t, i in vocab.items()}


def test_every_short_word_of_random_merges(tmp_path):
    """Brute force over all words of up to 7 letters under random merge tables, runs of one letter included."""
    rnd = random.Random(8)
    for table in range(12):
        made, merges = ["a", "b"], []
        while len(merges) < 7:
            pair = rnd.choice(made), rnd.choice(made)
            if pair not in merges and len(pair[0] + pair[1]) <= 6:
                merges.append(pair)
                if pair[0] + pair[1] not in made:
                    made.append(pair[0] + pair[1])
        bpe, text_of = toy(tmp_path, merges, f"{table}.json")
        ranks, pairs = {m: r for r, m in enumerate(merges)}, {}
        for n in range(1, 8):
            for word in map("".join, itertools.product("ab", repeat=n)):
                assert [text_of[i] for i in bpe.encode_chunk(word.encode(), pairs)] == merged(word, ranks), (merges, word)


def test_refused_files(tmp_path):
    with pytest.raises(ValueError, match="later merges"):
        toy(tmp_path, [("ab", "a"), ("a", "b")])
    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    path = tmp_path / "words.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        Bpe(str(path))


def test_long_chunks_take_linear_time(bpe):
    import time
    start = time.time()
    word = ("abcdefghij" * 50_000).encode()
    assert b"".join(bpe.decode(np.array(bpe.encode_chunk(word, {}))) for _ in (0,)) == word
    assert time.time() - start < 10


def test_round_trip_rows(spark, library):
    rows = texts()
    got = sorted(bpe_round_trip(documents(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    want = [(i, t) for i, t in enumerate(rows)] + [(None, "no id here"), (3, "\n\n")]
    by = {}
    for i, t in want:
        packed = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
        by.setdefault(i, set()).add((len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert len(got) == len(want)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in by[r.doc_id] for r in got)
    assert bpe_round_trip(empty(spark)).count() == 0


def test_other_columns_pass_by(spark, bpe):
    docs = documents(spark, ["plain words", None]).withColumn("_back", F.lit("kept"))
    out = add_ids(docs, bpe)
    assert out.columns == [*docs.columns, "ids"]
    back = add_text(out.drop("text"), bpe)
    assert {(r.doc_id, r.text, r._back) for r in back.where("doc_id < 2").collect()} == {(0, "plain words", "kept"), (1, "", "kept")}


def test_decoding_odd_ids(spark, bpe):
    rows = spark.createDataFrame([(None,), ([],), ([-5, 31373, None, 999_999],), ([222],)], "ids array<int>")
    assert [r.text for r in add_text(rows, bpe).collect()] == [None, "", "hello", "�"]
