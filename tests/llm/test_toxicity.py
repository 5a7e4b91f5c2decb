"""Noisy-channel restoration, and held-out accuracy on a planted corpus."""

import random
import zlib
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest

from kpispark.llm import toxicity as T
from kpispark.llm.toxicity import CharModel, disguised, drop_toxic, fit, restore, tokens_of, toxicity_scores

from .fixtures import EDGE, documents, empty, labels

BAD = ["idiot", "trash", "pathetic", "stupid"]


def model():
    rnd = random.Random(1)
    grams = {}
    for w in BAD * 60 + [" ".join(rnd.choice(["the", "and", "house", "water", "little", "you", "are"]) for _ in range(1))
                         for _ in range(2000)]:
        w = f"  {w} "
        for i in range(len(w) - 2):
            grams[w[i:i + 3]] = grams.get(w[i:i + 3], 0) + 1
    return CharModel(grams)


@pytest.mark.parametrize("seen,word", [
    ("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("iiidiooot", "idiot"), ("tr@sh", "trash"), ("$tup1d", "stupid"),
    ("p4th3t1c", "pathetic"), ("t-r-a-s-h", "trash"), ("st*pid", "stupid"), ("i d i o t", "idiot"), ("t r 4 $ h", "trash")])
def test_disguised_words_are_restored(seen, word):
    assert disguised(seen) and word in restore(seen, model()).split()


def test_spaced_letters_are_one_token():
    assert "y o u i d i o t" in tokens_of("hey Y O U  I D I O T now".replace("  ", " "))
    assert restore("y o u i d i o t", model()).split()[-1].endswith("idiot")


def planted(seed=2, n=900):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["ba", "lo", "ri", "ten", "mo", "sk", "a"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    texts, toxic = [], []
    hide = {"idiot": "1d10t", "trash": "t.r.a.s.h", "pathetic": "p4thet1c", "stupid": "stuuupid"}
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(3, 40))]
        y = rnd.random() < 0.25
        if y:
            for _ in range(2):
                w = rnd.choice(BAD)
                words.insert(rnd.randrange(len(words)), hide[w] if i % 7 == 0 else w)
        texts.append(" ".join(words))
        toxic.append(int(y if rnd.random() > 0.03 else True))
    return texts, toxic


def test_held_out_accuracy_and_no_leak(spark):
    texts, toxic = planted()
    docs = documents(spark, texts, extra=False)
    lab = labels(spark, [(i, 1, y) for i, y in enumerate(toxic)])
    got = {r["doc_id"]: r for r in toxicity_scores(docs, lab).collect()}
    assert len(got) == len(texts)
    held = [i for i in got if got[i]["held_out"]]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    said = [i for i in held if any(b in texts[i] for b in (*BAD, "1d10t", "t.r.a.s.h", "p4thet1c", "stuuupid"))]
    assert sum(got[i]["predicted"] for i in said) >= 0.95 * len(said)
    assert sum(got[i]["predicted"] for i in held) - sum(got[i]["predicted"] for i in said) <= 1
    assert all(0 <= got[i]["score"] <= 1 for i in got)
    # other labels on held-out documents change nothing
    other = labels(spark, [(i, 1, 1 - y if i in set(held) else y) for i, y in enumerate(toxic)])
    assert {i: r["score"] for i, r in got.items()} == {r["doc_id"]: r["score"] for r in toxicity_scores(docs, other).collect()}


def test_edge_cases_and_columns(spark):
    lab = labels(spark, [(0, 1, 1), (1, None, None), (None, 1, 1), (5, 1, 0), (5, 1, 0)])
    docs = documents(spark, EDGE)
    out = toxicity_scores(docs, lab).collect()
    assert len(out) == len(EDGE) + 2 and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in out)
    assert toxicity_scores(empty(spark), lab).count() == 0
    assert toxicity_scores(docs, labels(spark, [])).count() == len(EDGE) + 2
    assert drop_toxic(docs, lab).columns == docs.columns and drop_toxic(docs, lab).count() == len(EDGE) + 2
    assert fit(docs, lab)["lexicon"] == {}


def test_one_extra_letter_hides_no_word(spark):
    texts, toxic = planted()
    seen = ["idioot", "iddiot", "trrash", "patheetic", "stuupid", "say stuupid, now", "IDIOOT's"]
    clean = ["committee", "balloon", "coffee"]  # ordinary spellings stay what they are
    rows = texts + [f"balloon committee coffee tree number {i}" for i in range(40)]
    lab = labels(spark, [(i, 1, y) for i, y in enumerate(toxic + [0] * 40)])
    docs = documents(spark, rows + [f"ba lo {w} ri ten" for w in seen + clean], extra=False)
    got = {r["doc_id"]: r for r in toxicity_scores(docs, lab).collect()}
    assert all(got[len(rows) + i]["predicted"] == 1 for i in range(len(seen)))
    assert all(got[len(rows) + len(seen) + i]["predicted"] == 0 for i in range(len(clean)))


def test_an_ordinary_doubled_word_is_not_its_toxic_neighbour(spark):
    texts = [f"filler lorem lose x{i}" if i % 2 else f"filler lorem loose x{i}" for i in range(400)]
    lab = labels(spark, [(i, 1, i % 2) for i in range(400)])
    got = toxicity_scores(documents(spark, [*texts, "lorem loose", "lorem losse"], extra=False), lab).collect()
    said = {r["doc_id"]: r["predicted"] for r in got}
    assert said[400] == 0 and said[401] == 1 and all(said[i] == i % 2 for i in range(400))


def every_path(token, model):
    """Best reading over all paths of the lattice, scored one by one."""
    import itertools
    best = None
    for arcs in itertools.product(*T._lattice(token), [(" ", 0.0)]):
        score, state = 0.0, "  "
        for emit, cost in arcs:
            score += cost
            for c in emit:
                if c == " " and state[1] == " ":
                    continue
                score += model.cost(state + c)
                state = "  " if c == " " else state[1] + c
        best = max(best, score) if best is not None else score
    return best


def score_of(token, reading, model):
    """The best score of the paths that give one reading."""
    import itertools
    out = []
    for arcs in itertools.product(*T._lattice(token), [(" ", 0.0)]):
        if "".join(e for e, _ in arcs).strip() == reading:
            score, state = 0.0, "  "
            for emit, cost in arcs:
                score += cost
                for c in emit:
                    if c == " " and state[1] == " ":
                        continue
                    score += model.cost(state + c)
                    state = "  " if c == " " else state[1] + c
            out.append(score)
    return max(out)


def test_viterbi_finds_the_best_of_all_paths():
    grams = Counter()
    for w in ["idiot", "toast", "hello", "little", "boot", "sad", "a", "so", "it", "is"] * 5:
        w = f"  {w} "
        grams.update(w[i:i + 3] for i in range(len(w) - 2))
    model = T.CharModel(dict(grams))
    rnd = random.Random(1)
    tokens = ["1d10t", "i d i o t", "h3ll0", "b00t", "s.a.d", "t0@$t", "l1ttle", "!d!ot", "idiooot", "h**lo", "it 1s"]
    tokens += ["".join(rnd.choice("ia1!|0o@s$5t .") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    for token in tokens:
        got = T.restore(token, model)
        assert score_of(token, got, model) == pytest.approx(every_path(token, model)), (token, got)


def test_words_left_alone_could_not_count():
    """With or without the features' beginnings, every token has the same largest weight."""
    grams = Counter()
    for w in ["idiot", "hello", "boot", "moon", "goose", "stupid", "fool"] * 9:
        w = f"  {w} "
        grams.update(w[i:i + 3] for i in range(len(w) - 2))
    model = T.CharModel(dict(grams))
    lexicon = {"idiot": 0.9, "fool": 0.8, "^stup": 0.7, "ab": 0.6}
    lexicon |= {T.squeezed(w): p for w, p in lexicon.items() if w[0] != "^" and len(w) > 3}
    heads = T.heads_of(lexicon)
    rnd = random.Random(2)
    tokens = ["iidiot", "foool", "fools", "stuppid", "abs", "ab", "hello", "gooose", "ßtuppid", "idiott,", "f00l", "i.d.i.o.t"]
    tokens += ["".join(rnd.choice("idotfluspab") for _ in range(rnd.randint(1, 8))) for _ in range(2000)]
    for token in tokens:
        every = max((T.weight_of(w, lexicon) for w in T.words_of_token(token, model, 12, frozenset())), default=0.0)
        some = max((T.weight_of(w, lexicon) for w in T.words_of_token(token, model, 12, frozenset(), heads)
                    if (w[1:T.HEAD + 1] if w[0] == "~" else w[:T.HEAD]) in heads), default=0.0)
        assert every == some, token


def test_texts_that_share_a_passage_count_apart(spark):
    """A passage in many labelled texts does not merge them; copies of one label count once, labels stay apart."""
    rnd = random.Random(3)
    passage = " ".join(rnd.choice("abcdefgh") * 4 for _ in range(12))
    rows = [(i, passage + " " + " ".join(rnd.choice(["nice", "good", "warm"]) + str(rnd.randint(0, 99)) for _ in range(30))
             + (" gnarf" if i % 2 else "")) for i in range(60)]
    copy = " ".join(f"same{i}" for i in range(40)) + " zork"
    rows += [(100 + i, copy) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(100 + i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    model = T.fit(docs, labels)
    assert model["lexicon"].get("gnarf", 0) > 0.8 and "zork" not in model["lexicon"]


def test_trigrams_equal_a_plain_count(monkeypatch):
    rnd = random.Random(7)
    signs = "abcdeio" * 3 + "AÉßÿªŉſıİΣςаé0@.,;!'\"«”…-_/\\ \t\n\x1c\x85\xa0　、​漢😀"
    texts = [None, "", " ", "...", "a", "a.b", "(ab)", "ab…", "ÉA éa"] + [
        "".join(rnd.choice(signs) for _ in range(rnd.randint(1, 80))) for _ in range(2000)]
    want: Counter = Counter()
    for t in texts:
        for w in (t or "").lower().split():
            w = w.strip(T.EDGE)
            if w and T._LETTERS.issuperset(w):
                w = f"  {w} "
                want.update(w[i:i + 3] for i in range(len(w) - 2))
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i:i + 300], pa.string())}) for i in range(0, len(texts), 300)]
    for size, held in ((T.GRAM_BYTES, T.GRAMS_HELD), (100, 50)):
        monkeypatch.setattr(T, "GRAM_BYTES", size)
        monkeypatch.setattr(T, "GRAMS_HELD", held)
        got, = T._grams(iter(batches))
        assert dict(zip(got["gram"].to_pylist(), got["n"].to_pylist())) == want
    assert next(T._grams(iter([]))).num_rows == 0


def test_plain_words_are_not_taken_apart(spark, monkeypatch):
    """Plain words of any alphabet, doubled letters or not, cost a look-up; the others are read as before."""
    asked = []
    whole = T.words_of_token
    monkeypatch.setattr(T, "words_of_token", lambda token, *rest: asked.append(token) or whole(token, *rest))
    score = T._scorer({"grams": model().tri, "lexicon": {"idiot": 0.9}, "base": 0.1, "ordinary": frozenset({"idee"})}).func
    texts = ["letter, größe moon idiot straße ee (boss) idee", "idioot 1d10t letter", "lettter а"]
    got, = score(iter([pd.Series(texts)]))
    assert sorted(asked) == sorted(["idioot", "1d10t", "lettter", "а"])
    assert got["score"].tolist() == [0.9, 0.9, 0.1] and got["evidence"].tolist() == ["idiot", "idiot", ""]
