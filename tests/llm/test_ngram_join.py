"""The n-gram join against brute force over planted and edge-case documents."""

import random

import pytest

from kpispark.llm.components import connected
from kpispark.llm.ngram_join import drop_near_copies, ngram_components


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
                degree[i] += 1
                degree[j] += 1
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            r = find(i)
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(((d, len(s), least.get(find(i)), degree[i]) for i, ((d, _), s) in enumerate(zip(rows, sets))),
                  key=repr)


def corpus(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    texts = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, 14)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
    for _ in range(30):
        own = [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]
        texts.append(" ".join(own + passage))
    texts += ["", None, "  \n\t ", "one two", "ONE  two", "one two three", "É é É é É", "É é É é É",
              "a b c d e", "x " * 3000, "x " * 2990, " ".join(vocab * 8)]
    return [(i * 3, t) for i, t in enumerate(texts)]


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n int")
    return sorted((tuple(r) for r in ngram_components(docs.repartition(5), **kw).select(
        "doc_id", "n_shingles", "component_id", "n_links").collect()), key=repr)


@pytest.mark.parametrize("tile", [1024, 5])
def test_components_equal_brute_force(spark, tile):
    rows = corpus()
    assert run(spark, rows, tile_sets=tile) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(5, text), (5, text), (None, text), (7, "alone here"), (None, "nobody knows this"), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)],
                                  "a long, b long")
    got = {r["node"]: r["label"] for r in connected(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_drop_near_copies_keeps_one_of_a_class(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c, _ in brute(rows)})


def words(rnd, n):
    return " ".join(rnd.choice(["w%d" % i for i in range(500)]) for _ in range(n))


def test_repeated_ids_lose_no_other_text(spark):
    rnd = random.Random(9)
    a, b, c = words(rnd, 80), words(rnd, 80), words(rnd, 80)
    near = a + " one more"
    rows = [(5, a, "x"), (5, b, "x"), (3, near, "x"),         # b is like nothing else: its row stays
            (7, c, "y"), (7, c, "x"), (7, c + " end", "a"),   # one class under one id: the least text stays
            (8, "", "e"), (8, None, "e"), (8, words(rnd, 30), "e"), (None, a, "n"), (9, b, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    for limit in (0, 1000):
        got = sorted(((r.doc_id, r.text, r.key) for r in drop_near_copies(docs, limit).collect()), key=str)
        want = [(5, b, "x"), (3, near, "x"), (7, c, "x"), (8, "", "e"), (8, None, "e"), rows[8], (None, a, "n")]
        assert got == sorted(want, key=str)


def test_one_set_holds_a_third_of_all_rows(spark):
    rnd = random.Random(2)
    many = words(rnd, 40)
    rows = [(i, many if i % 3 == 0 else words(rnd, 40)) for i in range(1800)]
    got = {r.doc_id: r for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(got[i].component_id == (0 if i % 3 == 0 else i) and got[i].n_links == (599 if i % 3 == 0 else 0) for i in got) and len(got) == 1800
