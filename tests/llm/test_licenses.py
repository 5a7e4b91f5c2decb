"""Licence scan against a plain version of the base rules; method labels on planted notices."""

import random
import re

import pytest

from kpispark.llm.licenses import PHRASES, TEMPLATES, license_scan

from .fixtures import EDGE, documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places, names = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += hits
        if hits:
            names.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names))


def texts():
    rnd = random.Random(6)
    bits = ["Under the MIT License.", "under the mit", "license", "Apache License, Version 2.0", "apache license version 3", "CC BY-NC 4.0", "cc-by", "nc",
            "foo", "éa", "🙂", "ÀÉ", "under_the_mit_license", "underthe mit license", "\x7f", "CC\nBY\tNC", "licen"]
    return [" ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(250)]


def test_base_columns_equal_plain_version(spark):
    rows = EDGE + texts()
    got = {r["doc_id"]: r for r in license_scan(documents(spark, rows, extra=False)).collect()}
    for i, t in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"])


def test_templates_are_found_and_need_their_key_phrase(spark):
    filler = "some other words here and there "
    rows = [filler * 3 + t.title() + ". " + filler for _, t, _ in TEMPLATES]
    rows += ["This work is licensed under the GNU General Public License, version 3.",
             "permission granted software copy person hereby charge", "the general public was free to license software", "the public"]
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan(documents(spark, rows, extra=False)).collect()}
    for i, (label, _, _) in enumerate(TEMPLATES):
        assert label in got[i], (label, got[i])
    assert got[len(TEMPLATES)] == ["gpl-3"]
    assert all(got[i] == [""] for i in range(len(TEMPLATES) + 1, len(rows)))


def test_repeated_rows_null_ids_and_empty_table(spark):
    assert license_scan(documents(spark, EDGE)).count() == len(EDGE) + 2
    assert license_scan(empty(spark)).count() == 0


def test_every_license_of_a_file_is_found_whatever_else_it_holds(spark):
    text = {label: t for label, t, _ in TEMPLATES}
    both = text["bsd"] + " provided " + text["mit"]
    prose = "universal charge domain zero unencumbered dedication sharealike attribution " + text["isc"]
    rows = [text["mit"]] * 30 + [text["isc"]] * 30 + ["some public text"] * 5 + [both, prose]
    got = {r["doc_id"]: r for r in license_scan(documents(spark, rows, extra=False)).collect()}
    assert got[len(rows) - 2]["labels"] == "bsd,mit" and got[len(rows) - 1]["labels"] == "isc"
    assert all(abs(got[i]["score"] - 1) < 1e-9 for i in (0, 30, len(rows) - 2, len(rows) - 1))


def test_all_key_phrases_of_a_template_have_to_stand(spark):
    whole = next(t for label, t, _ in TEMPLATES if label == "apache-2")
    rows = [whole, whole.replace("version 2 0", "version 1 1")]
    got = {r["doc_id"]: r["labels"] for r in license_scan(documents(spark, rows, extra=False)).collect()}
    assert got == {0: "apache-2", 1: ""}


def by_hand(rows, templates=TEMPLATES):
    """Templates whose key phrases all stand where one beginning has them, found by trying every place."""
    out = []
    for text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        labels = set()
        for label, t, keys in templates:
            tw = t.split()
            for s in range(-len(tw), len(words)):
                def stands(key):
                    k = key.split()
                    at = s + next(i for i in range(len(tw)) if tw[i:i + len(k)] == k)
                    return at >= 0 and words[at:at + len(k)] == k
                if all(stands(k) for k in keys):
                    labels.add(label)
        out.append(labels | set(filter(None, plain(text)[4].split(","))))
    return out


def test_labels_equal_trying_every_place(spark):
    """Files of pieces of several templates, in parts, among prose with the rarest words, against brute force."""
    rnd = random.Random(8)
    pieces = [t for _, t, _ in TEMPLATES] + [k for _, _, ks in TEMPLATES for k in ks]
    pieces += ["zero unencumbered sharealike dedication", "universal domain charge", "public license", "software foundation", "Under the MIT License."]
    rows = []
    for _ in range(120):
        some = []
        for piece in rnd.choices(pieces, k=rnd.randint(1, 5)):
            w = piece.split()
            if rnd.random() < 0.4:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice([[], ["word"], w[at:at + 1] * 2]) + w[at + rnd.randint(0, 1):]
            some.append(" ".join(w))
        rows.append("\n".join(some))
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in license_scan(documents(spark, rows, extra=False)).collect()}
    assert [got[i] for i in range(len(rows))] == by_hand(rows)


def test_templates_of_ones_own(spark):
    own = (("house", "this text belongs to the house of words and nobody may copy it", ("house of words", "nobody may copy it")),)
    rows = ["This text belongs to the House of Words and nobody may copy it!", "house of words", "nobody may copy it", None]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 6)) for r in license_scan(documents(spark, rows, extra=False), own).collect()}
    assert got == {0: ("house", 1.0), 1: ("", 0.0), 2: ("", 0.0), 3: ("", 0.0)}
    with pytest.raises(ValueError, match="key phrase"):
        license_scan(documents(spark, rows, extra=False), (("x", "some words here", ("other words",)),))
