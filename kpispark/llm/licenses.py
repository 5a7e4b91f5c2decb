"""Licence scan by a positional rare-token index, by built-in functions only.

The index maps each licence word to its postings (template, position).  A file
looks up its own ``RARE`` licence words of highest IDF; each posting and place
tell where the template would begin (their difference), and a spot on which
``AGREE`` different words agree is a candidate.  A candidate counts once all
mandatory key phrases of its template stand there word by word.  Templates of
which the file has ``AGREE`` words or more and that this did not settle are
looked up by all of the file's licence words, the next rarest and so on: as
the words of a key phrase that stands agree on its spot, no template that can
be verified is missed, whatever else the file holds.

The corpus is read once: texts without any licence word only get their word
count, the others keep their words.  What is shuffled then are places of
licence words, a few numbers each, and the words of files with a candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AGREE = 2      # different words of a file that have to place a template alike
RARE = 6       # licence words of highest IDF that a file looks up first

#: Base phrases (fixed by the specification) and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Openings of public licence texts and notices, and the phrases that must stand in them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction",
     ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license",
     ("licensed under the apache license version 2", "except in compliance with the license")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either "
              "version 3 of the license",
     ("free software foundation either version 3",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met",
     ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted",
     ("permission to use copy modify and or distribute this software",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike",)),
    ("cc0", "creative commons zero v1 0 universal public domain dedication", ("creative commons zero",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
)
#: Function words are no index words.
STOP = frozenset("a and any are as by for in is it may of or that the this to use with you not 0 2 3 4 v".split())

def positions(templates) -> dict[str, list[tuple[int, int]]]:
    """word -> its postings (template, position)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text, keys) in enumerate(templates):
        for p, w in enumerate(text.split()):
            if w not in STOP:
                out.setdefault(w, []).append((t, p))
        for key in keys:
            if len({w for w in key.split() if w not in STOP}) < AGREE or f" {key} " not in f" {text} ":
                raise ValueError(f"key phrase {key!r} is not of its template or has too few licence words")
    return out


#: Every text with a base phrase, or with a template's key phrase, holds one of these.
SIGNS = (r"licen|permission|redistribution|mozilla|creative|unencumbered|software|public"
         r"|cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _stands(words: Column, phrase: str, at: Column) -> Column:
    """Whether a phrase's words stand at a place (from 0; places outside give false)."""
    out = F.lit(True)
    for i, w in enumerate(phrase.split()):
        out = out & F.coalesce(F.get(words, (at + i).cast("int")) == w, F.lit(False))
    return out & (at >= 0)


def _places(words: Column, phrase: str) -> Column:
    n = len(phrase.split())
    first = F.filter(F.transform(words, lambda w, i: F.when(w == phrase.split()[0], i)), lambda i: i.isNotNull())
    return F.when(F.size(words) >= n, F.filter(first, lambda i: _stands(words, phrase, i))).otherwise(
        F.array().cast("array<int>"))


def scan_words(docs: DataFrame, index) -> DataFrame:
    """Per document: row (a number of its own), doc_id, n_words, words (only of texts with a licence word, else null)."""
    low = _lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    told = docs.select("doc_id", low.alias("low"))
    words = F.regexp_extract_all("low", F.lit(WORD), F.lit(0))
    signs = SIGNS if index is None else SIGNS + "|" + "|".join(sorted(index))
    return told.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"),
                       F.when(F.rlike("low", F.lit(signs)), words).alias("words"))


def word_weights(hits: DataFrame, n: int, index) -> dict[str, float]:
    """IDF of every index word over the whole corpus of ``n`` documents."""
    df = {r["w"]: r["n"] for r in hits.groupBy("w").agg(F.count_distinct("row").alias("n")).collect()}  # index words at most
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in index}


def _verified(templates, t: int, words: Column, s: Column) -> Column:
    """Whether all key phrases of a template stand where a spot has them."""
    out = F.lit(True)
    for key in templates[t][2]:
        out = out & _stands(words, key, s + _offset(templates[t][1], key))
    return out


def _share(templates, t: int, idf: dict[str, float], words: Column, s: Column) -> Column:
    """Share of a template's IDF that the words standing at their places make up."""
    own: dict[str, list[int]] = {}
    for p, w in enumerate(templates[t][1].split()):
        if w not in STOP:
            own.setdefault(w, []).append(p)
    out = F.lit(0.0)
    for w, places in own.items():
        here = F.lit(False)
        for p in places:
            # the template may begin before the text does
            here = here | ((s + p >= 0) & F.coalesce(F.get(words, F.greatest(s + p, F.lit(0)).cast("int")) == w, F.lit(False)))
        out = out + F.when(here, idf[w]).otherwise(0.0)
    return out / (sum(idf[w] for w in own) or 1.0)


def _chosen(templates, of) -> Column:
    """``of(t)`` for a row's template."""
    out = F.when(F.lit(False), of(0))
    for t in range(len(templates)):
        out = out.when(F.col("t") == t, of(t))
    return out


def found_templates(scanned: DataFrame, templates, index) -> DataFrame:
    """(row, t, share) of the verified templates of every file, the best spot of each."""
    spark = scanned.sparkSession
    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(sorted(index)))
    hits = cut_lineage(scanned.where("words IS NOT NULL").select("row", F.inline(at)))
    idf = word_weights(hits, scanned.count(), index)
    postings = F.broadcast(spark.createDataFrame([(w, t, p) for w, ps in index.items() for t, p in ps], "w string, t int, p int"))
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "w string, idf double"))
    rarest = Window.partitionBy("row").orderBy(F.desc("idf"), "w")     # a file's index words: bounded by the index
    first = hits.select("row", "w").distinct().join(weights, "w").withColumn("rank", F.row_number().over(rarest)).where(
        F.col("rank") <= RARE).select("row", "w")

    def settled(some: DataFrame) -> DataFrame:
        """Verified templates by the postings of (row, w, i, t, p)."""
        spots = some.groupBy("row", "t", (F.col("i") - F.col("p")).alias("s")).agg(F.count_distinct("w").alias("n")).where(
            F.col("n") >= AGREE)
        there = spots.join(scanned.select("row", "words"), "row")
        s, words = F.col("s"), F.col("words")
        sure = there.where(_chosen(templates, lambda t: _verified(templates, t, words, s)))
        return sure.groupBy("row", "t").agg(F.max(_chosen(templates, lambda t: _share(templates, t, idf, words, s))).alias("share"))
    posted = hits.join(postings, "w")
    sure = cut_lineage(settled(posted.join(first, ["row", "w"], "left_semi")))
    open_ = (posted.groupBy("row", "t").agg(F.count_distinct("w").alias("n")).where(F.col("n") >= AGREE).select("row", "t")
             .join(sure, ["row", "t"], "left_anti"))
    return sure.unionByName(settled(posted.join(open_, ["row", "t"])))


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a base phrase stands; else the share of the best
    verified template's IDF that the words standing at their places make up;
    else 0.  ``templates`` are (label, lower-case text, mandatory key phrases).
    A null text counts as empty: no words, no labels, null places.  Every row
    is scanned by itself; an empty table stays empty; other columns are
    ignored.
    """
    index = positions(templates)
    scanned = cut_lineage(scan_words(docs.select("doc_id", "text"), None if templates is TEMPLATES else index))
    names = F.array(*[F.lit(label) for label, _, _ in templates])
    found = found_templates(scanned, templates, index).groupBy("row").agg(
        F.collect_set(F.get(names, F.col("t"))).alias("added"), F.max("share").alias("share"))   # templates at most
    words = F.col("words")
    base = F.array(*[F.struct(F.lit(label).alias("label"), _places(words, phrase).alias("at")) for phrase, label in PHRASES])
    places = F.flatten(F.transform("base", lambda x: x["at"]))
    own = F.transform(F.filter("base", lambda x: F.size(x["at"]) > 0), lambda x: x["label"])
    has = words.isNotNull()
    plain = scanned.select("row", "doc_id", "n_words", has.alias("has"), F.when(has, base).alias("base")).select(
        "row", "doc_id", "n_words", F.when(F.col("has"), F.size(places)).otherwise(0).cast("long").alias("n_base"),
        F.when(F.col("has"), F.array_min(places)).cast("long").alias("first_word"),
        F.when(F.col("has"), F.array_max(places)).cast("long").alias("last_word"),
        F.coalesce(F.sort_array(own), F.array().cast("array<string>")).alias("own"))
    out = plain.join(found, "row", "left")
    added = F.coalesce("added", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("own", added))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))).alias("score"))


def _offset(text: str, phrase: str) -> int:
    """Place of a key phrase in its template."""
    words, key = text.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i:i + len(key)] == key)
