"""Personal data in texts, by built-in functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and value ranges
confirm them, and words nearby raise or lower a span's score.

Base kinds: email, ip, card, phone; they stay whatever their score.  Added
kinds: iban (mod 97) and ssn (only with a telling word nearby).  Offsets count
code points, ends are exclusive.

The base patterns are those of the specification, written so that Java
matches them in linear time: repetitions are possessive where what follows
can't take part of them, and a pattern that starts with a run only starts at
the run's first character or where the last match ended.  Spark returns
matches but no offsets: they come from the lengths of the pieces between the
matches (``split`` by the same pattern).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
#: A cheap test that every match of a kind passes: most texts skip the patterns.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")),
    "phone": lambda t: F.rlike(t, F.lit(r"\+[0-9]")),
    "iban": lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{10}")),
    "ssn": lambda t: F.rlike(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
}
#: Score of a confirmed span, the words that raise it by ``RAISE``, and those that lower it.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.75, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
TELLING = {
    "email": r"mail|contact|write", "ip": r"\bip\b|host|server|address", "card": r"card|visa|credit|payment",
    "phone": r"phone|tel|call|mobile|fax", "iban": r"iban|bank|account", "ssn": r"ssn|social|security",
}
DOUBTFUL = r"version|example|sample|test"
RAISE, LOWER, NEAR, LEAST = 0.2, 0.2, 40, 0.5
CHUNK = 2048          # characters that a text is cut into to find places in it

_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def part(i):  # i-th digit from the right, doubled at even places
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number in capitals without blanks leaves 1 modulo 97."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(acc, i):
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c <= 57, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        code = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a function of elements would compute it for each of them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, op) -> Column:
    """For every int of an array what ``op`` (sum or maximum) makes of those before it, from 0.

    In blocks of about sqrt(n), as appending to an array copies it: n^1.5 small
    steps at most.
    """
    return _let(values, lambda vs: _before_bound(vs, op))


def _before_bound(values: Column, op) -> Column:
    n, ints = F.size(values), "array<int>"
    block = F.greatest(F.lit(64), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / block).cast("int")),
                         lambda b: F.slice(values, b * block + 1, block))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(ints).alias("all"))
    inner = F.transform(blocks, lambda xs: F.aggregate(xs, empty, lambda acc, x: F.struct(
        op(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{ints}>").alias("all"))
    return F.aggregate(inner, none, lambda acc, x: F.struct(
        op(acc["at"], x["at"]).alias("at"),
        F.concat(acc["all"], F.array(F.transform(x["all"], lambda v: op(v, acc["at"])))).alias("all")), lambda acc: F.flatten(acc["all"]))


def _chunks(text: Column) -> Column:
    """A text cut into pieces of ``CHUNK`` characters: finding a place in it does not start at its beginning then."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, n: Column) -> Column:
    """``n`` characters of a chunked text from ``start`` (from 0)."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor(F.greatest(start + n - 1, start) / CHUNK).cast("int")
    return F.when(n > 0, F.substr(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, n)).otherwise("")


def _found(text: Column, chunks: Column, kind: str) -> Column:
    """array<struct<start, ord, end, kind, score>> of a kind's confirmed spans."""
    pattern = F.lit(PATTERNS[kind])
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    kinds = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"
    pieces = F.arrays_zip(F.slice(between, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    ahead = _before(F.transform(pieces, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda a, b: a + b)
    placed = F.zip_with(pieces, ahead, lambda x, at: F.struct((at + F.length(x["gap"])).alias("start"), x["hit"].alias("hit")))

    def span(x):
        start, end = x["start"], x["start"] + F.length(x["hit"])
        around = F.lower(F.concat_ws("\n", _cut(chunks, F.greatest(start - NEAR, F.lit(0)), F.least(start, F.lit(NEAR))),
                                     _cut(chunks, end, F.lit(NEAR))))
        score = (F.lit(SCORES[kind]) + F.when(F.rlike(around, F.lit(TELLING[kind])), RAISE).otherwise(0.0)
                 - F.when(F.rlike(around, F.lit(DOUBTFUL)), LOWER).otherwise(0.0))
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"),
                        F.lit(kind).alias("kind"), F.round(F.least(F.lit(1.0), score), 2).alias("score"))
    spans = F.transform(F.filter(placed, lambda x: confirmed(kind, x["hit"])), span)
    if kind not in BASE:
        spans = F.filter(spans, lambda x: x["score"] >= LEAST)
    return F.when(HINTS[kind](text), spans.cast(kinds)).otherwise(F.array().cast(kinds))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def add_spans(docs: DataFrame, column: str = "_spans") -> DataFrame:
    """``docs`` with a struct of one span array per kind; other columns pass by untouched."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chunks = fresh([*docs.columns, column], "chunks")[0]
    cut = docs.withColumn(chunks, _chunks(text))
    return cut.withColumn(column, F.struct(*[_found(text, F.col(chunks), k).alias(k) for k in KINDS])).drop(chunks)


def _all(column: str, kinds=KINDS) -> Column:
    return reduce(lambda a, b: F.concat(a, b), [F.col(f"{column}.{k}") for k in kinds])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds and of the added ones, digest and list of spans, highest score.

    A null text counts as empty: no spans, the digest of the empty string, a
    null score.  Each row is looked at by itself, so repeated rows give equal
    results and an empty table an empty one; equal starts are ordered by kind.
    """
    found = add_spans(docs.select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id", *[F.size(f"_spans.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(_all("_spans", BASE)), 256).alias("base_sha256"), _listed(_all("_spans")).alias("spans"),
        F.array_max(F.transform(_all("_spans"), lambda x: x["score"])).alias("top_score"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; n_chars follows if there.

    Of overlapping spans the first (then the longest) gives the name and all their
    characters go.  Null texts stay null.
    """
    spans, chunks = fresh(docs.columns, "spans", "chunks")
    text = F.col("text").cast("string")
    found = add_spans(docs, spans).withColumn(chunks, _chunks(text))
    every = _all(spans)
    order = F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                         .when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["ord"] - b["ord"]))
    ends = F.transform(order, lambda x: x["end"])
    parts = F.zip_with(order, _before(ends, F.greatest), lambda x, at: F.when(
        x["start"] >= at, F.concat(_cut(F.col(chunks), at, x["start"] - at), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(""))
    last = F.array_max(ends)
    clean = F.concat(F.array_join(parts, ""), _cut(F.col(chunks), last, F.greatest(F.length(text) - last, F.lit(0))))
    out = found.withColumn("text", F.when(F.size(every) > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(every) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
