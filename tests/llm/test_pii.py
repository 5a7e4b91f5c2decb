"""Personal data against a plain regular-expression version."""

import hashlib
import random
import re

from kpispark.llm.pii import personal_data, redact

from .fixtures import EDGE, documents, empty

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def passes(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
            "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    out = []
    for k, (kind, rx) in enumerate(BASE.items()):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rx, text or "") if passes(kind, m.group())]
    return [x[2] for x in sorted(out)]


def texts():
    rnd = random.Random(5)
    bits = ["a@b.c_d@e.f", "x.y+z@mail-1.example.com.", "@", "a@b", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559",
            "1.2.3.4.5.6.7.8", "300.1.1.1", "010.000.255.1", "999999999999999999999.1.1.1", "+1 (555) 123-4567", "+1+22 333 444 555",
            "+49 30 901820", "++", "🙂", "é", " ", "\n", "word", "-", ".", "7", "12", "3782 822463 10005", "a" * 40 + "@", "0" * 30]
    return ["".join(rnd.choice(bits) + rnd.choice(["", " ", ","]) for _ in range(rnd.randint(1, 25))) for _ in range(300)]


def test_base_spans_equal_plain_regular_expressions(spark):
    rows = EDGE + texts()
    got = {r["doc_id"]: r for r in personal_data(documents(spark, rows, extra=False)).collect()}
    for i, t in enumerate(rows):
        want = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        for kind in BASE:
            assert got[i][f"n_{kind}"] == sum(x.startswith(kind + ":") for x in want)
        assert set(want) <= set(got[i]["spans"].split(","))


def test_added_kinds_need_checksum_or_context(spark):
    rows = ["pay to IBAN GB82 WEST 1234 5698 7654 32 today", "pay to IBAN GB83 WEST 1234 5698 7654 32 today",
            "DE89370400440532013000", "her ssn is 123-45-6789.", "part 123-45-6789.", "ssn 000-45-6789"]
    got = {r["doc_id"]: r["spans"] for r in personal_data(documents(spark, rows, extra=False)).collect()}
    assert got[0].split(",")[-1].startswith("iban:12:39") and "iban" not in got[1]
    assert "iban:0:22" in got[2]
    assert got[3] == "ssn:11:22" and "ssn" not in got[4] and "ssn" not in got[5]


def test_redaction_keeps_columns_and_rows(spark):
    rows = ["mail me: jo@example.org or call +1 555 123 4567!", "nothing", None, "+4111 1111 1111 1111"]
    docs = documents(spark, rows)
    out = redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r["doc_id"]: r for r in out.where("key = 'clash' AND n = 1").collect()}
    assert got[0]["text"] == "mail me: <EMAIL> or call <PHONE>!" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == "nothing" and got[2]["text"] is None
    assert "1111" not in got[3]["text"]


def test_repeated_rows_null_ids_and_empty_table(spark):
    out = personal_data(documents(spark, EDGE)).collect()
    assert len(out) == len(EDGE) + 2 and sum(r["doc_id"] is None for r in out) == 1
    assert personal_data(empty(spark)).count() == 0


def test_long_runs_take_linear_time(spark):
    rows = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "a.b" * 60_000 + "@x", "+1" + " " * 100_000, "1.2.3." * 30_000]
    assert personal_data(documents(spark, rows, extra=False)).count() == len(rows)


def test_many_hits_in_one_text(spark):
    """40,000 addresses in one text: places, digest and redaction, in little more than linear time."""
    import time
    n = 40_000
    text = " ".join(f"u{i % 7}@ex.org" for i in range(n))
    docs = documents(spark, [text, "🙂" * 3000 + text[:5000]], extra=False)
    personal_data(documents(spark, ["a@b.cd"], extra=False)).collect()  # compiled code
    start = time.time()
    got = {r["doc_id"]: r for r in personal_data(docs).collect()}
    assert time.time() - start < 20
    assert got[0]["n_email"] == n and got[0]["spans"].startswith("email:0:9,email:10:19") and got[0]["spans"].endswith(f"email:{len(text) - 9}:{len(text)}")
    assert got[1]["spans"].startswith("email:3000:3009,email:3010:3019")
    start = time.time()
    out = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert time.time() - start < 20
    assert out[0] == " ".join(["<EMAIL>"] * n) and out[1].startswith("🙂" * 3000 + "<EMAIL> <EMAIL>")


def test_places_across_chunks(spark, monkeypatch):
    monkeypatch.setattr("kpispark.llm.pii.CHUNK", 7)
    rows = ["ab 🙂 jo@example.org, 10.0.0.1 and +1 555 123 4567; visa 4111 1111 1111 1111 é x@y.zz", "x@y.zz", "é" * 50 + " call +1 555 123 4567"]
    small = sorted((r["doc_id"], r["spans"], r["top_score"]) for r in personal_data(documents(spark, rows, extra=False)).collect())
    clean = sorted((r["doc_id"], r["text"]) for r in redact(documents(spark, rows, extra=False)).collect())
    monkeypatch.undo()
    assert small == sorted((r["doc_id"], r["spans"], r["top_score"]) for r in personal_data(documents(spark, rows, extra=False)).collect())
    assert clean == sorted((r["doc_id"], r["text"]) for r in redact(documents(spark, rows, extra=False)).collect())
    for doc, spans, _ in small:
        for kind, a, b in (x.split(":") for x in spans.split(",")):
            assert rows[doc][int(a):int(b)].strip() and (kind != "email" or "@" in rows[doc][int(a):int(b)])
    assert clean[1][1] == "<EMAIL>"


def test_columns_of_any_name_pass_by(spark):
    docs = documents(spark, ["a@b.cd"], extra=False).selectExpr("*", "'x' AS _spans", "'y' AS spans", "'z' AS Chunks")
    out = redact(docs)
    assert out.columns == docs.columns
    assert [(r["text"], r["_spans"], r["spans"], r["Chunks"]) for r in out.collect()] == [("<EMAIL>", "x", "y", "z")]
