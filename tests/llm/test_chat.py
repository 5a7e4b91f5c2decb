"""Chat formatting against a plain version, and as an exact round trip."""

import hashlib
import random

from kpispark.llm.chat import END, START, chat_digest, chat_examples, read_back

SCHEMA = "conv_id long, turn long, role string, text string, stream string"
TRICKY = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\|", "<\\|", "<", "|", "a\nb\n", "", None, "<<|im_end|>\n", "\\n", "é🙂", "<|"]


def rows():
    rnd = random.Random(8)
    out = []
    for c in range(40):
        for t in range(rnd.randint(1, 12)):
            out.append((c, t, rnd.choice(["user", "assistant", "system", "tool\nbox", "a\\/b", None, "<|x"]), rnd.choice(TRICKY) or "", "s"))
    out += [(50, 0, "assistant", None, "s"), (50, 0, "assistant", None, "s"), (51, None, "user", "x", "s"), (None, 0, "user", "lost", None)]
    return out


def plain(data):
    convs = {}
    for c, t, r, x, _ in data:
        convs.setdefault(c, []).append(((t is not None, t), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_and_digest(spark):
    data = rows()
    want = plain(data)
    frame = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = {r["conv_id"]: r for r in chat_digest(frame).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == digest("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), digest(loss))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read_back(chat_examples(frame)).collect()}
    assert back == want


def test_every_reply_is_one_example_with_all_earlier_turns(spark):
    data = [(1, 0, "system", "be kind", ""), (1, 1, "user", "hi", ""), (1, 2, "assistant", "hello", ""), (1, 3, "user", "bye", ""),
            (1, 4, "assistant", "ciao", ""), (1, 5, "user", "?", ""), (2, 0, "user", "alone", "")]
    got = sorted(map(tuple, chat_examples(spark.createDataFrame(data, SCHEMA)).collect()))
    first = f"{START}system\nbe kind{END}\n{START}user\nhi{END}\n{START}assistant\nhello{END}\n"
    second = f"{first}{START}user\nbye{END}\n{START}assistant\nciao{END}\n"
    assert [g[2] for g in got] == [first, second, f"{second}{START}user\n?{END}\n", f"{START}user\nalone{END}\n"]
    assert [g[2][g[3]:g[4]] for g in got] == ["hello", "ciao", "", ""]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat_examples(none).count() == 0 and chat_digest(none).count() == 0
