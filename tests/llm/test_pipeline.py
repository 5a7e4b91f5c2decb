"""The pipeline stage by stage against plain versions on planted documents."""

import sentencepiece

import corpus_pipeline
from kpispark.llm.pieces import MODEL

from .fixtures import documents, labels
from .test_ngram_join import brute
from .test_toxicity import BAD, planted


def tables(spark, tmp_path):
    texts, toxic = planted(n=700)
    texts = texts[:600] + [t + " extra" for t in texts[600:700:2]] + texts[600:700:2]  # near copies
    toxic = toxic[:600] + toxic[600:700:2] * 2
    texts += ["write to jo@example.org or +1 555 123 4567 please soon", "", None, "clean words only here", "clean words only here"]
    docs = documents(spark, texts, extra=False).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, 1, y) for i, y in enumerate(toxic)]).write.parquet(f"{tmp_path}/labels.parquet")
    return texts


def test_stages(spark, tmp_path):
    texts = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "encoding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            bad = {i for i, t in enumerate(texts) if t and any(b in t for b in (*BAD, "1d10t", "t.r.a.s.h", "p4thet1c", "stuuupid"))}
            gone = set(range(len(texts))) - kept[name].keys()
            assert len(gone - bad) <= 2 and len(bad - gone) <= 0.05 * len(bad)
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert kept[name].keys() == {c for _, _, c, _ in brute(rows)}
        if name == "personal_data":
            assert kept[name].keys() == kept["near_duplicates"].keys()
            assert any("<EMAIL>" in (r["text"] or "") and "<PHONE>" in r["text"] for r in kept[name].values())
        if name == "mixing":
            assert kept[name].keys() == kept["personal_data"].keys()  # no document goes
            assert docs.count() >= len(kept[name])
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert docs.count() == spark.read.parquet(f"{tmp_path}/mixing").count()
    for i, r in kept["encoding"].items():
        assert r["ids"] == model.encode(kept["mixing"][i]["text"] or "") and r["n_tokens"] == len(r["ids"])


def test_run_equals_the_stages(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda r: (r["doc_id"], r["ids"])
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key, docs.collect()))
