"""The pipeline's stages in turn, over rows with nulls, repeats and more columns."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece

from veilwork.llm import quality_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", text.translate(LOW))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    base = [" ".join(f"word{rng.randrange(3000)}" for _ in range(120)) for _ in range(12)]
    texts = base + [base[0].upper(), base[0], base[1] + " tail", base[2].replace("word", "other", 1), None, "", "short", "same " * 200]
    rows = [(i, t, "en", "s", len(t or ""), i) for i, t in enumerate(texts)] + [(0, base[0], "en", "s", 1, 1), (None, base[3] + " more", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _maybe int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(8, 0, 0), (9, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages, where = dict(corpus_pipeline.STAGES), str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near copies", "mixing", "encoding"]

    good = stages["quality rules"](spark, docs, where)
    want = sum(r["kept"] for r in quality_rules.score(docs, labels).collect())
    assert good.columns == docs.columns and good.count() == want
    assert all(r["text"] and len(r["text"].split()) >= 50 and not r["text"].startswith("same") for r in good.collect())

    once = stages["exact dedup"](spark, docs, where)
    seen = {}
    for i, t, *_ in rows:
        seen.setdefault((t or "").translate(LOW), []).append(-1 if i is None else i)
    assert once.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in once.collect()) == sorted(max(v) for v in seen.values())

    near = stages["near copies"](spark, once.filter("doc_id is not null"), where)
    left = {r["doc_id"]: r["text"] or "" for r in once.collect() if r["doc_id"] is not None}
    gone = set()
    for i in left:  # families here are pairs, so the smaller one stays
        for j in left:
            a, b = shingles(left[i]), shingles(left[j])
            if i < j and left[i] and 100 * len(a & b) >= 80 * len(a | b):
                gone.add(j)
    assert gone and near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == sorted(set(left) - gone)

    mixed = stages["mixing"](spark, docs, where)
    assert mixed.columns == docs.columns and mixed.count() <= len(rows)

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in stages["encoding"](spark, docs, where).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = model.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), where).count() == 0, name


def test_each_stage_bounds_its_batches(spark, monkeypatch):
    """However a stage is called, and whatever was set before, texts go to Python a few megabytes at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for module, call in ((corpus_pipeline.quality_rules, "reject"), (corpus_pipeline.exact_dedup, "dedup"), (corpus_pipeline.ngram_join, "keep_one"), (corpus_pipeline.mixing, "sample"), (corpus_pipeline.piece_codec, "code")):
        monkeypatch.setattr(module, call, lambda docs, *_, **__: docs)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    docs = spark.range(1).selectExpr("id as doc_id", "'s' as source", "named_struct('n_tokens', 1, 'ids', 1, 'ids_sha256', 1, 'decoded_sha256', 1) as _piece_code")
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "64m")
            stage(spark, docs, "")
            assert int(spark.conf.get(name).rstrip("b")) == 4 << 20
    finally:
        spark.conf.set(name, before)
