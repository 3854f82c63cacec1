"""Quality rules, mixing, co-training, chat, tokens, pieces and licences on small data."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from veilwork.llm import chat_format, cotraining, license_scan, mixing, piece_codec, quality_rules, token_counts
from veilwork.llm.queries import BYTE_RANKS, PIECE_MODEL
from veilwork.llm.shared import shared_path

TEXTS = [None, "", " \n ", "one", "a b\nc d\na b\n\n a b\n", "x y z " * 40, "é % # ñ|<é>\n" * 3, "word " * 200_000, "same text here", "same text here"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 3 else "s1", "en", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, score string")


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def brute_counts(s):
    w = re.findall("[^\x20\x09-\x0d]+", s or "")
    seen, dup = set(), 0
    for line in (s or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s or ""), dup, len(cover)


def test_quality_counts(spark):
    docs = docs_of(spark, TEXTS)
    rows = quality_rules.score(docs, labels_of(spark)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = brute_counts(TEXTS[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])  # without labels both models are equal
    assert quality_rules.reject(docs.limit(0), labels_of(spark)).columns == docs.columns


def test_quality_ratio_by_hand(spark):
    texts = ["good plain words " * 3 + str(i) for i in range(6)] + ["bad%% ##sign " * 4] * 3
    docs = docs_of(spark, texts)
    ratios = quality_rules.fit(docs, labels_of(spark, [(i, 1, 0) for i in range(6)]), bits=10)
    assert np.exp(ratios).shape == (1024,)
    got = {r["doc_id"]: r["score"] for r in quality_rules.judge(docs, ratios).select("doc_id", "_q_verdict.score").collect()}
    assert min(got[i] for i in range(6)) > 0 > max(got[i] for i in range(6, 9))


def test_quality_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs, quality_rules.fit(docs, labels.filter("doc_id % 2 = 0"))).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    rows = rows.filter("not _q_verdict.base_failed and quality = 1 and toxic = 0").agg(F.avg(F.col("_q_verdict.kept").cast("int"))).first()
    assert rows[0] > 0.98


def test_mixing(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["sun", "sea", "sky", "day"]) for _ in range(60)) for _ in range(60)]
    texts += [" ".join(rng.choice(["%%", "##", "&&"]) for _ in range(60)) for _ in range(30)]
    docs = docs_of(spark, texts + [None, ""])
    labels = labels_of(spark, [(i, int(i < 60), 0) for i in range(0, 90, 2)])
    rates, plan = mixing.mix(docs, labels, {"good": 0.9, "poor": 0.1})
    rows = rates.collect()
    assert len(rows) == len(texts) + 2 and all(0 <= r["rate"] <= 1 for r in rows)
    assert all(r["p_good"] > 0.9 for r in rows if r["doc_id"] < 60) and all(r["p_poor"] > 0.9 for r in rows if 60 <= r["doc_id"] < 90)
    got = np.array([sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS])
    assert np.abs(got - plan.targets).max() < 0.02 * plan.targets.sum()
    # the same fit with rates held in memory, step by step
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    n = np.array([r["n_tokens"] for r in rows], float)
    gram = np.linalg.pinv((p * n[:, None]).T @ p, rcond=1e-12, hermitian=True)
    rate = np.full(len(rows), plan.start)
    for _ in plan.pulls:
        rate = np.clip(rate - p @ (gram @ ((rate * (n > 0) * n) @ p - plan.targets)), 0, 1)
    assert np.allclose(np.where(n > 0, rate, 0), [r["rate"] for r in rows], atol=1e-6)
    drawn = mixing.sample(docs, labels)
    assert drawn.columns == docs.columns and 0 < drawn.count() < len(texts)
    assert mixing.mix(docs.limit(0), labels)[0].count() == 0
    assert mixing.mix(docs, labels_of(spark))[0].count() == len(texts) + 2


def test_mixing_meets_weights(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rates, plan = mixing.mix(docs, labels)
    rows = rates.collect()
    got = np.array([sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS])
    asked = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    assert np.abs(got / got.sum() - asked).max() < 1e-3 and plan.met
    assert 0.98 * plan.possible < got.sum() <= min(plan.have / asked)
    cells = np.array([[8.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 1.0]])
    assert np.isclose(mixing._largest(cells, np.array([0.5, 0.3, 0.2])), 5.0) and np.isclose(mixing._largest(cells, np.array([0.8, 0.2, 0.0])), 10.0)


def test_mixing_out_of_reach(spark):
    docs = docs_of(spark, ["sun sea " * 30] * 5)
    with pytest.warns(UserWarning, match="not met"):
        plan = mixing.mix(docs, labels_of(spark, [(i, 1, 0) for i in range(5)]), {"good": 0.5, "toxic": 0.5})[1]
    assert not plan.met and plan.asked.tolist() == [0.5, 0.0, 0.5] and plan.totals.sum() > 0


def test_cotraining(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = cotraining.train_and_score(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    right = sum((r["p_good"] >= 0.5) == (r["quality"] == 1) for r in rows)
    assert right > 0.93 * len(rows)
    assert sum(r["kept"] for r in rows if r["quality"] == 1) > 0.98 * sum(r["quality"] == 1 for r in rows)
    odd = cotraining.train_and_score(docs_of(spark, TEXTS), labels_of(spark)).collect()
    assert len(odd) == len(TEXTS) and len({r["p_good"] for r in odd}) == 1


def test_text_view_counts_all(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "MAX_FITTED", 5, raising=False)  # a bound on labels and pseudo-labels together, before
    docs = docs_of(spark, [f"sun w{i}" if i % 2 else f"rain w{i}" for i in range(40)] + [None])
    teach = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, class int")
    ratios = cotraining._fit_text(cotraining.features(docs, labels_of(spark)).join(teach, "doc_id"))
    assert (ratios > 0.01).sum() >= 20 and (ratios < -0.01).sum() >= 20  # each word of its own class has a say


def test_meta_view_keeps_all_sources(spark):
    columns = [F.concat(F.lit("s"), F.floor(F.col("id") / 5)).alias("source"), F.lit("en").alias("lang"), *[F.lit("1").alias(c) for c in cotraining._LAYOUT]]
    rows = spark.range(5 * 10_200).select((F.floor(F.col("id") / 5) % 2).cast("int").alias("class"), *columns)
    scored = cotraining._with_meta_odds(rows, cotraining._fit_meta(rows))
    got = scored.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("meta_odds").alias("low"), F.max("meta_odds").alias("high")).collect()
    want = {0: -np.log(6), 1: np.log(6)}  # (5 + 1) to (0 + 1); the other features say nothing
    assert all(r["n"] == 25_500 and np.isclose(r["low"], want[r["class"]]) and np.isclose(r["high"], want[r["class"]]) for r in got)


def test_viterbi_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    model = chat_format.Model(rng.integers(0, 9, chat_format.STATES).astype(float), rng.integers(0, 9, (chat_format.STATES,) * 2).astype(float), rng.integers(0, 9, (chat_format.STATES, chat_format.N_SYMBOLS)).astype(float))
    symbols = rng.integers(0, chat_format.N_SYMBOLS, 40)
    whole = model.scores(symbols)[chat_format.BEGIN]
    path = model.path(symbols, chat_format.BEGIN, int(whole.argmax()))
    score = model.step[chat_format.BEGIN, path[0]] + model.emit[path, symbols].sum() + model.step[path[:-1], path[1:]].sum()
    assert np.isclose(score, whole.max())
    parts = [{"chunk": i, "scores": model.scores(symbols[i * 10 : i * 10 + 10]).ravel()} for i in range(4)]
    joined = np.concatenate([model.path(symbols[b["chunk"] * 10 : b["chunk"] * 10 + 10], b["entry"], b["last"]) for b in chat_format._borders(parts)])
    assert joined.tolist() == path.tolist()


def test_chat_repeated_rows(spark):
    rows = [("c", 0, "user", "A\nB")] * 2 + [("c", 1, "assistant", "ok")] + [("d", None, None, None)] * 2 + [(None, 0, "user", "x")]
    conv = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id string, turn int, role string, text string, gold string")
    lines = chat_format.transcripts(conv)
    parsed = chat_format.parse(lines, chat_format.fit(lines)).orderBy("conv_id", "chunk", "place").collect()
    assert [(r["conv_id"], r["said"]) for r in parsed] == [("c", s) for s in ("A", "B", "A", "B", "ok")] + [("d", "")] * 2
    empty = chat_format.transcripts(conv.limit(0))
    assert chat_format.render(chat_format.parse(empty, chat_format.fit(empty))).collect() == []


def test_packed_words(spark):
    batches = [pa.array(["b a b", "", "é  b\n"]), pa.array([], pa.string()), pa.array(["", ""])]
    for texts in batches:
        packed = cotraining._page(texts).field("words")
        buckets, sizes = cotraining._unpacked(packed)
        assert sizes.tolist() == [len(t.split()) for t in texts.to_pylist()] and len(buckets) == sizes.sum()
    packed = cotraining._page(batches[0]).field("words")
    buckets, sizes = cotraining._unpacked(packed.slice(2))
    whole, _ = cotraining._unpacked(packed)
    assert sizes.tolist() == [2] and buckets.tolist() == whole[3:].tolist() and whole[0] == whole[2] == whole[4]


def test_chat(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    lines = chat_format.transcripts(conv)
    parsed = chat_format.parse(lines, chat_format.fit(lines))
    role = F.element_at(F.array(*[F.lit(r) for r in chat_format.ROLES]), F.col("gold") + 1)
    n, right = parsed.agg(F.count(F.lit(1)), F.count_if(role == F.col("role"))).first()
    assert n == lines.count() and right > 0.85 * n
    turns = chat_format.render(parsed).collect()
    assert sum(t["n_lines"] for t in turns) == n and all(t["text"].startswith(f"<|{t['role']}|>\n") for t in turns)
    odd = spark.createDataFrame([(1, None, "user", None), (1, 0, None, "x"), (None, 0, "user", "y"), (1, 0, "bot", "x")], "conv_id long, turn long, role string, text string")
    assert chat_format.render(chat_format.parse(chat_format.transcripts(odd), chat_format.fit(chat_format.transcripts(odd)))).count() > 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_block_scan(block):
    rng = np.random.default_rng(block)
    for _ in range(200):
        tokens = rng.integers(0, 4, rng.integers(0, 30))
        want, size = [], 0
        for t in tokens:
            if t == 3:
                want.append(size)
                size = 0
            else:
                size += 1
        closed = size == 0
        if not closed:
            want.append(size)
        starts, lengths, whole = token_counts.block_scan(tokens, 3, block)
        assert lengths.tolist() == want and whole == closed
        assert starts.tolist() == [sum(want[:i]) + i for i in range(len(want))]


def test_flat_files(spark):
    path = shared_path(spark, "flat-test")
    token_counts.write_flat(docs_of(spark, TEXTS), path, BYTE_RANKS, public_tokenizers.PATTERN, docs_per_file=3)
    own = token_counts._encoder(open(BYTE_RANKS, "rb").read(), public_tokenizers.PATTERN)
    assert isinstance(own, tiktoken.Encoding)
    rows = token_counts.count(spark, path).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(own.encode_ordinary(t or "")) for t in TEXTS) and all(r["closed"] for r in rows)


def test_pieces(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    own = piece_codec.Codec(open(PIECE_MODEL, "rb").read())
    rng = random.Random(9)
    letters = "abcdefghinorst THE  ▁\n.,%é日😀0\x00�"
    texts = [t or "" for t in TEXTS] + ["▁▁ ▁", "a" * 500, " " * 40 + "x", "<s></s><0x0A>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        want = model.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == model.decode(want)
    coded = piece_codec.code(docs_of(spark, TEXTS), PIECE_MODEL).select("doc_id", "_piece_code.*").collect()
    assert [r["n_tokens"] for r in sorted(coded)] == [len(model.encode(t or "")) + 2 for t in TEXTS]


def test_licences(spark):
    notice = license_scan.TEMPLATES["mit"]
    docs = docs_of(spark, [None, "", notice, f"text\n{notice.upper()}!!\nmore text", "released under the old mit licence", "a b c d", notice + " " + "word " * 50])
    got = {(r["doc_id"], r["line_no"], r["license"]) for r in license_scan.scan(docs).collect()}
    assert got == {(2, 0, "mit"), (3, 1, "mit"), (6, 0, "mit")}  # the last: 4 of 6 distinct bigrams, 8 / 10
    for size in range(1, 40):
        low, high = license_scan.bounds(size, 0.8)
        fits = [m for m in range(1, 200) if 2 * min(m, size) / (m + size) >= 0.8]
        assert (low, high) == (fits[0], fits[-1])
    assert license_scan.scan(docs.limit(0)).count() == 0
