"""Quality classifier by co-training of two views.

* Text view: naive Bayes over hashed words, log likelihoods averaged over the words.
* Metadata view: naive Bayes over a page's source, language and layout bands (length, lines, line
  length, word length, capitals, digits, other signs), which know no word.

Labelled documents are split by a hash of their id: four fifths train, one fifth calibrates.  In
each round both views are fitted, score all documents, and hand their confident verdicts on
unlabelled documents to the other view as pseudo-labels.  At the end either view's log odds are
calibrated (logistic regression on the held-out fifth, from a histogram) and the calibrated log
odds are added, less the prior's, to score every document; ``kept`` is a score of ``KEEP`` or more,
which is low, so that a good document is rarely lost.

Texts are read once: each row keeps its words as packed 16-bit buckets beside its metadata, so that
every fit and score follows from the row alone and no text is joined or moved in a round.  The text
view is fitted on all labelled and pseudo-labelled documents; the metadata view, the histograms and
the scores cover all documents.  The weights of sources and languages, however many, stay a table;
all else that comes to the driver has a fixed size.  The first round has labels only, the others
exchange pseudo-labels.

Null text counts as empty.  A null doc_id is scored but never trains the text view; null source or language is
a value of its own.  Repeated rows are scored alike.  With labels of one class only, or none, every
score is the prior.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import pieces

BITS = 15
ROUNDS = 3
CONFIDENT = 0.95
KEEP = 0.2
SMOOTHING = 1.0
TEXT_SCALE = 10.0
_BINS = 400
_REACH = 20.0
_LAYOUT = ("length", "lines", "line_length", "word_length", "capitals", "digits", "signs")
_META = ("source", "lang", *_LAYOUT)

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _bucket(piece) -> np.ndarray:
    return (piece.hashes(piece.starts, piece.ends) >> np.uint64(64 - BITS)).astype(np.uint16)


def _page(texts: pa.Array) -> pa.Array:
    """The layout bands of each text and the buckets of its words, two bytes each."""
    out = [[np.zeros(0, np.int64)] for _ in _LAYOUT]
    packs, counts = [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)]
    for piece in pieces(texts):
        packs.append(_bucket(piece))
        counts.append(np.diff(piece.first))
        size = np.maximum(np.diff(piece.offsets), 1)
        words = np.maximum(np.diff(piece.first), 1)
        feeds = piece.per_text(piece.data == 10) + 1
        share = [np.minimum(np.round(np.log2(1 + 1000 * piece.per_text(flag[piece.data]) / size)), 12) for flag in (_CAPITAL, _DIGIT, _SIGN)]
        bands = [np.log2(size), np.log2(feeds), np.log2(size / feeds), 2 * np.log2(size / words), *share]
        for column, band in zip(out, bands, strict=True):
            column.append(band.astype(np.int64))
    ends = 2 * np.cumsum(np.concatenate(counts))
    packed = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.concatenate(packs))])
    return pa.StructArray.from_arrays([*[pa.array(np.concatenate(c)) for c in out], packed.cast(pa.binary())], names=[*_LAYOUT, "words"])


def _unpacked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of the rows, and how many each row has."""
    rows = words.cast(pa.large_binary())
    ends = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1, 8 * rows.offset)
    data = rows.buffers()[2]
    buckets = np.frombuffer(data, np.uint16, int(ends[-1] - ends[0]) // 2, int(ends[0])) if data and ends[-1] > ends[0] else np.zeros(0, np.uint16)
    return buckets, np.diff(ends) // 2


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label (1 good, 0 poor, null), trains, the metadata features, and the words' buckets."""
    page = F.arrow_udf(_page, "struct<" + ", ".join(f"{c}: bigint" for c in _LAYOUT) + ", words: binary>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", page(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("layout"))
    rows = rows.select("doc_id", "layout.words", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in ("source", "lang")], *[F.col(f"layout.{c}").cast("string").alias(c) for c in _LAYOUT])
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    # never broadcast: labels grow with the documents, and a plan that changes with their size has no steady disk use
    return rows.join(known.hint("merge"), "doc_id", "left").withColumn("trains", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)) > 0)


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        buckets, sizes = _unpacked(batch.column("words"))
        of_word = np.repeat(batch.column("class").to_numpy(zero_copy_only=False), sizes)
        for k in (0, 1):
            counts[k] += np.bincount(buckets[of_word == k], minlength=1 << BITS)
    kind, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(bucket), pa.array(counts[kind, bucket])], names=["kind", "bucket", "words"])


def _fit_text(taught: DataFrame) -> np.ndarray:
    """Log ratio of each word bucket, good to poor; ``taught`` holds class and words."""
    sums = taught.select(F.col("class").cast("int").alias("class"), "words").mapInArrow(_text_counts, "kind long, bucket long, words long")
    table = sums.groupBy("kind", "bucket").agg(F.sum("words").alias("words")).toPandas()
    counts = np.zeros((2, 1 << BITS))
    counts[table.kind, table.bucket] = table.words
    # pseudo-counts in proportion to the sizes, so that a bucket without counts says nothing
    share = np.maximum(counts.sum(axis=1, keepdims=True), 1.0) / max(counts.sum(), 1.0)
    counts = counts + SMOOTHING * 20 * share
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return logs[1] - logs[0]


def _with_text_odds(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """The rows with ``text_odds``, the mean log ratio of their words."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)

    def of(words: pa.Array) -> pa.Array:
        buckets, sizes = _unpacked(words)
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=shared.value[buckets], minlength=len(sizes))
        return pa.array(np.round(total / np.maximum(sizes, 1) * TEXT_SCALE, 9))

    return rows.withColumn("text_odds", F.arrow_udf(of, "double")("words"))


def _fit_meta(rows: DataFrame) -> DataFrame:
    """(feature, value, weight): the log ratio of each feature value; ``rows`` holds class and the
    features.  Values seen fewer than five times, however many there are, share one weight of 0."""
    pairs = rows.select("class", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in _META])))
    counts = pairs.groupBy("feature", "value").agg(F.count_if(F.col("class") == 1).alias("good"), F.count_if(F.col("class") == 0).alias("poor"))
    totals = rows.agg(F.count_if(F.col("class") == 1), F.count_if(F.col("class") == 0)).first()
    good = F.log((F.col("good") + SMOOTHING) / (totals[0] + 2 * SMOOTHING))
    poor = F.log((F.col("poor") + SMOOTHING) / (totals[1] + 2 * SMOOTHING))
    return written(counts.filter("good + poor >= 5").select("feature", "value", (good - poor).alias("weight")), "meta")


def _with_meta_odds(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """The rows with ``meta_odds``; layout bands are few, sources and languages are joined."""
    total = F.lit(0.0)
    layout: dict[str, dict[str, float]] = {}
    for r in weights.filter(F.col("feature").isin(*_LAYOUT)).collect():
        layout.setdefault(r["feature"], {})[r["value"]] = r["weight"]
    for c, own in sorted(layout.items()):
        table = F.create_map(*[F.lit(x) for pair in sorted(own.items()) for x in pair])
        total = total + F.coalesce(F.try_element_at(table, F.col(c)), F.lit(0.0))
    for c in ("source", "lang"):
        rows = rows.join(weights.filter(F.col("feature") == c).select(F.col("value").alias(c), F.col("weight").alias(f"{c}_weight")), c, "left")
        total = total + F.coalesce(f"{c}_weight", F.lit(0.0))
    return rows.withColumn("meta_odds", total).drop("source_weight", "lang_weight")


def _calibrated(rows: DataFrame, odds: str) -> tuple[float, float]:
    """(slope, offset) of a logistic regression of the label on the odds, from a histogram."""
    place = F.least(F.greatest(F.floor((F.col(odds) + _REACH) * _BINS / (2 * _REACH)), F.lit(0)), F.lit(_BINS - 1))
    bins = rows.groupBy(place.alias("bin")).agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("poor")).collect()
    x = np.array([(r["bin"] + 0.5) * 2 * _REACH / _BINS - _REACH for r in bins])
    good, poor = (np.array([float(r[c]) for r in bins]) for c in ("good", "poor"))
    if not good.sum() or not poor.sum():
        return 0.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge, which keeps separable data finite
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        n, off = good + poor, (good + poor) * p - good
        grad = np.array([(off * x).sum() + 1e-2 * a, off.sum() + 1e-2 * b])
        w = n * p * (1 - p)
        hess = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def train_and_score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, p_text, p_meta (calibrated views), p_good (combined) and kept for each document."""
    table = written(features(docs, labels), "features")
    have = table.filter("label is not null and trains").agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    both = have[0] > 0 and have[1] > 0
    prior = float(np.log((have[0] + 1) / (have[1] + 1)))
    sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
    own = F.when(F.col("label").isNotNull() & F.col("trains"), F.col("label"))
    free = F.col("label").isNull() & F.col("doc_id").isNotNull()
    by_text = by_page = table.withColumns({"text_odds": F.lit(0.0), "meta_odds": F.lit(0.0)})
    fit_text = (0.0, 0.0)
    fit_meta = (0.0, 0.0)
    for turn in range(rounds if both else 0):

        def verdict(odds: str, fit: tuple[float, float], turn: int = turn) -> Column:
            at = F.col(odds) * fit[0] + fit[1]
            return F.when(free & F.lit(turn > 0), F.when(at >= sure, 1).when(at <= -sure, 0))

        teach_text = by_page.withColumn("class", F.coalesce(own, verdict("meta_odds", fit_meta)))
        ratios = _fit_text(teach_text.filter("class is not null and doc_id is not null"))
        teach_meta = by_text.withColumn("class", F.coalesce(own, verdict("text_odds", fit_text)))
        meta = _fit_meta(teach_meta.filter("class is not null").select("class", *_META))
        by_text, by_page = _with_text_odds(table, ratios), _with_meta_odds(table, meta)
        held = "label is not null and not trains"
        fit_text = _calibrated(by_text.filter(held), "text_odds")
        fit_meta = _calibrated(by_page.filter(held), "meta_odds")
    # the words go before the rows meet the weights of sources and languages
    scored = _with_meta_odds(by_text.drop("words"), meta) if both else by_text

    def chance(odds: Column) -> Column:
        return F.round(1 / (1 + F.exp(-odds)), 6)

    text = F.col("text_odds") * fit_text[0] + fit_text[1]
    page = F.col("meta_odds") * fit_meta[0] + fit_meta[1]
    total = text + page - prior if both else F.lit(prior)
    shape = [F.col("doc_id"), chance(text if both else total).alias("p_text"), chance(page if both else total).alias("p_meta"), chance(total).alias("p_good")]
    return scored.select(*shape).withColumn("kept", F.col("p_good") >= KEEP)
