"""Quality rules: word statistics and an n-gram log-likelihood ratio for every document.

Two multinomials over hashed word unigrams and bigrams are compared: the trusted target
(labelled documents of good quality that are not toxic) and the raw corpus (all documents).  A
document's score is the mean over its n-grams of log p_target - log p_raw, so it does not grow
with length.  It is kept when the base rules hold and the score reaches ``threshold``, a
constant: the same text under the same two models always gets the same verdict.

The target is fitted on at most ``max_trusted`` labelled documents, those with the smallest
hash of their id; their ids are broadcast (1.6 MB at the default).  The raw counts cover all
documents.  Both models are ``2 ** bits`` pairs of numbers; tasks add up their counts before the
shuffle, and the summed table is all that reaches the driver.

Null text counts as empty: no words, base_failed.  A null doc_id is scored like any other, but
never trusted.  Without trusted documents the two models are equal and the score is 0 (kept, if
the base rules hold).  Repeated rows each count and get equal verdicts.  Other columns pass
through ``reject``; names that start with ``_q_`` are reserved.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Piece, grams, mix, pieces

BITS = 16
THRESHOLD = -0.22
MAX_TRUSTED = 200_000
SMOOTHING = 20.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _buckets(piece: Piece, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of a piece and the text each belongs to."""
    text = piece.text_of_word()
    pairs, at = grams(words, piece.first, 2)
    both = np.concatenate((mix(words + np.uint64(1)), pairs))
    return (both >> np.uint64(64 - bits)).astype(np.int64), np.concatenate((text, text[at]))


def _counts(batches: Iterator[pa.RecordBatch], trusted, bits: int) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for batch in batches:
        ids = batch.column("doc_id")
        good = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), trusted.value) & ids.is_valid().to_numpy(zero_copy_only=False)
        for piece in pieces(batch.column("text")):
            bucket, text = _buckets(piece, piece.hashes(piece.starts, piece.ends), bits)
            raw += np.bincount(bucket, minlength=1 << bits)
            target += np.bincount(bucket[good[piece.rows][text]], minlength=1 << bits)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(target[used]), pa.array(raw[used])], names=["bucket", "target", "raw"])


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """The log ratio of target to raw probability for each bucket."""
    spark = docs.sparkSession
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long"))
    ids = [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).collect()]
    trusted = spark.sparkContext.broadcast(np.array(ids, np.int64))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = base.mapInArrow(lambda it: _counts(it, trusted, bits), "bucket long, target long, raw long")
    rows = sums.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    target, raw = np.zeros(1 << bits), np.zeros(1 << bits)
    target[rows.bucket], raw[rows.bucket] = rows.target, rows.raw
    if not target.sum():
        return np.zeros(1 << bits)
    # pseudo-counts in proportion to the sizes: a bucket with few counts says little either way
    raw += SMOOTHING
    target += SMOOTHING * target.sum() / (raw.sum() - SMOOTHING * len(raw))
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _text_ids(borders: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(borders, at, "right") - 1


def _again(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of a text: whether an equal one stands in the same text, and whether an earlier one does."""
    key = hashes ^ mix(text.astype(np.uint64) + np.uint64(0x51ED270B))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def statistics(piece: Piece, words: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a piece."""
    data, n = piece.data, len(piece)
    count = np.diff(piece.first)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    chars = np.concatenate(([0], np.cumsum(lead[piece.ends] - lead[piece.starts])))
    text = piece.text_of_word()
    # lines: of each text the spans between line feeds, those with a word only
    feeds = np.flatnonzero(data == 10)
    filled = np.flatnonzero(np.diff(piece.offsets) > 0)
    starts = np.union1d(piece.offsets[filled], feeds + 1)
    starts = starts[starts < len(data)]
    of_line = _text_ids(piece.offsets, starts)
    ends = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, starts)], piece.offsets[of_line + 1])
    word_at = np.searchsorted(piece.starts, starts)
    full = np.append(piece.starts, len(data))[word_at] < ends
    starts, ends, of_line = starts[full], ends[full], of_line[full]
    _, later = _again(of_line, piece.hashes(starts, ends))
    # three-word windows found twice or more in their text
    runs, at = grams(words, piece.first, 3)
    twice, _ = _again(text[at], runs)
    covered = np.zeros(len(words) + 1, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return {
        "n_words": count,
        "word_chars": chars[piece.first[1:]] - chars[piece.first[:-1]],
        "n_symbols": piece.per_text(_SYMBOL[data]),
        "n_dup_lines": np.bincount(of_line[later], minlength=n),
        "n_repeat_words": np.bincount(text[covered[:-1]], minlength=n),
    }


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_VERDICT = "struct<" + ", ".join(f"{c}: bigint" for c in _BASE) + ", score: double, base_failed: boolean, kept: boolean>"


def _judged(texts: pa.Array, ratios: np.ndarray, bits: int, threshold: float) -> pa.StructArray:
    parts = []
    for piece in pieces(texts):
        words = piece.hashes(piece.starts, piece.ends)
        own = statistics(piece, words)
        bucket, text = _buckets(piece, words, bits)
        total = np.bincount(text, weights=ratios[bucket], minlength=len(piece))
        own["score"] = total / np.maximum(np.bincount(text, minlength=len(piece)), 1)
        own["base_failed"] = (own["n_words"] < 50) | (100 * own["n_repeat_words"] > 50 * own["n_words"])
        own["kept"] = ~own["base_failed"] & (own["score"] >= threshold)
        parts.append(own)
    names = [*_BASE, "score", "base_failed", "kept"]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names]
    kinds = [pa.int64()] * len(_BASE) + [pa.float64(), pa.bool_(), pa.bool_()]
    return pa.StructArray.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents with a struct ``_q_verdict`` of counts, score, base_failed and kept."""
    bits = int(len(ratios)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf(_VERDICT)
    def verdict(texts: pa.Array) -> pa.Array:
        return _judged(texts, shared.value, bits, threshold)

    return docs.withColumn("_q_verdict", verdict(F.col(text).cast("string")))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, score, base_failed and kept for each document."""
    return judge(docs, fit(docs, labels), **options).select("doc_id", "_q_verdict.*")


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The kept documents, with all their columns."""
    return judge(docs, fit(docs, labels), **options).filter("_q_verdict.kept").drop("_q_verdict")
