"""Exact dedup by two-pass Bloom filtering.

Texts are equal when they are identical after lower-casing A-Z.  The first pass hashes every
text and fills two Bloom filters: a hash that the first already holds goes into the second.
The second pass asks the second filter about each row, in the step that hashes its text.  Rows it does not know are surely unique
and pass straight through, without a shuffle; the rest, possibly repeated, shuffle by the full
SHA-256 digest, which decides.

Null counts as the empty text, and all empty texts are equal.  Of equal texts the row with the
largest ``doc_id`` stays (null is smaller than any number); ``dedup`` returns one row even where
several equal rows share that ``doc_id``, taken by a hash of all columns.  An empty table gives
an empty table.  Extra columns pass through; names that start with ``_dedup_`` are reserved.

The broadcast filter has at most 32 MB.  Beyond about 16 million texts it fills up and more rows
take the shuffle; results do not change.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .bloom import build
from .shared import written
from .words import text_bytes


def _digests(texts: pa.Array) -> pa.Array:
    data, offsets = text_bytes(texts)
    content, borders = memoryview(data), offsets.tolist()
    return pa.array([hashlib.sha256(bytes(content[a:b]).lower()).digest() for a, b in zip(borders, borders[1:])], pa.binary())  # noqa: B905


_digest = F.arrow_udf(_digests, BinaryType())


def digest(text: Column | str) -> Column:
    """SHA-256 of the normalised text in UTF-8; ``bytes.lower`` touches A-Z only."""
    return _digest(F.col(text) if isinstance(text, str) else text)


def possibly_repeated(table: DataFrame):
    """A UDF on ``xxhash64`` of the digest: whether the text may occur twice."""
    spark = table.sparkSession
    filled = build(table.select(F.xxhash64("_dedup_digest")), table.count(), repeated=True)
    shared = spark.sparkContext.broadcast(filled)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(shared.value.test(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    return maybe(F.xxhash64("_dedup_digest"))


def mark_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256."""
    table = written(docs.select("doc_id", digest(text).alias("_dedup_digest")), "digests")
    flagged = table.withColumn("_dedup_maybe", possibly_repeated(table))
    rest = written(flagged.filter("_dedup_maybe").drop("_dedup_maybe"), "maybe")
    sizes = rest.groupBy("_dedup_digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # both sides are tables, so that a group that holds much of the input is split at run time
    groups = written(sizes, "groups")
    alone = flagged.filter(~F.col("_dedup_maybe")).withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    return (
        rest.join(groups, "_dedup_digest")
        .unionByName(alone.drop("_dedup_maybe"))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_dedup_digest")).alias("text_sha256"))
    )


def _heads(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(d[:8] for d in digests.to_pylist()), np.uint64)


@F.arrow_udf(LongType())
def _head(texts: pa.Array) -> pa.Array:
    return pa.array(_heads(_digests(texts)).view(np.int64))


def repeated_digest(docs: DataFrame, text: str = "text"):
    """A UDF on the text: its digest where the text may occur twice, else null.

    Digest and filter are one Python step: each step of a task holds a worker of its own.  A UDF that counts as
    deterministic would be computed again for every filter on it.
    """
    table = written(docs.select(_head(F.col(text)).alias("_dedup_head")), "heads")
    shared = docs.sparkSession.sparkContext.broadcast(build(table, table.count(), repeated=True))

    @F.arrow_udf(BinaryType())
    def maybe(texts: pa.Array) -> pa.Array:
        digests = _digests(texts)
        return pc.if_else(pa.array(shared.value.test(_heads(digests))), digests, pa.scalar(None, pa.binary()))

    return maybe.asNondeterministic()


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns."""
    columns = docs.columns
    flagged = docs.withColumn("_dedup_digest", repeated_digest(docs, text)(F.col(text)))
    single = flagged.filter("_dedup_digest is null").select(*columns)
    order = F.struct(F.col("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    # partial maxima: a task sends one row of a group, however many copies it holds
    best = flagged.filter("_dedup_digest is not null").groupBy("_dedup_digest").agg(F.max_by(whole, order).alias("_dedup_row"))
    return single.unionByName(best.select("_dedup_row.*"))
