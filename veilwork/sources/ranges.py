"""Large text files read in byte ranges where a separator alone does not tell a border.

Spark's text reader deals any file out in blocks, cut at the next separator character, and reads each block in
order in one task.  Whether a separator is a border depends on all that stands before it: in CSV a line end may
be inside quotes, in JSON a comma inside a string or deeper down.  So two passes are made:

1. each block is summed up as a function of the state in which it begins, which is one small row per block;
   a prefix scan over these rows gives the state in which each block really begins;
2. each block is read again in that state and cut into whole items.

An item that goes on in the next block comes out in parts, which are joined by their places; all others are whole.
The rows of blocks, one for each split of a file (128 MB, say), are broadcast to the second pass; nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored



def fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(path, block, value): the text between separators, in order within a block."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Batches cut where a new block begins; a block may take several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, blocks = batch["path"].to_pylist(), batch["block"].to_pylist()
        start = 0
        for k in range(1, len(blocks) + 1):
            if k == len(blocks) or blocks[k] != blocks[start] or paths[k] != paths[start]:
                yield paths[start], blocks[start], batch.slice(start, k - start)
                start = k


def with_state(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """The pieces in the order in which they are read, with the state of their block.

    A block without one was cut otherwise than in the first pass, which must not go unseen.
    """
    columns = [c for c in states.columns if c not in ("path", "block")]
    joined = pieces.join(F.broadcast(states.withColumn("_known", F.lit(True))), ["path", "block"], "left")
    lost = F.raise_error(F.concat(F.lit("no state for a block of "), F.col("path")))
    return joined.withColumn(columns[0], F.when(F.col("_known"), F.col(columns[0])).otherwise(lost)).drop("_known")


def joined_parts(parts: DataFrame, separator: str, first: list[str], last: list[str] = ()) -> DataFrame:
    """Whole items of (path, block, seq, begins, ends, text): items of one part as they are, others joined in order.

    ``seq`` counts the items of a block.  ``first`` are columns that the first part of an item carries, ``last``
    such as only its last one has.  The last item of a file need not end.
    """
    whole = parts.filter("begins and ends").select("path", "block", "seq", *first, *last, "text")
    loose = stored(parts.filter("not (begins and ends)"), "loose-parts")  # two of a block at most
    upto = W.partitionBy("path").orderBy("block", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = loose.select("path", "block", "seq", F.sum(F.col("begins").cast("long")).over(upto).alias("_item"))
    joined = loose.join(placed, ["path", "block", "seq"])
    own = [F.min(F.when(F.col("begins"), F.col(c))).alias(c) for c in ("block", "seq", *first)]
    own += [F.max(F.when(F.col("ends"), F.col(c))).alias(c) for c in last]
    inside = F.sort_array(F.collect_list(F.struct("block", "seq", "text")))
    text = F.array_join(F.transform(inside, lambda p: p["text"]), separator)
    return whole.unionByName(joined.groupBy("path", "_item").agg(*own, text.alias("text")).drop("_item"))
