"""Token counts of flat token files by separator scan.

A flat file is a run of fixed-width token ids; an end-of-document id closes each document, and
there is no index.  ``write_flat`` makes such files from texts, through Spark's text writer with the
identifier as line separator.  ``count`` reads files through Spark, searches each block of a file for
the identifier in one vectorised pass, and stitches documents that cross blocks by an exclusive
prefix scan of the blocks' open tails.

Tokens after the last identifier of a file form a document that is not closed.  An empty text is a
document of 0 tokens, and null counts as empty; an empty file has no documents; an empty table
gives files without documents.  Rows that repeat are written and counted each; columns other than
the text are ignored.  A document of any length is counted whole.  A file must fit into one task's
memory (binary reads are per file); ``write_flat`` starts a new one after ``docs_per_file`` texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DTYPE = ">u2"
#: Above all ids of the 50,256-rank vocabularies; its two bytes, C5 80, are one UTF-8 character.
SEPARATOR = 0xC580
BLOCK_TOKENS = 1 << 16
DOCS_PER_FILE = 4096

_ENCODERS: dict[int, tiktoken.Encoding] = {}


def _encoder(content: bytes, pattern: str) -> tiktoken.Encoding:
    key = hash((content, pattern))
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def write_flat(docs: DataFrame, path: str, ranks: str, pattern: str, text: str = "text", docs_per_file: int = DOCS_PER_FILE) -> None:
    """Tokenise the texts and write flat files below ``path``; ``ranks`` is read by the driver."""
    with open(ranks, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def of(texts: pa.Array) -> pa.Array:
        encoder = _encoder(shared.value, pattern)
        return pa.array([np.array(encoder.encode_ordinary(t or ""), DTYPE).tobytes() for t in texts.to_pylist()], pa.binary())

    # the bytes pass through the writer as they are
    packed = docs.select(F.arrow_udf(of, "binary")(F.col(text).cast("string")).cast("string").alias("value"))
    packed.write.option("lineSep", chr(0x140)).option("maxRecordsPerFile", docs_per_file).text(path)


def block_scan(tokens: np.ndarray, separator: int, block: int = BLOCK_TOKENS) -> tuple[np.ndarray, np.ndarray, bool]:
    """(starts, lengths, whether the last is closed) of the documents in a token array."""
    firsts, heads, inner, tails = [], [], [], []
    for at in range(0, len(tokens), block):
        part = tokens[at : at + block]
        found = np.flatnonzero(part == separator)
        firsts.append(len(found))
        heads.append(int(found[0]) if len(found) else len(part))
        tails.append(len(part) - 1 - int(found[-1]) if len(found) else len(part))
        inner.append(np.diff(found) - 1)
    # open[i]: tokens of the document that block i goes on with; a block without identifier adds to it
    open_tail, carried = np.zeros(len(firsts) + 1, np.int64), 0
    for i, (n, tail) in enumerate(zip(firsts, tails, strict=True)):
        carried = tail if n else carried + tail
        open_tail[i + 1] = carried
    sizes = [np.concatenate(([open_tail[i] + heads[i]], inner[i])) for i in range(len(firsts)) if firsts[i]]
    closed = open_tail[-1] == 0
    if not closed:
        sizes.append(np.array([open_tail[-1]]))
    lengths = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    return starts, lengths, bool(closed)


def count(spark: SparkSession, path: str, dtype: str = DTYPE, separator: int = SEPARATOR, block: int = BLOCK_TOKENS) -> DataFrame:
    """file, doc_no, start, n_tokens, closed for each document of the flat files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                starts, lengths, closed = block_scan(np.frombuffer(content.as_buffer(), dtype), separator, block)
                n = len(starts)
                flags = np.ones(n, bool)
                if n:
                    flags[-1] = closed
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py().rsplit("/", 1)[-1]] * n, pa.string()), pa.array(np.arange(n)), pa.array(starts), pa.array(lengths), pa.array(flags)],
                    names=["file", "doc_no", "start", "n_tokens", "closed"],
                )

    return files.mapInArrow(run, "file string, doc_no long, start long, n_tokens long, closed boolean")
