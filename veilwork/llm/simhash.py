"""SimHash near-duplicates: pigeonhole blocks, then the Hamming distance itself.

A document's fingerprint has a bit for each bit that more than half of its shingles' XXH64 values
have (shingles of ``n`` lower-cased words, repeats included).  Two fingerprints link when they
differ in at most ``RADIUS`` bits.

Of the ``BLOCKS`` blocks that a fingerprint is cut into, a linked pair agrees on all but ``RADIUS`` at
least, so it meets under one of the masks that keep ``BLOCKS - RADIUS`` whole blocks.  Only distinct
fingerprints take part, and of those only such that share a key with another one:

1. each is compared with the smallest of its key, and components of these links are formed;
2. keys whose members are in one component are done, which is what becomes of large groups of near copies;
3. in the other keys all pairs from different components are compared, inside the tasks; one link of two
   components is enough.  A key of more than ``CROWD`` members is not compared but dealt again, by
   the same pigeonhole principle, over blocks of the bits that its mask leaves open, until it fits.  A mask
   of 60 bits has at most 16 members, so this ends, and no pair is lost.

Null and empty texts have fingerprint zero, which links like any other.  Fewer than ``n`` words are one
shingle.  Repeated rows stay and share their component; rows without a doc_id get one too, but do not name
it.  Other columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, written
from .words import Piece, pieces

RADIUS = 4
BLOCKS = 7
CROWD = 512
SEED = 42
_STEP = 1 << 15


def _joined(piece: Piece) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words, each followed by one space, and their borders."""
    sizes = piece.ends - piece.starts
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.full(starts[-1], 0x20, np.uint8)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(starts[:-1], sizes) + inside] = piece.data[np.repeat(piece.starts, sizes) + inside]
    return out.tobytes(), starts[:-1], starts[:-1] + sizes


def _shingles(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each shingle, and the text it is in."""
    words = np.diff(first)
    counts = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    text = np.repeat(np.arange(len(words)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][text]
    return at, np.minimum(at + n, first[1:][text]) - 1, text


def fingerprints(column: pa.Array, n: int) -> np.ndarray:
    """The fingerprints of a text column as unsigned 64-bit integers."""
    out = np.zeros(len(column), np.uint64)
    for piece in pieces(column, lower=True):
        content, starts, ends = _joined(piece)
        at, last, text = _shingles(piece.first, n)
        ones = np.zeros((len(piece), 64), np.int64)
        total = np.bincount(text, minlength=len(piece))
        for k in range(0, len(at), _STEP):
            now = slice(k, k + _STEP)
            spans = map(slice, starts[at[now]].tolist(), ends[last[now]].tolist())
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(content.__getitem__, spans), repeat(SEED)), ">u8", len(at[now]))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
            own = text[now]
            borders = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            ones[own[borders]] += np.add.reduceat(bits, borders, axis=0, dtype=np.int64)
        out[piece.rows] = np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprint(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row, the fingerprint as a signed 64-bit integer."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts, n).view(np.int64))

    return docs.select("doc_id", F.arrow_udf(of, "long")(F.col(text).cast("string")).alias("fp"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(bits: list[int], parts: int) -> list[int]:
    """The bits dealt to that many masks."""
    return [sum(1 << b for b in block.tolist()) for block in np.array_split(bits, parts)]


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of which two fingerprints within the radius agree under one at least."""
    return [_signed(sum(chosen)) for chosen in combinations(_cut(list(range(64)), blocks), blocks - radius)]


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """The mask with each of radius + 1 blocks of its open bits added; all of them when so few are open."""
    taken = mask % (1 << 64)
    bits = [b for b in range(64) if not taken >> b & 1]
    return [_signed(taken | more) for more in _cut(bits, radius + 1)]


def _near(radius: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= radius


def _cross(radius: int):
    """Links between components inside keys; the rows come sorted by key."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        m, v, c, fp = (table[name].to_numpy() for name in ("m", "v", "c", "fp"))
        found = []
        at, d = np.arange(len(fp)), 1
        while len(at):
            at = at[at + d < len(fp)]
            at = at[(m[at] == m[at + d]) & (v[at] == v[at + d])]  # places with d more of their key
            to = at + d
            close = (c[at] != c[to]) & (np.bitwise_count((fp[at] ^ fp[to]).view(np.uint64)) <= radius)
            found.append(np.stack([c[at[close]], c[to[close]]], axis=1))
            d += 1
        links = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            m, v = held["m"].to_numpy(), held["v"].to_numpy()
            same = (m == m[-1]) & (v == v[-1]) if len(m) else np.zeros(0, bool)
            whole = int(np.argmax(same)) if len(same) else 0  # the last key may go on in the next batch
            if whole:
                yield pairs(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield pairs(held)

    return run


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect what fingerprints ``fp`` within the radius connect; fp must be distinct.

    They connect fingerprints, or the smallest ones of what earlier links connect.
    """
    spark = prints.sparkSession
    every = F.array(*[F.lit(m).cast("long") for m in masks(blocks, radius)])
    keys = prints.select("fp", F.explode(every).alias("m")).withColumn("v", F.col("fp").bitwiseAND(F.col("m")))
    found: DataFrame | None = None
    spent: list[DataFrame] = []
    while True:
        ends = keys.groupBy("m", "v").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
        # both sides have a row for each mask; Spark sizes them as the fingerprints they come from, and would broadcast one
        met = written(keys.join(ends.drop("high").hint("merge"), ["m", "v"]), "simhash-keys")
        star = met.filter((F.col("low") != F.col("fp")) & _near(radius)).select(F.col("low").alias("a"), F.col("fp").alias("b"))
        star = star if found is None else found.unionByName(star)
        star = written(star.distinct(), "simhash-star")
        named = components(star)
        member = met.join(named, met["fp"] == named["id"], "left").select("m", "v", "fp", F.coalesce("component", "fp").alias("c"))
        member = written(member, "simhash-members")
        size = member.groupBy("m", "v").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"))
        open_keys = written(size.filter("c0 < c1").select("m", "v", "n"), "simhash-open")
        small, large = (open_keys.filter(f"n {sign} {crowd}").drop("n") for sign in ("<=", ">"))
        inside = member.join(small, ["m", "v"]).repartition("m", "v").sortWithinPartitions("m", "v", "c", "fp")
        met_inside = inside.select("m", "v", "c", "fp").mapInArrow(_cross(radius), "a long, b long")
        # a chain of earlier links leads from the smallest of a component to all of it
        found = written(star.unionByName(met_inside).distinct(), "simhash-links")
        spent += [met, star, named, open_keys]
        again = [row["m"] for row in large.select("m").distinct().collect()]  # masks, of which there are few
        if not again:
            discard(*spent, member)
            return found
        dealt = spark.createDataFrame([(m, f) for m in again for f in finer(m, radius)], "m long, f long")
        crowded = member.join(large, ["m", "v"]).join(F.broadcast(dealt), "m")
        keys = crowded.select("fp", F.col("f").alias("m"), F.col("fp").bitwiseAND(F.col("f")).alias("v")).distinct()
        keys = written(keys, "simhash-finer")
        spent += [member, keys]


def near_copies(docs: DataFrame, n: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; the component's smallest doc_id names it."""
    prints = written(fingerprint(docs, n, text), "simhash-prints")
    owners = written(prints.groupBy("fp").agg(F.min("doc_id").alias("owner")), "simhash-distinct")
    connecting = links(owners.select("fp"))
    named = components(connecting)
    classes = owners.join(named, owners["fp"] == named["id"], "left").select("fp", "owner", F.coalesce("component", "fp").alias("c"))
    classes = written(classes, "simhash-classes")
    smallest = classes.groupBy("c").agg(F.min("owner").alias("component_id"))
    labels = classes.join(smallest, "c").select("fp", "component_id")
    discard(owners, connecting, named)
    return prints.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
