"""JSON documents of any size, one a file, read in byte ranges as rows of their members.

A comma never stands inside a token other than a string, so files are cut into blocks at commas.  A block is summed up,
for either answer to whether it begins inside a string, by whether it ends inside one and by how far it goes
down; the prefix scan gives where each block really begins.  The second pass cuts blocks at the brackets and commas of
the outermost ``level`` containers only.  What stands between is a key, or a whole value however deep, and comes
out as text with its place, such as ``customers[17]``.

As in Python's reader the last of several equal keys counts.  A file is malformed when brackets, commas, keys or
values don't fit anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.nested import ODD_KEY, text_nodes
from ..session import stored
from .ranges import by_block, fragments, joined_parts, with_state

_QUOTE, _BACK, _COMMA = b'"'[0], b"\\"[0], b","[0]
_OPEN, _CLOSE = list(b"{["), list(b"}]")


def _bytes(batch: pa.RecordBatch, first: bool) -> bytes:
    """The text of fragments; each but the first of a file stands behind its comma."""
    text = b",".join(v or b"" for v in batch["value"].cast(pa.binary()).to_pylist())
    return text if first else b"," + text


def _lexed(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where brackets and commas outside strings are, by how much each goes down, and whether a string is open."""
    data = np.frombuffer(text, np.uint8)
    place = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != _BACK, place, -1)) if len(data) else place  # the last other byte
    escaped = np.zeros(len(data), bool)
    escaped[1:] = (place[:-1] - plain[:-1]) % 2 == 1
    quotes = (data == _QUOTE) & ~escaped
    open_before = (np.cumsum(quotes) - quotes + inside) % 2 == 1
    step = np.isin(data, _OPEN).astype(np.int64) - np.isin(data, _CLOSE)
    at = np.flatnonzero(~open_before & ((step != 0) | (data == _COMMA)))
    return at, step[at], bool((int(quotes.sum()) + inside) % 2)


_SUMMARY = pa.schema([("path", pa.string()), ("block", pa.int64()), ("odd", pa.int64()), ("out", pa.int64()), ("within", pa.int64())])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: whether it has an odd number of quotes, and how far it goes down from outside or inside a string."""
    place, ends, down = None, [False, True], [0, 0]

    def row() -> pa.RecordBatch:
        values = (*place, int(ends[0]), *down)
        return pa.RecordBatch.from_pylist([dict(zip(_SUMMARY.names, values, strict=True))], _SUMMARY)

    for path, block, batch in by_block(batches):
        if (path, block) != place:
            if place is not None:
                yield row()
            place, ends, down = (path, block), [False, True], [0, 0]
        text = _bytes(batch, False)
        for k in (0, 1):
            _, steps, ends[k] = _lexed(text, ends[k])
            down[k] += int(steps.sum())
    if place is not None:
        yield row()


def _cut(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, begun, seq, inside, depth = None, [], False, 0, False, 0

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            n = len(rows)
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.string())
            arrays = [pa.array([place[0]] * n, pa.string()), pa.array([place[1]] * n, pa.int64())]
            arrays += [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["path", "block", "seq", "begins", "ends", "ch", "depth", "text"])

        def last() -> pa.RecordBatch:
            return made([(seq, begun, False, None, None, b"".join(held).decode("utf-8", "replace"))])

        for path, block, batch in by_block(batches):
            first = (path, block) != place
            if first:
                if place is not None:
                    yield last()
                place, held, seq = (path, block), [], 0
                begun = block == 0  # otherwise what comes first goes on from the block before
                inside, depth = batch["state"][0].as_py() == 1, batch["depth"][0].as_py()
            text = _bytes(batch, first and block == 0)
            at, steps, inside = _lexed(text, inside)
            after = depth + np.cumsum(steps)
            depth = int(after[-1]) if len(after) else depth
            within = np.maximum(after, after - steps)  # the container that a bracket opens or closes, or a comma parts
            shallow = within <= level
            out, begin = [], 0
            for k, d in zip(at[shallow].tolist(), within[shallow].tolist(), strict=True):
                held.append(text[begin:k])
                out.append((seq, begun, True, chr(text[k]), d, b"".join(held).decode("utf-8", "replace")))
                held, begun, begin, seq = [], True, k + 1, seq + 1
            held.append(text[begin:])
            if out:
                yield made(out)
        if place is not None:
            yield last()

    return run


_PIECES = "path string, block long, seq long, begins boolean, ends boolean, ch string, depth long, text string"


def _block_states(summaries: DataFrame) -> DataFrame:
    """(path, block, state, depth): where each block begins; state is 1 inside a string.  And the file's end."""
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    states = summaries.withColumn("state", F.coalesce(F.sum("odd").over(before), zero) % 2)
    states = states.withColumn("down", F.when(F.col("state") == 0, F.col("out")).otherwise(F.col("within")))
    return states.withColumn("depth", F.coalesce(F.sum("down").over(before), zero)).select("path", "block", "state", "depth", "odd", "down")


def _pieces(spark: SparkSession, path: str, level: int) -> tuple[DataFrame, DataFrame]:
    """The pieces between shallow brackets and commas with running counts, and (path, open): files that don't end."""
    texts = fragments(spark, path, ",")
    states = stored(_block_states(texts.mapInArrow(_summaries, "path string, block long, odd long, out long, within long")), "json-blocks")
    ends = states.groupBy("path").agg(((F.sum("odd") % 2 != 0) | (F.sum("down") != 0)).alias("open"))
    parts = with_state(texts, states.select("path", "block", "state", "depth")).select("path", "block", "value", "state", "depth").mapInArrow(_cut(level), _PIECES)
    pieces = stored(joined_parts(stored(parts, "json-parts"), "", [], ["ch", "depth"]), "json-pieces")
    inside = W.partitionBy("path", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    flags = {}
    for k in range(1, level + 1):
        own = F.col("depth") == k
        flags[f"opened{k}"] = F.coalesce((own & F.col("ch").isin("{", "[")).cast("long"), F.lit(0).cast("long"))
        flags[f"commas{k}"] = F.coalesce((own & (F.col("ch") == ",")).cast("long"), F.lit(0).cast("long"))
    totals = pieces.groupBy("path", "block").agg(*[F.sum(c).alias(n) for n, c in flags.items()])
    earlier = totals.select("path", "block", *[F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")).alias(f"{n}_before") for n in flags])
    counted = pieces.withColumns({n: F.sum(c).over(inside) for n, c in flags.items()}).join(F.broadcast(earlier), ["path", "block"])  # a row per block
    counted = counted.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in flags}).drop(*[f"{n}_before" for n in flags])
    return stored(counted, "json-counted"), ends


# a key and what follows it
_KEYED = r'(?s)^\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*:(.*)$'
_BLANK = r"(?s)^[ \t\r\n]*$"


def _in(parent: Column, part: Column, keyed: Column) -> Column:
    named = F.when(parent == "", part).otherwise(F.concat(parent, F.lit("."), part))
    return F.when(keyed, named).otherwise(F.concat(parent, F.lit("["), part, F.lit("]")))


def json_members(spark: SparkSession, path: str, level: int = 2) -> tuple[DataFrame, DataFrame]:
    """Members of the outermost ``level`` containers of each file, and (path, malformed) of each file.

    Members are (path, place, is_key, addressable, value): value is JSON text, or null for a container that is
    itself cut into members.
    """
    counted, ends = _pieces(spark, path, level)
    blank = F.col("text").rlike(_BLANK)
    bad = [ends.select("path", F.col("open").alias("bad"))]
    root = counted.filter((F.col("depth") == 1) & F.col("ch").isin("{", "["))
    opened = root.select("path", F.col("opened1").alias("id"), F.col("commas1").alias("base"), F.col("ch").alias("kind"), F.lit("").alias("place"), F.lit(True).alias("fine"))
    bad.append(root.select("path", (~blank).alias("bad")))
    bad.append(root.groupBy("path").agg((F.count(F.lit(1)) > 1).alias("bad")))
    left = counted.filter("ch is null").select("path", "text").join(root.select("path", F.lit(True).alias("rooted")).distinct(), "path", "left")
    bare = left.filter("rooted is null")
    bad.append(left.filter("rooted").select("path", (~blank).alias("bad")))
    members = [bare.filter(~blank).select("path", F.lit("").alias("place"), F.lit(False).alias("is_key"), F.lit(True).alias("addressable"), F.col("text").alias("value"))]
    bad.append(bare.select("path", blank.alias("bad")))
    for k in range(1, level + 1):
        deeper = k < level
        ends_here = (F.col("depth") == k) & F.col("ch").isin(",", "}", "]")
        opens = (F.col("depth") == k + 1) & F.col("ch").isin("{", "[")
        at = F.col(f"commas{k}") - F.when((F.col("depth") == k) & (F.col("ch") == ","), 1).otherwise(0)
        rows = counted.filter(((ends_here & ~blank) | opens) if deeper else (ends_here & ~blank))
        rows = rows.select(
            "path", "block", "seq", F.col(f"opened{k}").alias("id"), at.alias("at"), "text", (opens if deeper else F.lit(False)).alias("opens"),
            F.col("ch").alias("sub"), *([F.col(f"opened{k + 1}").alias("sub_id"), F.col(f"commas{k + 1}").alias("sub_base")] if deeper else []),
        )
        found = rows.join(opened, ["path", "id"])
        keyed = F.col("kind") == "{"
        name, rest = F.regexp_extract("text", _KEYED, 1), F.regexp_extract("text", _KEYED, 2)
        key = F.when(keyed, F.get(F.from_json(F.concat(F.lit("["), name, F.lit("]")), "array<string>"), F.lit(0)))
        value = F.when(keyed, rest).otherwise(F.col("text"))
        # between a key, or nothing, and a bracket nothing else may stand
        wrong = (keyed & key.isNull()) | (F.col("opens") & ~value.rlike(_BLANK))
        part = F.when(keyed, key).otherwise((F.col("at") - F.col("base")).cast("string"))
        fine = F.col("fine") & F.when(keyed, ~key.rlike(ODD_KEY.pattern)).otherwise(F.lit(True))
        found = found.withColumns({"wrong": F.coalesce(wrong, F.lit(True)), "is_key": keyed, "part": part, "fine": fine, "value": value})
        found = stored(found.withColumn("place", _in(F.col("place"), F.col("part"), keyed)), "json-members")
        # as many members as commas and one, or none of both; brackets of one kind
        held = found.groupBy("path", "id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("wrong").alias("wrong"))
        closed = counted.filter((F.col("depth") == k) & F.col("ch").isin("}", "]"))
        closed = closed.select("path", F.col(f"opened{k}").alias("id"), F.col(f"commas{k}").alias("upto"), F.col("ch").alias("close"))
        every = opened.join(closed, ["path", "id"], "left").join(held, ["path", "id"], "left")
        commas, n = F.col("upto") - F.col("base"), F.coalesce("n", F.lit(0))
        odd = F.col("close") != F.when(F.col("kind") == "{", "}").otherwise("]")
        uneven = ~((n == commas + 1) | ((n == 0) & (commas == 0)))
        bad.append(every.select("path", F.coalesce(odd | uneven | F.coalesce("wrong", F.lit(False)), F.lit(True)).alias("bad")))
        # the last of equal keys counts
        final = found.filter("is_key").groupBy("path", "id", "part").agg(F.max(F.struct("block", "seq")).alias("last"))
        final = final.select("path", "id", "part", "last.block", "last.seq")
        lists = found.filter("not is_key")
        kept = lists.unionByName(found.filter("is_key").join(final, ["path", "id", "part", "block", "seq"]).select(lists.columns))
        shown = F.when(~F.col("opens"), F.col("value"))
        members.append(kept.select("path", "place", "is_key", F.col("fine").alias("addressable"), shown.alias("value")))
        if deeper:
            opened = kept.filter("opens").select("path", F.col("sub_id").alias("id"), F.col("sub_base").alias("base"), F.col("sub").alias("kind"), "place", "fine")
    return _union(members), _union(bad).groupBy("path").agg(F.bool_or("bad").alias("malformed"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def root_level(spark: SparkSession, path: str) -> int:
    """1 for a document that is a list, whose elements are rows then; 2 for an object, as its lists' elements."""
    first = spark.read.option("lineSep", ",").text(path).first()
    return 1 if first and first[0].lstrip().startswith("[") else 2


def json_file_nodes(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """The nodes of whole files as ``text_nodes`` gives them for texts: (file, path, value, is_key, is_text,
    addressable, malformed), with one row without a path for each file."""
    members, files = json_members(spark, path, level or root_level(spark, path))
    members = stored(members.withColumnRenamed("path", "file"), "json-values")
    nodes = text_nodes(members.filter("value is not null"), "file", "value", ("place", "addressable", "is_key"))
    nodes = stored(nodes, "json-nodes")
    nothing = F.lit(None).cast("string")
    cut = members.filter("is_key and value is null").select(
        "file", F.col("place").alias("path"), nothing.alias("value"), "is_key", F.lit(False).alias("is_text"), "addressable", F.lit(False).alias("malformed")
    )
    unread = nodes.filter("path is null").groupBy("file").agg(F.bool_or("malformed").alias("unread"))
    marks = files.withColumnRenamed("path", "file").join(unread, "file", "left").select(
        "file", nothing.alias("path"), nothing.alias("value"), F.lit(False).alias("is_key"), F.lit(False).alias("is_text"),
        F.lit(True).alias("addressable"), (F.col("malformed") | F.coalesce("unread", F.lit(False))).alias("malformed"),
    )
    return _union([nodes.filter("path is not null"), cut, marks])


__all__ = ["json_file_nodes", "json_members", "root_level"]
