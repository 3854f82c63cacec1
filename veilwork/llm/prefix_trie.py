"""The trie of conversation prefixes, rolled up by centroid decomposition.

``branches`` rebuilds related conversations from a common beginning.  ``trie`` names each distinct sequence
of first turns by its smallest member and its depth.  A prefix is recognised by the running XOR of keyed
256-bit turn digests; the key is drawn anew for each run, so that no text can be made to collide.

``rollup`` adds node values up over subtrees.  The forest of parent edges is cut at centroids: in each
component the deepest node that still has half of the component below it.  The totals of what lies below the
centroid are added to every node from there up to the component's top, and the component falls apart into the
pieces below the centroid and the rest above it, none with more than half of the nodes.  So the number of
rounds is the binary logarithm of the number of nodes at most, however deep or bushy the trie is.  What lies
below a centroid and what lies on its path is looked up in the table of memberships: a node's smallest member
passes through all its ancestors.

Turns are ordered by turn (null first); null roles and texts become empty.  Turns of equal number stand in the
order of a digest of role and text, so that no texts are moved, and equal rows all stay.  Rows without a
conv_id belong to no conversation and are left out.  An empty table gives no nodes.  Only conv_id, turn,
role and text are looked at.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .shared import discard, written

FAMILY = 5
SPREAD = 9
CHUNK = 256  # turns over which prefixes are formed in one window
RUN = 1024  # ids that are joined to one text before a node's ids are hashed
_PARTS = ("k0", "k1", "k2", "k3")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size): the turns in order from 0, as digests and bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(said, 256).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    return numbered(rows.filter("conv_id is not null"), ["turn", "digest"], ["conv_id"], "pos")


def branches(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from their family's first one: (conv_id, pos, digest, size), (conv_id).

    Of c, the first ``crc32(c) % SPREAD`` turns come from conversation ``c - c % FAMILY``, the others are its own.
    """
    own = written(turns(conversations), "turns")
    ids = written(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).dropna().distinct(), "conversations")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SPREAD
    asked = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), head.alias("head"))
    start = own.filter(f"pos < {SPREAD - 1}")
    # at most SPREAD - 1 rows of each first conversation meet the FAMILY of theirs
    taken = asked.join(start.withColumnRenamed("conv_id", "first"), "first").filter("pos < head")
    taken = written(taken.select("conv_id", "head", "pos", "digest", "size"), "taken")
    have = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("have"))
    heads = asked.join(have, "conv_id", "left").select("conv_id", "head", F.coalesce("have", F.lit(0)).alias("have"))
    rest = own.join(heads, "conv_id").filter("pos >= head").withColumn("pos", F.col("pos") - F.col("head") + F.col("have"))
    both = taken.drop("head").unionByName(rest.select("conv_id", "pos", "digest", "size"))
    return written(both, "rebuilt"), ids


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, k0-k3, size) of each prefix of one turn or more."""
    key = secrets.token_hex(16)
    keyed = F.sha2(F.concat_ws("|", F.lit(key), F.col("pos").cast("string"), F.col("digest")), 256)
    parts = [F.conv(F.substring(keyed, 16 * k + 1, 16), 16, -10).cast("long").alias(p) for k, p in enumerate(_PARTS)]
    rows = rebuilt.select("conv_id", "pos", "size", (F.col("pos") / CHUNK).cast("long").alias("chunk"), *parts)
    rows = written(rows, "keyed-turns")
    upto = W.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = rows.select("conv_id", "pos", "size", "chunk", *[F.bit_xor(p).over(upto).alias(p) for p in _PARTS])
    totals = rows.groupBy("conv_id", "chunk").agg(*[F.bit_xor(p).alias(p) for p in _PARTS])
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("conv_id", "chunk", *[F.bit_xor(p).over(before).alias(f"{p}_before") for p in _PARTS])
    shifted = [F.col(p).bitwiseXOR(F.coalesce(F.col(f"{p}_before"), F.lit(0))).alias(p) for p in _PARTS]
    # only chunks after a first one have anything before them
    joined = within.join(totals.filter("k0_before is not null"), ["conv_id", "chunk"], "left")
    return joined.select("conv_id", (F.col("pos") + 1).alias("depth"), *shifted, "size")


def trie(rebuilt: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, size) and memberships (member, depth, conv_id, next).

    ``next`` is the name of the member's node one deeper, null where the member ends.
    """
    root = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(p) for p in _PARTS], F.lit(0).cast("long").alias("size"))
    prefixes = written(_prefixes(rebuilt).unionByName(root), "prefixes")
    named = prefixes.groupBy("depth", *_PARTS).agg(F.min("conv_id").alias("name"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"))
    named = written(named, "named")
    members = prefixes.drop("size").join(named, ["depth", *_PARTS]).select(F.col("conv_id").alias("member"), "depth", F.col("name").alias("conv_id"))
    members = written(members, "members")
    deeper = members.select("member", (F.col("depth") - 1).alias("depth"), F.col("conv_id").alias("next"))
    members_next = written(members.join(deeper, ["member", "depth"], "left"), "memberships")
    # the node above a node is that of its smallest member
    above = members.filter("member is not null").select(F.col("member").alias("name"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    nodes = named.join(above, ["name", "depth"], "left").select(F.col("name").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "size")
    nodes = written(nodes, "nodes")
    discard(prefixes, named, members)
    return nodes, members_next


def _sizes(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, s): how many nodes each node's subtree has.

    A conversation names the nodes of its path from some depth on.  All members of a node but its smallest name
    only nodes below it, so the numbers that members name add up, the smallest one's counted from the node on.
    """
    own = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("named"), F.max("depth").alias("last"))
    per = members.join(own.select(F.col("conv_id").alias("member"), "named"), "member", "left")
    per = per.groupBy("conv_id", "depth").agg(F.sum(F.coalesce("named", F.lit(0))).alias("all"))
    total = per.join(own, "conv_id").withColumn("s", F.col("all") - F.col("named") + F.col("last") - F.col("depth") + 1)
    return total.select("conv_id", "depth", "s")


def _centroids(live: DataFrame) -> DataFrame:
    """Each component's deepest node with half of the component or more below it: (top, x_conv, x_depth, x_s).

    Such nodes form a path down from the top, on which names grow and sizes shrink.
    """
    tops = live.filter("conv_id = top_conv and depth = top_depth").select("top_conv", "top_depth", F.col("s").alias("whole"))
    heavy = live.join(tops, ["top_conv", "top_depth"]).filter("2 * s >= whole")
    found = heavy.groupBy("top_conv", "top_depth").agg(F.max("conv_id").alias("x_conv"), F.max("depth").alias("x_depth"), F.min("s").alias("x_s"))
    return written(found, "centroids")


def rollup(nodes: DataFrame, members: DataFrame, values: list[str]) -> DataFrame:
    """(conv_id, depth, sum_<value>): each value added up over the node's subtree, the node included."""
    sums = [f"sum_{v}" for v in values]
    zero = F.lit(0).cast("long")
    root = nodes.agg(F.min("conv_id")).first()[0]  # all nodes start in the tree of the one root
    live = nodes.select("conv_id", "depth", *values).join(_sizes(nodes, members), ["conv_id", "depth"])
    live = live.withColumns({"top_conv": F.lit(root).cast("long"), "top_depth": zero, **{v: zero for v in sums}})
    live = written(live.withColumn("done", F.lit(False)), "forest")
    rounds, spent = [], []
    comp = ["top_conv", "top_depth"]
    lookup = members.select("member", F.col("depth").alias("at"), F.col("conv_id").alias("there"), "next")
    while True:
        centroids = _centroids(live)
        deep = F.col("depth") >= F.col("x_depth")
        asked = live.join(centroids, comp).withColumns({
            "member": F.when(deep, F.col("conv_id")).otherwise(F.col("x_conv")),
            "at": F.when(deep, F.col("x_depth")).otherwise(F.col("depth")),
        })
        hit = F.coalesce(F.col("there") == F.when(deep, F.col("x_conv")).otherwise(F.col("conv_id")), F.lit(False))
        placed = asked.join(lookup, ["member", "at"], "left").withColumns({"below": deep & hit, "above": ~deep & hit})
        placed = written(placed.drop("member", "at", "there"), "placed")
        totals = placed.filter("below").groupBy(*comp).agg(*[F.sum(v).alias(f"total_{v}") for v in values])
        here = F.col("below") & (F.col("depth") == F.col("x_depth"))
        inner = F.col("below") & ~here
        moved = placed.join(totals, comp).withColumns({
            **{f"sum_{v}": F.col(f"sum_{v}") + F.when(here | F.col("above"), F.col(f"total_{v}")).otherwise(0) for v in values},
            "s": F.col("s") - F.when(F.col("above"), F.col("x_s")).otherwise(0),
            "done": here,
        })
        moved = moved.withColumns({
            "top_conv": F.when(inner, F.col("next")).otherwise(F.col("top_conv")),
            "top_depth": F.when(inner, F.col("x_depth") + 1).otherwise(F.col("top_depth")),
        })
        after = written(moved.select(live.columns), "forest")
        discard(centroids, placed)
        spent.append(after)
        rounds.append(after.filter("done").select("conv_id", "depth", *sums))
        discard(live) if len(rounds) == 1 else None
        live = after.filter("not done")
        if live.isEmpty():
            break
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    out = written(out, "rollup")
    discard(*spent)
    return out


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs one after the other; they come sorted, and only the state is kept."""
    node, state = None, None
    for batch in batches:
        out = []
        for conv, depth, run in zip(*(batch[c].to_pylist() for c in ("conv_id", "depth", "run")), strict=True):
            if (conv, depth) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256(run.encode())
            else:
                state.update(b"," + run.encode())
        yield _digests(out)
    if node is not None:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): the ids of the members that end at a node, ascending and comma-joined."""
    last = members.filter("next is null").select("conv_id", "depth", "member")
    placed = numbered(last, ["member"], ["conv_id", "depth"], "place").withColumn("part", (F.col("place") / RUN).cast("long"))
    run = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda m: m.cast("string")), ",")
    runs = written(placed.groupBy("conv_id", "depth", "part").agg(run.alias("run")), "runs")
    # a node of one run is hashed where it is; the runs of the others go by in order
    long = runs.filter("part = 1").select("conv_id", "depth").distinct()
    short = runs.join(long, ["conv_id", "depth"], "left_anti").select("conv_id", "depth", F.sha2("run", 256).alias("ends_sha256"))
    sorted_runs = runs.join(long, ["conv_id", "depth"]).repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")
    return short.unionByName(sorted_runs.select("conv_id", "depth", "run").mapInArrow(_streamed, "conv_id long, depth long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, members = trie(*branches(conversations))
    below = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = below.agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = full.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("size"),
    })
    full = written(full, "valued")
    summed = rollup(full, members, ["n_leaves", "saved_tokens"])
    out = full.drop("n_leaves", "saved_tokens", "size").join(summed, ["conv_id", "depth"]).join(ends(members), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("sum_n_leaves").alias("n_leaves"), F.col("sum_saved_tokens").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
