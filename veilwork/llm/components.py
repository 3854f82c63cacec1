"""Connected components by repeated contraction, with DataFrame operations only.

Each round orders the vertices, sends every vertex to the first of itself and its neighbours in that
order and renames the edges; loops and repeated edges go.  The first rounds take the order of the ids, which
ends stars around the smallest id at once; the others an order drawn anew at random (a keyed bijection of
the ids), in which a constant share of the vertices goes whatever the shape: a path of a thousand
is gone after about a dozen rounds.  Nothing but a row count comes to the driver.  Every round is a table in the shared folder, so lineage stays short and a
lost executor costs one round at most; tables that are no longer read are removed.  Once at most ``FEW`` edges are left, whatever
the input's size, a round is read by one task, its renamings are broadcast and nothing is shuffled, as its cost is then the start of tasks alone.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

_LOW = 0xFFFFFFFF
PLAIN = 2  # rounds in the order of the ids
FOLD = 4  # rounds whose renamings are joined before they are written
FEW = 1 << 14  # edges of a round that is not shuffled


def _half(x: Column, salt: int) -> Column:
    return F.xxhash64(x, F.lit(salt)).bitwiseAND(F.lit(_LOW))


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def scrambled(x: Column, salt: int) -> Column:
    """A bijection of the 64-bit integers (two Feistel rounds), another one for each salt."""
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    high = high.bitwiseXOR(_half(low, 2 * salt))
    return _join(high, low.bitwiseXOR(_half(high, 2 * salt + 1)))


def unscrambled(x: Column, salt: int) -> Column:
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    low = low.bitwiseXOR(_half(high, 2 * salt + 1))
    return _join(high.bitwiseXOR(_half(low, 2 * salt)), low)


def _as_is(x: Column) -> Column:
    return x


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each vertex of the edges (a, b); component is the smallest id in it.

    Loops count as a vertex of their own; rows with a null end are left out.
    """
    left = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna(), "edges")
    rounds: list[DataFrame] = []
    few = 0  # the last rounds, which are not shuffled
    while (size := left.count()) or not rounds:
        salt = len(rounds)
        there, back = (_as_is, _as_is) if salt < PLAIN else (partial(scrambled, salt=salt), partial(unscrambled, salt=salt))
        whole, sent = (partial(DataFrame.coalesce, numPartitions=1), F.broadcast) if size <= FEW else (_as_is, _as_is)
        both = whole(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        first = both.groupBy("a").agg(F.min(there(F.col("b"))).alias("first"))
        up = back(F.least(F.col("first"), there(F.col("a"))))
        parents = written(first.select(F.col("a").alias("v"), up.alias("up")), "parents")
        rounds.append(parents)
        few += size <= FEW
        # only tables on either side of a join: a vertex of very many edges is split at run time
        step = whole(left).join(sent(parents), F.col("a") == F.col("v")).select(F.col("up").alias("a"), "b")
        half = written(step, "half") if size > FEW else step
        step = half.alias("e").join(sent(parents).alias("p"), F.col("e.b") == F.col("p.v")).select("e.a", F.col("p.up").alias("b"))
        step = step.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        following = written(step, "edges")
        discard(left, *[half] * (size > FEW))
        left = following
    # the renamings from the last round, which is the smallest, back to the first
    labels: DataFrame | None = None
    folded: list[DataFrame] = []
    for n, parents in enumerate(reversed(rounds), 1):
        if labels is None:
            labels = parents
        else:
            later = labels.select(F.col("v").alias("w"), F.col("up").alias("top"))
            if n <= few:
                parents = parents.coalesce(1)
            if n - 1 <= few:
                later = F.broadcast(later)
            labels = parents.join(later, F.col("up") == F.col("w"), "left").select("v", F.coalesce("top", "up").alias("up"))
        if n % FOLD == 0 and n < len(rounds):
            labels = written(labels, "labels")
            folded.append(labels)
    if len(rounds) <= PLAIN:  # everything has moved to the smallest id
        out = written(labels.select(F.col("v").alias("id"), F.col("up").alias("component")), "components")
        discard(left, *rounds, *folded)
        return out
    labels = written(labels, "labels")
    named = labels.coalesce(1) if few == len(rounds) else labels
    smallest = named.groupBy("up").agg(F.min("v").alias("component"))
    smallest = F.broadcast(smallest) if few == len(rounds) else smallest
    out = written(named.join(smallest, "up").select(F.col("v").alias("id"), "component"), "components")
    discard(left, labels, *rounds, *folded)
    return out
