"""Positions and running sums over any order columns, without a task that sees all rows.

Rows are dealt to slices by ranges of (group, order), which Spark takes from samples, and written as a
table, so that every later read sees the same slices.  Places and sums are formed within a slice; what
comes before a slice is a small total per (group, slice).  As slices follow the order, only the first group
of a slice can have rows in earlier ones, so there is at most one non-zero offset per slice, and these
few rows are all that meets every row.

Rows with equal order columns are dealt by their place in the input as well, so equal keys
don't gather in one slice; their mutual order is that of the input as it was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored


def slices(df: DataFrame, by: list[str], label: str = "slices") -> DataFrame:
    """The rows as a written table with ``_slice``, ascending by ``by``, and ``_row``, which breaks ties."""
    tied = df.withColumn("_row", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], F.col("_row"))
    return stored(dealt.withColumn("_slice", F.spark_partition_id()), label)


def _before(totals: DataFrame, group: list[str], total: str) -> DataFrame:
    """What the earlier slices of a group add up to, where that is anything: at most a row per slice."""
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    found = totals.withColumn("_before", F.sum(total).over(earlier)).filter("_before is not null and _slice is not null")
    return found.select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col("_slice").alias("_in"), "_before")


def _running(sliced: DataFrame, group: list[str], order: list[str], value: Column, total: Column, name: str) -> DataFrame:
    """``value`` over the rows up to each within its slice, plus ``total`` of the slices before."""
    before = _before(sliced.groupBy(*group, "_slice").agg(total.alias("_total")), group, "_total")
    upto = W.partitionBy(*group, "_slice").orderBy(*[F.col(c).asc_nulls_first() for c in order], "_row")
    placed = sliced.withColumn("_within", value.over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)))
    same = F.col("_slice") == F.col("_in")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    shifted = F.coalesce(F.col("_before") + F.col("_within"), F.col("_before"), F.col("_within"))
    joined = placed.join(F.broadcast(before), same, "left").withColumn(name, shifted)
    return joined.drop("_slice", "_row", "_within", "_in", "_before", *[f"_of_{c}" for c in group])


def numbered(df: DataFrame, order: list[str], group: tuple[str, ...] | list[str] = (), name: str = "row_index") -> DataFrame:
    """The place from 0 by ``order``, nulls first, over all rows or within ``group``."""
    group = list(group)
    sliced = slices(df, [*group, *order])
    out = _running(sliced, group, order, F.count(F.lit(1)), F.count(F.lit(1)), name)
    return out.withColumn(name, F.col(name) - 1)


def running_sum(df: DataFrame, order: list[str], value: str, group: tuple[str, ...] | list[str] = (), name: str = "running") -> DataFrame:
    """The sum of ``value`` up to each row by ``order``, over all rows or within ``group``.

    As in SQL, nulls add nothing, and the sum is null until the first value.
    """
    group = list(group)
    sliced = slices(df, [*group, *order])
    return _running(sliced, group, order, F.sum(value), F.sum(value), name)
