"""Ordered operators over step logs and generated sequences.

An episode's log ends at its first final step, so only its first ``max_steps`` rows
can count.  Every plan here cuts to those rows before it shuffles (the optimizer
turns ``row_number() <= k`` into a limit per group on the map side), which keeps an
episode that holds a large share of all rows from ending up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordered import running_sum

FINAL_REWARD = 0.99


def step_counter(df: DataFrame, episode: str, order: list[str], limit: int, name: str = "step") -> DataFrame:
    """The first ``limit`` rows of each episode, numbered from 1."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(episode).orderBy(*order)))
    return ranked.filter(F.col(name) <= limit)


def is_final(step: Column, max_steps: Column, reward: Column) -> Column:
    return (step >= max_steps) | F.coalesce(reward >= FINAL_REWARD, F.lit(False))


def until_done(
    df: DataFrame, episode: str, order: list[str], max_steps: str = "max_steps", reward: str = "reward", limit: int | None = None
) -> DataFrame:
    """Steps up to and including the first final one, with ``step`` and ``done``.

    ``limit`` bounds the rows of an episode before the shuffle.  Left out, it is the largest
    ``max_steps`` of the frame, found by a small aggregate; a smaller one would lose steps.
    """
    if limit is None:
        limit = df.agg(F.max(max_steps)).first()[0] or 0
    steps = step_counter(df, episode, order, limit)
    steps = steps.withColumn("done", is_final(F.col("step"), F.col(max_steps), F.col(reward)))
    before = W.partitionBy(episode).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max("done").over(before), F.lit(False))
    return steps.withColumn("_over", seen).filter(~F.col("_over")).drop("_over")


def last_reward(steps: DataFrame, episode: str, reward: str = "reward", name: str = "last_reward") -> DataFrame:
    """Latest non-null reward so far, over the steps of ``until_done``."""
    upto = W.partitionBy(episode).orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.withColumn(name, F.last(reward, ignorenulls=True).over(upto))


def running_total(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Running sum of ``value`` within ``group`` by any ``order`` column; not even a single group has to fit one task."""
    return running_sum(df, [order], value, [group], name)


def last_value(df: DataFrame, group: str, value: str, order: str, name: str = "last_value") -> DataFrame:
    """Value of the last row by ``order`` in each group."""
    return df.groupBy(group).agg(F.max_by(value, order).alias(name))
