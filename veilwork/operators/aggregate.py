"""Counts, ratios and summaries."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import contains_pii, count_by_type, count_matches, count_pii
from ..functions.rules import CORE, RuleSet
from ..functions.text import clamp, round4, safe_ratio
from .rows import pii_spans


def total_matches(df: DataFrame, columns: list[str], rules: RuleSet, keys: list[str], name: str = "n_matches") -> DataFrame:
    """Matches summed over all cells of the columns, per key or overall."""
    cells = reduce(add, (count_pii(F.col(f"`{c}`"), rules) for c in columns))
    return df.groupBy(*keys).agg(F.sum(cells).alias(name))


def pii_summary(df: DataFrame, column: str, by: list[str], rules: RuleSet = CORE) -> DataFrame:
    """Rows, affected rows and matches per type, by any grouping columns."""
    counted = df.select(*by, *count_by_type(F.col(column), rules))
    names = [f"n_{r.name}" for r in rules]
    affected = reduce(add, (F.col(n) for n in names)) > 0
    return counted.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(affected).alias("n_affected"),
        *(F.sum(n).alias(n) for n in names),
    )


def removal_summary(df: DataFrame, before: str, after: str, by: list[str], rules: RuleSet = CORE) -> DataFrame:
    """Matches per type in two columns, and the share of them that is gone."""
    counted = df.select(
        *by,
        *count_by_type(F.col(before), rules, "before_"),
        *count_by_type(F.col(after), rules, "after_"),
    )
    names = [f"{side}_{r.name}" for r in rules for side in ("before", "after")]
    sums = counted.groupBy(*by).agg(F.count("*").alias("n_rows"), *(F.sum(n).alias(n) for n in names))
    total = lambda side: reduce(add, (F.col(f"{side}_{r.name}") for r in rules))
    removal = clamp(F.lit(1.0) - safe_ratio(total("after"), total("before"), 0.0), 0.0, None)
    return sums.withColumn("removal", round4(removal))


def dataset_summary(df: DataFrame, key: str, column: str, rules: RuleSet = CORE) -> DataFrame:
    """Size, whether it holds personal data, and which kinds."""
    flags = df.select(*(count_matches(F.col(column), r).alias(r.name) for r in rules))
    sums = flags.agg(F.count("*").alias("total_documents"), *(F.sum(r.name).alias(r.name) for r in rules))
    kinds = F.filter(
        F.array(*(F.when(F.col(r.name) > 0, F.lit(r.name)) for r in rules)), lambda kind: kind.isNotNull()
    )
    return sums.select(
        "total_documents",
        (F.size(kinds) > 0).alias("contains_pii"),
        F.array_join(F.array_sort(kinds), ",").alias("pii_types"),
    )


def span_counts(df: DataFrame, key: str, column: str, rules: RuleSet = CORE) -> DataFrame:
    """Matches and distinct matched texts per type."""
    return (
        pii_spans(df, key, column, rules)
        .groupBy("type", "match")
        .agg(F.count("*").alias("n"))
        .groupBy("type")
        .agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_distinct"))
    )
