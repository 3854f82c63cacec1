"""Pairing two versions of a dataset, and comparing sets of tokens and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import PROTECTED_COLUMNS, TOKENS, TokenRule
from ..functions.text import strip
from .nested import json_leaves, json_nodes, lookup_path
from .ordered import numbered
from .rows import token_probes, token_rows


def protected_columns(df: DataFrame, protected: tuple[str, ...] = PROTECTED_COLUMNS) -> list[str]:
    """Protected names that the header has, in header order."""
    return [name for name in df.columns if name in protected]


def with_rank(df: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """Position from 0 by any column, in slices of the order that Spark deals out by samples."""
    return numbered(df, [order], name=name)


def with_file_position(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Position from 0 in file order for a frame just read from files, ``_metadata`` included.

    A block of a file is read in order by one task, so a row's place is its running
    number in the block plus the rows of the blocks before; only one small row per
    block meets in one place.  The frame must not have been filtered since the read.
    """
    numbered = df.withColumn("_file", F.col("_metadata.file_path")).withColumn(
        "_start", F.col("_metadata.file_block_start")
    )
    numbered = numbered.withColumn("_id", F.monotonically_increasing_id())
    blocks = numbered.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_size"))
    offsets = blocks.select(
        "_file",
        "_start",
        "_first",
        F.expr(
            "sum(_size) over (order by _file, _start rows between unbounded preceding and current row) - _size"
        ).alias("_before"),
    )
    return (
        numbered.join(offsets, ["_file", "_start"])
        .withColumn(name, F.col("_before") + F.col("_id") - F.col("_first"))
        .drop("_file", "_start", "_id", "_first", "_before")
    )


def _side(df: DataFrame, keys: list[str], columns: list[str], is_baseline: bool) -> DataFrame:
    cells = [strip(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    return df.select(*keys, F.lit(is_baseline).alias("is_baseline"), F.struct(*cells).alias("cells"))


def _same(columns: list[str]) -> Column:
    return sum(
        (F.coalesce(F.col(f"b.{c}") == F.col(f"c.{c}"), F.lit(False)).cast("long") for c in columns),
        F.lit(0).cast("long"),
    )


def align_rows(baseline: DataFrame, candidate: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: ``n_baseline``, ``n_candidate``, ``n_equal`` cells and the cells ``b`` and ``c``.

    Both sides go through one grouping, which combines on the map side, so a key that
    repeats very often cannot blow up as it would in a join.  Keys are meant to be
    unique; rows that share one are compared as one, by their greatest cells.
    """
    both = _side(baseline, keys, columns, True).unionAll(_side(candidate, keys, columns, False))
    on_base = F.col("is_baseline")
    grouped = both.groupBy(*keys).agg(
        F.count_if(on_base).alias("n_baseline"),
        F.count_if(~on_base).alias("n_candidate"),
        F.max(F.when(on_base, F.col("cells"))).alias("b"),
        F.max(F.when(~on_base, F.col("cells"))).alias("c"),
    )
    return grouped.withColumn("n_equal", _same(columns))


def align_by_key(baseline: DataFrame, candidate: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Baseline rows with the candidate row of the same key; a lost row has no equal cell."""
    columns = protected_columns(baseline) if columns is None else columns
    return align_rows(baseline, candidate, [key], columns).filter("n_baseline > 0")


def align_by_position(
    baseline: DataFrame, candidate: DataFrame, position: str, columns: list[str] | None = None
) -> DataFrame:
    """The i-th baseline row with the i-th candidate row, up to the end of the shorter side."""
    columns = protected_columns(baseline) if columns is None else columns
    return align_rows(baseline, candidate, [position], columns).filter("n_baseline > 0 and n_candidate > 0")


def path_lookup(baseline: DataFrame, candidate: DataFrame, key: str, column: str) -> DataFrame:
    """Baseline leaves with the candidate's string at the same path, NULL when there is none."""
    return lookup_leaves(json_leaves(baseline, key, column), json_leaves(candidate, key, column), key)


def lookup_leaves(base: DataFrame, cand: DataFrame, key: str) -> DataFrame:
    place = lookup_path(F.col("path"), F.col("addressable"))
    reachable = cand.filter("addressable").select(key, F.col("path").alias("place"), F.col("value").alias("found"))
    # sized by the columns they were exploded from, leaves look small enough to broadcast; they are not
    return base.withColumn("place", place).join(reachable.hint("merge"), [key, "place"], "left").drop("place")


def key_path_overlap(baseline: DataFrame, candidate: DataFrame, key: str, column: str) -> DataFrame:
    """Per document the number of baseline key paths and how many of them the candidate has."""
    base, cand = (json_nodes(df, key, column, "is_key").select(key, "path") for df in (baseline, candidate))
    return overlap_counts(base, cand, key, "path", "n_paths", "n_common")


def overlap_counts(
    base: DataFrame, cand: DataFrame, key: str, item: str, total: str, common: str
) -> DataFrame:
    """Per key the size of the baseline set and of its intersection with the candidate's.

    Items may repeat on either side.  Grouping both sides by ``(key, item)`` spreads a large key over all tasks.
    """
    tagged = base.select(key, item, F.lit(True).alias("in_base")).unionAll(
        cand.select(key, item, F.lit(False).alias("in_base"))
    )
    items = tagged.groupBy(key, item).agg(
        F.bool_or("in_base").alias("in_base"), F.bool_or(~F.col("in_base")).alias("in_cand")
    )
    return items.groupBy(key).agg(
        F.count_if("in_base").alias(total),
        F.count_if(F.col("in_base") & F.col("in_cand")).alias(common),
    )


def token_survival(
    baseline: DataFrame, candidate: DataFrame, key: str, column: str, tokens: tuple[TokenRule, ...] = TOKENS
) -> DataFrame:
    """Per key the baseline's distinct tokens and how many occur anywhere in the candidate's text."""
    return overlap_counts(
        token_rows(baseline, [key], column, tokens),
        token_probes(candidate, [key], column, tokens),
        key,
        "token",
        "n_tokens",
        "n_survived",
    )
