"""Verification: how good is a candidate compared with its untouched baseline?

Each validator gives one row per key with the raw counts, the components, the
``status`` and the ``score``; without a key it gives a single row.  A side that has
no row for a key is ``missing``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.detect import count_cc, count_formatted, count_pii
from ..functions.rules import CORE, SSN_ONLY, TOKENS, RuleSet, TokenRule
from ..functions.text import CEILING, FLOOR, clamp, count_lines, round4, safe_ratio, strip
from ..operators import align
from ..operators.nested import clean_names, has_schema, json_nodes, lookup_path, node_array, text_nodes
from ..operators.rows import token_probes, token_rows
from ..operators.runs import TASKS
from ..session import stored
from ..sources.json_ranges import json_file_nodes
from ..sources.readers import CORRUPT, path_exists, read_table_csv, read_text, unreadable

# Weights of the components; ``constant`` is always earned.
TABLE_WEIGHTS = {"removal": 0.50, "structure": 0.25, "preservation": 0.25}
TEXT_WEIGHTS = {"removal": 0.50, "structure": 0.25, "preservation": 0.25}
JSON_WEIGHTS = {"removal": 0.40, "structure": 0.25, "preservation": 0.25, "constant": 0.10}

Validator = Callable[..., DataFrame]


def removal_of(candidate: Column, baseline: Column) -> Column:
    """Share of the baseline's matches that is gone; 1 when there was nothing to remove."""
    return clamp(F.lit(1.0) - safe_ratio(candidate, baseline, 0.0), 0.0, None)


def score_of(weights: dict[str, float]) -> Column:
    parts = (F.lit(w) * (F.lit(1.0) if name == "constant" else F.col(name)) for name, w in weights.items())
    return round4(clamp(reduce(add, parts)))


def _scored(result: DataFrame, key: str | None, counts: list[str], weights: dict[str, float]) -> DataFrame:
    shown = [n for n in weights if n != "constant"]
    score = F.when(F.col("status") == "ok", score_of(weights)).otherwise(F.lit(FLOOR))
    return result.withColumn("score", score).select(*([key] if key else []), *counts, *shown, "score", "status")


def _status(*bad: tuple[Column, str]) -> Column:
    status = F.lit("ok")
    for condition, name in reversed(bad):
        status = F.when(condition, name).otherwise(status)
    return status


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


# ---------------------------------------------------------------- flat tables


def _row_side(df: DataFrame, match: str, group: str | None, protected: list[str], is_baseline: bool) -> DataFrame:
    scanned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != CORRUPT]
    ragged = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    cells = [strip(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in df.columns else F.lit("").alias(c) for c in protected]
    return df.select(
        *([F.col(group).alias("group")] if group else [F.lit(0).alias("group")]),
        F.col(match).alias("match"),
        F.lit(is_baseline).alias("is_baseline"),
        reduce(add, (count_cc(F.col(f"`{c}`")) for c in scanned), F.lit(0).cast("long")).alias("n_cc"),
        ragged.alias("ragged"),
        F.struct(F.lit(0).alias("_"), *cells).alias("cells"),
    )


def validate_table(
    baseline: DataFrame,
    candidate: DataFrame,
    match: str = "id",
    key: str | None = None,
    by: str = "key",
    protected: list[str] | None = None,
) -> DataFrame:
    """Verify a masked table of strings.

    ``match`` pairs the rows: a unique key column (``by="key"``), or a position column
    such as ``with_file_position`` adds (``by="position"``), which compares only up to the
    end of the shorter side and so shifts after a lost row.  ``key`` groups many
    tables.  Card matches are counted in every string column.
    """
    columns = align.protected_columns(baseline) if protected is None else protected
    sides = _row_side(baseline, match, key, columns, True).unionAll(_row_side(candidate, match, key, columns, False))
    base = F.col("is_baseline")
    pairs = sides.groupBy("group", "match").agg(
        F.sum(F.when(base, F.col("n_cc"))).alias("b_cc"),
        F.sum(F.when(~base, F.col("n_cc"))).alias("c_cc"),
        F.count_if(base).alias("b_rows"),
        F.count_if(~base).alias("c_rows"),
        F.bool_or("ragged").alias("ragged"),
        F.max(F.when(base, F.col("cells"))).alias("b"),
        F.max(F.when(~base, F.col("cells"))).alias("c"),
    )
    equal = reduce(
        add,
        (F.coalesce(F.col(f"b.`{c}`") == F.col(f"c.`{c}`"), F.lit(False)).cast("long") for c in columns),
        F.lit(0).cast("long"),
    )
    compared = F.col("b_rows") > 0
    if by == "position":
        compared = compared & (F.col("c_rows") > 0)
    # without a key an empty pair is a result too
    sums = (pairs.groupBy("group") if key else pairs).agg(
        _zero(F.sum("b_cc")).alias("baseline_matches"),
        _zero(F.sum("c_cc")).alias("candidate_matches"),
        _zero(F.sum("b_rows")).alias("baseline_rows"),
        _zero(F.sum("c_rows")).alias("candidate_rows"),
        (F.count_if(compared) * len(columns)).alias("cells_compared"),
        _zero(F.sum(F.when(compared, equal))).alias("cells_equal"),
        F.coalesce(F.bool_or("ragged"), F.lit(False)).alias("ragged"),
    )
    either_empty = (F.col("baseline_rows") == 0) | (F.col("candidate_rows") == 0)
    result = sums.select(
        *([F.col("group").alias(key)] if key else []),
        "*",
        removal_of(F.col("candidate_matches"), F.col("baseline_matches")).alias("removal"),
        (F.col("baseline_rows") == F.col("candidate_rows")).cast("double").alias("structure"),
        F.when(either_empty, F.lit(0.0))
        .otherwise(safe_ratio(F.col("cells_equal"), F.col("cells_compared")))
        .alias("preservation"),
        _status((either_empty if key else F.lit(False), "missing"), (F.col("ragged"), "malformed")).alias("status"),
    )
    counts = ["baseline_matches", "candidate_matches", "baseline_rows", "candidate_rows", "cells_compared", "cells_equal"]
    return _scored(result, key, counts, TABLE_WEIGHTS)


# ------------------------------------------------------------------ log lines


_TEXT_SUMS = {"matches": "n_matches", "lines": "n_lines", "formatted": "n_formatted", "rows": "n_rows"}


def _text_rows(
    df: DataFrame, key: str | None, column: str, rules: RuleSet, tokens: tuple[TokenRule, ...], is_baseline: bool
) -> DataFrame:
    """Tokens as rows, and per text one row without a token that carries its counts."""
    c, zero = F.col(column), F.lit(0).cast("long")
    measured = df.select(
        (F.col(key) if key else F.lit(0)).alias("key"),
        c.alias("text"),
        count_pii(c, rules).alias("n_matches"),
        count_lines(c).alias("n_lines"),
        (zero if is_baseline else count_formatted(c)).alias("n_formatted"),
        F.lit(1).cast("long").alias("n_rows"),
    )
    carried = ["key", *_TEXT_SUMS.values()]
    make = token_rows if is_baseline else token_probes
    counts = (F.when(F.col("token").isNull(), F.col(n)).otherwise(zero).alias(n) for n in _TEXT_SUMS.values())
    return make(measured, carried, "text", tokens, marker=True).select(
        "key", "token", F.lit(is_baseline).alias("base"), *counts
    )


def validate_text(
    baseline: DataFrame,
    candidate: DataFrame,
    key: str | None = None,
    column: str = "value",
    rules: RuleSet = SSN_ONLY,
    tokens: tuple[TokenRule, ...] = TOKENS,
) -> DataFrame:
    """Verify masked log text.

    A row may hold one line or a whole text; rows of one ``key`` make up one text.  No SSN
    and no token spans a line end, so nothing has to be put together first; with rules
    whose matches may span one, give whole texts.
    """
    both = _text_rows(baseline, key, column, rules, tokens, True).unionAll(
        _text_rows(candidate, key, column, rules, tokens, False)
    )
    base = F.col("base")
    sums = {
        f"{side}_{name}": F.sum(F.when(mine, F.col(n)).otherwise(0))
        for side, mine in (("baseline", base), ("candidate", ~base))
        for name, n in _TEXT_SUMS.items()
    }
    # Grouping by token first spreads a large key; only counts go on to the grouping by key.
    items = both.groupBy("key", "token").agg(
        F.bool_or(base).alias("in_base"), F.bool_or(~base).alias("in_cand"), *(c.alias(n) for n, c in sums.items())
    )
    is_token = F.col("token").isNotNull() & F.col("in_base")
    joined = (items.groupBy("key") if key else items).agg(
        *(_zero(F.sum(n)).alias(n) for n in sums),
        F.count_if(is_token).alias("n_tokens"),
        F.count_if(is_token & F.col("in_cand")).alias("n_survived"),
    ).withColumnRenamed("candidate_formatted", "formatted_lines")
    formatted = safe_ratio(F.col("formatted_lines"), F.col("baseline_lines"), 0.0)
    same_count = (F.col("baseline_lines") == F.col("candidate_lines")).cast("double")
    gone = (F.col("baseline_rows") == 0) | (F.col("candidate_rows") == 0)
    result = joined.select(
        *([F.col("key").alias(key)] if key and key != "key" else []),
        "*",
        removal_of(F.col("candidate_matches"), F.col("baseline_matches")).alias("removal"),
        F.when(F.col("baseline_lines") > 0, 0.5 * same_count + 0.5 * formatted).otherwise(F.lit(0.0)).alias("structure"),
        safe_ratio(F.col("n_survived"), F.col("n_tokens")).alias("preservation"),
        _status((gone if key else F.lit(False), "missing")).alias("status"),
    )
    counts = [
        "baseline_matches", "candidate_matches", "baseline_lines", "candidate_lines",
        "formatted_lines", "n_tokens", "n_survived",
    ]
    return _scored(result, key, counts, TEXT_WEIGHTS)


# ----------------------------------------------------------- nested documents

JSON_COUNTS = ["baseline_matches", "candidate_matches", "n_paths", "n_common", "n_values", "n_preserved"]


def _json_result(counts: DataFrame, key: str) -> DataFrame:
    result = counts.select(
        "*",
        removal_of(F.col("candidate_matches"), F.col("baseline_matches")).alias("removal"),
        safe_ratio(F.col("n_common"), F.col("n_paths")).alias("structure"),
        safe_ratio(F.col("n_preserved"), F.col("n_values")).alias("preservation"),
    )
    return _scored(result, key, JSON_COUNTS, JSON_WEIGHTS)


def _doc_measures(docs: DataFrame, key: str, column: str, rules: RuleSet, side: str) -> DataFrame:
    """Per document: matches, key paths, and the leaves without personal data as ``path NUL text``."""
    nodes = node_array(column, docs.schema[column].dataType)
    leaf = lambda n: F.concat(n["path"], F.lit("\0"), strip(n["value"]))
    texts = F.filter("nodes", lambda n: n["is_text"])
    measured = docs.select(F.col(key), F.col(f"`{column}`").isNull().alias(f"{side}_null"), nodes.alias("nodes"))
    measured = measured.select(
        key,
        f"{side}_null",
        F.transform(F.filter("nodes", lambda n: n["is_key"]), lambda n: n["path"]).alias(f"{side}_paths"),
        F.transform(texts, lambda n: F.struct(count_pii(n["value"], rules).alias("n"), leaf(n).alias("leaf"))).alias("leaves"),
    )
    total = F.aggregate("leaves", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    kept = F.col("leaves") if side == "c" else F.filter("leaves", lambda x: x["n"] == 0)
    # the join sorts by key anyway; a document of a key that comes again counts for nothing
    same = W.partitionBy(key).orderBy(key)
    measured = measured.withColumns({f"{side}_docs": F.count(F.lit(1)).over(W.partitionBy(key)), "nth": F.row_number().over(same)}).filter("nth = 1")
    return measured.select(
        key,
        f"{side}_docs",
        f"{side}_null",
        f"{side}_paths",
        F.when(~F.col(f"{side}_null"), total).alias(f"{side}_matches"),
        F.transform(kept, lambda x: x["leaf"]).alias(f"{side}_leaves"),
    )


def _validate_documents(baseline: DataFrame, candidate: DataFrame, key: str, column: str, rules: RuleSet) -> DataFrame:
    """Documents of a known schema: one join of whole documents, all comparisons within the row.

    The arrays are far larger than the files they come from, so a size estimate made from
    those must not turn this into a broadcast.
    """
    both = _doc_measures(baseline, key, column, rules, "b").join(
        _doc_measures(candidate, key, column, rules, "c").hint("merge"), key, "left"
    )
    size = lambda c: _zero(F.size(c).cast("long"))
    repeated = F.greatest("b_docs", F.coalesce("c_docs", F.lit(1))) > 1
    arrays = [n for n in both.columns if n.endswith(("_matches", "_paths", "_leaves"))]
    both = both.withColumns({n: F.when(~repeated, F.col(n)) for n in arrays})
    counts = both.select(
        key,
        _zero(F.col("b_matches")).alias("baseline_matches"),
        _zero(F.col("c_matches")).alias("candidate_matches"),
        size(F.col("b_paths")).alias("n_paths"),
        size(F.array_intersect("b_paths", "c_paths")).alias("n_common"),
        size(F.col("b_leaves")).alias("n_values"),
        size(F.array_intersect("b_leaves", "c_leaves")).alias("n_preserved"),
        _status(
            (F.col("c_docs").isNull(), "missing"), (repeated, "repeated"), (F.col("b_null") | F.col("c_null"), "malformed")
        ).alias("status"),
    )
    return _json_result(counts, key)


_LEAF_SUMS = ("key_b", "key_c", "clean_b", "found_c", "pii_b", "pii_c", "seen_b", "seen_c", "bad")


def _leaf_row(at: Column, text: Column, **counts: Column) -> Column:
    sums = (counts.get(n, F.lit(0).cast("long")).alias(n) for n in _LEAF_SUMS)
    return F.struct(at.alias("at"), text.alias("text"), *sums)


def _seen(side: str, bad: Column) -> Column:
    nothing = F.lit(None).cast("string")
    return _leaf_row(nothing, nothing, **{f"seen_{side}": F.lit(1).cast("long"), "bad": bad.cast("long")})


def _node_rows(nodes: DataFrame, key: str, rules: RuleSet, side: str, marked: bool) -> DataFrame:
    """Key paths, leaves and, where nodes come ``marked``, one marker row per document as ``(key, at, text, counts...)``.

    Baseline leaves stand where the candidate is looked up; candidate leaves stand where
    they can be found.
    """
    v, path, one = F.col("value"), F.col("path"), F.lit(1).cast("long")
    nothing = F.lit(None).cast("string")
    n_pii = count_pii(v, rules)
    if side == "b":
        clean = (n_pii == 0).cast("long")
        leaf = _leaf_row(lookup_path(path, F.col("addressable")), strip(v), clean_b=clean, pii_b=n_pii)
        name = _leaf_row(path, nothing, key_b=one)
    else:
        leaf = _leaf_row(path, strip(v), found_c=F.col("addressable").cast("long"), pii_c=n_pii)
        name = _leaf_row(path, nothing, key_c=one)
    rows = [F.when(F.col("is_key"), name), F.when(F.col("is_text"), leaf)]
    if marked:
        rows.append(F.when(path.isNull(), _seen(side, F.col("malformed"))))
    return nodes.select(F.col(key).alias("key"), F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def _leaf_rows(docs: DataFrame, key: str, column: str, rules: RuleSet, side: str) -> DataFrame:
    if not has_schema(docs, column):
        return _node_rows(text_nodes(docs, key, column), key, rules, side, True)
    nodes = _node_rows(json_nodes(docs, key, column), key, rules, side, False)
    markers = docs.select(F.col(key).alias("key"), F.inline(F.array(_seen(side, F.col(f"`{column}`").isNull()))))
    return nodes.unionAll(markers)


def _validate_leaves(baseline: DataFrame, candidate: DataFrame, key: str, column: str, rules: RuleSet) -> DataFrame:
    """Documents of any shape: leaves and paths as rows.

    Each side is walked once.  Grouping by ``(key, path, text)`` spreads even a single huge
    document over all tasks, and only counts go on to the grouping by document.
    """
    return _compared_leaves(
        _leaf_rows(baseline, key, column, rules, "b"), _leaf_rows(candidate, key, column, rules, "c"), key
    )


def _compared_leaves(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    both = baseline.unionAll(candidate)
    places = both.groupBy("key", "at", "text").agg(*(F.sum(n).alias(n) for n in _LEAF_SUMS))
    n = F.col
    docs = places.groupBy("key").agg(
        F.sum("pii_b").alias("baseline_matches"),
        F.sum("pii_c").alias("candidate_matches"),
        F.count_if(n("key_b") > 0).alias("n_paths"),
        F.count_if((n("key_b") > 0) & (n("key_c") > 0)).alias("n_common"),
        F.sum("clean_b").alias("n_values"),
        F.sum(F.when(n("found_c") > 0, n("clean_b")).otherwise(0)).alias("n_preserved"),
        F.sum("seen_b").alias("seen_b"),
        F.sum("seen_c").alias("seen_c"),
        F.sum("bad").alias("bad"),
    )
    repeated = F.greatest("seen_b", "seen_c") > 1
    counts = docs.filter("seen_b > 0").select(
        F.col("key").alias(key),
        *(F.when(repeated, 0).otherwise(F.col(c)).cast("long").alias(c) for c in JSON_COUNTS),
        _status((n("seen_c") == 0, "missing"), (repeated, "repeated"), (n("bad") > 0, "malformed")).alias("status"),
    )
    return _json_result(counts, key)


def validate_json(
    baseline: DataFrame,
    candidate: DataFrame,
    key: str | None = None,
    column: str = "doc",
    rules: RuleSet = CORE,
    strategy: str | None = None,
) -> DataFrame:
    """Verify masked nested documents, one row per document.

    Without a ``key`` each side is one document, and the result has one row.  A key is expected once on
    each side; one that comes more often has the status ``repeated`` and the lowest score.

    ``strategy`` is ``documents`` (compare within one row per document; needs a schema with
    plain key names) or ``leaves`` (leaves as rows: any shape, and documents of any
    size).  By default the first wherever it applies.
    """
    if key is None:
        sides = (df.select(F.lit(0).alias("_one"), F.col(f"`{column}`")) for df in (baseline, candidate))
        return validate_json(*sides, "_one", column, rules, strategy).drop("_one")
    types = [df.schema[column].dataType for df in (baseline, candidate)]
    plain = all(not isinstance(t, (T.StringType, T.VariantType)) and clean_names(t) for t in types)
    chosen = strategy or ("documents" if plain else "leaves")
    if chosen == "documents" and not plain:
        raise ValueError("strategy 'documents' needs a schema whose keys are plain names")
    run = _validate_documents if chosen == "documents" else _validate_leaves
    return run(baseline, candidate, key, column, rules)


# ------------------------------------------------------------------- registry

VALIDATORS: dict[str, Validator] = {"easy": validate_table, "medium": validate_text, "hard": validate_json}


def validate_json_files(spark: SparkSession, baseline: str, candidate: str, rules: RuleSet = CORE) -> DataFrame:
    """Verify one masked JSON file of any size; files are read in byte ranges, never as a whole."""
    sides = []
    for side, path in (("b", baseline), ("c", candidate)):
        nodes = json_file_nodes(spark, path).withColumn("file", F.lit(0))
        empty = spark.range(1).select(F.lit(0).alias("key"), F.inline(F.array(_seen(side, F.lit(True)))))
        read = _node_rows(nodes, "file", rules, side, True)
        # a file without a byte has no blocks, and is malformed
        sides.append(read if not nodes.isEmpty() else empty)
    return _compared_leaves(*sides, "key").drop("key")


def register_validator(name: str, validator: Validator) -> None:
    VALIDATORS[name] = validator


def _one_row(spark: SparkSession, dataset: str, status: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(dataset).alias("dataset"), F.lit(FLOOR).alias("score"), F.lit(status).alias("status")
    )


def validate_many(spark: SparkSession, jobs: dict[str, tuple[str, tuple, dict]], isolate: bool = True) -> DataFrame:
    """Run ``{dataset: (validator name, arguments, options)}`` and stack ``(dataset, ..., score, status)``.

    Each dataset is run on its own and its few result rows are written; one that cannot be planned (missing column,
    unknown validator) or that fails while it runs takes the lowest score and leaves the others alone.  Without
    ``isolate`` only an unknown validator does; any other failure is raised, as its dataset has no scores.
    """
    parts = []
    for dataset, (name, args, options) in jobs.items():
        try:
            result = VALIDATORS[name](*args, **options)
            group = options.get("key") or (result.columns[0] if name == "hard" and len(args) > 2 else None)
            label = F.col(group).cast("string") if group else F.lit(None).cast("string")
            parts.append(stored(result.select(F.lit(dataset).alias("dataset"), label.alias("key"), "score", "status"), "scores"))
        except (PySparkException, Py4JJavaError, KeyError, ValueError, TypeError):
            if name in VALIDATORS and not isolate:
                raise
            row = _one_row(spark, dataset, "error")
            parts.append(row.select("dataset", F.lit(None).cast("string").alias("key"), "score", "status"))
    return reduce(DataFrame.unionAll, parts)


def score_violations(results: DataFrame) -> DataFrame:
    """Rows whose score is not strictly between 0 and 1; there must be none."""
    return results.filter(F.col("score").isNull() | (F.col("score") <= 0) | (F.col("score") >= 1))


def validate_files(spark: SparkSession, task_id: str, workspace_dir: str, baseline_dir: str) -> DataFrame:
    """Verify a workspace folder against a baseline folder: one row ``(dataset, score, status)``.

    A file that is missing, malformed or not UTF-8 takes the lowest score.  Table rows are paired by
    their position in the file.
    """
    name = next(file for task, _, file, _ in TASKS if task == task_id)
    base, cand = f"{baseline_dir}/{name}", f"{workspace_dir}/{name}"
    if not (path_exists(spark, cand) and path_exists(spark, base)):
        return _one_row(spark, task_id, "missing")
    if task_id == "easy":
        frames = [read_table_csv(spark, p, position="row_index") for p in (base, cand)]
        result = validate_table(*frames, match="row_index", by="position")
    elif task_id == "medium":
        result = validate_text(read_text(spark, base), read_text(spark, cand))
    else:
        result = validate_json_files(spark, base, cand)
    unread = unreadable(spark, base).unionAll(unreadable(spark, cand)).select(F.lit(None).alias("score"), F.lit(None).alias("status"), "bad")
    both = result.select("score", "status", F.lit(False).alias("bad")).unionAll(unread)
    judged = both.agg(F.bool_or("bad").alias("bad"), F.max("score").alias("score"), F.max("status").alias("status"))
    return judged.select(
        F.lit(task_id).alias("dataset"),
        F.when(F.col("bad"), F.lit(FLOOR)).otherwise(F.col("score")).alias("score"),
        F.when(F.col("bad"), F.lit("unreadable")).otherwise(F.col("status")).alias("status"),
    )


__all__ = [
    "CEILING", "FLOOR", "VALIDATORS", "register_validator", "score_of", "score_violations", "validate_files",
    "validate_json", "validate_json_files", "validate_many", "validate_table", "validate_text",
]
