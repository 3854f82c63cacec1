"""Row filters, match rows and line rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import contains_pii, find_matches, matches_of, non_ssn_tokens
from ..functions.rules import CORE, TOKENS, Probe, Rule, RuleSet, TokenRule
from ..functions.text import is_blank, splitlines


def filter_pii_rows(df: DataFrame, column: str, rules: RuleSet = CORE) -> DataFrame:
    return df.filter(contains_pii(F.col(column), rules))


def filter_clean(df: DataFrame, column: str, rules: RuleSet = CORE) -> DataFrame:
    return df.filter(~contains_pii(F.col(column), rules))


def pii_spans(df: DataFrame, key: str, column: str, rules: RuleSet = CORE) -> DataFrame:
    """One row per match: ``(key, type, ordinal, match)``, ordinals from 1 within type and row.

    All rules run in the same pass over the text.
    """

    def matches(rule: Rule):
        return F.transform(
            find_matches(F.col(column), rule),
            lambda m, i: F.struct(
                F.lit(rule.name).alias("type"), (i + 1).cast("long").alias("ordinal"), m.alias("match")
            ),
        )

    return df.select(key, F.inline(F.concat(*map(matches, rules))))


def text_lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """Non-blank lines ``(key, line_no, line)``; ``line_no`` counts all lines from 0."""
    exploded = df.select(key, F.posexplode(splitlines(F.col(column))).alias("line_no", "line"))
    return exploded.filter(~is_blank(F.col("line"))).withColumn("line_no", F.col("line_no").cast("long"))


def token_rows(
    df: DataFrame, keys: list[str], column: str, tokens: tuple[TokenRule, ...] = TOKENS, marker: bool = False
) -> DataFrame:
    """Protected tokens as rows, distinct only within a text.

    With ``marker`` each text also gives one row without a token.
    """
    found = non_ssn_tokens(F.coalesce(F.col(column), F.lit("")), tokens)
    if marker:
        found = F.concat(F.array(F.lit(None).cast("string")), found)
    return df.select(*keys, F.explode(found).alias("token"))


def distinct_tokens(df: DataFrame, keys: list[str], column: str, tokens: tuple[TokenRule, ...] = TOKENS) -> DataFrame:
    """Distinct protected tokens per key as rows."""
    return token_rows(df, keys, column, tokens).distinct()


def token_probes(
    df: DataFrame, keys: list[str], column: str, tokens: tuple[TokenRule, ...] = TOKENS, marker: bool = False
) -> DataFrame:
    """Every substring of the text that can equal a protected token, as rows ``(keys, token)``.

    A token occurs in a text exactly when it is among these rows, so a substring
    test over whole texts becomes an equality on ``(keys, token)``.  With ``marker`` each
    text also gives one row without a token.
    """
    text = F.coalesce(F.col(column), F.lit(""))

    def stretch(run, lo, hi, width):
        return F.struct(
            run.alias("run"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.lit(width).cast("int").alias("width")
        )

    def found(rule: TokenRule, probe: Probe):
        def one(run):
            size = F.length(run)
            if probe.width is not None:
                return stretch(run, F.lit(1), size - probe.width + 1, probe.width)
            return stretch(run, size if probe.shortest is None else F.lit(probe.shortest), size, None)

        return F.transform(F.array_distinct(matches_of(text, probe.pattern, 0, rule.needs)), one)

    parts = [found(t, p) for t in tokens for p in t.probes]
    if marker:
        parts.append(F.array(stretch(F.lit(None).cast("string"), F.lit(1), F.lit(1), None)))
    runs = df.select(*keys, F.inline(F.concat(*parts)))
    cuts = runs.select(*keys, "run", "width", F.explode(F.sequence("lo", "hi")).alias("n"))
    token = F.when(F.col("width").isNull(), F.left("run", F.col("n"))).otherwise(F.substr("run", F.col("n"), F.col("width")))
    return cuts.select(*keys, token.alias("token"))
