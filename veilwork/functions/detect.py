"""Detection: counts, flags and match lists as ``Column`` expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import CARD_TABLE, CORE, SSN, TOKENS, Rule, RuleSet, TokenRule
from .text import CHAT_START, CHAT_START_INLINE, count_line_starts


def count_matches(c: Column, rule: Rule) -> Column:
    """Number of non-overlapping matches; 0 for NULL."""
    found = F.coalesce(F.regexp_count(c, F.lit(rule.counting_regex)), F.lit(0)).cast("long")
    if rule.needs is None or rule.tally is not None:
        return found
    return F.when(F.contains(c, F.lit(rule.needs)), found).otherwise(F.lit(0).cast("long"))


def count_pii(c: Column, rules: RuleSet = CORE) -> Column:
    """Independent scans summed, so one stretch of text may count under two rules."""
    return reduce(add, (count_matches(c, r) for r in rules))


def count_cc(c: Column) -> Column:
    """Card matches of a table cell; an unbroken 16-digit card counts twice."""
    return count_pii(c, CARD_TABLE)


def count_by_type(c: Column, rules: RuleSet = CORE, prefix: str = "n_") -> list[Column]:
    return [count_matches(c, r).alias(f"{prefix}{r.name}") for r in rules]


def contains_pii(c: Column, rules: RuleSet = CORE) -> Column:
    return F.coalesce(reduce(or_, (c.rlike(r.counting_regex) for r in rules)), F.lit(False))


def find_matches(c: Column, rule: Rule) -> Column:
    return matches_of(c, rule.regex, 0, rule.needs)


def find_ssns(c: Column) -> Column:
    return find_matches(c, SSN)


def matches_of(c: Column, pattern: str, group: int = 0, needs: str | None = None) -> Column:
    """All matches of a pattern; the text is not searched when it lacks ``needs``."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    if needs is None:
        return found
    return F.when(~F.contains(c, F.lit(needs)), F.array().cast("array<string>")).otherwise(found)


def non_ssn_tokens(c: Column, tokens: tuple[TokenRule, ...] = TOKENS) -> Column:
    """Distinct protected tokens of a text."""
    found = (matches_of(c, t.pattern, t.group, t.needs) for t in tokens)
    return F.array_distinct(F.flatten(F.array(*found)))


def line_format_ok(line: Column) -> Column:
    """Does one line follow the chat grammar?  For single lines only."""
    return F.coalesce(line.rlike(CHAT_START), F.lit(False))


def count_formatted(c: Column) -> Column:
    """Number of lines of a text that follow the chat grammar; a single line counts as 0 or 1."""
    return count_line_starts(c, r"\[", CHAT_START_INLINE)
