"""Masking: rules folded over a column in order."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import CARD_ONLY, CORE, GENERIC, SSN_ONLY, Rule, RuleSet


def _replacement(mask: str) -> str:
    """``$`` and ``\\`` have a meaning in Java replacement text."""
    return re.sub(r"([\\$])", r"\\\1", mask)


def mask(c: Column, rules: RuleSet = CORE, passes: int = 1) -> Column:
    """Replace every match, rule after rule.  Extra passes catch what masking itself uncovers.

    Masks add none of the texts that rules need, so the untouched column can tell whether
    a rule has anything to do.
    """

    def apply(masked: Column, rule: Rule) -> Column:
        replaced = F.regexp_replace(masked, rule.regex, _replacement(rule.mask))
        if rule.needs is None or any(rule.needs in r.mask for r in rules):
            return replaced
        return F.when(F.contains(c, F.lit(rule.needs)), replaced).otherwise(masked)

    return reduce(apply, [r for _ in range(passes) for r in rules], c)


def mask_cc(c: Column) -> Column:
    return mask(c, CARD_ONLY)


def mask_ssn(c: Column) -> Column:
    return mask(c, SSN_ONLY)


def mask_all(c: Column) -> Column:
    return mask(c, CORE)


def mask_generic(c: Column, rules: RuleSet = GENERIC) -> Column:
    return mask(c, rules)


def mask_json_text(c: Column, rules: RuleSet = CORE) -> Column:
    """Mask serialized JSON as text; NULL when the masked text is no longer JSON.  Length and depth don't matter."""
    from .opaque import json_only

    return json_only(mask(c, rules))


def residual_digit_run(c: Column) -> Column:
    """Does a mask directly follow digits, i.e. was only the tail of a number masked?"""
    return F.coalesce(c.rlike(r"\d\[REDACTED"), F.lit(False))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def mask_columns(df: DataFrame, rules: RuleSet = CORE, columns: list[str] | None = None) -> DataFrame:
    """Mask the named string columns, by default all of them; order and names stay."""
    chosen = set(string_columns(df) if columns is None else columns)
    return df.select(
        *(mask(F.col(f"`{n}`"), rules).alias(n) if n in chosen else F.col(f"`{n}`") for n in df.columns)
    )


def _has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_text(dtype.valueType)
    return isinstance(dtype, T.StringType)


def rewrite_strings(c: Column, dtype: T.DataType, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to every string value below ``c``; keys, order, lengths and other types stay."""
    if isinstance(dtype, T.StringType):
        return fn(c)
    if not _has_text(dtype):
        return c
    if isinstance(dtype, T.StructType):
        changed = (f for f in dtype.fields if _has_text(f.dataType))
        return reduce(
            lambda acc, f: acc.withField(f"`{f.name}`", rewrite_strings(c.getField(f.name), f.dataType, fn)),
            changed,
            c,
        )
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: rewrite_strings(x, dtype.elementType, fn))
    return F.transform_values(c, lambda _, v: rewrite_strings(v, dtype.valueType, fn))


def mask_struct(df: DataFrame, column: str, rules: RuleSet = CORE, only: str | None = None) -> DataFrame:
    """Mask every string below ``column``, or only below its top-level field ``only``."""
    dtype = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if only is None:
        masked = rewrite_strings(c, dtype, lambda s: mask(s, rules))
    else:
        part = rewrite_strings(c.getField(only), dtype[only].dataType, lambda s: mask(s, rules))
        masked = c.withField(f"`{only}`", part)
    return df.withColumn(column, masked)
