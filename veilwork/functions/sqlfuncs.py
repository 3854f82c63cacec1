"""The rules as SQL functions, usable from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .rules import CARD_TABLE, CORE, RuleSet


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _mask_body(rules: RuleSet) -> str:
    body = "s"
    for rule in rules:
        mask = rule.mask.replace("\\", "\\\\").replace("$", "\\$")
        replaced = f"regexp_replace({body}, {_literal(rule.regex)}, {_literal(mask)})"
        body = replaced if rule.needs is None else f"if(contains(s, {_literal(rule.needs)}), {replaced}, {body})"
    return body


def _count_body(rules: RuleSet) -> str:
    return " + ".join(f"cast(regexp_count(coalesce(s, ''), {_literal(r.counting_regex)}) as bigint)" for r in rules)


def register(spark: SparkSession, rules: RuleSet = CORE, suffix: str = "all") -> None:
    """Create ``mask_<suffix>``, ``count_<suffix>``, ``contains_<suffix>`` and ``count_cards``.

    They are SQL functions, not UDFs: the optimizer inlines their bodies.  As with the column
    functions, NULL counts as no match and is masked to NULL.
    """
    contains = " or ".join(f"rlike(coalesce(s, ''), {_literal(r.counting_regex)})" for r in rules)
    bodies = {
        f"mask_{suffix}": ("string", _mask_body(rules)),
        f"count_{suffix}": ("bigint", _count_body(rules)),
        f"contains_{suffix}": ("boolean", contains),
        "count_cards": ("bigint", _count_body(CARD_TABLE)),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"create or replace temporary function {name}(s string) returns {kind} return {body}")
