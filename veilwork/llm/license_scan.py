"""Licence scans: Dice coefficient of word bigrams between lines and licence templates.

A unit is one line, or the whole text where it has several lines.  Units and templates are
normalised (lower case, runs of other characters than a-z and 0-9 become one space) and turned
into their sets of word bigrams.  A unit matches a template when 2 * common / (unit + template)
reaches ``least``.  That needs between t * least / (2 - least) and t * (2 - least) / least bigrams
in the unit, t being the template's; only templates within these size bounds are compared, and a
unit outside all of them is dropped before its bigrams are made.

DataFrame operations only, without a shuffle.  Null text has no units; a unit of fewer than two
words matches nothing.  A row that matches several templates equally well gets one result for
each.  Repeated rows give repeated results, an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common short licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
}
LEAST = 0.8


def _normal(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for name, text in templates.items():
        words = _normal(text)
        out[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})  # noqa: B905
    return out


def bounds(size: int, least: float) -> tuple[int, int]:
    """The bigram counts with which a unit can reach ``least`` against a template of ``size`` bigrams."""
    share = Fraction(str(least))
    return max(1, math.ceil(size * share / (2 - share))), math.floor(size * (2 - share) / share)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, line_no (-1: the whole text), license, dice for each match."""
    grams = {k: v for k, v in template_bigrams(TEMPLATES if templates is None else templates).items() if v}
    if not grams:
        raise ValueError("no template has two words")
    limits = {k: bounds(len(v), least) for k, v in grams.items()}
    low, high = min(a for a, _ in limits.values()), max(b for _, b in limits.values())

    def words(unit: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " ")), " ")

    def unit(number: Column | int, content: Column) -> Column:
        found = F.when(F.length(content) >= 2 * low, words(content))
        return F.struct((F.lit(number) if isinstance(number, int) else number).alias("line_no"), found.alias("words"))

    # the words are made below the generator, so that no later expression makes them again
    split = F.split("text", "\n")
    each = F.transform(split, lambda line, k: unit(k, line))
    units = F.when(F.size(split) > 1, F.concat(each, F.array(unit(-1, F.col("text"))))).otherwise(each)
    rows = docs.select("doc_id", F.inline(units)).filter(F.size("words") > low)
    # a unit has at least as many distinct bigrams as distinct words less one
    rows = rows.filter(F.size(F.array_distinct("words")) <= high + 1)
    pair = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda x, y: F.concat_ws(" ", x, y))
    rows = rows.select("doc_id", "line_no", F.array_distinct(pair).alias("grams")).filter(F.size("grams").between(low, high))

    def dice(name: str) -> Column:
        own = F.array(*[F.lit(g) for g in grams[name]])
        common = F.size(F.array_intersect("grams", own))
        return F.when(F.size("grams").between(*limits[name]), 2.0 * common / (F.size("grams") + F.lit(len(grams[name]))))

    found = rows.select("doc_id", "line_no", F.inline(F.array(*[F.struct(F.lit(k).alias("license"), dice(k).alias("dice")) for k in sorted(grams)])))
    return found.filter(F.col("dice") >= least)
