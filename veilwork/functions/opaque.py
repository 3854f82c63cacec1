"""Masking of JSON documents whose shape is unknown and may differ from row to row.

A text is cut at its quotation marks: every second part is a string, and a string is a key when a colon
follows it.  Only strings that are values and hold personal data change; all else (numbers, spaces, key order,
repeated keys, escapes) stays as it is, letter for letter.  That takes SQL functions only, at any depth.
Python sees those texts alone that Spark's parser turns down, since some are JSON all the same: very
long or deep ones, or with repeated keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mask import mask
from .rules import CORE, RuleSet

# stand for an escaped backslash and an escaped quotation mark; strings of JSON can't hold them as they are
_BACKSLASH, _QUOTE = "\x01", "\x02"
_LEXEME = re.compile(
    r"[ \t\n\r]*+(?:(?P<mark>[\[\]{},:])"
    r'|(?P<text>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")'
    r"|(?P<plain>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|NaN|-?Infinity)|(?P<end>\Z))"
)


def value_strings(text: str) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, key of the outermost object, as written) of each string of a JSON text that is a value.

    Raises ``ValueError`` at the first place where the text is not JSON, as Python reads it.  An explicit
    stack holds the open brackets, so depth is not bounded.
    """
    open_: list[str] = []
    top: str | None = None
    want, at = "value", 0  # value, first (value or end of list), key, first key, colon, next (comma or end)
    while True:
        found = _LEXEME.match(text, at)
        if found is None:
            raise ValueError(f"not JSON at {at}")
        at, kind, lexeme = found.end(), found.lastgroup, found[found.lastgroup]
        if kind == "end":
            if open_ or want != "next":
                raise ValueError("the text ends early")
            return
        if kind == "text" and want in ("key", "first key"):
            if len(open_) == 1:
                top = lexeme
            want = "colon"
        elif lexeme == ":" and want == "colon":
            want = "value"
        elif lexeme == "," and want == "next" and open_:
            want = "key" if open_[-1] == "{" else "value"
        elif lexeme in ("]", "}") and open_ and open_[-1] + lexeme in ("[]", "{}") and want in ("next", "first" if lexeme == "]" else "first key"):
            open_.pop()
            want = "next"
        elif want in ("value", "first") and (kind != "mark" or lexeme in ("[", "{")):
            if kind == "mark":
                open_.append(lexeme)
                want = "first" if lexeme == "[" else "first key"
            else:
                if kind == "text":
                    yield found.start("text"), at, top if open_ and open_[0] == "{" else None
                want = "next"
        else:
            raise ValueError(f"not JSON at {found.start(kind)}")


def _readable(texts: pa.Array) -> pa.Array:
    def one(text: str | None) -> bool | None:
        try:
            return None if text is None else all(True for _ in value_strings(text))
        except ValueError:
            return False

    return pa.array([one(t) for t in texts.to_pylist()], pa.bool_())


def _is_document(c: Column) -> Column:
    """Whether Spark's parser takes a text as one document.

    It ignores what follows a document.  Between brackets and between braces at once, nothing can follow it.
    """
    ends = (("[", "]"), ('{"":', "}"))
    first, second = (F.try_parse_json(F.concat(F.lit(a), c, F.lit(b))).isNotNull() for a, b in ends)
    return first & second


def json_only(c: Column) -> Column:
    """The text itself where it is one JSON document, else NULL; of any length and depth."""
    seen = _bound(c, lambda t: F.struct(t.alias("text"), _is_document(t).alias("parsed")))
    text, parsed = seen["text"], seen["parsed"]
    return F.when(parsed | F.arrow_udf(_readable, "boolean")(F.when(~parsed, text)), text)


def _shut(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _opened(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a costly value that it uses more than once, which is made once."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def _masked_string(part: Column, rules: RuleSet) -> Column:
    """The inside of one string, masked; the same letters where there is nothing to mask."""
    read = F.from_json(F.concat(F.lit('["'), _opened(part), F.lit('"]')), "array<string>", {"maxStringLen": str(2**31 - 1)})

    def written(masked: Column) -> Column:
        return _bound(F.to_json(F.array(masked)), lambda again: _shut(F.substr(again, F.lit(3), F.length(again) - 4)))

    def fresh(plain: Column) -> Column:
        return _bound(mask(plain, rules), lambda masked: F.when(masked == plain, part).otherwise(written(masked)))

    escaped = part.contains("\\") | part.contains(_BACKSLASH) | part.contains(_QUOTE)
    return F.when(escaped, _bound(F.coalesce(F.get(read, F.lit(0)), part), fresh)).otherwise(mask(part, rules))


def mask_strings(c: Column, rules: RuleSet = CORE) -> Column:
    """Every string value of a JSON text masked; the text must be JSON.

    Half a surrogate pair, in a string that has something to mask, becomes ``?``.
    """
    parts = F.split(_shut(c), '"')
    following = F.concat(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")))
    pairs = F.zip_with(parts, following, lambda part, after: F.struct(part.alias("part"), after.rlike(r"^[ \t\r\n]*:").alias("is_key")))
    done = F.transform(pairs, lambda p, i: F.when((i % 2 == 0) | p["is_key"], p["part"]).otherwise(_masked_string(p["part"], rules)))
    return _opened(F.array_join(done, '"'))


def _masker(rules: RuleSet) -> Callable[[str], str]:
    steps = [(re.compile(r.pattern, 0 if r.unicode else re.ASCII), r.mask) for r in rules]

    def apply(text: str) -> str:
        for pattern, token in steps:
            text = pattern.sub(lambda _, token=token: token, text)
        return text

    return apply


def _below(key: str, rules: RuleSet) -> Callable[[pa.Array], pa.Array]:
    fn = _masker(rules)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        try:
            for start, end, top in value_strings(text):
                if top is not None and json.loads(top) == key:
                    plain = json.loads(text[start:end])
                    masked = fn(plain)
                    if masked != plain:
                        fresh = json.dumps(masked, ensure_ascii=any("\ud800" <= x <= "\udfff" for x in masked))
                        out += [text[done:start], fresh]
                        done = end
        except ValueError:
            return None
        return "".join([*out, text[done:]])

    return lambda texts: pa.array([one(t) for t in texts.to_pylist()], pa.string())


def mask_variant(df: DataFrame, column: str, rules: RuleSet = CORE, only: str | None = None) -> DataFrame:
    """Mask every string value of a column of JSON text or variants; NULL where malformed.

    ``only`` restricts the masking to what is below one key of the outermost object; that needs the depth of each
    string and runs in Python, on Arrow batches of this column.  Variants have lost the spelling of their numbers
    before they come here.  Use ``mask_struct`` wherever there is a schema.
    """
    text = F.col(f"`{column}`").cast("string")
    masked = mask_strings(json_only(text), rules) if only is None else F.arrow_udf(_below(only, rules), "string")(text)
    return df.withColumn(column, masked)
