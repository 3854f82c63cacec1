"""Scalar text and number functions, all built from Spark's own expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as white space, and line ends.
_SPACE_POINTS = (
    *range(0x09, 0x0E),
    *range(0x1C, 0x21),
    0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(map(chr, _SPACE_POINTS))
# Single code points below 256 make a much faster character class than ranges do.
_LINE_ENDS = r"\n\x0B\f\r\x1C\x1D\x1E\x85\x{2028}-\x{2029}"
_SPACES = "".join(f"\\x{{{point:04X}}}" if point > 255 else f"\\x{point:02X}" for point in _SPACE_POINTS)
LINE_END = rf"\r\n|[{_LINE_ENDS}]"
# A non-blank line, from its first character that is not white space on.
_LINE = rf"(?:[!-~]|[^{_SPACES}])[^{_LINE_ENDS}]*+"
TRUNCATION_MARK = "\n... [output truncated]"
FLOOR, CEILING = 0.01, 0.99

# The classes of the chat grammar over all of Unicode: digits, white space, white space within a line, word characters.
_DIGIT, _SPACE, _INLINE, _WORD = r"\p{Nd}", r"[\s\x1c-\x1f\x85\p{Z}]", r"[ \t\x1f\p{Zs}]", r"[\p{L}\p{N}_]"
_CLOCK = f"{_DIGIT}{{2}}:{_DIGIT}{{2}}:{_DIGIT}{{2}}"
_CHAT_LINE = rf"(?s)^\[({_CLOCK})\]{_SPACE}+({_WORD}+):{_SPACE}?(.*)$"
CHAT_START = rf"^\[{_CLOCK}\]{_SPACE}+{_WORD}+:"
CHAT_START_INLINE = rf"{_CLOCK}\]{_INLINE}+{_WORD}+:"


def strip(c: Column) -> Column:
    """Drop white space, Unicode spaces included, from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def splitlines(c: Column) -> Column:
    """Array of lines; a line end at the very end opens no further line."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def count_lines(c: Column) -> Column:
    """Number of non-blank lines, without making an array of them."""
    return F.coalesce(F.regexp_count(c, F.lit(_LINE)), F.lit(0)).cast("long")


def count_line_starts(c: Column, first: str, rest: str) -> Column:
    """Number of lines that start with ``first`` and ``rest``, which must not run past a line end.

    Looking for ``first``, one fixed character, before looking back for the line end is what
    keeps this fast.
    """
    found = F.regexp_count(c, F.lit(f"{first}(?<![^{_LINE_ENDS}]{first}){rest}"))
    return F.coalesce(found, F.lit(0)).cast("long")


def safe_ratio(n: Column, d: Column, default: float = 1.0) -> Column:
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(default))


def clamp(c: Column, lo: float | None = FLOOR, hi: float | None = CEILING) -> Column:
    out = c if lo is None else F.greatest(F.lit(lo), c)
    return out if hi is None else F.least(F.lit(hi), out)


def fixed(c: Column, digits: int) -> Column:
    """Number as text with that many decimals, rounded from its exact binary value (ties to even)."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits))


def round4(c: Column) -> Column:
    return fixed(c, 4).cast("double")


def truncate_marked(c: Column, limit: int = 50_000) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(TRUNCATION_MARK))).otherwise(c)


def first_n(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def one_line_preview(c: Column, n: int = 100) -> Column:
    return first_n(F.replace(c, F.lit("\n"), F.lit(" ")), n)


def format_card(digits: Column, style: Column) -> Column:
    """Group a 16-digit number as ``raw``, ``dashed`` or ``spaced``; leave other lengths."""

    def grouped(sep: str) -> Column:
        return F.concat_ws(sep, *(F.substring(digits, at, 4) for at in (1, 5, 9, 13)))

    sixteen = F.length(digits) == 16
    return (
        F.when(sixteen & (style == "dashed"), grouped("-"))
        .when(sixteen & (style == "spaced"), grouped(" "))
        .otherwise(digits)
    )


def format_ssn(area: Column, group: Column, serial: Column) -> Column:
    return F.format_string("%03d-%02d-%04d", area, group, serial)


def format_phone(area: Column, exchange: Column, line: Column, style: str = "us") -> Column:
    """``us`` gives ``(ddd) ddd-dddd``, anything else ``ddd-ddd-dddd``."""
    return F.format_string("(%03d) %03d-%04d" if style == "us" else "%03d-%03d-%04d", area, exchange, line)


def format_email(first: Column, last: Column, domain: Column) -> Column:
    return F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@"), domain)


def format_clock(seconds: Column) -> Column:
    """Seconds since midnight as ``HH:MM:SS``; hours keep counting past 23."""
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(seconds / 3600),
        F.floor(seconds / 60) % 60,
        seconds % 60,
    )


def parse_chat_line(line: Column) -> Column:
    """``struct<ts, user, message>`` of a chat line, NULL when the line has another form."""
    piece = lambda i: F.regexp_extract(line, _CHAT_LINE, i)
    return F.when(
        line.rlike(_CHAT_LINE),
        F.struct(piece(1).alias("ts"), piece(2).alias("user"), piece(3).alias("message")),
    )


def path_parts(path: Column) -> Column:
    """Steps of a key path: ``a.b[0].c`` gives ``[a, b, 0, c]``."""
    dotted = F.regexp_replace(path, r"\[(\d+)\]", ".$1.")
    return F.filter(F.split(dotted, r"\."), lambda part: part != "")


def template_fill(templates: list[str], index: Column, values: dict[str, Column]) -> Column:
    """The ``index``-th template (from 0) with the values in its ``{name}`` slots.

    Only the values of the chosen template are computed.  ``index`` is compared once per
    template, so give a column, not a costly expression.
    """

    def filled(template: str) -> Column:
        used = ((n, v) for n, v in values.items() if f"{{{n}}}" in template)
        return reduce(
            lambda text, item: F.replace(text, F.lit(f"{{{item[0]}}}"), item[1].cast("string")), used, F.lit(template)
        )

    first, *others = enumerate(templates)
    chain = F.when(index == first[0], filled(first[1]))
    return reduce(lambda c, item: c.when(index == item[0], filled(item[1])), others, chain)
