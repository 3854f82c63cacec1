import random
import re

import pytest
from pyspark.sql import functions as F

from veilwork.functions import detect, mask, replies, rules, text
from veilwork.functions.sqlfuncs import register
from veilwork.operators import rows

ALPHABET = ["4111", "1111", "1234", "12", "345", "67", "-", " ", "(", ")", ".", "@", "a", "b.co", "x_y", "#", "PRD-", "\n", "%", "+", "555", " million", " tickets"]


@pytest.fixture(scope="module")
def texts():
    """Random strings made of pieces of what the rules look for."""
    rng = random.Random(7)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    return made + [
        "", "4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111", "378282246310005",
        "a@b.co@d.com", "a@b.com_x@y.org", "@b.com", "a@@b.com", "a@b.c", "x" * 300 + "@y.org", "closed 345 tickets",
        "x-1234 5678", "37.4 million", "137.4 million", "0 5 (189973035545360528847",
    ]


def apply(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1:] for r in sorted(df.select("i", *columns).collect())]


def test_counts_equal_python(spark, texts):
    t = F.col("t")
    found = apply(spark, texts, *detect.count_by_type(t), detect.count_pii(t), detect.contains_pii(t), detect.count_cc(t))
    for value, row in zip(texts, found, strict=True):
        expected = [len(re.findall(r.pattern, value)) for r in rules.CORE]
        cards = sum(len(re.findall(p, value)) for p in (rules.CARD_PATTERN, rules.CARD16_PATTERN))
        assert row == (*expected, sum(expected), sum(expected) > 0, cards), value


def test_variant_counts_equal_python(spark, texts):
    found = apply(spark, texts, *detect.count_by_type(F.col("t"), rules.VARIANT))
    assert found == [tuple(len(re.findall(r.pattern, v)) for r in rules.VARIANT) for v in texts]


def masked(value, found=rules.CORE):
    for r in found:
        value = re.sub(r.pattern, lambda _, r=r: r.mask, value)
    return value


def test_masks_equal_python(spark, texts):
    t = F.col("t")
    found = apply(spark, texts, mask.mask_all(t), mask.mask_generic(t), mask.mask_cc(t), mask.mask(t, passes=2))
    for value, (all_, generic, card, twice) in zip(texts, found, strict=True):
        assert all_ == masked(value)
        assert generic == masked(value, rules.GENERIC)
        assert card == masked(value, rules.CARD_ONLY)
        assert twice == masked(masked(value))


def test_sql_functions_equal_columns(spark, texts):
    register(spark)
    t = F.col("t")
    found = apply(spark, texts, F.expr("mask_all(t)"), mask.mask_all(t), F.expr("count_all(t)"), detect.count_pii(t), F.expr("contains_all(t)"), detect.contains_pii(t))
    assert all(a == b and c == d and e == f for a, b, c, d, e, f in found)


def test_mask_escapes_and_order(spark):
    odd = rules.RuleSet((rules.Rule("ssn", rules.SSN_PATTERN, "$1\\x"),))
    assert apply(spark, ["my 123-45-6789."], mask.mask(F.col("t"), odd)) == [("my $1\\x.",)]
    phone_first = rules.RuleSet((rules.PHONE, rules.CARD))
    assert apply(spark, ["4111111111111111"], mask.mask(F.col("t"), phone_first)) == [("411111[REDACTED_PHONE]",)]


def test_residue(spark):
    t = F.col("t")
    found = apply(spark, ["378282246310005", "4111111111111111"], mask.mask_all(t), mask.residual_digit_run(mask.mask_all(t)))
    assert found == [("37828[REDACTED_PHONE]", True), ("[REDACTED_CC]", False)]


def test_unicode_rules(spark):
    arabic = "".join(chr(0x660 + int(d)) if d.isdigit() else d for d in "123-45-6789")
    values = [arabic, "555" + chr(0xA0) + "123" + chr(0xA0) + "4567", chr(0xE9) + "4111111111111111"]
    found = apply(spark, values, *detect.count_by_type(F.col("t"), rules.CORE.with_unicode()))
    assert found == [tuple(len(re.findall(r.pattern, v)) for r in rules.CORE) for v in values]


def test_tokens_equal_python(spark, texts):
    found = apply(spark, texts, detect.non_ssn_tokens(F.col("t")))
    for value, (tokens,) in zip(texts, found, strict=True):
        expected = {m if isinstance(m, str) else m[0] for t in rules.TOKENS for m in re.findall(t.pattern, value)}
        assert set(tokens) == expected and len(tokens) == len(expected), value


def test_token_probes_decide_substrings(spark, texts):
    """Every token of any text occurs in a text exactly when it is among that text's probes."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, t string")
    probes = {}
    for r in rows.token_probes(df, ["i"], "t").collect():
        probes.setdefault(r.i, set()).add(r.token)
    tokens = {r.token for r in rows.distinct_tokens(df, ["i"], "t").collect()}
    assert len(tokens) > 20
    for i, value in enumerate(texts):
        assert {t for t in tokens if t in value} == tokens & probes.get(i, set()), value


def test_long_number_probes(spark):
    long = "#" + "7" * 3000
    df = spark.createDataFrame([(1, long)], "i int, t string")
    assert rows.token_probes(df, ["i"], "t").filter(F.col("token").startswith("#")).count() == len(long) - 4


def test_spans(spark):
    df = spark.createDataFrame([(1, "a@b.com 123-45-6789 c@d.org")], "i int, t string")
    found = sorted(map(tuple, rows.pii_spans(df, "i", "t").collect()))
    assert found == [(1, "email", 1, "a@b.com"), (1, "email", 2, "c@d.org"), (1, "ssn", 1, "123-45-6789")]


LINE_ENDS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", chr(0x2028), chr(0x2029)]


def test_lines_equal_python(spark):
    rng = random.Random(3)
    pieces = [*LINE_ENDS, " ", "\t", chr(0xA0), chr(0x3000), "a", "[09:00:01] ann: hi", "[09:00:01]  x_1:", "[09:0:01] b:", chr(0x416), "[09:00:01]", "[\u0660\u0669:00:01] \u00e9ric_\u00bd:", "[09:00:01]\u2003Zo\u00eb:", "[09:00:01] e\u0301:"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(800)] + ["", "a\n", "\n"]
    t = F.col("t")
    found = apply(spark, values, text.splitlines(t), text.count_lines(t), detect.count_formatted(t), text.strip(t))
    for value, (lines, n, formatted, stripped) in zip(values, found, strict=True):
        kept = [line for line in value.splitlines() if line.strip()]
        assert lines == value.splitlines(), repr(value)
        assert n == len(kept) and stripped == value.strip(), repr(value)
        assert formatted == sum(bool(re.match(rules.CHAT_LINE_PATTERN, line)) for line in kept), repr(value)


def test_text_lines_drop_blanks(spark):
    df = spark.createDataFrame([(1, "a\n \nb\x0bc")], "i int, t string")
    assert sorted(map(tuple, rows.text_lines(df, "i", "t").collect())) == [(1, 0, "a"), (1, 2, "b"), (1, 3, "c")]


def test_numbers(spark):
    df = spark.createDataFrame([(1, 0, 0.00015), (1, 2, 0.125), (3, 4, 0.145)], "n int, d int, x double")
    got = df.select(text.safe_ratio(F.col("n"), F.col("d")), text.fixed(F.col("x"), 2), text.round4(F.col("x")), text.clamp(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [
        (1.0 if d == 0 else n / d, f"{x:.2f}", round(x, 4), min(0.99, max(0.01, x)))
        for n, d, x in ((1, 0, 0.00015), (1, 2, 0.125), (3, 4, 0.145))
    ]


def test_formats(spark):
    df = spark.createDataFrame([("4111111111111111", "dashed"), ("4111111111111111", "spaced"), ("378282246310005", "dashed")], "d string, s string")
    got = [r[0] for r in df.select(text.format_card(F.col("d"), F.col("s"))).collect()]
    assert got == ["4111-1111-1111-1111", "4111 1111 1111 1111", "378282246310005"]
    one = spark.range(1).select(
        text.format_ssn(F.lit(7), F.lit(5), F.lit(42)), text.format_clock(F.lit(90061)), text.truncate_marked(F.lit("abcdef"), 3),
        text.one_line_preview(F.lit("a\nb" * 60)), text.path_parts(F.lit("a.b[0].c")), text.template_fill(["x {a}", "y {b} {a}"], F.lit(1), {"a": F.lit(1), "b": F.lit("q")}),
    )
    assert tuple(one.first()) == ("007-05-0042", "25:01:01", "abc\n... [output truncated]", ("a b" * 60)[:100], ["a", "b", "0", "c"], "y q 1")


def test_parse_chat_line(spark):
    got = apply(spark, ["[09:00:18] sarah_j: Budget: $61", "no line", "[09:00:18]sarah_j: x"], text.parse_chat_line(F.col("t")))
    assert tuple(got[0][0]) == ("09:00:18", "sarah_j", "Budget: $61") and got[1] == (None,)


def test_parse_action(spark):
    fence = "```"
    cases = {
        '{"action_type": "python", "command": "x = 1"}': ("python", "x = 1"),
        f'{fence}json\n{{"command": "ls"}}\n{fence}': ("bash", "ls"),
        '{"action_type": "perl", "command": "x"}': ("bash", '{"action_type": "perl", "command": "x"}'),
        '{"action_type": null, "command": "x"}': ("bash", '{"action_type": null, "command": "x"}'),
        '{"command": 5}': ("bash", '{"command": 5}'),
        "[1]": ("bash", "[1]"),
        "{}": ("bash", ""),
        "  \n": ("bash", "ls"),
        "y" * 600: ("bash", "y" * 500),
    }
    got = apply(spark, list(cases), replies.parse_action(F.col("t")))
    assert [tuple(r[0]) for r in got] == list(cases.values())


def test_flatten_observation(spark):
    inner = '"observation": {"stdout": "o", "done": false, "reward": 0.5}'
    cases = [f'{{"data": {{{inner}}}}}', f'{{"data": {{{inner}, "reward": null}}}}', f'{{"data": {{{inner}, "reward": 0.9, "done": true}}}}']
    got = apply(spark, cases, *replies.flatten_observation(F.col("t")))
    assert [(r[0], r[4], r[5]) for r in got] == [("o", False, 0.5), ("o", False, None), ("o", True, 0.9)]


def test_a_token_rule_needs_probes():
    with pytest.raises(ValueError, match="probes"):
        rules.TokenRule("ticket", r"T-\d+", 0, ())
