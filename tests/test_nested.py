import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veilwork.functions.mask import mask_json_text, mask_struct
from veilwork.functions.opaque import mask_variant
from veilwork.operators import align, nested
from veilwork.plans.verify import validate_json

from .models import clamp_round, grade_json, key_paths, leaves


def made_json(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.35:
        return rng.choice(["x", " y ", "a@b.com", "123-45-6789", "4111111111111111", 5, 2.5, True, None, ""])
    if kind < 0.75:
        names = rng.sample(["a", "b", "c", "d.e", "7", "", "k[0]"], rng.randint(0, 4))
        return {n: made_json(rng, depth + 1) for n in names}
    return [made_json(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def changed(rng, value):
    if isinstance(value, dict):
        return {k: changed(rng, v) for k, v in value.items() if rng.random() > 0.1}
    if isinstance(value, list):
        return [changed(rng, v) for v in value][: rng.choice([1, 9, 9])]
    return rng.choice([value, value, value, "[REDACTED]"]) if isinstance(value, str) else value


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(11)
    docs = [{"r": made_json(rng)} for _ in range(150)] + ["root", ["p", ["q"]], {"a": {"b": "x"}, "a.b": "x"}, {}]
    return [(i, d, changed(rng, d)) for i, d in enumerate(docs)]


def frames(spark, pairs):
    base = spark.createDataFrame([(i, json.dumps(b)) for i, b, _ in pairs], "id int, doc string")
    cand = spark.createDataFrame([(i, json.dumps(c)) for i, _, c in pairs], "id int, doc string")
    return base, cand


def test_untyped_walk_equals_python(spark, pairs):
    base, _ = frames(spark, pairs)
    found = sorted((r.id, r.path, r.value) for r in nested.json_leaves(base, "id", "doc").collect())
    assert found == sorted((i, p, v) for i, doc, _ in pairs for p, v in leaves(doc))
    paths = sorted((r.id, r.path) for r in nested.json_key_paths(base, "id", "doc").collect())
    assert paths == sorted((i, p) for i, doc, _ in pairs for p in key_paths(doc))


def test_untyped_scores_equal_python(spark, pairs):
    base, cand = frames(spark, pairs)
    found = {r.id: r for r in validate_json(base, cand, "id").collect()}
    for i, b, c in pairs:
        expected = grade_json(b, c)
        got = (found[i].removal, found[i].structure, found[i].preservation)
        assert got == pytest.approx(expected[:3]), (b, c)
        assert found[i].score == expected[3] == clamp_round(0.4 * got[0] + 0.25 * got[1] + 0.25 * got[2] + 0.1)


def test_broken_documents(spark):
    base = spark.createDataFrame([(1, '{"a": "x"}'), (2, '{"a": "x"}'), (3, "NOT VALID JSON {{{")], "id int, doc string")
    cand = spark.createDataFrame([(1, "NOT VALID JSON {{{"), (3, '{"a": "x"}')], "id int, doc string")
    found = {r.id: (r.score, r.status) for r in validate_json(base, cand, "id").collect()}
    assert found == {1: (0.01, "malformed"), 2: (0.01, "missing"), 3: (0.01, "malformed")}


TYPED = "a:string, n:bigint, o:struct<s:string, l:array<string>, deep:array<struct<t:string, m:map<string,string>>>>"


def test_typed_walk_equals_untyped(spark):
    rows = [
        (1, '{"a": "x", "n": 1, "o": {"s": "y", "l": ["p", null, "q"], "deep": [{"t": "z", "m": {"k": "v", "7": "w"}}, {"t": null, "m": {}}]}}'),
        (2, '{"a": null, "n": null, "o": null}'),
        (3, '{"a": "x", "n": 3, "o": {"s": null, "l": [], "deep": null}}'),
    ]
    text = spark.createDataFrame(rows, "id int, doc string")
    typed = text.select("id", F.from_json("doc", f"struct<{TYPED}>").alias("doc"))
    read = lambda df: sorted(map(str, nested.json_nodes(df, "id", "doc").collect()))
    assert read(typed) == read(text)


def test_masking_keeps_shape(spark):
    doc = {"a": "mail a@b.com", "n": 4111111111, "o": {"s": "123-45-6789", "l": ["x", "4111111111111111"], "deep": []}}
    text = spark.createDataFrame([(1, json.dumps(doc))], "id int, doc string")
    typed = text.select("id", F.from_json("doc", f"struct<{TYPED}>").alias("doc"))
    out = mask_struct(typed, "doc").first().doc
    assert (out.a, out.n, out.o.s, out.o.l) == ("mail [REDACTED_EMAIL]", 4111111111, "[REDACTED_SSN]", ["x", "[REDACTED_CC]"])
    part = mask_struct(typed, "doc", only="o").first().doc
    assert (part.a, part.o.s) == ("mail a@b.com", "[REDACTED_SSN]")
    loose = json.loads(mask_variant(text, "doc").first().doc)
    assert loose == {**doc, "a": "mail [REDACTED_EMAIL]", "o": {"s": "[REDACTED_SSN]", "l": ["x", "[REDACTED_CC]"], "deep": []}}
    assert text.select(mask_json_text(F.col("doc"))).first()[0] is None  # the number became an unquoted mask


def test_variant_masking_of_mixed_arrays(spark):
    text = spark.createDataFrame([(1, '{"m": [1, "a@b.com", {"k": null}]}'), (2, "oops"), (3, None)], "id int, doc string")
    assert [r.doc for r in mask_variant(text, "doc").orderBy("id").collect()] == ['{"m": [1, "[REDACTED_EMAIL]", {"k": null}]}', None, None]


def test_lookup_and_overlap(spark):
    base = spark.createDataFrame([(1, '{"a": {"b": "x", "c": "y"}, "l": ["p", "q"]}')], "id int, doc string")
    cand = spark.createDataFrame([(1, '{"a": {"b": "z"}, "l": ["p"]}')], "id int, doc string")
    found = {(r.path, r.found) for r in align.path_lookup(base, cand, "id", "doc").collect()}
    assert found == {("a.b", "z"), ("a.c", None), ("l[0]", "p"), ("l[1]", None)}
    assert tuple(align.key_path_overlap(base, cand, "id", "doc").first()) == (1, 4, 3)


def at_path(value, path):
    """The plain walk: names and list positions; a text has no positions here."""
    for part in filter(None, re.split(r"\.|\[(\d+)\]", path)):
        if part.isdigit():
            value = value[int(part)] if isinstance(value, list) and int(part) < len(value) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value if isinstance(value, str) else None


def test_odd_paths(spark):
    docs = [
        {"a": ["x", "y", 5], "b": {"c": "z", "it's?": "q", " pad": "p", "k[": "r", "two words": "w"}, "7": "digits"},
        "whole text",
        ["first"],
    ]
    paths = ["", ".", "b..c", "b.c.", ".b.c", "a.1", "a[1]", "a[0]", "a[2]", "a[9]", "a[99999999999]", "7", "0", "[0]", "b.it's?", "b. pad", "b.k["]
    paths += ["b.two words", "b", "a.c", "nothing", "a[1].c", "[0].c", "a[01]", "a[x]", "a]"]
    rows = [(i, json.dumps(d), p) for i, d in enumerate(docs) for p in paths]
    frame = spark.createDataFrame(rows, "id int, doc string, path string").select("id", F.parse_json("doc").alias("v"), "path")
    found = {(r["id"], r["path"]): r["s"] for r in frame.select("id", "path", nested.get_by_path(F.col("v"), F.col("path")).alias("s")).collect()}
    assert found == {(i, p): at_path(docs[i], p) for i in range(len(docs)) for p in paths}


def test_strategies_agree_and_ignore_partitions(spark, sf):
    from veilwork.plans import inputs

    base = inputs.records(spark, sf)
    cand = inputs.masked_records(base)
    runs = [
        validate_json(base, cand, "id"),
        validate_json(base, cand, "id", strategy="leaves"),
        validate_json(base.repartition(7), cand.repartition(3), "id"),
    ]
    first, *others = (sorted(map(str, r.collect())) for r in runs)
    assert all(other == first for other in others)


ODD_JSON = [
    '{"a":1.10,"b":1e400, "c" : "a@b.com"}',
    '{"a":"x","a":"123-45-6789"}',
    '"\\ud800"',
    "[" * 1200 + '"a@b.com"' + "]" * 1200,
    '{"say \\"hi\\" a@b.com":"\\"a@b.com\\" \\\\ \\n\\u00e9","p":"c:\\\\"}',
    '{ "k" : ":a@b.com", "l":["",":", "x\\\\\\\\", {"m":"\\u0061@b.com \\/"}] }\n',
    '["tab\\t/", -0, 1E5, NaN, true, null]',
    "{}",
    " [ ] ",
    '"a@b.com"',
    '{"a":01}', "[1,]", '"a\tb"', "", "{'a':1}", "[1] 2", "{a:1}", "[1]//c", "1,2", "1],[2", '1,"a":2', "[1", '["a":1]', '{"a"}', "{,}", "[}", '"', '"\\x"',
]


def masked_values(value):
    if isinstance(value, str):
        return value.replace("a@b.com", "[REDACTED_EMAIL]").replace("123-45-6789", "[REDACTED_SSN]")
    if isinstance(value, list):
        return [masked_values(v) for v in value]
    return value if not isinstance(value, tuple) else tuple((k, masked_values(v)) for k, v in value)


def read_whole(text, limit=10_000):
    """Numbers as written, in bytes; objects as tuples of pairs."""
    import sys

    before = sys.getrecursionlimit()
    sys.setrecursionlimit(limit)
    try:
        return json.loads(text, parse_float=str.encode, parse_int=str.encode, parse_constant=str.encode, object_pairs_hook=tuple)
    finally:
        sys.setrecursionlimit(before)


def test_untyped_masking_keeps_the_rest_letter_for_letter(spark):
    rng = random.Random(5)
    texts = ODD_JSON + [json.dumps(made_json(rng), ensure_ascii=False) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, doc string")
    got = [r.doc for r in mask_variant(frame, "doc").orderBy("id").collect()]
    for text, out in zip(texts, got, strict=True):
        if len(text) > 2000:
            assert out == text.replace("a@b.com", "[REDACTED_EMAIL]")
            continue
        try:
            value = read_whole(text)
        except ValueError:
            assert out is None, text
            continue
        if "@" not in text and "6789" not in text and "1111" not in text:
            assert out == text
        if "4111" not in text:
            assert repr(read_whole(out)) == repr(masked_values(value)), text
    assert got[0] == '{"a":1.10,"b":1e400, "c" : "[REDACTED_EMAIL]"}'
    below = [r.doc for r in mask_variant(frame, "doc", only="c").orderBy("id").collect()]
    assert below[0] == got[0] and below[4] == texts[4] and below[1] == texts[1]
    assert [a is None for a in below] == [a is None for a in got]


def test_untyped_masking_of_long_and_empty_input(spark):
    from pyspark.sql import functions as F

    big = spark.range(1).select(F.concat(F.lit('{"t":"a@b.com '), F.repeat(F.lit("words x"), 3_000_000), F.lit('"}')).alias("doc"))
    out = mask_variant(big, "doc").select(F.length("doc").alias("n"), F.left("doc", F.lit(30)).alias("head")).first()
    assert out.n == 21_000_000 + 16 + 9 and out.head.startswith('{"t":"[REDACTED_EMAIL] words')
    assert big.select(F.length(mask_json_text(F.col("doc")))).first()[0] == 21_000_000 + 16 + 9
    assert mask_variant(big.limit(0), "doc").count() == 0
