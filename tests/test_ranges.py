"""Files read in byte ranges, with ranges of a few bytes, against Python's readers."""

import csv
import io
import json
import random

import pytest

from veilwork.sources import csv_ranges, json_ranges, readers


@pytest.fixture
def tiny_ranges(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, str(getattr(request, "param", 40)))
    yield
    for name in names:
        spark.conf.unset(name)


def plain_rows(content):
    rows = [r for r in csv.reader(io.StringIO(content, newline="")) if r]
    return rows[1:]


def csv_text(seed, newline):
    rng = random.Random(seed)
    bits = ["a", "bb", "", " ", '""', ",", newline, newline * 2, "é", "日本", "x y", "'"]
    lines = ["id,notes,z"]
    for k in range(24):
        quoted = '"' + "".join(rng.choices(bits, k=rng.randrange(0, 9))) + '"'
        plain = "".join(rng.choices(["a", "b c", 'in"ch', "é", "5\"", ""], k=rng.randrange(0, 3)))
        if plain.startswith('"'):
            plain = "x" + plain
        cells = [str(k), quoted if rng.random() < 0.6 else plain, rng.choice(["", "end", '"q"', f'"{newline}"', 'st"ray'])]
        lines.append(",".join(cells))
        if rng.random() < 0.1:
            lines.append("")
    return newline.join(lines) + (newline if seed % 2 else "")


@pytest.mark.parametrize("tiny_ranges", [23, 300], indirect=True)
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_rows_equal_the_csv_module(spark, tmp_path, tiny_ranges, newline):
    for seed in range(2):
        content = csv_text(seed, newline)
        file = tmp_path / f"{seed}.csv"
        file.write_bytes(content.encode())
        found = sorted((r.row_index, r.text) for r in csv_ranges.csv_rows(spark, str(file)).collect())
        want = plain_rows(content)
        assert [i for i, _ in found] == list(range(len(want)))
        assert [next(csv.reader(io.StringIO(t, newline=""))) for _, t in found] == want


@pytest.mark.parametrize("tiny_ranges", [60], indirect=True)
def test_csv_table_of_many_ranges(spark, tmp_path, tiny_ranges):
    rng = random.Random(3)
    rows = [[str(k), "".join(rng.choices(["a", "\n", '"', ",", "\r\n", "word "], k=rng.randrange(12))), "z" * rng.randrange(3)] for k in range(80)]
    for part, name in ((rows[:50], "a.csv"), (rows[50:], "b.csv")):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            csv.writer(out).writerows([["id", "notes", "z"], *part])
    table = readers.read_table_csv(spark, str(tmp_path), position="row_index")
    assert table.rdd.getNumPartitions() > 1
    found = sorted(table.collect(), key=lambda r: r.row_index)
    assert [[r.id, r.notes, r.z] for r in found] == rows and [r.row_index for r in found] == list(range(80))
    assert all(r._corrupt_record is None for r in found)


def test_csv_odd_files(spark, tmp_path):
    cases = {"empty": "", "header": "a,b\n", "no end": 'a,b\n1,"x\ny"', "unclosed": 'a,b\n1,"x\n2,y\n', "blank": "a,b\n\n\n1,2\n\n"}
    for name, content in cases.items():
        file = tmp_path / f"{name}.csv"
        file.write_text(content)
        rows = [next(csv.reader(io.StringIO(r.text, newline=""))) for r in csv_ranges.csv_rows(spark, str(file)).orderBy("row_index").collect()]
        assert [[c.strip("\n") for c in r] for r in rows] == [[c.strip("\n") for c in r] for r in plain_rows(content)], name
    assert readers.read_table_csv(spark, str(tmp_path / "empty.csv")).count() == 0


# ------------------------------------------------------------------ JSON


def plain_nodes(document):
    """(path, value, is_key, is_text) of every key and every string, by plain recursion."""
    out = []

    def walk(value, path):
        if isinstance(value, dict):
            for name, child in value.items():
                at = f"{path}.{name}" if path else name
                out.append((at, child if isinstance(child, str) else None, True, isinstance(child, str)))
                if isinstance(child, (dict, list)):
                    walk(child, at)
        elif isinstance(value, list):
            for i, child in enumerate(value):
                if isinstance(child, str):
                    out.append((f"{path}[{i}]", child, False, True))
                else:
                    walk(child, f"{path}[{i}]")
        elif isinstance(value, str):
            out.append((path, value, False, True))

    walk(document, "")
    return sorted(out, key=repr)


def json_value(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind < 3:
        return "".join(rng.choices(['"', "\\", ",", "[", "}", "é", "日", "a b", ":", "\n", "x,y"], k=rng.randrange(5)))
    if kind < 5:
        return rng.choice([1, -2.5, True, None, 10**20])
    if kind < 6:
        return [json_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b,c", 'q"', "d\\", "é", "k", "m.n", ""]): json_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def documents():
    rng = random.Random(12)
    return {
        "object": {"company": "A, B", "list": [json_value(rng) for _ in range(8)], "meta": {"n": 1, "t": ["x", {"y": "z"}]}, "empty": [], "none": {}},
        "list": [json_value(rng) for _ in range(8)],
        "text": 'just "text", really',
        "number": 17,
        "nothing": {},
    }


@pytest.mark.parametrize("tiny_ranges", [90, 1 << 20], indirect=True)
@pytest.mark.parametrize("name", list(documents()))
def test_json_nodes_equal_the_json_module(spark, tmp_path, tiny_ranges, name):
    file = tmp_path / "d.json"
    document = documents()[name]
    file.write_text(json.dumps(document, ensure_ascii=False, indent=1 if name == "list" else None), encoding="utf-8")
    rows = json_ranges.json_file_nodes(spark, str(file)).collect()
    assert [r.malformed for r in rows if r.path is None] == [False]
    found = sorted(((r.path, r.value, r.is_key, r.is_text) for r in rows if r.path is not None), key=repr)
    assert found == plain_nodes(document)


def test_json_files_that_are_malformed(spark, tmp_path):
    texts = [
        '{"a": [1, 2}', '{"a": 1,}', "[1,,2]", '{"a" 1}', '["a]', "{} {}", "[1] x", '{"a": [1 2]}', "", "  ", '{"a": {"b": tru}}',
        '{1: 2}', '{"a": x[1]}', '{"a": [1, 2]]}', "[1, 2", '{"a": "b" "c"}', "[[1] 2]",
    ]
    for k, text in enumerate(texts):
        (tmp_path / f"{k:02}.json").write_text(text)
    (tmp_path / "90.json").write_text('{"a": 1, "b": [{"x": "1"}], "a": "last"}')
    rows = json_ranges.json_file_nodes(spark, str(tmp_path), 2).collect()
    marks = {r.file.rsplit("/", 1)[1]: r.malformed for r in rows if r.path is None}
    empty = {f"{k:02}.json" for k, t in enumerate(texts) if not t}
    assert {n for n, bad in marks.items() if not bad} == {"90.json"}
    assert set(marks) | empty == {f.name for f in tmp_path.iterdir()}
    assert [(r.path, r.value) for r in rows if r.file.endswith("90.json") and r.is_text] == [("b[0].x", "1"), ("a", "last")] or sorted(
        (r.path, r.value) for r in rows if r.file.endswith("90.json") and r.is_text
    ) == [("a", "last"), ("b[0].x", "1")]
