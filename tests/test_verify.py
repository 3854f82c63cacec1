import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from veilwork.functions import mask, rules
from veilwork.operators import align
from veilwork.plans import verify
from veilwork.sources import generate, writers

from .models import clamp_round, grade_rows, grade_text

HEADER = ["id", "first_name", "last_name", "email", "phone", "address", "notes"]


def table_of(spark, rows):
    return spark.createDataFrame([tuple(str(c) for c in r) for r in rows], ", ".join(f"{n} string" for n in HEADER))


def customers(n):
    rng = random.Random(5)
    cards = ["4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111", "378282246310005"]
    return [
        (i, f"F{i}", f"L{i}", f"f{i}@x.org", "555-123-4567", f" {i} Oak ", f"CC: {rng.choice(cards)}" if i % 3 == 0 else "")
        for i in range(n)
    ]


def masked_rows(rows):
    return [tuple(re.sub(rules.CARD_PATTERN, rules.CARD_MASK, str(c)) for c in r) for r in rows]


@pytest.mark.parametrize("case", ["same", "masked", "dropped", "longer", "overdone", "empty"])
def test_table_by_position(spark, case):
    base = customers(40)
    cand = {
        "same": base,
        "masked": masked_rows(base),
        "dropped": masked_rows(base)[:7] + masked_rows(base)[8:],
        "longer": base + [(99, "a", "b", "c", "d", "e", "4111111111111111")] * 3,
        "overdone": [(*r[:2], "[REDACTED]", *r[3:]) for r in base],
        "empty": [],
    }[case]
    frames = [
        spark.createDataFrame([(i, *map(str, r)) for i, r in enumerate(rows)], "row_index long, " + ", ".join(f"{n} string" for n in HEADER))
        for rows in (base, cand)
    ]
    found = verify.validate_table(*frames, match="row_index", by="position").first()
    dicts = [[dict(zip(HEADER, map(str, r), strict=True)) for r in rows] for rows in (base, cand)]
    assert found.score == grade_rows(*dicts, rules.PROTECTED_COLUMNS)


def test_table_by_key_survives_a_lost_row(spark):
    base = table_of(spark, customers(40))
    lost = base.filter("id <> '7'")
    found = verify.validate_table(base, lost).first()
    assert (found.cells_compared, found.cells_equal, found.structure) == (160, 156, 0.0)
    shuffled = verify.validate_table(base, base.orderBy(F.rand(1))).first()
    assert shuffled.preservation == 1.0 and shuffled.structure == 1.0


def test_table_without_protected_columns_or_pii(spark):
    a = spark.createDataFrame([("1", "x")], "k string, v string")
    b = spark.createDataFrame([("1", "4111111111111111")], "k string, v string")
    found = verify.validate_table(a, b, match="k").first()
    assert (found.removal, found.preservation, found.score) == (1.0, 1.0, 0.99)


def test_repeated_key_does_not_multiply(spark):
    """One key on a third of the rows: counts stay exact and nothing is paired with everything."""
    rows = customers(3000)
    base = table_of(spark, [("", *r[1:]) if i % 3 == 0 else r for i, r in enumerate(rows)])
    found = verify.validate_table(base, base).first()
    assert (found.baseline_rows, found.candidate_rows) == (3000, 3000)
    assert found.baseline_matches == found.candidate_matches > 0 and found.preservation == 1.0


def chat_text(n):
    rng = random.Random(9)
    messages = ["my SSN is 525-68-1945", "Order #63627 is pending", "hit 37.4 million", "closed 345 tickets", "PRD-20246985", "Extension is 4821.", "Thanks all!"]
    return "\n".join(f"[09:{i % 60:02d}:18] user_{i % 5}: {rng.choice(messages)}" for i in range(n)) + "\n"


@pytest.mark.parametrize("case", ["same", "masked", "digits", "dropped", "longer", "empty", "prose"])
@pytest.mark.parametrize("whole", [True, False])
def test_text(spark, case, whole):
    base = chat_text(60)
    masked = re.sub(rules.SSN_PATTERN, rules.SSN_MASK, base)
    cand = {
        "same": base,
        "masked": masked,
        "digits": re.sub(r"\d", "X", base),
        "dropped": "\n".join(masked.splitlines()[:40]),
        "longer": masked + masked,
        "empty": "",
        "prose": "tickets #636270 1137.4 million x48215",
    }[case]
    split = (lambda t: [t]) if whole else (lambda t: t.split("\n"))
    frames = [spark.createDataFrame([(x,) for x in split(t)], "value string") for t in (base, cand)]
    assert verify.validate_text(*frames).first().score == grade_text(base, cand)


def test_text_per_key(spark):
    texts = {k: chat_text(10 + k) for k in range(6)}
    cands = {k: re.sub(rules.SSN_PATTERN, "x", t) if k % 2 else t for k, t in texts.items() if k != 4}
    frame = lambda d: spark.createDataFrame([(k, line) for k, t in d.items() for line in t.split("\n")], "k int, value string")
    found = {r.k: (r.score, r.status) for r in verify.validate_text(frame(texts), frame(cands), "k").collect()}
    assert found == {k: (grade_text(t, cands[k]), "ok") if k != 4 else (0.01, "missing") for k, t in texts.items()}


def test_files(spark, tmp_path):
    """The three kinds of files: untouched, masked, missing and broken."""
    ids = spark.range(1, 121)
    made = {
        "customers.csv": generate.gen_customers(ids).toPandas().to_csv(index=False),
        "chat_logs.txt": "\n".join(r.line for r in generate.gen_chat(ids).orderBy("id").collect()) + "\n",
        "records.json": json.dumps({"customers": [json.loads(r[0]) for r in generate.gen_records(ids.filter("id < 20")).select(F.to_json("record")).collect()]}),
    }
    dirs = {name: tmp_path / name for name in ("base", "same", "masked", "none", "broken")}
    for name, folder in dirs.items():
        os.makedirs(folder)
        for file, text in made.items():
            if name == "masked":
                for r in {"customers.csv": [rules.CARD], "chat_logs.txt": [rules.SSN]}.get(file, rules.CORE):
                    text = re.sub(r.pattern, r.mask, text)
            if name == "broken":
                text = {"customers.csv": text + "1,2\n", "records.json": "NOT VALID JSON {{{"}.get(file, text)
            if name != "none":
                (folder / file).write_text(text, encoding="utf-8")
    score = lambda task, name: tuple(verify.validate_files(spark, task, str(dirs[name]), str(dirs["base"])).first())[1:]
    assert score("easy", "same") == (0.5, "ok") and score("medium", "same") == (0.5, "ok") and score("hard", "same") == (0.6, "ok")
    assert all(score(task, "masked") == (0.99, "ok") for task in ("easy", "medium", "hard"))
    assert all(score(task, "none") == (0.01, "missing") for task in ("easy", "medium", "hard"))
    assert score("easy", "broken") == (0.01, "malformed") and score("hard", "broken") == (0.01, "malformed")


def test_validate_many_isolates_failures(spark):
    base = spark.createDataFrame([("[09:00:00] a: b",)], "value string")
    jobs = {"good": ("medium", (base, base), {}), "bad": ("medium", (base, base), {"column": "nope"}), "odd": ("none", (), {})}
    out = {r.dataset: (r.score, r.status) for r in verify.validate_many(spark, jobs).collect()}
    assert out == {"good": (0.99, "ok"), "bad": (0.01, "error"), "odd": (0.01, "error")}
    assert verify.score_violations(verify.validate_many(spark, jobs)).count() == 0
    wrong = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (None,)], "score double")
    assert verify.score_violations(wrong).count() == 3


def test_positions(spark, tmp_path):
    rank = align.with_rank(spark.range(0, 5000, 7).repartition(5), "id")
    assert [r.row_index for r in rank.orderBy("id").collect()] == list(range(len(range(0, 5000, 7))))
    df = spark.range(1000).orderBy("id").select(F.col("id").cast("string").alias("value"))
    path = writers.write_lines(df.repartitionByRange(6, F.col("value").cast("int")).sortWithinPartitions(F.col("value").cast("int")), "value", str(tmp_path / "t"))
    placed = align.with_file_position(spark.read.text(path).select("value", "_metadata"))
    assert all(int(r.value) == r.row_index for r in placed.collect()) and placed.count() == 1000


def test_score_rounding():
    assert clamp_round(2) == 0.99 and clamp_round(-1) == 0.01


def test_generators_do_not_depend_on_partitions(spark):
    ids = spark.range(300)
    for make in (generate.gen_customers, generate.gen_chat, generate.gen_records):
        one = sorted(map(str, make(ids.repartition(1)).collect()))
        assert one == sorted(map(str, make(ids.repartition(9)).collect()))
        assert one != sorted(map(str, make(ids, seed=7).collect()))


def test_generated_shares_and_clock(spark):
    ids = spark.range(2000)
    notes = generate.gen_customers(ids)
    cards = mask.mask_columns(notes, rules.CARD_ONLY).filter("notes like '%REDACTED_CC%'").count()
    assert 0.25 < cards / 2000 < 0.35
    lines = [r.line for r in generate.gen_chat(ids).orderBy("id").collect()]
    assert all(re.match(rules.CHAT_LINE_PATTERN, x) for x in lines)
    seconds = [int(h) * 3600 + int(m) * 60 + int(s) for h, m, s in (x[1 : x.index("]")].split(":") for x in lines)]
    assert all(10 <= b - a <= 45 for a, b in zip([9 * 3600, *seconds], seconds, strict=False))
    assert 0.12 < sum(bool(re.search(rules.SSN_PATTERN, x)) for x in lines) / 2000 < 0.18


def test_empty_pairs_have_a_score(spark, tmp_path):
    """As in the plain model: nothing to remove, same number of rows, nothing preserved."""
    rows = spark.createDataFrame([], ", ".join(f"{n} string" for n in HEADER))
    assert tuple(verify.validate_table(rows, rows).select("score", "status").first()) == (grade_rows([], [], rules.PROTECTED_COLUMNS), "ok")
    lines = spark.createDataFrame([], "value string")
    assert tuple(verify.validate_text(lines, lines).select("score", "status").first()) == (grade_text("", ""), "ok")
    for name in ("base", "work"):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "customers.csv").write_text(",".join(HEADER) + "\n")
        (tmp_path / name / "chat_logs.txt").write_text("")
        (tmp_path / name / "records.json").write_text("")
    files = {t: tuple(verify.validate_files(spark, t, str(tmp_path / "work"), str(tmp_path / "base")).first())[1:] for t in ("easy", "medium", "hard")}
    assert files == {"easy": (0.75, "ok"), "medium": (0.75, "ok"), "hard": (0.01, "malformed")}


@pytest.mark.parametrize("task, file, text", [
    ("easy", "customers.csv", b"id,notes\n1,caf\xe9\n"), ("medium", "chat_logs.txt", b"[09:00:00] a: b\nx\xff\n"), ("hard", "records.json", b'{"a": "\xc3"}'),
])
def test_bytes_that_are_no_text(spark, tmp_path, task, file, text):
    good = {"easy": b"id,notes\n1,x\n", "medium": b"[09:00:00] a: b\n", "hard": b'{"a": "x"}'}[task]
    for name, content in (("good", good), ("bad", text)):
        os.makedirs(tmp_path / name)
        (tmp_path / name / file).write_bytes(content)
    for work, base in (("bad", "good"), ("good", "bad")):
        found = verify.validate_files(spark, task, str(tmp_path / work), str(tmp_path / base)).first()
        assert tuple(found)[1:] == (0.01, "unreadable")
    assert verify.validate_files(spark, task, str(tmp_path / "good"), str(tmp_path / "good")).first().status == "ok"


def test_failures_at_run_time_are_isolated(spark):
    base = spark.createDataFrame([("[09:00:00] a: b",)], "value string")
    failing = base.withColumn("value", F.raise_error(F.lit("no such block")).cast("string"))
    cast = base.select((F.col("value").cast("int") + 1).cast("string").alias("value"))
    jobs = {"good": ("medium", (base, base), {}), "fails": ("medium", (base, failing), {}), "cast": ("medium", (cast, base), {}), "last": ("medium", (base, base), {})}
    out = {r.dataset: (r.score, r.status) for r in verify.validate_many(spark, jobs).collect()}
    assert out == {"good": (0.99, "ok"), "fails": (0.01, "error"), "cast": (0.01, "error"), "last": (0.99, "ok")}


@pytest.mark.parametrize("failure", ["run", "plan"])
def test_a_failure_is_no_count_of_violations(spark, monkeypatch, failure):
    from veilwork.plans import queries

    rows = table_of(spark, customers(4)).withColumn("g", F.lit(1))
    docs = spark.createDataFrame([(1, ("x",))], "id int, doc struct<a:string>")
    chat = spark.createDataFrame([(1, "[09:00:00] a: b")], "user_id int, line string")
    monkeypatch.setattr(queries, "_customer_pair", lambda *_: (rows.withColumnRenamed("g", "c_nationkey"),) * 2)
    monkeypatch.setattr(queries, "_record_pair", lambda *_: (docs, docs))
    monkeypatch.setattr(queries, "_chat", lambda *_: chat)
    monkeypatch.setattr(queries.inputs, "masked_chat", lambda df: df)
    assert [tuple(r) for r in queries.QUERIES["score_violations"](spark, "").collect()] == [(0,)]
    no_block = lambda df: df.withColumn("line", F.raise_error(F.lit("no such block")).cast("string"))
    monkeypatch.setattr(queries.inputs, "masked_chat", no_block if failure == "run" else lambda df: df.drop("line"))
    with pytest.raises(Exception, match="no such block" if failure == "run" else "line"):
        queries.QUERIES["score_violations"](spark, "").collect()
    status = {r.dataset: r.status for r in queries.QUERIES["validate_many"](spark, "").collect()}
    assert status == {"customers": "ok", "chat": "error", "records": "ok", "broken": "error"}


@pytest.mark.parametrize("strategy", ["documents", "leaves"])
def test_repeated_keys_and_no_key_in_json(spark, strategy):
    shape = "id int, doc struct<a:string,b:string>"
    base = spark.createDataFrame([(1, ("x", "y"))] * 3 + [(2, ("x", "555-123-4567")), (3, ("p", "q"))], shape)
    cand = spark.createDataFrame([(1, ("x", "y"))] * 3 + [(2, ("x", "gone")), (3, ("p", "q")), (3, ("p", "q"))], shape)
    found = {r.id: (r.n_paths, r.score, r.status) for r in verify.validate_json(base, cand, "id", strategy=strategy).collect()}
    assert found == {1: (0, 0.01, "repeated"), 2: (2, 0.99, "ok"), 3: (0, 0.01, "repeated")}
    pair = (df.filter("id = 2").select("doc") for df in (base, cand))
    assert tuple(verify.validate_json(*pair, strategy=strategy).select("score", "status").first()) == (0.99, "ok")
    assert verify.validate_json(base, cand, "id", strategy=strategy).count() == 3


def test_positions_and_sums_by_sparse_ids(spark):
    """Hashed ids, nulls and repeated rows, over all rows and within groups; no task sees all rows."""
    from veilwork.operators import ordered

    rows = [(random.Random(k).getrandbits(62) if k % 11 else None, "abc"[k % 3] if k % 5 else None, k % 7) for k in range(500)] + [(7, "a", 2)] * 40
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    low = -(1 << 70)
    order = sorted(rows, key=lambda r: low if r[0] is None else r[0])
    places = sorted((r.row_index, low if r.id is None else r.id) for r in ordered.numbered(df, ["id"]).collect())
    assert places == [(k, low if r[0] is None else r[0]) for k, r in enumerate(order)]
    found = ordered.running_sum(df.filter("id is not null and id <> 7"), ["id"], "v", ["g"], "total").collect()
    sums, want = {}, set()
    for i, g, v in order:
        if i not in (None, 7):
            sums[g] = sums.get(g, 0) + v
            want.add((i, g, sums[g]))
    assert {(r.id, r.g, r.total) for r in found} == want
    plan = ordered.numbered(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # of the few rows that sum up slices
