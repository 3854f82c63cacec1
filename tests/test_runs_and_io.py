import os
from datetime import timedelta

from pyspark.sql import functions as F

from veilwork.operators import runs, windows
from veilwork.sources import readers, writers
from veilwork.streaming import streams


def log(spark, rows):
    df = spark.createDataFrame(rows, "episode_id long, event_id long, task_id string, reward double")
    return runs.task_lookup(df.withColumn("ts", F.timestamp_seconds("event_id"))).withColumn("command", F.lit("ls\n-l"))


def accepted(steps):
    return windows.until_done(steps.filter("error is null"), "episode_id", ["ts", "event_id"])


ROWS = (
    [(1, i, "easy", 0.5) for i in range(40)]
    + [(2, 100, "medium", None), (2, 101, "medium", 0.3), (2, 102, "medium", 0.99), (2, 103, "medium", 0.1)]
    + [(3, 200, "nope", 0.5)]
    + [(4, 300 + i, "hard", None) for i in range(2)]
)


def test_until_done(spark):
    found = {}
    for r in accepted(log(spark, ROWS)).collect():
        found.setdefault(r.episode_id, []).append((r.step, r.done))
    assert {k: sorted(v)[-1] for k, v in found.items()} == {1: (15, True), 2: (3, True), 4: (2, False)}


def test_unknown_task(spark):
    errors = {r.task_id: r.error for r in log(spark, ROWS).collect()}
    assert errors == {"easy": None, "medium": None, "hard": None, "nope": "Unknown task_id 'nope'"}


def test_summary_and_rates(spark):
    steps = accepted(log(spark, ROWS))
    last = {(r.episode_id, r.step): r.last_reward for r in windows.last_reward(steps, "episode_id").collect()}
    assert (last[2, 1], last[2, 2], last[2, 3], last[4, 2]) == (None, 0.3, 0.99, None)
    summary = {r.episode_id: (r.steps, list(r.rewards), r.score, r.success) for r in runs.episode_summary(steps).collect()}
    assert summary[2] == (3, [0.0, 0.3, 0.99], 0.99, True)
    assert summary[4] == (2, [0.0, 0.0], 0.0, False)
    rates = {r.task_id: r.success_rate for r in runs.success_rate(runs.episode_summary(steps)).collect()}
    assert rates == {"easy": 1.0, "medium": 1.0, "hard": 0.0}


def test_cut_happens_before_the_shuffle(spark):
    plan = accepted(log(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.index("Exchange hashpartitioning(episode_id")
    assert "WindowGroupLimit" in plan[first_exchange:], plan


def test_averages_of_averages(spark):
    trials = spark.createDataFrame(
        [("easy", 1.0, 10.0, 0.5, None), ("easy", 3.0, 20.0, None, None), ("hard", 5.0, 40.0, 1.0, None), ("bad", 1.0, 1.0, 1.0, "x")],
        "task_id string, reset_ms double, step_ms double, reward double, error string",
    )
    per_task = runs.avg_by_task(trials)
    assert {r.task_id: (r.reset_avg, r.step_avg, r.accuracy) for r in per_task.collect()} == {"easy": (2.0, 15.0, 0.25), "hard": (5.0, 40.0, 1.0)}
    assert tuple(runs.avg_of_avgs(per_task).first()) == (27.5, 62.5)


def test_running_total(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 5).alias("v"))
    found = windows.running_total(df, "g", "id", "v", "total")
    expected, sums = {}, {}
    for i in range(1000):
        sums[i % 3] = sums.get(i % 3, 0) + i % 5
        expected[i] = sums[i % 3]
    assert {r.id: r.total for r in found.collect()} == expected


def test_run_log_lines(spark, tmp_path):
    steps = accepted(log(spark, ROWS))
    lines = writers.run_log_lines(steps, runs.episode_summary(steps), "episode_id", "spark", "m")
    shown = [r.value for r in lines.filter("episode_id = 2").orderBy("at").collect()]
    assert shown == [
        "[START] task=medium env=spark model=m",
        "[STEP] step=1 action=ls -l reward=0.00 done=false error=null",
        "[STEP] step=2 action=ls -l reward=0.30 done=false error=null",
        "[STEP] step=3 action=ls -l reward=0.99 done=true error=null",
        "[END] success=true steps=3 score=0.990 rewards=0.00,0.30,0.99",
    ]
    path = writers.write_lines(lines, "value", str(tmp_path / "log"))
    back = readers.read_run_log(spark, path)
    ends = back.filter("kind = 'end'").select("step", "success", "score", "rewards").orderBy("step").collect()
    assert tuple(ends[1]) == (3, True, 0.99, [0.0, 0.3, 0.99])
    assert back.filter("kind is null").count() == 0
    failed = spark.range(1).select(F.lit("[STEP]  step=4 action=rm x reward=0.10 done=false error=boom").alias("value"))
    assert readers.parse_run_log(failed).first().error == "boom"


def test_csv(spark, tmp_path):
    file = tmp_path / "c.csv"
    file.write_text('id,notes,x\n1,"a\nb ""q""",\n2,,z\n3,short\n4,a,b,long\n', encoding="utf-8")
    table = readers.read_table_csv(spark, str(file))
    rows = {r.id: (r.notes, r.x, r._corrupt_record is None) for r in table.collect()}
    assert rows["1"] == ('a\nb "q"', "", True) and rows["2"] == ("", "z", True)
    assert not rows["3"][2] and not rows["4"][2]
    assert readers.table_status(table).first().status == "malformed"
    good = table.filter("id < 3").drop("_corrupt_record")
    path = writers.write_csv(good, str(tmp_path / "out"))
    again = readers.read_table_csv(spark, path)
    assert again.columns[:3] == ["id", "notes", "x"]
    assert sorted(map(tuple, again.drop("_corrupt_record").collect())) == sorted(map(tuple, good.collect()))


def test_json_nulls_survive(spark, tmp_path):
    docs = spark.createDataFrame([((None, "x"),)], "doc struct<a:string,b:string>")
    path = writers.write_json_docs(docs, "doc", str(tmp_path / "j"))
    assert spark.read.text(path).first().value == '{"a":null,"b":"x"}'
    assert readers.read_json_lines(spark, path).filter("doc is not null").count() == 1
    whole = readers.read_json_docs(spark, path, "a string, b string").filter("doc is not null")
    assert whole.first().doc.b == "x"


def test_manifest(spark, tmp_path):
    for name in ("b.txt", "d/a.txt", ".hidden", "d/.h/x.txt", "_agent_script.py"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [tuple(r) for r in readers.dataset_manifest(spark, str(tmp_path)).collect()] == [("b.txt", 1), ("d/a.txt", 1)]


def test_source_status(spark):
    expected = spark.createDataFrame([(i,) for i in range(4)], "id int")
    found = spark.createDataFrame([(0, b'{"a": 1}'), (1, b"{{"), (2, b"\xff{}")], "id int, content binary")
    got = {r.id: (r.status, r.score) for r in readers.source_status(expected, found, "id", "content").collect()}
    assert got == {0: ("ok", None), 1: ("malformed", 0.01), 2: ("unreadable", 0.01), 3: ("missing", 0.01)}


def test_lines_numbered(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("a\r\n\nb\x0bc\n".encode())
    rows = readers.read_lines(spark, str(tmp_path / "t.txt"), numbered=True).orderBy("row_index", "line_no").collect()
    assert [(r.row_index, r.line) for r in rows] == [(0, "a"), (2, "b"), (2, "c")]


def test_episode_stream_equals_the_batch(spark):
    """Steps that arrive out of order in several batches end up as in one, and nothing follows the last."""
    steps = log(spark, ROWS).filter("error is null").select("episode_id", "event_id", "max_steps", "reward", (F.col("ts") + F.expr("interval 1 day")).alias("at"))
    feed = streams.arrivals(steps, "at", "test", timedelta(seconds=60), timedelta(seconds=60))
    found = {(r.episode_id, r.event_id, r.step, r.done) for r in streams.drain(streams.episode_stream(feed, "2 minutes"), "test").collect()}
    assert found == {(r.episode_id, r.event_id, r.step, r.done) for r in accepted(log(spark, ROWS)).collect()}


def test_until_done_takes_its_bound_from_the_frame(spark):
    from veilwork.operators import windows

    rows = spark.range(60).selectExpr("1L as episode_id", "id as at", "50 as max_steps", "cast(0.1 as double) as reward")
    done = windows.until_done(rows, "episode_id", ["at"]).collect()
    assert len(done) == 50 and [r["step"] for r in done if r["done"]] == [50]
    assert windows.until_done(rows.limit(0), "episode_id", ["at"]).count() == 0


def test_sql_functions_on_null(spark):
    from veilwork.functions import sqlfuncs

    sqlfuncs.register(spark)
    row = spark.sql("select count_all(null) as n, contains_all(null) as has, mask_all(null) as m, count_cards(null) as c").first()
    assert tuple(row) == (0, False, None, 0)


def test_lookups_do_not_move_or_broadcast_contents(spark):
    from veilwork.operators import align
    from veilwork.sources import readers

    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    found = spark.createDataFrame([("a", b"{}"), ("b", b"{")], "name string, content binary")
    got = {r["name"]: r["status"] for r in readers.source_status(expected, found, "name", "content").collect()}
    assert got == {"a": "ok", "b": "malformed", "c": "missing"}
    base = spark.createDataFrame([(1, "p", "v", True)], "id int, path string, value string, addressable boolean")
    plan = align.lookup_leaves(base, base, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
