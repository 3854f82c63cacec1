"""Streams over rows that arrive out of order, late or not at all."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veilwork.streaming import streams

START = datetime(2024, 1, 1)
SCHEMA = "episode_id long, at timestamp, event_id long, max_steps int, reward double"


def at(minutes):
    return START + timedelta(minutes=minutes)


def arriving(spark, folder, *batches):
    """Each batch of (episode, minute, event, max_steps, reward) as one file and one micro-batch."""
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame([(e, at(m), i, n, r) for e, m, i, n, r in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def beat(minute):
    return [(None, minute, None, None, None)]


FAR = 10**6


def shown(frame):
    return {(r.episode_id, r.event_id): (r.step, r.done, r.last_reward) for r in frame.collect()}


def test_steps_across_files_come_out_in_order_of_time(spark, tmp_path):
    later = [(1, m, m, 15, m / 100) for m in (3, 4, 5)]
    sooner = [(1, m, m, 15, None if m == 1 else m / 100) for m in (0, 1, 2)]
    stream = streams.episode_stream(arriving(spark, tmp_path, later, sooner, beat(FAR)))
    found, query = streams.drained(stream, "test")
    assert shown(found) == {(1, m): (m + 1, False, 0.0 if m == 1 else m / 100) for m in range(6)}
    assert streams.late_rows(query) == 0


def test_an_episode_ends_once(spark, tmp_path):
    """Neither rows after the last step nor rows beyond the limit come out, whenever they arrive."""
    won = [(1, 2, 102, 15, 0.99), (1, 0, 100, 15, 0.2), (2, 9, 209, 3, 0.5), (2, 8, 208, 3, 0.5)]
    more = [(1, 3, 103, 15, 0.1), (1, 1, 101, 15, None), (2, 7, 207, 3, 0.4), (2, 6, 206, 3, 0.3), (2, 90, 290, 3, 0.3)]
    stream = streams.episode_stream(arriving(spark, tmp_path, won, more, beat(200), [(1, 210, 110, 15, 0.4)], beat(FAR)))
    found, query = streams.drained(stream, "test")
    assert shown(found) == {
        (1, 100): (1, False, 0.2), (1, 101): (2, False, 0.2), (1, 102): (3, True, 0.99),
        (2, 206): (1, False, 0.3), (2, 207): (2, False, 0.4), (2, 208): (3, True, 0.5),
    }
    assert streams.state_rows(query) == 0


def test_equal_times_and_repeated_rows(spark, tmp_path):
    rows = [(1, 0, 5, 15, 0.1), (1, 0, 4, 15, 0.2), (1, 0, 4, 15, 0.2)]
    found, _ = streams.drained(streams.episode_stream(arriving(spark, tmp_path, rows, [(1, 0, 3, 15, None)], beat(FAR))), "test")
    assert sorted((r.event_id, r.step, r.last_reward) for r in found.collect()) == [(3, 1, None), (4, 2, 0.2), (4, 3, 0.2), (5, 4, 0.1)]


def test_late_rows_are_counted(spark, tmp_path):
    stream = arriving(spark, tmp_path, [(1, 500, 1, 15, 0.1)], [(2, 600, 2, 15, 0.1)], [(1, 10, 3, 15, 0.5), (1, 520, 4, 15, 0.2)], beat(FAR))
    found, query = streams.drained(streams.episode_stream(stream, "2 hours"), "test")
    assert shown(found) == {(1, 1): (1, False, 0.1), (1, 4): (2, False, 0.2), (2, 2): (1, False, 0.1)}
    assert streams.late_rows(query) == 1


def test_state_goes_when_episodes_fall_silent(spark, tmp_path):
    rows = [(e, e % 7, e, 15, 0.99 if e % 2 else 0.1) for e in range(40)]
    quiet, query = streams.drained(streams.episode_stream(arriving(spark, tmp_path / "a", rows, beat(300))), "test")
    assert quiet.count() == 40 and streams.state_rows(query) > 0
    again = [(1, 30 * 24 * 60 + 900, 99, 15, 0.3)]
    after = arriving(spark, tmp_path / "b", rows, beat(300), beat(30 * 24 * 60 + 400), again, beat(FAR))
    found, query = streams.drained(streams.episode_stream(after), "test")
    assert streams.state_rows(query) == 0
    assert shown(found)[1, 99] == (1, False, 0.3)  # so long after the last step it is a new episode


def test_empty_stream(spark, tmp_path):
    found, query = streams.drained(streams.episode_stream(arriving(spark, tmp_path, beat(0))), "test")
    assert found.count() == 0 and streams.late_rows(query) == 0


def test_closed_windows(spark, tmp_path):
    """Windows come out once, equal to the batch; the state is gone; a late row is counted."""
    def batch(rows, name="in"):
        frame = spark.createDataFrame([(at(m), t, g) for m, t, g in rows], "ts timestamp, line string, g string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    rows = [(m, "ssn 123-45-6789" if m % 3 else "none", "ab"[m % 2]) for m in range(0, 400, 7)]
    for part in (rows[20:40], rows[:20], rows[40:]):
        batch(part)
    batch([(3000, None, None)])
    batch([(5, "ssn 123-45-6789", "a")])
    batch([(FAR, None, None)])
    stream = spark.readStream.schema("ts timestamp, line string, g string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = streams.leak_counts_stream(stream, "line", "ts", "1 hour", "5 hours", ("g",))
    found, query = streams.drained(counts, "test")
    got = {(r.window_start, r.g): (r.n_rows, r.n_pii) for r in found.filter("g is not null").collect()}
    table = spark.createDataFrame([(at(m), t, g) for m, t, g in rows], "ts timestamp, line string, g string")
    want = {(r.window_start, r.g): (r.n_rows, r.n_pii) for r in streams.leak_counts_stream(table, "line", "ts", "1 hour", "5 hours", ("g",)).collect()}
    assert got == want and len(got) == found.filter("g is not null").count()
    assert streams.late_rows(query) == 1
    assert streams.state_rows(query) == 1  # the last heartbeat's window


def test_arrivals_lose_nothing(spark, tmp_path):
    rows = spark.range(3000).select("id", F.timestamp_seconds(1_700_000_000 + F.col("id") * 1200).cast("timestamp_ntz").alias("ts"))
    stream = streams.arrivals(rows, "ts", "test", timedelta(days=10), timedelta(hours=6))
    assert sorted(r.id for r in streams.drain(stream, "test").collect() if r.id is not None) == list(range(3000))
    empty = streams.arrivals(rows.limit(0), "ts", "test")
    assert streams.drain(empty, "test").filter("id is not null").count() == 0


def test_a_table_is_a_file_or_a_folder_of_files(spark, tmp_path):
    """A table in several files was not found, as only names of files were matched."""
    rows = spark.range(40).selectExpr("id as doc_id", "concat('a', id, '@example.org') as text")
    rows.repartition(4).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.limit(1).write.parquet(str(tmp_path / "many" / "other.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "single").mkdir()
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "single" / "documents.parquet")
    for folder in ("many", "single"):
        for name in ("documents.parquet", "doc*.parquet"):
            masked = streams.mask_stream(streams.stream_table(spark, str(tmp_path / folder), name, 2), "text")
            out = streams.drain(masked, "test").collect()
            assert sorted(r.doc_id for r in out) == list(range(40)), (folder, name)
            assert not [r for r in out if "example" in r.text]


def test_rows_without_an_episode_leave_the_others_alone(spark, tmp_path):
    """Ids that came in a batch with a null were read as floats, and their steps went to one episode without an id."""
    rows = [(e, 10 * m + e, 100 * e + m, 15, None if m == 2 else 0.1) for e in range(1, 6) for m in range(4)]
    nulls = [(None, m, 900 + m, 15, 0.1) for m in range(30)]
    mixed = [r for pair in zip(rows, nulls, strict=False) for r in pair]
    found, _ = streams.drained(streams.episode_stream(arriving(spark, tmp_path, mixed, beat(FAR))), "test")
    assert shown(found) == {(e, 100 * e + m): (m + 1, False, 0.1) for e in range(1, 6) for m in range(4)}
