"""The same functions on streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.detect import count_pii
from ..functions.mask import mask
from ..functions.rules import CORE, RuleSet
from ..operators.windows import FINAL_REWARD
from ..session import scratch_dir


def stream_table(spark: SparkSession, folder: str, files: str, files_per_batch: int = 64) -> DataFrame:
    """Parquet tables of a folder whose names match ``files``, rows that arrive later included.

    A table is one file or a folder of files.  The name is given as a pattern even where it is none, as
    Spark streams from a file only when a pattern finds it.
    """
    pattern = files if set("*?[{\\") & set(files) else f"[{files[0]}]{files[1:]}"
    path = f"{folder}/{pattern}"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def mask_stream(stream: DataFrame, column: str, rules: RuleSet = CORE) -> DataFrame:
    """Mask a column of arriving rows; no state, append mode."""
    return stream.withColumn(column, mask(F.col(column), rules))


def leak_counts_stream(
    stream: DataFrame,
    column: str,
    ts: str,
    window: str = "1 day",
    watermark: str = "1 hour",
    by: tuple[str, ...] = (),
    rules: RuleSet = CORE,
) -> DataFrame:
    """Matches still present in a masked feed, per time window.

    Counts are taken before the grouping, and partial sums are formed before the
    shuffle, so a busy window or group costs one row per task.
    """
    counted = stream.select(
        F.col(ts).cast("timestamp").alias("at"), *by, count_pii(F.col(column), rules).alias("n")
    )
    return (
        counted.withWatermark("at", watermark)
        .groupBy(F.window("at", window).alias("window"), *by)
        .agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_pii"))
        .select(F.col("window.start").alias("window_start"), *by, "n_rows", "n_pii")
    )


STEP_SCHEMA = (
    "episode_id long, at long, event_id long, max_steps int, reward double, "
    "step int, done boolean, last_reward double"
)
EPISODE_STATE = (
    "taken int, done boolean, last double, upto long, "
    "at array<long>, event_id array<long>, max_steps array<int>, reward array<double>"
)
_INPUT = ["episode_id", "at", "event_id", "max_steps", "reward"]
_ORDER = ["at", "event_id"]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _earliest(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of each episode that can still be steps; rows without an episode stay, as they move the watermark."""
    rows = rows.sort_values(_ORDER, kind="stable")
    return rows[rows["episode_id"].isna() | (rows.groupby("episode_id", sort=False, dropna=False).cumcount() < rows["max_steps"])]


def _cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield _earliest(rows)


class EpisodeSteps(StatefulProcessor):
    """Numbers an episode's steps in order of time, whatever the order in which they arrive.

    An episode is one value, read and written once a call: the number of steps so far, whether it is over, the last
    reward, the time of the last step, and the steps that wait, as later arrivals could still precede them; of those
    only as many as the episode has steps left.  A timer at the earliest of them fires when the watermark has passed
    it: what the watermark has passed is in its final order and is put out.  ``idle`` after the last step the value goes.
    """

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episode = handle.getValueState("episode", EPISODE_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        taken, done, last, upto, held = self._known()
        if upto is not None and upto + self.idle_us <= timerValues.getCurrentWatermarkInMs() * 1000 and not held:
            self.episode.clear()  # its timer fires with this batch
            taken, done, last, upto = 0, False, None, None
        if not done and key[0] is not None:
            before = {r[:2] for r in held[:1]}
            held += [(r["micros"], r["event_id"], r["max_steps"], r["reward"]) for r in rows]
            # of equal rows all are steps, as in a table
            held.sort(key=lambda r: r[:2])
            held = [r for k, r in enumerate(held) if taken + k < r[2]]
            if held:
                self._keep(taken, done, last, upto, held)
                if held[0][:2] not in before:
                    self._wake(held[0][0])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        taken, done, last, upto, held = self._known()
        held = [] if done else held
        out = []
        while held and held[0][0] <= passed and not done:
            at, event_id, max_steps, reward = held.pop(0)
            taken, upto = taken + 1, at
            last = last if reward is None else reward
            done = taken >= max_steps or (reward is not None and reward >= FINAL_REWARD)
            out.append(Row(episode_id=key[0], at=at, event_id=event_id, max_steps=max_steps, reward=reward, step=taken, done=done, last_reward=last))
        held = [] if done else held
        if not held and upto is not None and upto + self.idle_us <= passed:
            self.episode.clear()
        elif out:
            self._keep(taken, done, last, upto, held)
            self._wake(held[0][0] if held else upto + self.idle_us)
        return iter(out)

    def close(self) -> None:
        pass

    def _known(self) -> tuple:
        value = self.episode.get()
        if value is None:
            return 0, False, None, None, []
        return (*value[:4], list(zip(*value[4:], strict=True)))

    def _keep(self, taken: int, done: bool, last: float | None, upto: int | None, held: list[tuple]) -> None:
        self.episode.update((taken, done, last, upto, *([r[k] for r in held] for k in range(4))))

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))


def episode_stream(stream: DataFrame, delay: str = "1 hour", idle: timedelta = timedelta(days=30)) -> DataFrame:
    """Accepted steps of each episode, with ``step``, ``done`` and ``last_reward``, in order of ``at`` and ``event_id``.

    Needs ``(episode_id, at, event_id, max_steps, reward)``.  Steps may arrive in any order that is not
    off by more than ``delay``: a step is put out once the watermark, which follows the latest ``at`` by
    that much, has passed it.  Rows that arrive behind the watermark are left out and counted
    (``late_rows``).  Rows without an episode, such as heartbeats, only move the watermark.

    An episode's state is one value: at most ``max_steps`` waiting steps and four numbers.  It goes when the watermark has passed
    the last step by ``idle``, finished or not.  Ids are meant to be used once: rows of an id that arrive after that
    begin a new episode.

    No episode has more than its ``max_steps`` steps, so each input batch is cut to that many of
    the earliest rows of every episode before the shuffle; an episode with very many rows sends
    only those to its task.  What a row that is cut stands behind are as many earlier rows, so it is no step.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    cut = stream.select(*_INPUT).mapInPandas(_cut_batches, stream.select(*_INPUT).schema)
    timed = cut.withWatermark("at", delay).withColumn("micros", F.unix_micros(F.col("at").cast("timestamp")))
    # rows rather than a pandas frame per episode and batch: an episode has few rows, and a frame costs more than they do
    steps = timed.groupBy("episode_id").transformWithState(
        EpisodeSteps(idle // timedelta(microseconds=1)),
        outputStructType=STEP_SCHEMA,
        outputMode="Append",
        timeMode="eventTime",
    )
    return steps.withColumn("at", F.timestamp_micros("at"))


def late_rows(query: StreamingQuery) -> int:
    """How many rows came behind the watermark of a query and were left out."""
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)


def state_rows(query: StreamingQuery) -> int:
    """How many rows the state of a query holds after its last batch."""
    last = query.lastProgress
    return sum(op.numRowsTotal for op in last.stateOperators) if last else 0


def arrivals(
    rows: DataFrame, ts: str, label: str, stretch: timedelta = timedelta(days=16), disorder: timedelta = timedelta(hours=6), files: int = 4
) -> DataFrame:
    """The rows of a table as a stream of micro-batches, out of order by up to ``disorder``.

    A row arrives at its time plus a share of ``disorder`` that is drawn by its content; what arrives within a
    ``stretch`` is written together, as up to ``files`` files, and read in one micro-batch or two.  So no row is
    late for a watermark with a delay of ``stretch + disorder``.  A last file holds a heartbeat: a row of nulls, ten
    years later, that lets the watermark pass all rows.
    """
    spark = rows.sparkSession
    folder = scratch_dir(spark, label)
    micros = timedelta(microseconds=1)
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) / float(1 << 20)
    arrival = F.unix_micros(F.col(ts).cast("timestamp")) + share * (disorder // micros)
    placed = rows.withColumn("_stretch", F.floor(arrival / (stretch // micros)))
    first, last = placed.agg(F.min("_stretch"), F.max("_stretch")).first()
    for k in [] if first is None else range(first, last + 1):
        placed.filter(F.col("_stretch") == k).drop("_stretch").repartition(files).write.mode("append").parquet(folder)
    ahead = F.timestamp_micros(F.lit(((last or 0) + 1) * (stretch // micros) + timedelta(days=3650) // micros)).cast(rows.schema[ts].dataType)
    beat = spark.range(1).select(*[(ahead if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema.fields])
    beat.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def drained(stream: DataFrame, label: str) -> tuple[DataFrame, StreamingQuery]:
    """Process everything that is there now into a new folder (append mode): what came out, and the ended query."""
    spark = stream.sparkSession
    root = scratch_dir(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{root}/out")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out"), query


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Process everything that is there now into a new folder and read it back (append mode)."""
    return drained(stream, label)[0]


def drain_complete(stream: DataFrame, label: str) -> DataFrame:
    """Like ``drain`` for a full result that replaces the one before (complete mode)."""
    spark = stream.sparkSession
    root = scratch_dir(spark, label)
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        written.append(number)

    query = (
        stream.writeStream.option("checkpointLocation", f"{root}/checkpoint")
        .outputMode("complete")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out/batch={max(written)}")
