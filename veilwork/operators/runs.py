"""Analytics over masking runs: step logs, episodes and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clamp

# The registered tasks and thresholds.
TASKS = (
    ("easy", "Redact Credit Card Numbers from CSV", "customers.csv", 15),
    ("medium", "Redact SSNs from Chat Logs", "chat_logs.txt", 20),
    ("hard", "Redact Mixed PII from Nested JSON", "records.json", 30),
)
SUCCESS_SCORE = 0.5


def task_table(spark: SparkSession) -> DataFrame:
    """The registry as a table of three rows."""
    return spark.createDataFrame(
        [(i, n, steps) for i, n, _, steps in TASKS], "task_id string, task_name string, max_steps int"
    )


def task_lookup(steps: DataFrame) -> DataFrame:
    """Attach name and step limit by ``task_id``; an unknown id yields an ``error``.

    The registry has three rows, so it is broadcast whatever the size of the log.
    """
    known = steps.join(F.broadcast(task_table(steps.sparkSession)), "task_id", "left")
    unknown = F.concat(F.lit("Unknown task_id '"), F.col("task_id"), F.lit("'"))
    return known.withColumn("error", F.when(F.col("max_steps").isNull(), unknown))


def episode_summary(steps: DataFrame, episode: str = "episode_id", keep: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Steps, ordered rewards, final score and success of each episode.

    Takes the output of ``until_done``, whose episodes have a bounded number of steps;
    a reward that is null counts as 0.
    """
    reward = F.coalesce("reward", F.lit(0.0))
    grouped = steps.groupBy(episode, *keep).agg(
        F.max("step").cast("long").alias("steps"),
        F.max_by(reward, "step").alias("final"),
        F.array_sort(F.collect_list(F.struct("step", reward.alias("reward")))).alias("log"),
    )
    score = clamp(F.col("final"), 0.0, 1.0)
    return grouped.select(
        episode,
        *keep,
        "steps",
        F.transform("log", lambda x: x["reward"]).alias("rewards"),
        score.alias("score"),
        (score >= SUCCESS_SCORE).alias("success"),
    )


def success_rate(episodes: DataFrame, by: str = "task_id") -> DataFrame:
    return episodes.groupBy(by).agg(
        F.count("*").alias("n_runs"), F.avg(F.col("success").cast("double")).alias("success_rate")
    )


def avg_by_task(trials: DataFrame, by: str = "task_id") -> DataFrame:
    """Mean timings and accuracy of the trials that succeeded; tasks without any are absent."""
    ok = trials.filter("error is null")
    return ok.groupBy(by).agg(
        F.avg("reset_ms").alias("reset_avg"),
        F.avg("step_ms").alias("step_avg"),
        F.avg(F.coalesce("reward", F.lit(0.0))).alias("accuracy"),
    )


def avg_of_avgs(per_task: DataFrame) -> DataFrame:
    """Unweighted mean of the tasks' means; accuracy in percent."""
    return per_task.agg(F.avg("step_avg").alias("overall_latency"), (F.avg("accuracy") * 100).alias("overall_accuracy"))
