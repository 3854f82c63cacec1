"""Writers.  Each writes a new folder: Spark cannot replace the files it is reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fixed, one_line_preview


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header; quotes only where needed, quotes inside cells doubled."""
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("quoteAll", False)
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def write_lines(df: DataFrame, column: str, path: str) -> str:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)
    return path


def json_text(df: DataFrame, column: str) -> Column:
    """A document column as JSON text; null fields are kept, or key paths would be lost."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.StringType, T.VariantType)):
        return c.cast("string")
    return F.to_json(c, {"ignoreNullFields": "false"})


def write_json_docs(df: DataFrame, column: str, path: str) -> str:
    """One document per line."""
    df.select(json_text(df, column).alias("value")).write.text(path)
    return path


def start_line(task: Column, env: Column, model: Column) -> Column:
    return F.format_string("[START] task=%s env=%s model=%s", task, env, model)


def step_line(step: Column, action: Column, reward: Column, done: Column, error: Column) -> Column:
    shown_error = F.when(F.coalesce(error, F.lit("")) == "", F.lit("null")).otherwise(error)
    return F.format_string(
        "[STEP] step=%d action=%s reward=%s done=%s error=%s",
        step,
        one_line_preview(action),
        fixed(F.coalesce(reward, F.lit(0.0)), 2),
        done.cast("string"),
        shown_error,
    )


def end_line(success: Column, steps: Column, score: Column, rewards: Column) -> Column:
    shown = F.array_join(F.transform(rewards, lambda r: fixed(r, 2)), ",")
    return F.format_string(
        "[END] success=%s steps=%d score=%s rewards=%s", success.cast("string"), steps, fixed(score, 3), shown
    )


def run_log_lines(steps: DataFrame, episodes: DataFrame, episode: str, env: str, model: str) -> DataFrame:
    """All lines of all runs as ``(episode, at, value)``; ``at`` orders the lines of a run."""
    starts = episodes.select(
        episode, F.lit(0).alias("at"), start_line(F.col("task_id"), F.lit(env), F.lit(model)).alias("value")
    )
    middle = steps.select(
        episode,
        F.col("step").cast("int").alias("at"),
        step_line(F.col("step"), F.col("command"), F.col("reward"), F.col("done"), F.col("error")).alias("value"),
    )
    ends = episodes.select(
        episode,
        (F.col("steps") + 1).cast("int").alias("at"),
        end_line(F.col("success"), F.col("steps"), F.col("score"), F.col("rewards")).alias("value"),
    )
    return starts.unionAll(middle).unionAll(ends)


def write_run_log(lines: DataFrame, episode: str, path: str) -> str:
    """All runs in one folder; each line carries its run's id and a tab in front."""
    tagged = F.concat(F.col(episode).cast("string"), F.lit("\t"), F.col("value"))
    lines.repartition(episode).sortWithinPartitions(episode, "at").select(tagged.alias("value")).write.text(path)
    return path
