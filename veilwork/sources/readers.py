"""Readers for tables, text, JSON documents, run logs and file listings."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FLOOR, is_blank, splitlines, strip
from ..operators.align import with_file_position
from ..operators.rows import text_lines
from .csv_ranges import csv_rows

CORRUPT = "_corrupt_record"


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder, from its first line only."""
    first = spark.read.text(path).first()
    return next(csv.reader([first[0]])) if first else []


def read_table_csv(
    spark: SparkSession, path: str, header: list[str] | None = None, multi_line: bool = True, position: str | None = None
) -> DataFrame:
    """CSV with a header as strings; blank cells are ``''``.

    Rows with too few or too many cells keep their text in ``_corrupt_record``, which is
    NULL for proper rows.  Give ``header`` to spare the look at the first line.  Files are read in byte
    ranges; ``multi_line=False``, for files where no cell holds a line end, spares the pass that
    finds the ends of rows.  ``position`` names a column for the place of a row in file order, from 0.
    """
    names = csv_header(spark, path) if header is None else header
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    options = {"multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if not names:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn(position, F.lit(0).cast("long")) if position else empty
    if multi_line or position:
        rows = csv_rows(spark, path)
        shape = ", ".join("`{}` string".format(f.replace("`", "``")) for f in schema.names)
        parsed = rows.select(*([F.col("row_index").alias(position)] if position else []), F.from_csv("text", shape, options).alias("_row"))
        raw = parsed.select("_row.*", *([position] if position else []))
    else:
        raw = spark.read.schema(schema).options(**(options | {"multiLine": False})).option("header", True).option("enforceSchema", True).csv(path)
    return raw.fillna("", subset=names)


def read_lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Non-blank lines of text files as ``(path, line)``.

    Files are split at ``\\n`` so that large ones are read in parallel; other line ends
    inside such a piece are split afterwards.  ``numbered`` adds ``row_index``, the place
    of the piece in file order, and ``line_no`` within the piece.
    """
    pieces = spark.read.option("lineSep", "\n").text(path)
    if not numbered:
        keyed = pieces.select(F.col("_metadata.file_path").alias("path"), "value")
        return text_lines(keyed, "path", "value").drop("line_no")
    placed = with_file_position(pieces.select("value", "_metadata"))
    lines = placed.select(
        F.col("_metadata.file_path").alias("path"),
        "row_index",
        F.posexplode(splitlines(F.col("value"))).alias("line_no", "line"),
    )
    return lines.filter(~is_blank(F.col("line")))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text pieces ``(path, value)``; any file size, no line numbers needed."""
    pieces = spark.read.option("lineSep", "\n").text(path)
    return pieces.select(F.col("_metadata.file_path").alias("path"), "value")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(bad)``: are there bytes that are no UTF-8?

    A line end is never part of a longer character, so a file is valid when each of its lines is, and files
    of any size are judged line by line in splits.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.agg(F.coalesce(F.bool_or(~F.is_valid_utf8("value")), F.lit(False)).alias("bad"))


def read_json_docs(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole JSON files, one document each: ``(path, doc)``.

    Without a schema ``doc`` is a variant, with one a struct; NULL marks a malformed file.
    """
    files = spark.read.text(path, wholetext=True)
    parsed = F.try_parse_json("value") if schema is None else F.from_json("value", schema)
    return files.select(F.col("_metadata.file_path").alias("path"), parsed.alias("doc"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON document per line, the form for many or large documents."""
    lines = spark.read.text(path)
    parsed = F.try_parse_json("value") if schema is None else F.from_json("value", schema)
    return lines.select(parsed.alias("doc"))


# Fixed value: the name of the scratch script that listings leave out.
SCRATCH_SCRIPT = "_agent_script.py"


def dataset_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` as ``(path, length)``, hidden ones and the scratch script left out, sorted.

    File contents are not read: only the listed columns of the source are asked for.
    Spark itself leaves out every name that starts with an underscore.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    )
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace("path", "^.*?" + _quote(base) + "/", "")
    named = files.select(relative.alias("path"), "length")
    hidden = F.col("path").rlike(r"(^|/)\.") | F.col("path").rlike(r"(^|/)" + _quote(SCRATCH_SCRIPT) + "$")
    return named.filter(~hidden).orderBy("path")


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E"


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def json_status(content: Column) -> Column:
    """``missing``, ``unreadable``, ``malformed`` or ``ok`` for the bytes of a JSON file."""
    return (
        F.when(content.isNull(), "missing")
        .when(~F.is_valid_utf8(content.cast("string")), "unreadable")
        .when(F.try_parse_json(content.cast("string")).isNull(), "malformed")
        .otherwise("ok")
    )


def text_status(content: Column) -> Column:
    return (
        F.when(content.isNull(), "missing")
        .when(~F.is_valid_utf8(content.cast("string")), "unreadable")
        .otherwise("ok")
    )


def source_status(expected: DataFrame, found: DataFrame, key: str, content: str, kind: str = "json") -> DataFrame:
    """Status of each expected input: ``(key, status, score)``; the score is set unless the input is ok.

    ``found`` holds ``(key, content)``, e.g. from ``binaryFile`` or a column of texts.
    """
    judge = json_status if kind == "json" else text_status
    status = judge(F.col(content))
    judged = found.select(key, status.alias("status"))  # contents stay where they are, the short status moves
    joined = expected.select(key).join(judged, key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return joined.withColumn("score", F.when(F.col("status") != "ok", F.lit(FLOOR)))


def table_status(table: DataFrame) -> DataFrame:
    """``malformed`` as soon as one row of a CSV frame is ragged."""
    # Spark refuses to read the corrupt-record column alone, so the flag carries another.
    flag = F.when(F.col(CORRUPT).isNotNull(), F.coalesce(F.col(f"`{table.columns[0]}`"), F.lit("")))
    return table.agg(F.when(F.count(flag) > 0, "malformed").otherwise("ok").alias("status"))


_START = r"^\[START\] task=(.*?) env=(.*?) model=(.*)$"
_STEP = r"^\[STEP\]\s+step=(\d+) action=(.*) reward=(-?\d+\.\d+) done=(true|false) error=(.*)$"
_END = r"^\[END\]\s+success=(true|false) steps=(\d+) score=(-?\d+\.\d+) rewards=(.*)$"


def parse_run_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """``[START]``, ``[STEP]`` and ``[END]`` lines as typed columns; other columns stay.

    ``kind`` tells which line it was (NULL for any other line); fields of the other
    kinds are NULL.
    """
    c = F.col(column)
    kind = F.when(c.rlike(_START), "start").when(c.rlike(_STEP), "step").when(c.rlike(_END), "end")

    def field(of: str, pattern: str, i: int, cast: str = "string") -> Column:
        return F.when(F.col("kind") == of, F.regexp_extract(c, pattern, i)).cast(cast)

    error = field("step", _STEP, 5)
    rewards = F.filter(F.split(field("end", _END, 4), ","), lambda r: strip(r) != "")
    others = [F.col(n) for n in lines.columns if n != column]
    return lines.withColumn("kind", kind).select(
        *others,
        "kind",
        field("start", _START, 1).alias("task"),
        field("start", _START, 2).alias("env"),
        field("start", _START, 3).alias("model"),
        F.coalesce(field("step", _STEP, 1, "int"), field("end", _END, 2, "int")).alias("step"),
        field("step", _STEP, 2).alias("action"),
        field("step", _STEP, 3, "double").alias("reward"),
        field("step", _STEP, 4, "boolean").alias("done"),
        F.when(error != "null", error).alias("error"),
        field("end", _END, 1, "boolean").alias("success"),
        field("end", _END, 3, "double").alias("score"),
        F.transform(rewards, lambda r: r.cast("double")).alias("rewards"),
    )


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path)
    return parse_run_log(files.select(F.col("_metadata.file_path").alias("path"), "value"))
