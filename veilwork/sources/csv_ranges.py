"""CSV rows of files of any size, with line ends inside quoted cells, read in byte ranges.

Where a line begins, a reader is either at the start of a row or inside a quoted cell, so a line is a function of
these two states, and so is a block of lines.  A quote only opens a cell at its beginning and is a plain
character elsewhere, as in Python's ``csv``.  Rows end at ``\\n`` or ``\\r\\n``; empty lines between rows are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .ranges import by_block, fragments, joined_parts, with_state

_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_CELL = rf'"{_INSIDE}"[^,]*+|[^",][^,]*+'
# from the start of a row, and from inside a quoted cell, to inside a quoted cell
_OPENS = re.compile(rf'(?:(?:{_CELL}|),)*+"{_INSIDE}\Z')
_STAYS = re.compile(rf'{_INSIDE}(?:"[^,]*+(?:,(?:{_CELL}|(?=,|\Z)))*+,"{_INSIDE})?+\Z')


def _turns(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines with quotes, and whether each leads into a quoted cell from outside and from inside."""
    at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    texts = lines.take(pa.array(at)).to_pylist()
    return at, np.array([_OPENS.match(t) is not None for t in texts], bool), np.array([_STAYS.match(t) is not None for t in texts], bool)


def _states(n: int, turns: tuple[np.ndarray, np.ndarray, np.ndarray], inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside a quoted cell, and whether the next one does."""
    out = np.zeros(n, bool)
    begin = 0
    for at, opens, stays in zip(*(t.tolist() for t in turns), strict=True):
        out[begin : at + 1] = inside
        inside, begin = (stays if inside else opens), at + 1
    out[begin:] = inside
    return out, inside


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.is_in(lines, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


def _text(batch: pa.RecordBatch) -> pa.Array:
    """The lines as text; bytes that are none are read as replacement characters."""
    column = batch["value"].cast(pa.binary())
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in column.to_pylist()], pa.string())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: the state at its end and the rows that begin in it, for either state at its start."""
    place, ends, rows = None, [False, True], [0, 0]

    def row() -> pa.RecordBatch:
        names = ["path", "block", "end_out", "end_in", "n_out", "n_in"]
        return pa.RecordBatch.from_pylist([dict(zip(names, (*place, int(ends[0]), int(ends[1]), *rows), strict=True))], _SUMMARY)

    for path, block, batch in by_block(batches):
        if (path, block) != place:
            if place is not None:
                yield row()
            place, ends, rows = (path, block), [False, True], [0, 0]
        lines = _text(batch)
        turns, blank = _turns(lines), _blank(lines)
        for k in (0, 1):
            inside, ends[k] = _states(len(lines), turns, ends[k])
            rows[k] += int((~inside & ~blank).sum())
    if place is not None:
        yield row()


_SUMMARY = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("block", "end_out", "end_in", "n_out", "n_in"))])
_SUMMARY_SQL = "path string, block long, end_out long, end_in long, n_out long, n_in long"


def _block_states(summaries: DataFrame) -> DataFrame:
    """(path, block, state, first): where each block begins, 1 inside a quoted cell, and the rows before it.

    A block either leads to one state whatever came before, or swaps the two, or leaves them.  So its start is
    what the last block of the first kind led to, swapped as often as blocks of the second kind came since.
    """
    fixed, swaps = F.col("end_out") == F.col("end_in"), (F.col("end_out") > F.col("end_in")).cast("long")
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    since = W.partitionBy("path", "era").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    eras = summaries.withColumns({
        "era": F.coalesce(F.sum(fixed.cast("long")).over(before), zero),
        "led": F.coalesce(F.last(F.when(fixed, F.col("end_out")), ignorenulls=True).over(before), zero),
    })
    states = eras.withColumn("state", (F.col("led") + F.coalesce(F.sum(swaps).over(since), zero)) % 2)
    # the first row of a file is its header; a row per block meets in one place here
    n = F.when(F.col("state") == 0, F.col("n_out")).otherwise(F.col("n_in")) - F.when(F.col("block") == 0, 1).otherwise(0)
    earlier = W.orderBy("path", "block").rowsBetween(W.unboundedPreceding, -1)
    return states.withColumn("first", F.coalesce(F.sum(F.greatest(n, zero)).over(earlier), zero)).select("path", "block", "state", "first")


_PARTS = "path string, block long, first long, seq long, begins boolean, ends boolean, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block, whole ones and parts; a row is open until its last line has come."""
    place, first, inside, seq, held, begun = None, 0, False, 0, [], False

    def made(items: list[tuple[int, bool, bool, str]]) -> pa.RecordBatch:
        n = len(items)
        columns = [
            pa.array([place[0]] * n, pa.string()), pa.array([place[1]] * n, pa.int64()), pa.array([first] * n, pa.int64()),
            pa.array([i[0] for i in items], pa.int64()), pa.array([i[1] for i in items], pa.bool_()),
            pa.array([i[2] for i in items], pa.bool_()), pa.array([i[3] for i in items], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["path", "block", "first", "seq", "begins", "ends", "text"])

    for path, block, batch in by_block(batches):
        if (path, block) != place:
            if held:
                yield made([(seq - 1, begun, False, "\n".join(held))])
            place, first, inside = (path, block), batch["first"][0].as_py(), bool(batch["state"][0].as_py())
            seq, held, begun = 0, [], False
        lines = _text(batch)
        states, after = _states(len(lines), _turns(lines), inside)
        goes_on = np.append(states[1:], after)  # whether the next line is inside the same row
        blank = _blank(lines)
        out = []
        for line, within, more, empty in zip(lines.to_pylist(), states.tolist(), goes_on.tolist(), blank.tolist(), strict=True):
            if not within:
                if empty:
                    continue
                begun, seq = True, seq + 1
            if more or held:
                held.append(line)
                if more:
                    continue
                line, held = "\n".join(held), []
            out.append((seq - 1, begun, True, line))
            begun = False
        inside = after
        if out:
            yield made(out)
    if held:
        yield made([(seq - 1, begun, False, "\n".join(held))])


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_index, text): each row of CSV files as it stands in the file, without the header rows.

    ``row_index`` counts the rows of all files from 0, in order of path and place.
    """
    lines = fragments(spark, path, "\n")
    states = stored(_block_states(lines.mapInArrow(_summaries, _SUMMARY_SQL)), "csv-blocks")
    parts = with_state(lines, states).select("path", "block", "value", "state", "first").mapInArrow(_cut, _PARTS)
    rows = joined_parts(parts, "\n", ["first"]).filter("not (block = 0 and seq = 0)")
    index = F.col("first") + F.col("seq") - F.when(F.col("block") == 0, 1).otherwise(0)
    text = F.regexp_replace("text", "\r$", "")
    return rows.select("path", index.cast("long").alias("row_index"), text.alias("text"))
