"""Transcript parsing: a hidden Markov model recovers the speakers, then turns are rendered.

A transcript is a run of lines, some opened by a speaker marker ("User:", "AI:", ...), many not.
States are role x (first line of a turn, later line).  A line's observation is its marker, its
length band, and whether it ends in a question mark.  Start, transition and observation
probabilities are counted over lines of known roles; Viterbi then finds the best states of a
transcript, and every first-line state opens a canonical turn.

A transcript may hold any share of all lines: it is cut into chunks of ``CHUNK`` turns of input.  A
chunk's best scores between its entry and its end state form a matrix; the matrices of a
transcript are combined in order (max-plus), which fixes each chunk's entry and end state, and all
chunks are decoded apart.  Only these matrices, some 400 bytes a chunk, come together by transcript.

Null text is one empty line, null turn sorts first, rows without conv_id are left out.  An unknown or
null role trains nothing.  Rows of one (conv_id, turn) are ordered by a hash of role and text; equal
rows are all kept, one after the other.  An empty table gives an empty result; other columns are ignored.  Ties between paths go
to the smaller state number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

ROLES = ("system", "user", "assistant")
CHUNK = 32
SMOOTHING = 0.5
#: What a marker says about its speaker.
MARKERS = {"system": "system|instructions?", "user": "user|human|q", "assistant": "assistant|ai|bot|a"}
_LENGTHS = (0, 40, 120, 400)
N_MARKS = len(ROLES) + 1
N_SYMBOLS = N_MARKS * (len(_LENGTHS) + 1) * 2
STATES = 2 * len(ROLES)  # 2 * role for a first line, 2 * role + 1 for a later one
BEGIN = STATES


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcript lines of role-labelled turns: conv_id, turn, copy, pos, line, gold, opens.

    A hash of the conversation picks the style of its markers; of each four turns about one has none.
    """
    styles = [["System: ", "User: ", "Assistant: "], ["Instructions: ", "Human: ", "AI: "], ["SYSTEM> ", "Q> ", "A> "]]
    role = sum((F.when(F.col("role") == r, F.lit(i)).otherwise(F.lit(0)) for i, r in enumerate(ROLES)), F.lit(0))
    known = F.col("role").isin(*ROLES)
    mark = F.element_at(F.element_at(F.array(*[F.array(*[F.lit(m) for m in s]) for s in styles]), F.pmod(F.xxhash64("conv_id"), F.lit(len(styles))).cast("int") + 1), role + 1)
    shown = F.when(known & (F.pmod(F.xxhash64("conv_id", "turn", F.lit(3)), F.lit(4)) > 0), mark).otherwise("")
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", F.when(known, role).alias("gold"), F.concat(shown, F.coalesce("text", F.lit(""))).alias("text"))
    # the order of rows that share a turn; equal rows are counted before they move, then numbered
    same = rows.groupBy("conv_id", "turn", "gold", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = same.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rows = rows.withColumn("copy", F.struct(F.xxhash64("gold", "text").alias("h"), "nth"))
    split = rows.select("conv_id", "turn", "copy", "gold", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.withColumn("opens", F.col("pos") == 0)


def observed(lines: DataFrame) -> DataFrame:
    """The lines with their observation number ``symbol`` and their text without marker, ``said``."""
    mark = F.lit(0)
    for i, r in enumerate(ROLES):
        mark = F.when(F.col("line").rlike(rf"(?i)^({MARKERS[r]})\s?[:>]"), i + 1).otherwise(mark)
    size = F.length("line")
    band = sum((F.when(size > n, 1).otherwise(0) for n in _LENGTHS), F.lit(0))
    asks = F.col("line").rlike(r"\?\s*$").cast("int")
    symbol = (mark * (len(_LENGTHS) + 1) + band) * 2 + asks
    said = F.when(mark > 0, F.regexp_replace("line", r"^[A-Za-z]+\s?[:>]\s?", "")).otherwise(F.col("line"))
    return lines.withColumns({"symbol": symbol.cast("int"), "said": said})


class Model:
    """Log probabilities: start of a transcript, state to state, state to observation."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        def logs(counts: np.ndarray, allowed) -> np.ndarray:
            counts = np.where(allowed, counts + SMOOTHING, 0.0)
            with np.errstate(divide="ignore"):
                return np.log(counts / counts.sum(axis=-1, keepdims=True))

        first = np.zeros(STATES, bool)
        first[::2] = True
        own = np.eye(len(ROLES), dtype=bool).repeat(2, axis=0).repeat(2, axis=1)
        allowed = first[None, :] | (own & ~first[None, :])  # a later line keeps its role
        self.step = np.full((STATES + 1, STATES), -np.inf)
        self.step[:STATES] = logs(step, allowed)
        self.step[BEGIN] = logs(start, first)
        self.emit = logs(emit, True)

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        """Best log probability from each entry state (rows; the last is the begin) to each end state."""
        best = self.step + self.emit[:, symbols[0]]
        for s in symbols[1:]:
            best = (best[:, :, None] + self.step[None, :STATES]).max(axis=1) + self.emit[:, s]
        return best

    def path(self, symbols: np.ndarray, entry: int, end: int) -> np.ndarray:
        """The best states between a given entry state and a given end state."""
        best = self.step[entry] + self.emit[:, symbols[0]]
        back = np.zeros((len(symbols), STATES), np.int64)
        for i, s in enumerate(symbols[1:], 1):
            through = best[:, None] + self.step[:STATES]
            back[i] = through.argmax(axis=0)
            best = through.max(axis=0) + self.emit[:, s]
        out = np.empty(len(symbols), np.int64)
        state = end
        for i in range(len(symbols) - 1, -1, -1):
            out[i] = state
            state = back[i, state]
        return out


def _ordered(lines: DataFrame) -> DataFrame:
    return lines.withColumn("chunk", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / CHUNK))


def fit(lines: DataFrame) -> Model:
    """Count a model over lines with ``gold`` and ``opens``; only tables of the model's size are read."""
    state = (F.col("gold") * 2 + F.when(F.col("opens"), 0).otherwise(1)).cast("int")
    rows = observed(lines).filter("gold is not null").select("conv_id", "turn", "copy", "pos", "opens", "symbol", state.alias("state"))
    emit = np.zeros((STATES, N_SYMBOLS))
    for r in rows.groupBy("state", "symbol").agg(F.count(F.lit(1)).alias("c")).collect():
        emit[r["state"], r["symbol"]] = r["c"]
    # steps inside a turn follow from its line count; steps between turns join a turn to the one before
    turns = rows.groupBy("conv_id", "turn", "copy").agg(F.count(F.lit(1)).alias("n"), F.min("state").alias("first"))
    turns = written(turns, "turns")
    step = np.zeros((STATES, STATES))
    for r in turns.groupBy("first").agg(F.count_if(F.col("n") > 1).alias("two"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("more")).collect():
        step[r["first"], r["first"] + 1] = r["two"]
        step[r["first"] + 1, r["first"] + 1] = r["more"]
    last = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), (F.col("first") + F.when(F.col("n") > 1, 1).otherwise(0)).alias("before"))
    for r in turns.join(last, ["conv_id", "turn"]).groupBy("before", "first").agg(F.count(F.lit(1)).alias("c")).collect():
        step[r["before"], r["first"]] += r["c"]
    start = np.zeros(STATES)
    for r in turns.filter("turn = 0").groupBy("first").agg(F.count(F.lit(1)).alias("c")).collect():
        start[r["first"]] = r["c"]
    return Model(start, step, emit)


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """The lines with the recovered ``role`` and ``begins`` (whether the line opens a turn)."""
    rows = _ordered(observed(lines))
    order = F.array_sort(F.collect_list(F.struct("turn", "copy", "pos", "symbol")))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.transform(order, lambda r: r["symbol"]).alias("symbols"))

    @F.arrow_udf("array<double>")
    def scores(symbols: pa.Array) -> pa.Array:
        return pa.array([model.scores(np.array(s)).ravel().tolist() for s in symbols.to_pylist()], pa.list_(pa.float64()))

    chunks = written(chunks.withColumn("scores", scores("symbols")), "chunks")

    @F.arrow_udf("array<struct<chunk: bigint, entry: int, last: int>>")
    def borders(rows: pa.Array) -> pa.Array:
        return pa.array([_borders(r) for r in rows.to_pylist()])

    per = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "scores"))).alias("all"))
    fixed = written(per.select("conv_id", F.inline(borders("all"))), "borders")

    @F.arrow_udf("array<int>")
    def states(symbols: pa.Array, entry: pa.Array, last: pa.Array) -> pa.Array:
        return pa.array([model.path(np.array(s), a, b).tolist() for s, a, b in zip(symbols.to_pylist(), entry.to_pylist(), last.to_pylist(), strict=True)], pa.list_(pa.int32()))

    decoded = chunks.join(fixed, ["conv_id", "chunk"]).select("conv_id", "chunk", F.posexplode(states("symbols", "entry", "last")).alias("place", "state"))
    place = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "copy", "pos", "symbol")) - 1
    named = rows.withColumn("place", place).join(decoded, ["conv_id", "chunk", "place"])
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.floor(F.col("state") / 2).cast("int") + 1)
    return named.withColumns({"role": role, "begins": F.col("state") % 2 == 0}).drop("state", "symbol")


def _borders(rows: list[dict]) -> list[dict]:
    """Entry and end state of each chunk of one transcript, from the chunks' score matrices in order."""
    tables = [np.array(r["scores"]).reshape(STATES + 1, STATES) for r in rows]
    best = np.full(STATES + 1, -np.inf)
    best[BEGIN] = 0.0
    choice = []
    for t in tables:
        through = best[:, None] + t
        choice.append(through.argmax(axis=0))
        best = np.append(through.max(axis=0), -np.inf)
    last = int(best.argmax())
    out = []
    for r, pick in zip(reversed(rows), reversed(choice), strict=True):
        entry = int(pick[last])
        out.append({"chunk": r["chunk"], "entry": entry, "last": last})
        last = entry
    return out[::-1]


def render(parsed: DataFrame) -> DataFrame:
    """conv_id, turn_no, role, text: the canonical turns; text is "<|role|>\\n...lines...<|end|>"."""
    parsed = written(parsed.select("conv_id", "chunk", "place", "role", "begins", "said"), "parsed")
    counts = parsed.groupBy("conv_id", "chunk").agg(F.count_if("begins").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "offsets")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parsed.withColumn("own", F.sum(F.col("begins").cast("long")).over(inside)).join(offsets, ["conv_id", "chunk"])
    numbered = numbered.withColumn("turn_no", F.col("offset") + F.col("own") - 1)
    lines = F.array_sort(F.collect_list(F.struct("chunk", "place", "said")))
    turns = numbered.groupBy("conv_id", "turn_no").agg(F.first("role").alias("role"), F.transform(lines, lambda r: r["said"]).alias("lines"), F.count(F.lit(1)).alias("n_lines"))
    text = F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.array_join("lines", "\n"), F.lit("<|end|>"))
    return turns.select("conv_id", "turn_no", "role", "n_lines", text.alias("text"))
