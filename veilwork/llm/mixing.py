"""Mixing sources to target weights by soft domain membership.

A classifier fitted on the labels table gives every document a posterior over domains.  Rates
r >= 0 for the documents are then fitted so that the expected tokens of each domain,
sum(rate * tokens * posterior), match the targets.

* Domains: ``good`` (quality 1, not toxic), ``poor`` (quality 0, not toxic), ``toxic``.
* Classifier: naive Bayes over hashed words, its log likelihoods divided by the word count and
  scaled by ``SHARPNESS``; fitted on at most ``MAX_LABELLED`` labelled documents, those with the
  smallest hash of their id (their ids and classes are broadcast, 2.6 MB at most).
* Fit: projected gradient on the least squares 1/2 (A r - t)' G^-1 (A r - t), where A holds
  tokens * posterior and G = sum(tokens * posterior posterior').  Rates are scaled by the root of
  the tokens, so that equal posteriors get equal rates; in that metric the step 1 is safe and
  convergence does not hang on how rare a domain is.  Rates start at the one uniform rate that
  gives the budget.  A step needs only the domain totals, one small aggregate over a compact
  table; a document's rate follows from the few totals so far, so no rate is stored between steps.

* A fit that has stalled or not converged after ``MAX_STEPS``, as near the largest budget, goes on with
  Newton steps on the dual: rates are then the start plus one combination of the posteriors, clipped.

The budget is ``NEAR`` of the largest at which all weights can be met at once, found on a histogram of
posteriors (at most 33,000 cells with their exact sums).  Weights are out of reach when that is below
``LEAST`` of all tokens: then the budget is ``FILL`` of all tokens, a domain gets at most ``MOST`` of what
it has, and what it can't give goes to the other domains by weight.  The plan holds what was asked,
what was possible and what was reached, and a warning says when the weights are not met.

Null text counts as empty: no tokens, rate 0, prior posteriors.  A null doc_id is scored and never
trained on; ``sample`` treats it as an id of its own.  Equal rows get equal posteriors and rates.
A domain without tokens has target 0.  An empty table gives an empty result.  ``sample``
passes all columns through; names that start with ``_mix_`` are reserved.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import pieces

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.9, "poor": 0.06, "toxic": 0.04}
MAX_LABELLED = 200_000
BITS = 15
SMOOTHING = 1.0
SHARPNESS = 12.0
MAX_STEPS = 30
TOLERANCE = 1e-4
FILL = 0.85
MOST = 0.95
NEAR = 0.99
LEAST = 0.01
NEWTON_STEPS = 60
_CELLS = 256
_BOUND = 1000.0


def _word_counts(batches: Iterator[pa.RecordBatch], labelled) -> Iterator[pa.RecordBatch]:
    ids, classes = labelled.value
    counts = np.zeros((len(DOMAINS), 1 << BITS), np.int64)
    for batch in batches:
        own = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
        known = (ids[at] == own) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(own), bool)
        domain = np.where(known, classes[at] if len(ids) else 0, -1)
        for piece in pieces(batch.column("text")):
            of_word = domain[piece.rows][piece.text_of_word()]
            bucket = (piece.hashes(piece.starts, piece.ends) >> np.uint64(64 - BITS)).astype(np.int64)
            for k in range(len(DOMAINS)):
                counts[k] += np.bincount(bucket[of_word == k], minlength=1 << BITS)
    domain, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(domain), pa.array(bucket), pa.array(counts[domain, bucket])], names=["domain", "bucket", "words"])


def fit_classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each word bucket by domain, log priors)."""
    spark = docs.sparkSession
    kind = F.when(F.coalesce("toxic", F.lit(0)) == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    rows = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("domain"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_labelled).collect()
    chosen = dict(map(tuple, picked))
    ids = np.array(sorted(chosen), np.int64)
    classes = np.array([chosen[i] for i in ids.tolist()], np.int64)
    labelled = spark.sparkContext.broadcast((ids, classes))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = base.mapInArrow(lambda it: _word_counts(it, labelled), "domain long, bucket long, words long")
    table = sums.groupBy("domain", "bucket").agg(F.sum("words").alias("words")).toPandas()
    counts = np.full((len(DOMAINS), 1 << BITS), SMOOTHING)
    counts[table.domain, table.bucket] += table.words
    priors = np.bincount(classes, minlength=len(DOMAINS)) + 1.0
    return np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(priors / priors.sum())


_MEMBERSHIP = "struct<n_tokens: bigint, " + ", ".join(f"p_{d}: double" for d in DOMAINS) + ">"


def membership(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The documents with a struct ``_mix_member`` of n_tokens (words) and the domain posteriors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> pa.Array:
        logs, priors = shared.value
        tokens, chances = [np.zeros(0, np.int64)], [np.zeros((0, len(DOMAINS)))]
        for piece in pieces(texts):
            bucket = (piece.hashes(piece.starts, piece.ends) >> np.uint64(64 - BITS)).astype(np.int64)
            text, n = piece.text_of_word(), np.diff(piece.first)
            mean = np.stack([np.bincount(text, weights=row[bucket], minlength=len(piece)) for row in logs], axis=1) / np.maximum(n, 1)[:, None]
            raw = priors + SHARPNESS * mean
            weight = np.exp(raw - raw.max(axis=1, keepdims=True))
            tokens.append(n)
            chances.append(weight / weight.sum(axis=1, keepdims=True))
        p = np.concatenate(chances)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(tokens)), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], names=["n_tokens", *(f"p_{d}" for d in DOMAINS)])

    member = F.arrow_udf(of, _MEMBERSHIP)
    return docs.withColumn("_mix_member", member(F.col("text").cast("string")))


def _rates(p: np.ndarray, start: float, pulls: list[np.ndarray], max_rate: float) -> np.ndarray:
    """The rates after the steps whose pulls, G^-1 (A r - t), are given."""
    rate = np.full(len(p), start)
    for pull in pulls:
        rate = np.clip(rate - p @ pull, 0.0, max_rate)
    return rate


@dataclass
class Plan:
    """The fitted mixture: the steps' pulls define every document's rate.

    ``asked`` are the weights as shares, ``have`` each domain's tokens at ``max_rate``, ``possible`` the
    largest total at which all weights can be met, ``totals`` what the rates reach.
    """

    start: float
    pulls: list[np.ndarray]
    max_rate: float
    targets: np.ndarray
    totals: np.ndarray
    asked: np.ndarray
    have: np.ndarray
    possible: float = 0.0

    @property
    def converged(self) -> bool:
        return bool(np.abs(self.totals - self.targets).max() <= TOLERANCE * self.targets.sum())

    @property
    def met(self) -> bool:
        """Whether the shares reached are the weights."""
        total = self.totals.sum()
        return bool(total > 0 and np.abs(self.totals / total - self.asked).max() <= 2 * TOLERANCE)

    def rate(self, member: str = "_mix_member") -> Column:
        """The rate of a row as a column."""
        start, pulls, most = self.start, list(self.pulls), self.max_rate

        def of(rows: pa.Array) -> pa.Array:
            fields = [f.to_numpy(zero_copy_only=False) for f in rows.flatten()]
            rate = _rates(np.stack(fields[1:], axis=1), start, pulls, most)
            return pa.array(np.round(np.where(fields[0] > 0, rate, 0.0), 9))

        return F.arrow_udf(of, "double")(F.col(member))


def _targets(have: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The budget dealt by weight, no domain above ``MOST`` of what it has."""
    out, full = np.zeros(len(have)), goal <= 0
    for _ in have:
        if full.all():
            break
        left = FILL * have.sum() - out[full].sum()
        out[~full] = left * goal[~full] / goal[~full].sum()
        over = ~full & (out > MOST * have)
        out[over] = MOST * have[over]
        full |= over
    return out


def _largest(cells: np.ndarray, share: np.ndarray) -> float:
    """The largest b such that rates from 0 to 1 give totals of b * share; ``cells`` has tokens by domain.

    By duality this is the least of sum(max(0, cells @ x)) over x with x @ share = 1, which is convex.
    """
    asked = share > 0
    scale = np.where(asked, 1.0 / np.where(asked, share, 1.0), 1.0)
    base = int(np.argmax(share))
    free = [d for d in range(len(share)) if d != base]

    def at(point: np.ndarray) -> float:
        x = np.zeros(len(share))
        x[free] = point
        x[base] = 1.0 - sum(x[d] for d in free if asked[d])
        return float(np.maximum(cells @ (x * scale), 0.0).sum())

    starts = [np.zeros(len(free))] + [np.eye(len(free))[i] for i, d in enumerate(free) if asked[d]]
    best, place = min((at(x), tuple(x)) for x in starts)
    width = 1.0
    for _ in range(300):
        if width < 1e-6:
            break
        steps = [np.clip(np.array(place) + width * np.array(d), -_BOUND, _BOUND) for d in product((-1.0, -0.5, 0.0, 0.5, 1.0), repeat=len(free))]
        found, there = min((at(x), tuple(x)) for x in steps)
        moved = found < best * (1 - 1e-9)
        best, place = (found, there) if moved else (best, place)
        width *= 1.5 if moved else 0.5
    return best


def _newton(members: DataFrame, plan: Plan, names: list[str], n: Column) -> Plan:
    """The plan whose rates are the start plus a combination of posteriors, clipped, that meets the targets."""
    k = len(names)

    def look(points: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        columns = []
        for x in points:
            raw = F.lit(plan.start) + sum(F.lit(float(v)) * F.col(c) for v, c in zip(x, names, strict=True))
            rate = F.least(F.greatest(raw, F.lit(0.0)), F.lit(plan.max_rate))
            inner = F.when((raw > 0) & (raw < plan.max_rate), n).otherwise(0.0)
            columns += [n * (rate * raw - rate * rate / 2), *[n * rate * F.col(c) for c in names], *[inner * F.col(a) * F.col(b) for a in names for b in names]]
        got = np.array([float(v or 0.0) for v in members.agg(*[F.sum(c) for c in columns]).first()]).reshape(len(points), -1)
        return [(row[0] - float(plan.targets @ x), row[1 : k + 1], row[k + 1 :].reshape(k, k)) for x, row in zip(points, got, strict=True)]

    at = np.zeros(k)
    (value, totals, bend), = look([at])
    ridge = 1e-3 * plan.have.sum()
    for _ in range(NEWTON_STEPS):
        off = totals - plan.targets
        if np.abs(off).max() <= TOLERANCE * plan.targets.sum():
            break
        tries = [at - np.linalg.solve(bend + r * np.eye(k), off) for r in (ridge * 1e-3, ridge * 0.1, ridge, ridge * 10, ridge * 1e3)]
        seen = look(tries)
        i = min(range(len(tries)), key=lambda j: seen[j][0])
        if seen[i][0] >= value and np.abs(seen[i][1] - plan.targets).max() >= np.abs(off).max():
            ridge *= 100
            continue
        at, (value, totals, bend) = tries[i], seen[i]
        ridge = float(np.clip(ridge * (1e-3, 0.1, 1, 10, 1e3)[i], 1e-12 * plan.have.sum(), 1e6 * plan.have.sum()))
    return Plan(plan.start, [-at], plan.max_rate, plan.targets, totals, plan.asked, plan.have, plan.possible)


def fit_rates(members: DataFrame, weights: dict[str, float] | None = None, max_rate: float = 1.0) -> Plan:
    """Fit rates on a table with the struct ``_mix_member``."""
    weights = WEIGHTS if weights is None else weights
    k = len(DOMAINS)
    goal = np.array([float(weights.get(d, 0.0)) for d in DOMAINS])
    asked = goal / goal.sum() if goal.sum() else goal.copy()
    names = [f"_mix_member.p_{d}" for d in DOMAINS]
    n = F.col("_mix_member.n_tokens").cast("double")

    def sums(*columns: Column) -> np.ndarray:
        return np.array([float(x or 0.0) for x in members_rated.agg(*[F.sum(c) for c in columns]).first()])

    members_rated = members
    row = sums(*[n * F.col(c) for c in names], *[n * F.col(a) * F.col(b) for a in names for b in names])
    have, gram = row[:k], row[k:].reshape(k, k)
    goal[have <= 0] = 0.0
    if not goal.sum():
        return Plan(0.0, [], max_rate, np.zeros(k), np.zeros(k), asked, have * max_rate)
    cell = [F.floor(F.sqrt(F.col(c)) * _CELLS) for c in names[1:]]
    cells = members.groupBy(*[c.alias(f"cell{i}") for i, c in enumerate(cell)]).agg(*[F.sum(n * F.col(c)).alias(f"sum{i}") for i, c in enumerate(names)])
    cells = np.array([[float(v or 0.0) for v in r] for r in cells.select(*[f"sum{i}" for i in range(k)]).collect()])
    possible = _largest(cells * max_rate, asked)
    reachable = possible >= LEAST * max_rate * have.sum()
    targets = NEAR * possible * asked if reachable else _targets(have * max_rate, goal)
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    plan = Plan(min(max_rate, targets.sum() / have.sum()), [], max_rate, targets, np.zeros(k), asked, have * max_rate, possible)
    last: list[float] = []
    for step in range(MAX_STEPS + 1):
        members_rated = members.withColumn("_mix_rate", plan.rate())
        plan.totals = sums(*[F.col("_mix_rate") * n * F.col(c) for c in names])
        off = plan.totals - targets
        last.append(float(np.abs(off).max()))
        if plan.converged or len(last) > 4 and last[-1] > last[-4] / 2:
            break
        if step < MAX_STEPS:
            plan.pulls.append(inverse @ off)
    if reachable and not plan.converged:
        closer = _newton(members, plan, names, n)
        plan = closer if np.abs(closer.totals - targets).max() < np.abs(off).max() else plan
    if not plan.met:
        told = ", ".join(f"{d}: asked {a:.4f}, available {h:.0f}, reached {t:.0f} tokens" for d, a, h, t in zip(DOMAINS, asked, have * max_rate, plan.totals, strict=True))
        warnings.warn(f"the mixing weights are not met; at most {possible:.0f} tokens can meet them ({told})", stacklevel=2)
    return plan


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, max_rate: float = 1.0) -> tuple[DataFrame, Plan]:
    """(doc_id, n_tokens, posteriors, rate for each document; the plan)."""
    members = written(membership(docs, fit_classifier(docs, labels)).select("doc_id", "_mix_member"), "members")
    plan = fit_rates(members, weights, max_rate)
    return members.select("doc_id", "_mix_member.*", plan.rate().alias("rate")), plan


def sample(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents drawn at their rates, each at most once, with all columns.

    A document stays when a hash of its id, as a number in [0, 1), is below its rate.
    """
    model = fit_classifier(docs, labels)
    scored = membership(docs, model)
    plan = fit_rates(written(scored.select("_mix_member"), "members"), weights, 1.0)
    draw = F.pmod(F.xxhash64(F.lit(20240607), "doc_id"), F.lit(1 << 52)) / float(1 << 52)
    return scored.withColumn("_mix_rate", plan.rate()).filter(draw < F.col("_mix_rate")).drop("_mix_member", "_mix_rate")
