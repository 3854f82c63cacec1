"""Alignment of two tokenizers' tokens over the same bytes, by lockstep vectorised merging.

Each text is encoded by A (a byte-level vocabulary, with one space in front) and by B (a piece model, which
puts the space in front itself), without special tokens.  Where the tokens of both join to exactly these
bytes, all ends of tokens are places on one byte axis, and all documents of a batch are merged at once:
one state vector holds, for each lane, the current A token, the current B token and the byte where their
overlap begins.  A step emits a link for each lane, emits a cut where both tokens end, and moves whichever
token ends first (both at a cut); finished lanes are compacted away.  Lanes are stretches of at most ``LANE``
bytes of a document, so that long documents neither add steps nor leave a thin vector.

How many documents hold a linked id pair is counted over all rows: batches of about ``BATCH`` bytes write
their documents (with the pairs they hold, as places in the batch's list of distinct pairs) and this list;
the lists are counted by Spark, joined with the counts and led back to the batch, where the sums of
each document are formed.  The pairs that each A id holds most often need one small row per A id.

A is the tokenizers library; texts whose characters all libraries class alike go through the several times faster
merges of tiktoken with the same vocabulary, where the tokenizer's file shows that both do the same.

Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens and
zeros.  Repeated rows count as so many documents; a null doc_id stays; other columns are not looked at; an empty
table gives an empty one.  Whole texts are taken, however long; one text is never split over batches.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

LANE = 512
BATCH = 4 << 20
SLICE = 1 << 18
MARK = "▁"
# Fixed value: the pattern by which byte-level tokenizers split a text before they merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Letters, digits, spaces and punctuation here are the same in all versions of Unicode that libraries carry.
STEADY = re.compile("[\\0-\u024f\u2010-\u2027]*")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves,
    the others, in order, for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Merged:
    """A batch after merging.  Tokens, links and cuts of all texts stand one after the other."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_first: np.ndarray  # a text's first A token; one more than texts
    b_first: np.ndarray
    cuts: np.ndarray  # places on the joint byte axis, ascending
    cut_first: np.ndarray
    link_a: np.ndarray  # index of the A token of each link, ordered by place
    link_b: np.ndarray
    link_first: np.ndarray
    base: np.ndarray  # where each text begins on the byte axis


def merge(a_ends: np.ndarray, b_ends: np.ndarray, base: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlapping token pairs (index in A, index in B), ordered by place, and the cuts.

    Ends ascend over all texts together; text k takes the bytes from ``base[k]`` to ``base[k + 1]``.
    """
    counts = -(-np.diff(base) // lane)
    text = np.repeat(np.arange(len(counts)), counts)
    start = base[:-1][text] + lane * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    stop = np.minimum(start + lane, base[1:][text])
    a, b = np.searchsorted(a_ends, start, "right"), np.searchsorted(b_ends, start, "right")
    at = np.maximum(np.concatenate(([0], a_ends))[a], np.concatenate(([0], b_ends))[b])  # where the overlap begins
    own = at >= start  # else it belongs to the lane before
    out_a, out_b, out_at, cuts = [], [], [], []
    while len(a):
        out_a.append(a[own])
        out_b.append(b[own])
        out_at.append(at[own])
        end_a, end_b = a_ends[a], b_ends[b]
        at = np.minimum(end_a, end_b)
        cuts.append(at[own & (end_a == end_b)])
        a, b = a + (end_a == at), b + (end_b == at)
        own = at >= start
        live = at < stop
        if not live.all():
            a, b, at, start, stop, own = a[live], b[live], at[live], start[live], stop[live], own[live]
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(np.concatenate(out_at))
    return np.concatenate(out_a)[order], np.concatenate(out_b)[order], np.sort(np.concatenate(cuts))


def plain_merges(spec: dict, alphabet: dict[str, int]) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if the file describes nothing but merges in the order of their ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if spec.get("normalizer") or any(split.get(k) != v for k, v in known.items()) or model.get("type", "BPE") != "BPE":
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    added = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [ranks.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
    first = len(ranks) - len(merged)
    singles = {t for t, i in ranks.items() if i < first}
    if merged != list(range(first, len(ranks))) or singles != set(alphabet):
        return None
    return {bytes(alphabet[c] for c in t): i for t, i in ranks.items()}


class Pair:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, json_content: str, model_content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(json_content)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_content)
        alphabet = byte_alphabet()
        ranks = plain_merges(json.loads(json_content), alphabet)
        self.quick = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        width = len(str(most)) + 1
        # each id as decimal text with what follows it: a token of its own kind, or the next kind
        self.shown = np.array([f"{i}{sign}" for sign in ",|;" for i in range(most)], f"S{width}")
        self.most = most

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        steady = [self.quick is not None and STEADY.fullmatch(t) is not None for t in texts]
        rest = self.a.encode_batch_fast([t for t, quick in zip(texts, steady, strict=True) if not quick], add_special_tokens=False)
        others = iter(rest)
        return [self.quick.encode_ordinary(t) if quick else next(others).ids for t, quick in zip(texts, steady, strict=True)]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers; empty where the bytes do not come back from both."""
        a_ids = [np.zeros(0, np.int32)] * len(texts)
        b_ids = list(a_ids)
        asked = [k for k, t in enumerate(texts) if t]
        at = 0
        while at < len(asked):  # a few texts at a time, as the library's own results are large
            now, held = [], 0
            while at < len(asked) and held < SLICE:
                now.append(asked[at])
                held += len(texts[asked[at]])
                at += 1
            found_a = self.encode_a([" " + texts[k] for k in now])
            found_b = self.b.encode([texts[k] for k in now], num_threads=1)
            for k, a, b in zip(now, found_a, found_b, strict=True):
                content = b" " + texts[k].encode()
                if b"".join(map(self.a_bytes.__getitem__, a)) == content and b"".join(map(self.b_bytes.__getitem__, b)) == content:
                    a_ids[k], b_ids[k] = np.array(a, np.int32), np.array(b, np.int32)
        return a_ids, b_ids

    def align(self, texts: list[str | None]) -> Merged:
        a_lists, b_lists = self.encode(texts)
        a_first, b_first = (np.concatenate(([0], np.cumsum([len(ids) for ids in lists], dtype=np.int64))) for lists in (a_lists, b_lists))
        a_ids, b_ids = (np.concatenate([np.zeros(0, np.int32), *lists]) for lists in (a_lists, b_lists))
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        base = np.concatenate(([0], a_ends))[a_first]
        link_a, link_b, cuts = merge(a_ends, b_ends, base)
        return Merged(
            a_ids, b_ids, a_first, b_first, cuts, np.searchsorted(cuts, base, "right"),
            link_a, link_b, np.searchsorted(link_a, a_first), base,
        )

    def group_digests(self, m: Merged) -> tuple[list[str], np.ndarray]:
        """SHA-256 of each text's groups ``a1,a2|b1;a3|b2,b3`` and their number."""
        a_ends, b_ends = np.cumsum(self.a_size[m.a_ids]), np.cumsum(self.b_size[m.b_ids])
        a_group, b_group = np.searchsorted(m.cuts, a_ends), np.searchsorted(m.cuts, b_ends)  # a token up to the cut
        a_upto, b_upto = (np.cumsum(np.bincount(g, minlength=len(m.cuts))) for g in (a_group, b_group))
        codes = np.zeros(len(m.a_ids) + len(m.b_ids), np.int64)
        a_last, b_last = np.diff(a_group, append=-1) != 0, np.diff(b_group, append=-1) != 0
        # A tokens stand behind the B tokens of earlier groups, B tokens behind the A tokens of their own
        codes[np.arange(len(m.a_ids)) + np.concatenate(([0], b_upto))[a_group]] = m.a_ids + self.most * a_last
        codes[np.arange(len(m.b_ids)) + a_upto[b_group]] = m.b_ids + 2 * self.most * b_last
        first = m.a_first + m.b_first
        out = []
        for k in range(len(first) - 1):
            if first[k] == first[k + 1]:
                out.append("")
                continue
            text = self.shown[codes[first[k] : first[k + 1]]].tobytes().replace(b"\0", b"")
            out.append(hashlib.sha256(text[:-1]).hexdigest())
        return out, np.diff(m.cut_first)

    def document_pairs(self, m: Merged) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The batch's distinct linked pairs (a << 32 | b), and per text which it holds how often."""
        pairs = m.a_ids[m.link_a].astype(np.int64) << 32 | m.b_ids[m.link_b]
        distinct, place = np.unique(pairs, return_inverse=True)
        text = np.repeat(np.arange(len(m.link_first) - 1), np.diff(m.link_first))
        held, times = np.unique(text * max(len(distinct), 1) + place, return_counts=True)
        text, place = np.divmod(held, max(len(distinct), 1))
        return distinct, place, times, np.searchsorted(text, np.arange(len(m.link_first)))


_PAIRS: dict[str, Pair] = {}


def _pair(json_content: str, model_content: bytes) -> Pair:
    name = hashlib.sha256(json_content.encode() + model_content).hexdigest()
    if name not in _PAIRS:
        _PAIRS[name] = Pair(json_content, model_content)
    return _PAIRS[name]


def _packed(numbers: np.ndarray) -> bytes:
    """Small non-negative numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(content: bytes) -> np.ndarray:
    n = int.from_bytes(content[:8], "little")
    planes = pa.decompress(content[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


_OWN = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_TOKENS = "a_ids array<int>, b_ids array<int>, cuts array<long>, links array<struct<a: int, b: int>>"


def _files(docs: DataFrame, json_path: str, model_path: str):
    """Both files, some megabytes, read by the driver and broadcast."""
    with open(json_path, encoding="utf-8") as file, open(model_path, "rb") as model:
        return docs.sparkSession.sparkContext.broadcast((file.read(), model.read()))


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(doc_id, texts) of about ``BATCH`` bytes, of one text at least."""
    ids: list[pa.Array] = []
    texts: list[str | None] = []
    held = 0
    for batch in rows:
        sizes = np.diff(np.asarray(batch.column(1).cast(pa.large_string()).fill_null("").buffers()[1]).view(np.int64)[: len(batch) + 1]) if len(batch) else []
        at = 0
        for k, size in enumerate(sizes):
            held += int(size)
            if held >= BATCH:
                yield pa.concat_arrays([*ids, batch.column(0).slice(at, k + 1 - at)]), [*texts, *batch.column(1).slice(at, k + 1 - at).to_pylist()]
                ids, texts, held, at = [], [], 0, k + 1
        ids.append(batch.column(0).slice(at))
        texts += batch.column(1).slice(at).to_pylist()
    if texts:
        yield pa.concat_arrays(ids), texts


def align(docs: DataFrame, json_path: str, model_path: str, text: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, cuts, links) of each row: ids, byte offsets of the cuts in space + text, and
    the overlapping token pairs as positions in a_ids and b_ids."""
    shared = _files(docs, json_path, model_path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pair(*shared.value)
        for ids, texts in _batches(rows):
            m = own.align(texts)
            text_of_cut = np.repeat(np.arange(len(texts)), np.diff(m.cut_first))
            text_of_link = np.repeat(np.arange(len(texts)), np.diff(m.link_first))
            places = [pa.array((m.link_a - m.a_first[text_of_link]).astype(np.int32)), pa.array((m.link_b - m.b_first[text_of_link]).astype(np.int32))]
            columns = [
                ids.cast(pa.int64()),
                pa.ListArray.from_arrays(m.a_first.astype(np.int32), pa.array(m.a_ids)),
                pa.ListArray.from_arrays(m.b_first.astype(np.int32), pa.array(m.b_ids)),
                pa.ListArray.from_arrays(m.cut_first.astype(np.int32), pa.array(m.cuts - m.base[text_of_cut])),
                pa.ListArray.from_arrays(m.link_first.astype(np.int32), pa.StructArray.from_arrays(places, names=["a", "b"])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "cuts", "links"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {_TOKENS}")


def _digested(docs: DataFrame, json_path: str, model_path: str, text: str) -> DataFrame:
    """A row for each document, and for each batch one with its distinct pairs and the documents that hold them.

    A batch is known by its task and its number there; the table is written before it is used, so only one
    attempt of a task counts.
    """
    shared = _files(docs, json_path, model_path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pair(*shared.value)
        task = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(_batches(rows)):
            m = own.align(texts)
            digests, groups = own.group_digests(m)
            distinct, place, times, first = own.document_pairs(m)
            held = [_packed(np.diff(place[a:b], prepend=0)) if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]
            often = [_packed(times[a:b]) if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]
            n = len(texts)
            none = pa.nulls(1, pa.int64())
            columns = {
                "batch": pa.array(np.full(n + 1, task << 32 | number)),
                "doc_id": pa.concat_arrays([ids.cast(pa.int64()), none]),
                "n_a": pa.concat_arrays([pa.array(np.diff(m.a_first)), none]),
                "n_b": pa.concat_arrays([pa.array(np.diff(m.b_first)), none]),
                "n_groups": pa.concat_arrays([pa.array(groups.astype(np.int64)), none]),
                "n_links": pa.concat_arrays([pa.array(np.diff(m.link_first)), none]),
                "groups_sha256": pa.array([*digests, None], pa.string()),
                "held": pa.array([*held, None], pa.binary()),
                "times": pa.array([*often, None], pa.binary()),
                "pairs": pa.array([None] * n + [distinct], pa.list_(pa.int64())),
                "docs": pa.array([None] * n + [np.bincount(place, minlength=len(distinct))], pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"batch long, doc_id long, {_OWN}, held binary, times binary, pairs array<long>, docs array<long>")


def _summed(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one batch with the sums over their links."""
    size = counts.num_rows
    count, best = np.zeros(size, np.int64), np.zeros(size, bool)
    place = counts["place"].to_numpy()
    count[place], best[place] = counts["n"].to_numpy(), counts["is_best"].to_numpy()
    n_best, sums = [], []
    for held, times in zip(documents["held"].to_pylist(), documents["times"].to_pylist(), strict=True):
        if held is None:
            n_best.append(0)
            sums.append(0)
            continue
        own, often = np.cumsum(_unpacked(held)), _unpacked(times)
        n_best.append(int(often[best[own]].sum()))
        sums.append(int((often * count[own]).sum()))
    kept = documents.drop_columns(["batch", "held", "times"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def pair_counts(lists: DataFrame) -> DataFrame:
    """(pair, n, is_best): how many documents hold each linked pair, and whether its A id has none above."""
    counts = written(lists.select(F.explode(F.arrays_zip("pairs", "docs")).alias("e")).groupBy("e.pairs").agg(F.sum("e.docs").alias("n")).withColumnRenamed("pairs", "pair"), "align-counts")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))  # a row per A id
    return counts.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))


def summary(docs: DataFrame, json_path: str, model_path: str, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    table = written(_digested(docs, json_path, model_path, text), "align-batches")
    lists = table.filter("pairs is not null").select("batch", "pairs", "docs")
    counts = written(pair_counts(lists), "align-best")
    placed = lists.select("batch", F.posexplode("pairs").alias("place", "pair"))
    led = placed.join(counts, "pair").select(F.col("batch").alias("of"), "place", "n", "is_best")
    documents = table.filter("pairs is null").drop("pairs", "docs")
    result = f"doc_id long, {_OWN}, n_best long, count_sum long"
    return documents.groupBy("batch").cogroup(led.groupBy("of")).applyInArrow(_summed, result)
