"""SentencePiece encoding and decoding with a merge-type prefix table.

The merges of a byte-pair model give every prefix of a text one last token that no longer text
that starts with this prefix can contradict.  ``Codec`` stores that token for each prefix: the
tokens that end at a position come from an automaton over the vocabulary, and a token fits when
the prefix before it is encoded and the pair of that prefix's last token and this one is stable,
that is, when merging the two tokens' joined text gives back just these two.  Exactly one fits; the
ids are read off backwards.

Spaces become U+2581 and one is put in front.  As no piece holds U+2581 after another character, no
merge crosses into it, nor across a line feed, which has no piece; so a text is encoded word by word
(both facts are checked when a model is loaded).  The distinct new words of some megabytes of text go
through the table together, one position of all words after the other, in numpy; known words are
looked up in a bounded cache.  Characters without a piece become byte tokens.

Null counts as empty, which is the begin and the end id alone.  Texts are whole, however long;
repeated rows get equal results; an empty table gives an empty one; other columns pass through, and
names that start with ``_piece_`` are reserved.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MAX_WORDS = 1 << 18  # in either of two generations
PAIR_SLOTS = 1 << 20
LONG_WORD = 48
SLICE = 2 << 20


class Codec:
    """One model's tables, with bounded caches of words and pairs."""

    def __init__(self, content: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not model.is_byte(i)}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte = [0] * 256
        self.shown = []
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.shown.append(bytes([int(p[3:5], 16)]))
            else:
                self.shown.append(b"" if special[i] else p.replace(MARK, " ").encode())
        # pieces that merging never makes are never tokens
        made = [(p, i) for p, i in self.ids.items() if self.merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p, i in made:
            self.automaton.add_word(p, len(p) << 20 | i)
        self.automaton.make_automaton()
        self._merge_tables(n, [p for p, _ in made])
        self.by_word = "\n" not in self.ids and not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.feed = array("I", [self.byte[10]]).tobytes()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pair_keys = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_fits = np.zeros(PAIR_SLOTS, bool)

    def _merge_tables(self, n: int, made: list[str]) -> None:
        """When each token is merged, from which two, and what two neighbours merge to."""
        order = sorted((p for p in made if len(p) > 1), key=lambda p: -self.score[p])
        self.time = np.zeros(n, np.int64)
        self.left = np.arange(n)
        self.right = np.arange(n)
        keys, times = [], []
        moment, last = 0, None
        for p in order:
            if self.score[p] != last:
                moment, last = moment + 1, self.score[p]
            i = self.ids[p]
            self.time[i] = moment
            _, (a, b) = self._merge(p)
            self.left[i], self.right[i] = self.ids[a], self.ids[b]
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    keys.append(self.ids[p[:k]] << 20 | self.ids[p[k:]])
                    times.append(moment)
        sort = np.argsort(keys)
        self.join_keys = np.array(keys, np.int64)[sort]
        self.join_time = np.array(times, np.int64)[sort]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """The plain definition, for short texts: merge the best-scored pair, leftmost first.

        Returns the parts and the last two that were merged.
        """
        parts, pair = list(text), ("", "")
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            pair = (parts[at], parts[at + 1])
            parts[at : at + 2] = [pair[0] + pair[1]]
        return parts, pair

    def merged(self, text: str) -> list[str]:
        return self._merge(text)[0]

    def stable(self, a: int, b: int) -> bool:
        """Whether token b may follow token a, by definition."""
        left, right = self.pieces[a], self.pieces[b]
        return self.merged(left + right) == [left, right]

    def stable_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stable`` for many pairs: undo the merges that led to a and b, the latest first, and see
        whether two parts that met at the border would have merged while both were there."""
        x, y = a.copy(), b.copy()
        until_x = np.full(len(a), np.iinfo(np.int64).max)
        until_y = until_x.copy()
        fits = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            own_x, own_y = x[live], y[live]
            key = own_x << 20 | own_y
            at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
            meets = self.join_keys[at] == key
            # inside a, an equal merge further left comes first; inside b, the border comes first
            broken = meets & (self.join_time[at] < until_x[live]) & (self.join_time[at] <= until_y[live])
            fits[live[broken]] = False
            time_x, time_y = self.time[own_x], self.time[own_y]
            go = ~broken & ((time_x > 0) | (time_y > 0))
            undo_x = go & (time_x > time_y)
            undo_y = go & ~undo_x
            at_x, at_y = live[undo_x], live[undo_y]
            until_x[at_x], x[at_x] = time_x[undo_x], self.right[own_x[undo_x]]
            until_y[at_y], y[at_y] = time_y[undo_y], self.left[own_y[undo_y]]
            live = live[go]
        return fits

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``stable_pairs`` through a table of one pair per slot."""
        key = before << 20 | token
        slot = ((key * 0x9E3779B97F4A7C1) >> 20) & (PAIR_SLOTS - 1)
        known = self.pair_keys[slot] == key
        out = self.pair_fits[slot]
        if not known.all():
            new = ~known
            asked, back = np.unique(key[new], return_inverse=True)
            fits = self.stable_pairs(asked >> 20, asked & 0xFFFFF)
            out[new] = fits[back]
            self.pair_keys[slot[new]] = key[new]
            self.pair_fits[slot[new]] = out[new]
        return out

    def learn(self, words: list[str]) -> None:
        """Put words into the cache, all through the prefix table at once."""
        if len(self.words) >= MAX_WORDS:
            self.older, self.words = self.words, {}
        plain = []
        for w in words:
            if len(w) <= LONG_WORD and not w.startswith(MARK + MARK):
                plain.append(w)
            else:
                self.words[w] = array("I", self.tokens(w)).tobytes()
        if not plain:
            return
        sizes = np.array([len(w) for w in plain])
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        # a line feed has no piece; the matches go straight into one array, so that no object outlives its turn
        found = np.fromiter(chain.from_iterable(self.automaton.iter("\n".join(plain))), np.int64)
        ends, match = found[::2] + 1, found[1::2]
        length, token = match >> 20, match & 0xFFFFF
        word = np.repeat(np.arange(len(plain)), sizes + 1)[ends - 1]
        place = ends - starts[word]
        last = np.full((len(plain), LONG_WORD + 1), -1, np.int64)
        order = np.argsort(place.astype(np.int16), kind="stable")  # a radix sort
        borders = np.searchsorted(place[order], np.arange(1, LONG_WORD + 2))
        for p in range(1, LONG_WORD + 1):
            now = order[borders[p - 1] : borders[p]]
            if not len(now):
                continue
            w, start, t = word[now], p - length[now], token[now]
            before = last[w, start]
            fits = start == 0
            inner = np.flatnonzero(~fits & (before >= 0))
            fits[inner] = self._fits(before[inner], t[inner])
            last[w[fits], p] = t[fits]
        # read the ids off backwards
        width = np.zeros(len(self.pieces), np.int64)
        width[token] = length
        ids = np.zeros((len(plain), LONG_WORD), np.uint32)
        at, count = sizes.copy(), np.zeros(len(plain), np.int64)
        live = np.arange(len(plain))
        odd = np.zeros(len(plain), bool)
        while len(live):
            t = last[live, at[live]]
            odd[live[t < 0]] = True  # a character without a piece
            live, t = live[t >= 0], t[t >= 0]
            count[live] += 1
            ids[live, LONG_WORD - count[live]] = t
            at[live] -= width[t]
            live = live[at[live] > 0]
        content = ids.tobytes()
        row = LONG_WORD * 4
        for k, (w, n, strange) in enumerate(zip(plain, count.tolist(), odd.tolist(), strict=True)):
            self.words[w] = array("I", self.tokens(w)).tobytes() if strange else content[(k + 1) * row - n * 4 : (k + 1) * row]

    def tokens(self, text: str) -> list[int]:
        """The ids of one run of text, by the prefix table."""
        n = len(text)
        last = [-1] * (n + 1)  # the last token of each prefix
        size = [0] * (n + 1)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for at, match in self.automaton.iter(text):
            ends[at].append((match >> 20, match & 0xFFFFF))
        seen: dict[tuple[int, int], bool] = {}
        for at, found in enumerate(ends):
            if not found:  # no piece ends here: the character has none
                last[at + 1], size[at + 1] = -2, 1
                continue
            for length, token in found:
                start = at + 1 - length
                if start:
                    before = last[start]
                    if before == -1:
                        continue
                    if before >= 0:
                        fits = seen.get((before, token))
                        if fits is None:
                            fits = seen[before, token] = self.stable(before, token)
                        if not fits:
                            continue
                last[at + 1], size[at + 1] = token, length
                break
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend(self.byte[b] for b in reversed(text[at - 1].encode()))
            at -= size[at]
        out.reverse()
        return out

    def _split(self, text: str) -> list[str]:
        """The words of a text: runs of marks with what follows up to the next; a line feed alone."""
        out: list[str] = []
        for k, line in enumerate((MARK + text.replace(" ", MARK)).split("\n")):
            if k:
                out.append("\n")
            head, *parts = line.split(MARK)
            if head:
                out.append(head)
            if "" not in parts:
                out.extend([MARK + p for p in parts])
                continue
            run = MARK
            for p in parts:
                if p:
                    out.append(run + p)
                    run = MARK
                else:
                    run += MARK
            if run != MARK:
                out.append(run[1:])
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """All ids of each text as little-endian unsigned 32-bit integers, with begin and end."""
        begin, end = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        if not self.by_word:
            return [begin + (array("I", self.tokens(MARK + t.replace(" ", MARK))).tobytes() if t else b"") + end for t in texts]
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            split, held = [], 0
            while at < len(texts) and held < SLICE:
                split.append(self._split(texts[at]) if texts[at] else [])
                held += len(texts[at])
                at += 1
            own: dict[str, bytes] = {}
            missing = []
            for w in set().union(*split):
                ids = self.words.get(w) or self.older.get(w)
                if ids:
                    own[w] = ids
                elif w == "\n":
                    own[w] = self.feed
                else:
                    missing.append(w)
            self.learn(missing)
            for w in missing:
                own[w] = self.words[w]
            out += [begin + b"".join([own[w] for w in words]) + end for words in split]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, the one mark put in front taken away."""
        shown = self.shown
        text = b"".join([shown[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(content: bytes) -> Codec:
    """The codec of a model file's content, kept by each Python worker."""
    name = hashlib.sha256(content).hexdigest()
    if name not in _CODECS:
        _CODECS[name] = Codec(content)
    return _CODECS[name]


_CODED = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string, ids: binary, decoded: string>"


def code(docs: DataFrame, path: str, text: str = "text", whole: bool = True) -> DataFrame:
    """The documents with a struct ``_piece_code``: n_tokens, SHA-256 of the packed ids and of the
    decoded text, and with ``whole`` the ids (little-endian unsigned 32-bit) and the decoded text.

    ``path`` is read by the driver; the file, some hundred kilobytes, is broadcast.
    """
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def of(texts: pa.Array) -> pa.Array:
        own = codec(shared.value)
        counts, ids_hex, text_hex, packed, shown = [], [], [], [], []
        for at in range(0, len(texts), 512):  # the ids of a few texts at a time
            for ids in own.encode_all([t or "" for t in texts.slice(at, 512).to_pylist()]):
                decoded = own.decode(ids)
                counts.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(decoded.encode()).hexdigest())
                packed.append(ids if whole else None)
                shown.append(decoded if whole else None)
        columns = [pa.array(counts, pa.int64()), *(pa.array(c, pa.string()) for c in (ids_hex, text_hex)), pa.array(packed, pa.binary()), pa.array(shown, pa.string())]
        return pa.StructArray.from_arrays(columns, names=["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    return docs.withColumn("_piece_code", F.arrow_udf(of, _CODED)(F.col(text).cast("string")))
