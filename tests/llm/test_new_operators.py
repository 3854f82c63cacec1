"""SimHash near-dedup, cross-tokenizer alignment and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash

from veilwork.llm import prefix_trie, simhash, token_align
from veilwork.llm.components import components, scrambled, unscrambled

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
EDGES = [None, "", "  \n\t ", "one", "ONE", "two words", "a b c d", "A b C d", "é É", " x", "a\tb\r\n\n c", "long " * 30_000]


def connected(ids, pairs):
    """The smallest id reachable from each."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in sorted(ids):
        if i not in out:
            out[i], todo = i, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in out:
                        out[j] = i
                        todo.append(j)
    return out


# ------------------------------------------------------------------ components


def test_scrambling_is_a_bijection(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in (0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567)], "x long")
    for salt in (1, 2, 9):
        assert df.filter(unscrambled(scrambled(F.col("x"), salt), salt) != F.col("x")).isEmpty()


@pytest.mark.parametrize("shape", ["chain", "star", "mixed"])
def test_components(spark, shape):
    rng = random.Random(4)
    pairs = {
        "chain": [(k, k + 1) for k in range(1000)],
        "star": [(7, k) for k in range(8, 400)],
        "mixed": [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(5, 5), (10**15, -(10**15))],
    }[shape]
    found = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == connected({x for p in pairs for x in p}, pairs)


def test_rounds_of_a_long_chain(spark, monkeypatch):
    import veilwork.llm.components as module

    labels = []
    own = module.written
    monkeypatch.setattr(module, "written", lambda df, label: labels.append(label) or own(df, label))
    components(spark.range(1000).selectExpr("id as a", "id + 1 as b"))
    assert labels.count("parents") <= 15


@pytest.mark.parametrize("few", [0, 40])
def test_components_with_and_without_shuffle(spark, monkeypatch, few):
    """Rounds of many edges are shuffled, those of few are not, and both may follow each other."""
    import veilwork.llm.components as module

    monkeypatch.setattr(module, "FEW", few)
    rng = random.Random(6)
    pairs = [(k, k + 1) for k in range(150)] + [(rng.randrange(-300, -1), rng.randrange(-300, -1)) for _ in range(150)] + [(7, 7), (7, None)]
    found = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == connected({x for p in pairs[:-1] for x in p}, pairs[:-1])


def test_few_edges_need_no_shuffle(spark, monkeypatch):
    """Each shuffled round of a handful of edges cost as many tasks as there are shuffle partitions."""
    import veilwork.llm.components as module

    plans, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert components(edges).count() == 61
    assert len(plans) > 8 and not any("hashpartitioning" in p for p in plans)


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_documents(spark):
    rng = random.Random(11)
    texts = list(EDGES)
    for _ in range(8):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 12, 200, 600]))]
        for _ in range(12):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
            texts.append(" ".join(own).title() if rng.random() < 0.3 else "\n".join(own))
    rows = [(i, t, "s", "c") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "again", None), (None, texts[20], "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    found = simhash.near_copies(docs).collect()
    assert len(found) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in prints for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = connected(prints, links)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found if r.doc_id is not None) == Counter(
        [(i, f"{prints[i]:016x}", want[i]) for i in [*prints, 3]]
    )
    assert [r.component_id for r in found if r.doc_id is None] == [want[20]]


def test_masks_meet_every_close_pair():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
        met = [m for m in simhash.masks() if (a & m % 2**64) == (b & m % 2**64)]
        assert met
        assert any((a & f % 2**64) == (b & f % 2**64) for f in simhash.finer(met[0]))


@pytest.mark.parametrize("crowd", [16, 512])
def test_simhash_links_connect_what_brute_force_connects(spark, crowd):
    """Clouds of fingerprints around a few centres, so that keys are shared by many and must be dealt again."""
    rng = random.Random(crowd)
    prints = {0, 2**64 - 1}
    for centre in [rng.getrandbits(64) for _ in range(4)]:
        for _ in range(150):
            bits = rng.sample(range(64), rng.choice([1, 3, 6, 9]))
            prints.add(centre ^ sum(1 << b for b in bits))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowd=crowd)
    found = connected(signed, [(r.a, r.b) for r in links.collect()])
    assert found == connected(signed, [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) % 2**64).bit_count() <= 4])


def test_simhash_keys_are_not_broadcast(spark, monkeypatch):
    """They are 35 rows a fingerprint, which Spark sizes as one."""
    plans = {}

    def kept(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    written = simhash.written
    monkeypatch.setattr(simhash, "written", kept)
    links = simhash.links(written(spark.createDataFrame([(1,), (3,), (1 << 40,), (-1,)], "fp long"), "prints"), crowd=2)
    assert (1, 3) in {tuple(sorted(r)) for r in links.collect()}
    assert plans["simhash-keys"] and not any("Broadcast" in p for p in plans["simhash-keys"])


def test_simhash_empty_table(spark):
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ------------------------------------------------------------------ cross-tokenizer alignment


def plain_alignment(own, text):
    """Ids, cuts and links of one text by comparing all byte ranges in order."""
    a = own.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = own.b.encode(text) if text else []
    want = (" " + (text or "")).encode()
    if any(b"".join(table[i] for i in ids) != want for table, ids in ((own.a_bytes, a), (own.b_bytes, b))):
        return [], [], [], []
    spans = []
    for table, ids in ((own.a_bytes, a), (own.b_bytes, b)):
        at, found = 0, []
        for i in ids:
            found.append((at, at + len(table[i])))
            at += len(table[i])
        spans.append(found)
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
    return a, b, cuts, links, spans


def plain_groups(a, b, cuts, spans):
    parts, before = [], 0
    for cut in cuts:
        sides = [",".join(str(i) for i, (s, _) in zip(ids, sp, strict=True) if before <= s < cut) for ids, sp in ((a, spans[0]), (b, spans[1]))]
        parts.append("|".join(sides))
        before = cut
    return ";".join(parts)


def alignment_texts():
    rng = random.Random(2)
    words = ["the", "tokenization", "straße", "日本語", "😀", "x1y2", "…", "naïve", "  ", "\n", "\t", "<|endoftext|>", "</s>", "<0x0A>", "▁", "ﬁne", "\x00", "I'll"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(25)]
    return [*[e for e in EDGES if e is None or len(e) < 100], " lead", "trail ", *texts, texts[0], "plain words that come back " * 60]


def test_alignment_of_texts(spark):
    texts = alignment_texts()
    own = token_align.Pair(open(BYTE_JSON).read(), open(PIECE_MODEL, "rb").read())
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, a_ids string")
    found = {r.doc_id: r for r in token_align.align(docs, BYTE_JSON, PIECE_MODEL).collect()}
    for i, text in enumerate(texts):
        a, b, cuts, links, *_ = plain_alignment(own, text)
        row = found[i]
        assert (row.a_ids, row.b_ids, row.cuts) == (a, b, cuts), text
        assert [(x.a, x.b) for x in row.links] == links, text


def test_both_ways_to_encode_agree():
    """All steady characters, alone and among others, and random strings of them."""
    own = token_align.Pair(open(BYTE_JSON).read(), open(PIECE_MODEL, "rb").read())
    assert own.quick is not None
    steady = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    rng = random.Random(6)
    texts = [a + b + a for a in steady for b in (" ", "a", "1", "!", "\n", "'s", "\u00a0")]
    texts += ["".join(rng.choices(steady + list(" 'stremvld") * 12, k=rng.randrange(1, 40))) for _ in range(8000)]
    assert all(token_align.STEADY.fullmatch(t) for t in texts)
    assert own.encode_a(texts) == [e.ids for e in own.a.encode_batch(texts, add_special_tokens=False)]
    assert not token_align.STEADY.fullmatch("\u0250") and not token_align.STEADY.fullmatch("a\u2028")


@pytest.mark.parametrize("lane", [1, 3, 7, 512])
def test_lanes_give_the_same_links(lane):
    import numpy as np

    rng = random.Random(lane)
    size = 900
    ends = [np.array(sorted({*rng.sample(range(1, size), 400), 300, 301, size})) for _ in range(2)]
    a, b, cuts = token_align.merge(*ends, np.array([0, 300, 301, 301, size]), lane)
    spans = [list(zip([0, *e[:-1].tolist()], e.tolist(), strict=True)) for e in ends]
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [
        (i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e
    ]
    assert cuts.tolist() == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))


@pytest.mark.parametrize("batch", [200, 1 << 22])
def test_alignment_summary(spark, batch, monkeypatch):
    monkeypatch.setattr(token_align, "BATCH", batch)
    texts = alignment_texts()
    own = token_align.Pair(open(BYTE_JSON).read(), open(PIECE_MODEL, "rb").read())
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (3, texts[3])]
    found = Counter(tuple(r) for r in token_align.summary(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BYTE_JSON, PIECE_MODEL).collect())
    per, counts = [], Counter()
    for i, text in rows:
        a, b, cuts, links, *spans = plain_alignment(own, text)
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(set(pairs))
        shown = hashlib.sha256(plain_groups(a, b, cuts, spans[0]).encode()).hexdigest() if a else ""
        per.append((i, len(a), len(b), len(cuts), len(links), shown, pairs))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    assert found == Counter((*row, sum(counts[p] == top[p[0]] for p in pairs), sum(counts[p] for p in pairs)) for *row, pairs in per)


def test_alignment_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.summary(docs, BYTE_JSON, PIECE_MODEL).collect() == []


# ------------------------------------------------------------------ conversation trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            digest = hashlib.sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, said))
    for turns in own.values():
        turns.sort()
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(t[3] for t in own.get(c - c % 5, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = Counter(seq[:-1] for seq in nodes if seq)
    leaves, saved = Counter(), Counter()
    for seq, members in nodes.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not kids[seq]
            saved[seq[:d]] += (len(members) - 1) * len(seq[-1][1].encode()) if seq else 0
    out = Counter()
    for seq, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(seq))
        parent = min(nodes[seq[:-1]]) if seq else None
        out[min(members), len(seq), parent, len(members), kids[seq], leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def shapes():
    rng = random.Random(8)
    bushy = [(c, t, rng.choice("ua"), rng.choice(["yes", "no", "päh"])) for c in range(60) for t in range(rng.randrange(1, 6))]
    deep = [(c, t, "u", f"t{t if t < 40 else c * 100 + t}") for c in (10, 11, 12, 13) for t in range(70)]
    same = [(c, 0, "u", "hello") for c in range(200)]
    odd = [(1, None, None, None), (1, 0, "u", ""), (1, 0, "u", ""), (1, 1, "a", None), (2, 5, "u", "b"), (2, 5, "a", "b"), (None, 0, "u", "x"), (7, 0, "u", "long " * 20_000)]
    return {"bushy": bushy, "deep": deep, "same": same, "odd": odd, "single": [(9, 0, "u", "x")]}


@pytest.mark.parametrize("shape", list(shapes()))
def test_trie(spark, shape, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "RUN", 5)
    rows = shapes()[shape]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    found = prefix_trie.prefix_trie(frame)
    assert Counter(tuple(r) for r in found.collect()) == plain_trie(rows)


def test_trie_of_an_empty_table(spark):
    rows = prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert rows.collect() == []


# ------------------------------------------------------------------ hashes of words and lines


def thue_morse(k):
    """Two different strings of 2**k letters whose difference vanishes in polynomial hashes modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(1 << k)]
    return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]


def test_regular_words_have_different_hashes():
    import numpy as np
    import pyarrow as pa

    from veilwork.llm import words

    rng = random.Random(1)
    texts = [t for k in range(4, 13) for t in thue_morse(k)] + [thue_morse(12)[0]]
    texts += ["".join(rng.choices("ab", k=n)) for n in range(1, 700)] + ["a" * n for n in range(1, 700)] + ["a" * n + "b" for n in range(1, 700)]
    for order in (texts, texts[::-1]):
        seen = {}
        for piece in words.pieces(pa.array(order)):
            for text, h in zip(order[piece.rows], piece.hashes(piece.starts, piece.ends).tolist(), strict=True):
                assert seen.setdefault(text, h) == h  # equal wherever they stand
        assert len(set(seen.values())) == len(set(texts))
    piece = next(words.pieces(pa.array(["x"])))
    assert len(piece.hashes(np.array([0, 1]), np.array([0, 1]))) == 2  # empty spans, the last one at the end


def test_regular_words_are_not_linked_or_repeated(spark):
    from veilwork.llm import ngram_join, quality_rules

    docs, lines = [], []
    for k in range(8, 13):
        one, other = thue_morse(k)
        docs += [f"{one} b c d e", f"{other} b c d e"]
        lines.append(f"{one}\n{other}\n{one}\n{one} {other} z {other} {one} z")
    rows = [(i, t) for i, t in enumerate(docs)]
    found = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=85)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(i, i) for i in range(len(docs))]
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    counted = quality_rules.score(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), labels)
    assert [(r.n_dup_lines, r.n_repeat_words) for r in counted.collect()] == [(1, 0)] * len(lines)
