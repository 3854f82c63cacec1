"""Exact dedup, the n-gram join and line dedup against brute force."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from veilwork.llm import bloom, exact_dedup, line_dedup, ngram_join

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tree string")


def family(seed=3, n_base=6, copies=14):
    rng = random.Random(seed)
    out = []
    for _ in range(n_base):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 9, 40, 120, 300]))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(4000)}"
            out.append(" ".join(own).title() if rng.random() < 0.3 else " ".join(own))
    return out


EDGES = [None, "", "  \n\t ", "one", "ONE", "two words", "a b c d", "A b C d", "é É", "long " * 30_000]


def rows_of(texts):
    return [(i, t, "s", "x") for i, t in enumerate(texts)]


def brute_components(texts, n, percent):
    sets = {}
    for i, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("blocks", ["as is", "small"])
def test_ngram_join(spark, monkeypatch, blocks):
    if blocks == "small":  # trees of many blocks, wide keys, large labels
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
        monkeypatch.setattr(ngram_join, "KEY_SETS", 3)
        monkeypatch.setattr(ngram_join, "LARGE_LABEL", 3)
    texts = EDGES + family()
    got = ngram_join.near_copies(frame(spark, rows_of(texts)), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(list(enumerate(texts)), 4, 85)


def test_keep_one_and_empty(spark):
    texts = family(5, 3, 8)
    docs = frame(spark, rows_of(texts)).selectExpr("*", "'m' as _maybe", "doc_id as _lost")
    kept = ngram_join.keep_one(docs, 5, 80)
    want = {i for i, (_, c) in brute_components(list(enumerate(texts)), 5, 80).items() if c == i}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    assert ngram_join.near_copies(docs.limit(0)).count() == 0


def test_exact_dedup(spark):
    texts = EDGES + family()
    docs = frame(spark, rows_of(texts) + [(None, "one", "n", "x"), (3, "one", "s", "x")])
    rows = exact_dedup.mark_copies(docs).collect()
    assert len(rows) == docs.count()
    groups = {}
    for i, t, *_ in docs.collect():
        groups.setdefault(hashlib.sha256((t or "").translate(LOW).encode()).hexdigest(), []).append(i)
    for r in rows:
        own = groups[r["text_sha256"]]
        best = max(x for x in own if x is not None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(own), r["doc_id"] == best)
    left = exact_dedup.dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(max(x for x in g if x is not None) for g in groups.values())
    assert exact_dedup.dedup(docs.limit(0)).count() == 0 and exact_dedup.mark_copies(docs.limit(0)).count() == 0


def test_exact_dedup_takes_one_python_step_a_task(spark):
    plan = exact_dedup.dedup(frame(spark, rows_of(["one", "two"])))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") + plan.count("SortAggregate") >= 1
    assert plan.count("EvalPython [") == 2  # the surely single rows, and the rest


def test_bloom_filters_send_four_bytes_a_hash():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 64, 200_000, dtype=np.uint64)
    bits = bloom.filter_bits(len(h))
    batches = [pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], names=["h"]) for x in (h, h[:500])]
    sent = [b for x in batches for b in bloom._packed(iter([x]), bits)]
    assert sum(len(x) for b in sent for c in ("once", "again") for x in b.column(c).to_pylist()) == 4 * 200_500
    for repeated, known in ((False, h), (True, h[:500])):
        made = bloom.Filter(bits, {r["segment"]: r["bits"] for b in bloom._filled(iter(sent), repeated) for r in b.to_pylist()})
        assert made.test(known).all()
        assert made.test(rng.integers(0, 1 << 64, 100_000, dtype=np.uint64)).mean() < 0.01


def words_of(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def test_line_dedup(spark):
    rng = random.Random(2)
    base = [" ".join(f"term{rng.randrange(900)}" for _ in range(60)) for _ in range(4)]
    lines = []
    for b in base:
        lines += [b, b.upper() + "!!", b.replace("term1", "tern1", 1), b + " x"]
    lines += ["b a c", "a b c", "lone line", "--", ""]
    docs = frame(spark, [(i, "\n".join([lines[i], lines[-i - 1], "shared   Line"]), "s", "t") for i in range(len(lines))] + [(99, None, "s", "t"), (None, "shared line", "s", "t")])
    occ = line_dedup.occurrences(docs).collect()
    texts = {(d["doc_id"], k): words_of(x) for d in docs.collect() if d["text"] and d["doc_id"] is not None for k, x in enumerate(d["text"].split("\n"))}
    assert {(r["doc_id"], r["line_no"]) for r in occ} == {k for k, t in texts.items() if t}
    group = {}
    for r in occ:
        group.setdefault(r["group"], []).append((r["doc_id"], r["line_no"], r["kept"]))
    for rows in group.values():  # one, the first, stays
        assert [k for *_, k in sorted(rows)] == [True] + [False] * (len(rows) - 1)
    where = {(r["doc_id"], r["line_no"]): r["group"] for r in occ}
    same = {}
    for k, g in where.items():  # equal lines are never apart
        assert same.setdefault(texts[k], g) == g
    assert len(set(where.values())) < len(set(texts.values()))
    cleaned = {r["doc_id"]: r["text"] for r in line_dedup.clean(docs).collect()}
    assert cleaned[99] is None and cleaned[0].count("shared   Line") == 1 and "shared" not in cleaned[1].lower()
    assert line_dedup.dropped(docs.limit(0)).count() == 0


def test_line_links_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz "
    lines = ["word", "ward", "ten letter", "ten better", "nine char", "nine chars", "é" * 30, "é" * 27]
    for size in (2, 5, 8, 12, 20, 27, 40, 60, 400):
        base = " ".join("".join(rng.choice(letters[:26]) for _ in range(rng.randrange(1, 10))) for _ in range(size))
        lines.append(base)
        for share in (0.02, 0.05, 0.09, 0.1, 0.12):
            own = list(base)
            for _ in range(int(share * len(base))):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters), rng.choice("xyz")])
            lines.append(" ".join("".join(own).split()))
        lines.append("".join("#" if i % 10 == 9 and c != " " else c for i, c in enumerate(base)).replace("#", "ö"))  # edits as even as can be
    table = line_dedup.lines(frame(spark, rows_of(lines))).select("h", "norm").distinct()
    l, r = table.alias("l"), table.alias("r")
    brute = l.join(r, F.expr("l.h < r.h and levenshtein(l.norm, r.norm) <= cast(0.1 * greatest(length(l.norm), length(r.norm)) as int)"))
    brute = [tuple(x) for x in brute.select("l.h", "r.h").collect()]
    got = [tuple(x) for x in line_dedup.links(line_dedup.lines(frame(spark, rows_of(lines)))).collect()]

    def parts(pairs):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[root(a)] = root(b)
        groups = {}
        for x in list(up):
            groups.setdefault(root(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    assert len(brute) > 40 and parts(got) == parts(brute)


def test_line_links_in_passes(spark, monkeypatch):
    """The rows of segments and substrings are on disk for a few lengths and places at a time; no link is lost."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    lines = []
    for size in (9, 10, 14, 21, 33, 50, 75, 110, 170, 700):
        base = "".join(rng.choice("abcdefgh") for _ in range(size))
        lines.append(base)
        for share in (0.05, 0.1, 0.13):
            own = list(base)
            for _ in range(int(share * size)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
            lines.append("".join(own))
        lines += [base[: size // 2] + "z" * (size // 10) + base[size // 2 :], base[size // 10 :], base[: size - size // 10]]
        lines.append("".join("ö" if k % 10 == 9 else c for k, c in enumerate(base)))  # edits as even as can be
    monkeypatch.setattr(line_dedup, "_near", lambda texts: line_dedup.written(texts.select(F.col("h").alias("a"), F.col("h").alias("b")).limit(0), "near"))
    monkeypatch.setattr(line_dedup, "FAMILY", 0)
    monkeypatch.setattr(line_dedup, "PASS_ROWS", 2500)
    written, mixed = line_dedup.written, []

    def seen(df, label):
        table = written(df, label)
        if label == "mixed":
            assert sum(Path(t.scratch_path.removeprefix("file:")).is_dir() for t in mixed) <= 1
            mixed.append(table)
        return table

    monkeypatch.setattr(line_dedup, "written", seen)
    table = line_dedup.lines(frame(spark, rows_of(lines)))
    got = {tuple(sorted(x)) for x in line_dedup.links(table).collect()}
    texts = {r["h"]: r["norm"] for r in table.collect()}
    pairs = spark.createDataFrame([(a, b, texts[a], texts[b]) for a in texts for b in texts if a < b], "a long, b long, l string, r string")
    brute = {tuple(x) for x in pairs.filter("levenshtein(l, r) <= cast(0.1 * greatest(length(l), length(r)) as int)").select("a", "b").collect()}

    def root(up, x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    def connected(links):
        up = {}
        for a, b in links:
            up[root(up, a)] = root(up, b)
        return {frozenset(y for y in up if root(up, y) == root(up, x)) for x in list(up)}

    assert got <= brute and len(brute) > 60 and connected(got) == connected(brute)
    assert len(mixed) > 3
    whole = spark.createDataFrame([(h, len(n), h, n) for h, n in texts.items()], "h long, size int, part long, norm string")
    passes = line_dedup._passes(whole)
    each = [line_dedup._substrings(whole, first, last) for first, last in passes]
    assert sum(d.count() for d in each) == line_dedup._substrings(whole, 0, 16 * 200).count() > 2 * max(d.count() for d in each)


def test_simhash(spark):
    from pyspark.sql import functions as F

    texts = ["a b c d e", "a a b", "x", " ".join(f"w{i}" for i in range(3000))]
    docs = frame(spark, rows_of(texts))
    table = line_dedup.lines(docs)
    got = {r["norm"]: r["sim"] for r in line_dedup.signatures(table).join(table, "h").collect()}
    words = sorted({w for t in texts for w in t.split()})
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for t in texts:
        own = [hashes[w] for w in t.split()]
        want = sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in own) > len(own))
        assert got[t] & ((1 << 64) - 1) == want


def test_line_dedup_of_repeated_rows(spark):
    text = "a line that comes again\n--\nanother line"
    docs = frame(spark, [(1, text, "s", "t"), (1, text, "s", "t"), (1, "another line", "s", "u"), (2, text, "s", "t"), (None, text, "s", "t"), (None, text, "s", "t"), (3, None, "s", "t"), (3, "", "s", "t")])
    occ = line_dedup.occurrences(docs).collect()
    assert len(occ) == 7 and sum(r["kept"] for r in occ) == 2  # of each line one occurrence stays
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["dropped"]) for r in line_dedup.dropped(docs).collect())
    assert len(got) == 8 and [x for x in got if x[0] in (0, 3)] == [(0, 0, 0, []), (0, 0, 0, []), (3, 0, 0, []), (3, 0, 0, [])]
    assert sum(x[2] for x in got) == 5 and (2, 2, 2, [0, 2]) in got
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == 8
    left = [r["text"] for r in cleaned.filter("doc_id in (1, 2)").collect()]
    assert sum(t.count("again") for t in left) == 1 and sum(t.count("another") for t in left) == 1 and sum(t.count("--") for t in left) == 3


def test_batches_of_the_near_copies_are_small(spark):
    from veilwork.llm.shared import small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), spark.range(0, 2500, 1, 1)

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    def sizes():
        return [r.n for r in docs.mapInArrow(counted, "n long").collect()]

    with small_batches(spark):
        assert max(sizes()) == 1000
    assert spark.conf.get(name) == before and max(sizes()) == 2500


def test_labels_are_not_broadcast(spark):
    """Their join changed its form with their size, from which disk seemed to grow faster than the input."""
    from veilwork.llm.cotraining import features

    docs = spark.createDataFrame([(1, "a b", "s", "en"), (2, None, "s", None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = features(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_bitmaps_move_without_their_texts(spark, monkeypatch):
    """The shuffle that makes bitmaps unique comes after the texts have become bitmaps."""
    plans, write = {}, ngram_join.written

    def seen(df, label):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(ngram_join, "written", seen)
    texts = family(5, 3, 8)
    docs = frame(spark, rows_of(texts) * 2)  # repeated rows too
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(docs, 4, 85).collect()}
    assert got == {(i, n, c) for i, (n, c) in brute_components(list(enumerate(texts)), 4, 85).items()}
    assert -1 < plans["bits"].find("Exchange") < plans["bits"].find("MapInArrow")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_trees_of_many_blocks_rename_labels(spark, monkeypatch):
    """After the first round only links between labels are followed, not all links from the start."""
    followed, follow = [], ngram_join.components

    def seen(edges):
        followed.append(edges.count())
        return follow(edges)

    monkeypatch.setattr(ngram_join, "components", seen)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_join, "LARGE_LABEL", 3)
    texts = family(11, 40, 30) + family(12, 3, 30) + family(13, 2, 6)
    docs = frame(spark, rows_of(texts) * 2)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(docs, 4, 85).collect()}
    assert got == {(i, n, c) for i, (n, c) in brute_components(list(enumerate(texts)), 4, 85).items()}
    assert len(followed) > 2 and max(followed[2:]) < followed[1]
