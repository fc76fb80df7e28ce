import random
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.helpers import awkward, empty

from millrace.llm import line_dedup, ngram_join
from millrace.llm.components import components
from millrace.llm.shingles import shingle_sets


def brute_components(rows, k, percent):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.45 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.55:
            texts.append(" ".join(rng.choices(words, k=rng.randint(0, 4))))
        else:
            texts.append(" ".join(["Common boiler plate line that many share"] * rng.randint(0, 1) + rng.choices(words, k=rng.randint(5, 120))))
    return list(enumerate(texts, start=10))


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_join_equals_brute_force(spark, seed, k, percent):
    rows = corpus(seed, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, words=k, percent=percent, block=6).collect()}
    assert got == brute_components(rows, k, percent)


def test_join_of_one_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(250):  # each copy edits the one before, so that first and last don't link
        base[rng.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, block=8).collect()}
    assert got == brute_components(rows, 4, 85)


def test_copies_too_far_to_link_meet_nothing_across_components(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(100):  # the first 20 link with each other; the others have 16 shingles of their own, and 12 are too many
        w = list(base)
        for at in [rng.randrange(10, 140)] if i < 20 else rng.sample(range(5, 145, 5), 4):
            w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w)))
    met, table = {}, ngram_join.scratch.table

    def kept(df, name, *how):
        met[name] = table(df, name, *how)
        return met[name]

    monkeypatch.setattr(ngram_join.scratch, "table", kept)
    monkeypatch.setattr(ngram_join.scratch, "drop", lambda *tables: None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, block=8).collect()}
    assert got == brute_components(rows, 4, 85)
    assert [c for _, c in got.values()].count(0) == 20 and len(set(got.values())) == 81
    assert met["open"].join(met["unions"], "shingle").count() == 0


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (1, 60)])
def test_links_across_components_are_whole(spark, monkeypatch, k, percent):
    rng = random.Random(8)
    rows = corpus(5, 120)
    for i in range(60):  # near the least size that can link, and near the threshold
        w = [f"b{i % 6}x{j}" for j in range(100)]
        if i % 2:
            w = w[: rng.randint(percent - 4, percent + 4)]
        else:
            w[rng.randrange(100)] = f"n{i}"
            w[rng.randrange(100)] = f"m{i}"
        rows.append((1000 + i, " ".join(w)))
    # without the blocks of step 3, every link is one across components
    monkeypatch.setattr(ngram_join, "_block_links", lambda blocks, rule: spark.createDataFrame([], "a long, b long"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, words=k, percent=percent, block=6).collect()}
    assert got == brute_components(rows, k, percent)


@pytest.mark.parametrize("copies", ["one row", "ids"])
def test_join_reads_a_class_once(spark, monkeypatch, copies):
    near = [f"copy {i} " + " ".join(f"w{j}" for j in range(80)) for i in range(4)]
    # pairs that share many shingles, a few too few to link: they meet across components
    far = [(7000 + i, " ".join(f"v{i}x{j}" for j in range(60 if i < 4 else 30)) + " " + " ".join(f"t{j}" for j in range(40))) for i in range(8)]
    rows = [(5, near[0])] * 3000 if copies == "one row" else [(5 + i, near[0]) for i in range(200)]
    rows += [(6000 + i, t) for i, t in enumerate(near[1:])] + far
    most = []

    def counted(compare, by):
        def run(blocks, rule):
            most.append(blocks.groupBy(*by, "class").count().agg({"count": "max"}).first()[0])
            return compare(blocks, rule)

        return run

    monkeypatch.setattr(ngram_join, "WANTED_BITS", 32)
    monkeypatch.setattr(ngram_join, "_block_links", counted(ngram_join._block_links, ["r", "group", "block"]))
    monkeypatch.setattr(ngram_join, "_pair_links", counted(ngram_join._pair_links, ["one", "other"]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert most[0] == 1 and most[1] in (None, 1)
    assert got == brute_components(sorted(set(rows)), 4, 85)


def test_join_takes_awkward_rows(spark):
    docs = awkward(spark, ["n_shingles", "component_id", "class", "key"])
    got = sorted(map(tuple, ngram_join.join(docs).collect()), key=repr)
    assert len(got) == 12
    found = {k: c for k, _, c in got}
    assert found[None] is None and found[1] == 1 and found[2] == 2 and found[3] == 3 and found[9] == 9
    assert found[5] == found[4] == 4 and found[6] == found[7] == 6
    assert ngram_join.join(empty(spark)).count() == 0
    kept = ngram_join.keep_one(awkward(spark, ["key", "stays"])).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3, 4, 6, 6, 8, 9, 10]


def test_shingles_match_word_sets():
    texts = ["A b\tc d e", "a B c D e", "a b", "b a", "", None, "a  b\x0bc\x0cd e", "x" * 200 + " y z q", "é É e e"]
    for k in (1, 2, 4):
        sets = [frozenset(s.tolist()) for s in shingle_sets(texts, k)]
        plain = []
        for t in texts:
            w = (t or "").encode().lower().split()
            plain.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
        assert [len(s) for s in sets] == [len(p) for p in plain]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (7, 7), (None, 3), (1, 2), (2, 9)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 1, 8: 1, 1: 1, 2: 1, **dict.fromkeys(range(20, 61), 20)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_patience_matches_increase_and_agree():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 15))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    assert line_dedup.patience([1, 2, 3, 4, 5], [1, 9, 3, 4, 8]) == [(0, 0), (2, 2), (3, 3)]
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def blocks(later, earlier, words, least):
    sizes = {x: w for x, w in zip(later, words)}
    a, b = (np.array(x, np.int64) for x in (later, earlier))
    return np.flatnonzero(line_dedup.common_blocks(a, np.array(words), b, np.array([sizes.get(x, 1) for x in earlier]), least)).tolist()


def test_blocks_need_enough_words():
    later, earlier = [1, 2, 3, 9, 4], [7, 1, 2, 3, 8, 4]
    assert blocks(later, earlier, [5, 5, 5, 5, 5], 15) == [0, 1, 2]
    assert blocks(later, earlier, [5, 5, 5, 5, 5], 16) == []
    assert blocks(later, earlier, [5, 5, 5, 5, 15], 15) == [0, 1, 2, 4]
    # blocks that repeat, that moved, and the tail of a block behind a long line
    assert blocks([8, 1, 2, 1, 2, 1, 2, 9], [7, 1, 2, 1, 2, 1, 2, 6], [12] * 8, 20) == [1, 2, 3, 4, 5, 6]
    assert blocks([1, 2, 3, 4], [3, 4, 1, 2], [10] * 4, 20) == [0, 1, 2, 3]
    assert blocks([1, 2, 3], [1, 2, 3], [25, 3, 3], 20) == [0, 1, 2]


def plain_dedup(rows, min_words):
    """All pairs, all common sequences of lines: nothing shared with the operator."""
    blanks = " \t\r\x0b\x0c"
    docs = {d: [(i, x.strip(blanks)) for i, x in enumerate(t.split("\n")) if x.strip(blanks)] for d, t in sorted(rows)}
    out = dict(rows)
    for d in docs:
        drop = set()
        for e in docs:
            if e >= d:
                continue
            a, b = docs[d], docs[e]
            for i in range(len(a)):
                for j in range(len(b)):
                    n = words = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                        words += a[i + n][1].count(" ") + 1
                        n += 1
                    if words >= min_words:
                        drop |= {at for at, _ in a[i : i + n]}
        if drop:
            left = [x for i, x in enumerate(out[d].split("\n")) if i not in drop]
            out[d] = "\n".join(left) if any(x.strip(blanks) for x in left) else ""
    return out


@pytest.mark.parametrize(("seed", "pool_size", "least"), [(7, 60, 12), (8, 12, 20), (9, 200, 5)])
def test_dedup_equals_brute_force(spark, seed, pool_size, least):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=rng.randint(1, 9))) for _ in range(pool_size)]
    rows = [(i, "\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs, min_words=least).collect()}
    assert got == plain_dedup(rows, least)


def test_overlaps_of_later_documents_are_found(spark):
    one, two = " ".join(f"l{i}" for i in range(12)), " ".join(f"m{i}" for i in range(12))
    rows = [(1, f"{one}\nx"), (2, f"y\n{two}"), (3, f"a\n{one}\n{two}\nb"), (4, f"c\n{one}\n{two}\nd")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows), 4: "c\nd"}


def test_a_group_of_copies_stands_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FANS", 4)
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(4))
    rows = [(i, text) for i in range(60)] + [(100 + i, f"own {i}\n{text}") for i in range(60)] + [(5, text)] * 40
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows) and {r.text for r in got if 0 < r.doc_id < 100} == {""}
    assert all(r.text == f"own {r.doc_id - 100}" and r.n_deleted == 4 for r in got if r.doc_id >= 100)
    assert [r.text for r in got if r.doc_id == 0] == [text]


def test_dedup_takes_awkward_rows(spark):
    docs = awkward(spark, ["key", "copy", "drop", "_n"])
    got = line_dedup.dedup(docs, min_words=5).collect()
    assert len(got) == 12 and got[0]._n == "clash"
    text = defaultdict(list)
    for r in got:
        text[r.doc_id].append(r.text)
    assert text[None] == ["a row without a key"] and text[1] == [None] and text[2] == [""]
    assert len(text[4][0]) > 1000 and text[5] == [""] and text[7] == [""]
    assert text[6] == ["same text here for two rows"] * 2
    assert line_dedup.dedup(empty(spark)).count() == 0


def test_a_long_passage_stays_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own line number {i} of this text\n{passage}\nand another own line {i}") for i in range(30)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0] and not any(passage in got[i] for i in range(1, 30))
    assert got[3] == "own line number 3 of this text\nand another own line 3"


def test_a_passage_of_frequent_short_lines_stays_once(spark):
    passage = [" ".join(f"p{i}x{j}" for j in range(8)) for i in range(3)]
    # pairs share a rarer line too: the passage's lines are never the rarest
    rows = [(i, "\n".join([f"own {i}", f"of the pair {i // 2}", f"more {i}", *passage, f"end {i}"])) for i in range(40)]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in got if passage[0] in got[i].text] == [0]
    assert all(got[i].n_deleted == (3 if i else 0) for i in got)


def test_rule_bounds():
    rule = ngram_join.Rule(4, 85)
    assert rule.links(85, 85, 100) and not rule.links(84, 85, 99)
    assert rule.least(np.array([100, 101])).tolist() == [85, 86]
