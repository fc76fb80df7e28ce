import re
import time

import numpy as np
import pytest
from tests.llm.helpers import awkward, empty

from millrace.llm import ann, fingerprints, html_text, licenses, quality

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def phrase_places(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), found


def test_licences_find_every_base_place(spark):
    texts = [
        "All rights reserved. all-rights\nRESERVED all rights  reserved", "CC BY cc by cc_by CC BY-NC 4.0", "ccby acc by", None, "",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
        "general public license general public license", "Released under the MIT License.", "é cc by", "cc by", "all rights", "...",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        n, found = phrase_places(texts[r.doc_id])
        starts = [i for i, _ in found]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert labels[5] == "gpl,gpl-3.0" and labels[6] == "apache-2.0" and labels[8] == "mit"


def test_licence_rules_are_hundreds_and_suppress(spark):
    assert len(licenses.rules()) > 300 and all(re.compile(r.regex) for r in licenses.rules())
    docs = spark.createDataFrame([(1, "licensed under the CC BY-NC-SA 4.0 license")], "doc_id long, text string")
    row = licenses.scan(docs).first()
    assert [d.label for d in row.detections] == ["cc-by-nc-sa-4.0"] and row.labels == "cc-by,cc-by-nc-sa-4.0"


def test_licences_take_awkward_rows(spark):
    got = licenses.scan(awkward(spark, ["form", "base", "n_words"])).collect()
    assert len(got) == 12 and all(r.n_words == phrase_places(t)[0] for r, t in zip(sorted(got, key=lambda r: r.doc_id or 0)[:2], ["a row without a key", None]))
    assert licenses.scan(empty(spark)).count() == 0


def test_fingerprints_are_homomorphic(spark):
    f = spark.range(1).select(
        fingerprints.lanes(fingerprints.F.lit("a\nb. c\nd")).alias("whole"), fingerprints.lanes(fingerprints.F.lit("d\na\nb. c")).alias("moved"),
        fingerprints.insert(fingerprints.lanes(fingerprints.F.lit("a\nd")), fingerprints.F.lit("b. c")).alias("grown"),
        fingerprints.delete(fingerprints.lanes(fingerprints.F.lit("a\nx y z\nb. c\nd")), fingerprints.F.lit("x y z")).alias("shrunk"),
        fingerprints.lanes(fingerprints.F.lit("a\nb. c\nd\nd")).alias("twice"),
    )
    r = f.select("*", fingerprints.number_form(fingerprints.text_form(fingerprints.F.col("whole"))).alias("back")).first()
    assert r.whole == r.moved == r.grown == r.shrunk == r.back and r.twice != r.whole
    none = spark.range(1).select(fingerprints.lanes(fingerprints.F.lit(None).cast("string")).alias("x")).first().x
    assert set(none) == {0}


def test_edits_follow_the_next_document(spark):
    import hashlib

    rows = [(i * 3, f"Line one of {i}.\nLine two of {i}, which is longer.\nLine three é漢 {i}" * (i % 4)) for i in range(40)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)
    got = sorted(fingerprints.edits(docs).collect(), key=lambda r: r.doc_id)
    for i, r in enumerate(got):
        text, nxt = rows[i][1], rows[(i + 1) % 40][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (rows[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.fingerprint == r.edited_fingerprint) >= (text == edited)
    assert sum(r.near_edited for r in got) > sum(r.near_next for r in got)
    assert fingerprints.edits(docs.limit(1)).first().near_next == 1.0


def test_edits_take_awkward_rows(spark):
    got = fingerprints.edits(awkward(spark, ["own", "next_text", "_k", "_b"])).collect()
    assert len(got) == 12
    same = {r.fingerprint for r in got if r.doc_id in (6, 7)}
    assert len(same) == 1 and fingerprints.edits(empty(spark)).count() == 0


def test_quality_learns_held_out_rows(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeilmnorst"), rng.integers(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        w = list(rng.choice(words, rng.integers(30, 300)))
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w[:40]) + " " + " ".join(w)))
        labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, marks).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out]
    assert np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.95
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(9), marks).collect()}
    assert all(abs(again[k] - got[k].score) < 1e-9 for k in got)


def test_held_out_labels_change_nothing(spark):
    docs = spark.createDataFrame([(i, ("ok word " if i % 2 else "BAD!! ") * 20) for i in range(100)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    held = quality.held_out(quality.F.col("doc_id"))
    turned = marks.withColumn("quality", quality.F.when(held, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    one, two = (dict(quality.classify(docs, m).select("doc_id", "score").collect()) for m in (marks, turned))
    assert one == two


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(2)
    m = quality.GatedAttention(5, 4, 3)
    x, begin, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m._forward(x, begin)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = m._gradient(m._forward(x, begin), y, begin[:-1])
    for k, w in m.p.items():
        for i in np.ndindex(w.shape):
            w[i] += 1e-6
            up = loss()
            w[i] -= 2e-6
            down = loss()
            w[i] += 1e-6
            assert abs((up - down) / 2e-6 - grad[k][i]) < 1e-5


def test_quality_takes_awkward_rows(spark):
    docs = awkward(spark, ["score", "quality", "held_out"])
    marks = spark.createDataFrame([(None, 1), (1, None), (4, 1), (6, 0), (6, 1), (8, 0)], "doc_id long, quality int")
    got = quality.classify(docs, marks).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(empty(spark), marks).count() == 0
    assert quality.score(docs, quality.GatedAttention()).columns == ["doc_id", "text", "quality", "held_out", "score"]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><div id="wrap" class="page with-sidebar">
<div class="topMenu"><a href=/>Home</a> About</div><div class=content><h1>Title</h1><p>Long text here with words and more words to read on &amp; on.
<p>Second   paragraph is also long enough to be&nbsp;text. <b>bold</b>er<br>line<ul><li>one<li>two</ul>
<div class="comments"><p>Reader: I disagree strongly with all of this long text here.</p></div></div>
<form><p>Subscribe now to our newsletter please</form></div><footer>c</footer>"""


def test_main_text_of_pages():
    assert html_text.main_text(PAGE) == (
        "Title\n\nLong text here with words and more words to read on & on.\n\nSecond paragraph is also long enough to be text. bolder line\n\none\n\ntwo"
    )
    article = '<nav>menu</nav><article><header><h1>T</h1></header><p>x</p><aside>ad</aside><section id=comments><article class=comment>no</article></section></article><p>out</p>'
    assert html_text.main_text(article) == "T\n\nx"
    for odd in (None, "", "   ", "<p>", "<script>var a='<p>x</p>'</script>", "<!-- x -->", "<nav>a</nav>"):
        assert html_text.main_text(odd) == ""
    assert html_text.main_text("just text") == "just text"


LONG = "A sentence that is long enough to be read as running text, with a comma. "
GOLD = [
    # a name tells a state, not what the element is
    (f'<nav><a href=/>Home</a></nav><article class="post has-comments"><h1>T</h1><p>{LONG}</article>', ["T", LONG]),
    (f'<article class="comments-open"><p>{LONG}<p>Short.</article><footer>x</footer>', [LONG, "Short."]),
    # no article, no names: ratios alone part the menu, the story and the last line
    (f"<div><a href=/>Home</a> <a href=/a>News</a></div><div><a href=/b>Sport</a></div><div><p>{LONG * 3}<p>{LONG * 2}<p>Short one.</p></div><div>Imprint</div><div><a href=/c>Top</a></div>", [LONG * 3, LONG * 2, "Short one."]),
    # two sibling sections with very different shares of the story
    (f"<ul><li><a href=/>a</a><li><a href=/>b</a></ul><div><div><p>{LONG * 9}</div><div><p>{LONG}</div></div><div><a href=/>z</a></div>", [LONG * 9, LONG]),
    # a heading beside the container of its text, not the site's name above the menu
    (f"<h1>Site</h1><ul><li><a href=/>a</a><li><a href=/>b</a></ul><div><h2>Story</h2><div><p>{LONG}<p>{LONG}</div></div>", ["Story", LONG, LONG]),
    # lists, quotations and links inside a story stay
    (f'<article><p>{LONG}<ul><li>one<li><a href=/>two</a></ul><blockquote>said</blockquote><p>{LONG}<p>See <a href=/>this</a></article>', [LONG, "one", "two", "said", LONG, "See this"]),
    # adverts, notices, forms and reader comments inside the article go, long ones too
    (f'<article><p>{LONG}<div class="ad-slot">{LONG}</div><form>Mail</form><p>{LONG}<div id="comments"><p>{LONG * 5}</div></article><div class="cookie-notice">{LONG}</div>', [LONG, LONG]),
    # a short article beside a longer advert
    (f'<nav><a href=/>a</a></nav><div class="ad">{LONG}</div><article><h1>Hi.</h1><p>Yo.</article><footer>f</footer>', ["Hi.", "Yo."]),
    # a wrapper with the name of boilerplate
    (f'<div class="page sidebar"><p>{LONG}<p>{LONG}</div><div class="footer">x</div>', [LONG, LONG]),
    # blocks and white space
    ("<main><p>a\n  b<br>c<table><tr><td>1<td>2<tr><td>3</table>d &lt;&#233;&gt;</main>", ["a b c", "1 2", "3", "d <é>"]),
    (f"<p>{LONG}<p>{LONG}", [LONG, LONG]),
]


@pytest.mark.parametrize(("html", "blocks"), GOLD)
def test_gold_pages(html, blocks):
    assert html_text.main_text(html) == "\n\n".join(b.strip() for b in blocks)


def test_clusters_decide(monkeypatch):
    pages = [html for html, _ in GOLD if "<a " in html or "<footer" in html]
    monkeypatch.setattr(html_text, "clustered", lambda ratios, share=0.5: np.ones(len(ratios), bool))
    changed = [html_text.main_text(html) for html in pages]
    monkeypatch.undo()
    assert sum(html_text.main_text(html) != c for html, c in zip(pages, changed)) >= 0.7 * len(pages)


def test_deep_pages_take_linear_time():
    n = 100_000
    began = time.process_time()
    assert html_text.main_text("<div>" * n + f"<p>{LONG}" + "</div>" * n) == LONG.strip()
    assert html_text.main_text("<div>" * n + f"<p>{LONG}" + "</p></x>" * n) == LONG.strip()
    assert time.process_time() - began < 20


def test_smoothing_and_clusters():
    ratios = np.array([1, 1, 1, 80, 90, 85, 1, 1, 1.0])
    assert html_text.clustered(ratios)[3:6].all() and not html_text.clustered(ratios)[[0, 8]].any()
    assert abs(html_text.smoothed(np.ones(2)) - 1).max() < 1e-9


def test_pages_take_awkward_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (2, None, PAGE), (2, None, PAGE), (3, "u", "<p>é 漢</p>"), (4, "u", "<p>" + "long text " * 50_000 + "</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and len(got) == 6
    assert html_text.extract(pages.limit(0)).count() == 0


def brute_nearest(rows, k, asks):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if asks(q):
            s = sorted((-float(v @ w), i) for i, w in ok if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_search_reaches_its_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.6 * rng.normal(size=16)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, ann.F.col("vec_id") % 20 == 0, k=20, leaf_rows=24).collect()
    want = brute_nearest(rows, 20, lambda q: q % 20 == 0)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(want)
    hits = sum(len({i for _, i, _ in found[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    vector = {i: np.array(v) for i, v in rows}
    for q, f in found.items():
        f.sort()
        assert [n for n, _, _ in f] == list(range(1, 21)) and f == sorted(f, key=lambda x: (-x[2], x[1]))
        assert all(abs(s - vector[q] @ vector[i]) < 1e-9 for _, i, s in f)


def test_search_with_its_defaults_scores_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6_000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ann.F.col("vec_id") % 20 == 0).collect()
    near, found = x.astype(float) @ x.astype(float).T, {}
    np.fill_diagonal(near, -9)
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(found) == 300 and {len(f) for f in found.values()} == {20}
    hits = sum(len(f & set(np.argsort(-near[q])[:20].tolist())) for q, f in found.items())
    assert hits >= 0.9 * 20 * 300
    tree = ann.Tree(x[:4_000].astype(float))
    leaf, q = tree.leaf(x.astype(float)), x[7].astype(float)
    walk = tree.walk(q, 10**6)
    rank = {name: i for i, name in enumerate(walk)}
    assert np.median([rank[name] for name in leaf[np.argsort(-near[7])[:20]]]) < 0.15 * len(walk)


def test_search_takes_awkward_rows(spark):
    one = [1.0, 0.5]
    rows = [(None, one), (0, one), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0])]
    rows += [(i, one) for i in range(20, 120)] + [(200, [0.2, 0.1]), (201, [-1.0, 0.0]), (0, one), (300, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, query_id int")
    got = ann.search(df, ann.F.col("vec_id") % 20 == 0, k=5, block_rows=8).collect()
    near = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        near.setdefault(r.query_id, []).append(r.vec_id)
    assert near[0] == [20, 21, 22, 23, 24] and near[20] == [0, 21, 22, 23, 24] and set(near) == {0, 20, 40, 60, 80, 100, 200}
    few = df.where("vec_id in (0, 200)").dropDuplicates(["vec_id"])
    assert sorted((r.query_id, r.vec_id) for r in ann.search(few, ann.F.col("vec_id") % 20 == 0, k=5).collect()) == [(0, 200), (200, 0)]
    assert ann.search(df.limit(0), ann.F.lit(True)).count() == 0
    with pytest.raises(Exception):
        ann.search(df, ann.F.col("no_such_column") == 1)


def test_tree_walk_visits_every_leaf():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    tree = ann.Tree(x, 4, 20)
    assert sorted(tree.walk(x[0], 10**6)) == sorted(tree.leaves)
    assert set(tree.leaf(x)) <= set(tree.leaves)
    assert tree.walk(x[0], 3) == tree.walk(x[0], 10**6)[:3]


def test_quality_learns_from_whole_documents(spark):
    # good and bad differ only far behind the first passages
    rows = [(i, "plain word " * 3_000 + ("end of it " if i % 2 else "BAD!! STUFF?? ") * 2_000) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for most in (200_000, 4_000):
        got = quality.classify(docs, marks, sample_passages=most).collect()
        assert all(r.predicted == r.doc_id % 2 for r in got)


def test_edits_in_many_ranges_and_of_one_key(spark):
    import hashlib

    rows = [(None if i % 3 == 0 else i // 7, f"text {i % 50}\nof row {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = fingerprints.edits(docs).collect()
    assert len(got) == 900
    # rows of one key come in some order of their own; every row is the next of one other
    texts = dict(zip((hashlib.sha256(t.encode()).hexdigest() for _, t in rows), rows))
    want = set()
    for _, a in rows:
        for _, b in rows:
            half = len(a) // 2
            want.add(hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest())
    assert all(r.edited_sha256 in want for r in got) and len(texts) == 900
    base = docs.select(fingerprints.F.col("doc_id"), "text")
    chained = fingerprints.with_next(base, "doc_id", "text", lambda d: d, ["doc_id", "text"], range_chars=300).collect()
    assert sorted(r.next_text for r in chained) == sorted(t for _, t in rows)
    order = sorted({k for k, _ in rows}, key=lambda k: (k is not None, k))
    follows = dict(zip(order, [*order[1:], order[0]]))
    assert all(r.next_doc_id in (r.doc_id, follows[r.doc_id]) for r in chained)
    assert sum(r.next_doc_id != r.doc_id for r in chained) == len(order)


def test_search_of_a_key_with_many_vectors(spark):
    rows = [(0, [1.0, i / 1000]) for i in range(30)] + [(i, [0.5, i / 1000]) for i in range(1, 20)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ann.F.col("vec_id") == 0, k=5, target=1.0).collect()
    assert len(got) == 5 and 0 not in {r.vec_id for r in got}


def plain_detections(text):
    """Rules by Python's own expressions on lists of words, and suppression pair by pair."""
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    form, found = " " + " ".join(words) + " ", []
    for i, r in enumerate(licenses.rules()):
        if any(k in form for k in r.keywords.split("|")):
            for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", form):
                start = form[: m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" ") + 1, i, r.label, r.priority))

    def beats(o, d):
        size = (o[1] - o[0]) - (d[1] - d[0])
        return o[0] <= d[0] and o[1] >= d[1] and (o[4] > d[4] or o[4] == d[4] and (size > 0 or size == 0 and o[2] < d[2]))

    return sorted((d[0], d[1], d[3]) for d in found if not any(beats(o, d) for o in found))


def test_licence_detections_equal_a_plain_scan(spark):
    texts = [
        "CC BY-SA 4.0", "Apache License, Version 2.0", "see https://www.apache.org/licenses/LICENSE-2.0.txt or www.gnu.org/licenses/gpl-3.0.html",
        "Permission is hereby granted, free of charge, to any person obtaining a copy. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. Provided AS IS, without warranty of any kind.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the University nor the names of its contributors may be used to endorse or promote products.",
        "This program is free software: redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License. Copyright (c) 2020 X. All rights reserved.",
        "Released under the MIT License. " * 40 + "Licensed under CC BY-NC-ND 4.0, GPLv3, GPL v2 and the BSD 3-Clause License. " * 40, "nothing here", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        assert sorted((d.start, d.stop, d.label) for d in r.detections) == plain_detections(texts[r.doc_id])
    labels = [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()]
    assert labels[0] == "cc-by,cc-by-sa-4.0" and labels[1] == "apache-2.0" and "gpl" in labels[2] and "mit" in labels[3] and "bsd-3-clause" in labels[4]


def test_licences_of_a_very_long_text(spark):
    text = "Licensed under the CC BY-NC-SA 4.0 license. Copyright 2020 foo, all rights reserved. " * 1_500
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_base == 3_000 and len(row.detections) == 4_500
