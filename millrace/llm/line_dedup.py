"""Line deduplication by pairwise alignment of overlapping documents.

Documents overlap when they share a block: consecutive lines with `min_words`
words at least.  The hashes by which they find each other are those of *rare
lines*: a line that is long enough by itself, and shorter ones put together
with the lines that follow (or precede) until they just reach `min_words`.
Every line of a common block stands in such a run that both documents hold, so
no overlap is missed however frequent single lines are.  A run pairs a document
with the *earliest* one that holds it, never with all of them, so pairs grow
with lines and not with the square of a group.

Each pair is aligned by patience diff: common lines at both ends match; then
lines that occur once in each and are in both anchor the alignment along their
longest increasing sequence; the gaps between are treated alike.  A run of
lines that follow one another in both documents is a common block; blocks of at
least `min_words` words are deleted from the later document.  An alignment
keeps the order of lines: what it can't hold (blocks that moved, that repeat, or
lie in gaps without a unique line) is aligned by the shared runs themselves.
So a line goes just when it lies in a block that some earlier document has, and
the earliest one keeps it.

A later copy of a whole text is the alignment of equal documents: all its lines
go, if the text has that many words, without a comparison.

Lines are compared without the white space around them, by 64-bit hashes and
word counts; blank lines match nothing and don't part a block.

Defined results: null text stays null; empty texts, and rows with null keys,
stay as they are; documents are ordered by key, then by the text's hash; rows
of one key and text are one document and have the same result; a document of
which nothing remains has an empty text; other columns go along unchanged (one
named as the count is replaced); an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.tokens import _begins, bounded, forget

#: Documents paired with one earlier document that go to a task together.
FANS = 256
_ODD = 0x9E3779B97F4A7C15
_BLANKS = " \t\r\x0b\x0c"


def _anchors(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines once in each part and in both, along their longest increasing sequence."""
    once: dict = {}
    for i in range(a0, a1):
        once[a[i]] = None if a[i] in once else [i, -1]
    for j in range(b0, b1):
        spot = once.get(b[j])
        if spot:
            if spot[1] < 0:
                spot[1] = j
            else:
                once[b[j]] = None
    pairs = sorted((x[0], x[1]) for x in once.values() if x and x[1] >= 0)
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [k]
        back[k] = ends[at - 1] if at else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b) of two lists of lines, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, a0, a1, b0, b1)
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:]) if p + 1 < q and r + 1 < s]
    return sorted(out)


def _run_hashes(begin: np.ndarray, line: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, hash) of the runs of lines of documents that just reach `min_words` words.

    `begin` has the places where documents begin, and the end.  From each line
    one run goes forward and one back.  Sums of lines times powers of an odd
    number name them.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.arange(len(line))
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    ahead = np.searchsorted(total, total[:-1] + min_words)
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    first, end, doc = np.concatenate([at, back]), np.concatenate([ahead, at + 1]), np.concatenate([doc, doc])
    fits = (end <= begin[1:][doc]) & (first >= begin[:-1][doc])
    first, end = first[fits], end[fits]
    powers, roots = (np.cumprod(np.full(len(line) + 1, x, np.uint64)) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
    named = line.view(np.uint64) + words.astype(np.uint64) * np.uint64(_ODD)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(named * powers[:-1], dtype=np.uint64)])
    return first, end, ((sums[end] - sums[first]) * roots[first]).view(np.int64)


def common_blocks(later: np.ndarray, words: np.ndarray, earlier: np.ndarray, other_words: np.ndarray, min_words: int) -> np.ndarray:
    """Which lines of `later` lie in a common block with enough words: aligned by patience, the rest by shared runs."""
    a, b = later.tolist(), earlier.tolist()
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    gone = np.zeros(len(a), bool)
    start, last = 0, (-2, -2)
    for i, j in [*patience(a, b), (-1, -1)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if last[0] >= 0 and total[last[0] + 1] - total[start] >= min_words:
                gone[start : last[0] + 1] = True
            start = i
        last = (i, j)
    first, end, name = _run_hashes(np.array([0, len(a)]), later, words, min_words)
    kept = np.concatenate([[0], np.cumsum(~gone)])
    left = np.flatnonzero(kept[end] > kept[first])  # runs of which the alignment has left something
    if len(left):
        theirs, _, runs = _run_hashes(np.array([0, len(b)]), earlier, other_words, min_words)
        where = dict(zip(runs.tolist(), theirs.tolist()))
        for k in left.tolist():
            i, stop, j = int(first[k]), int(end[k]), where.get(int(name[k]), -1)
            if j >= 0 and a[i:stop] == b[j : j + stop - i]:
                gone[i:stop] = True
    return gone


def _lines(text: Column) -> Column:
    """The non-blank lines of a text with their places."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(_BLANKS)).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def _profile(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(row, key, copy, lines) of documents with enough words: the text's digest; each line's place, hash and words."""

    def facts(x: Column) -> Column:
        spaces = F.octet_length(x["line"]) - F.octet_length(F.replace(x["line"], F.lit(" "), F.lit("")))
        return F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("line"), (spaces + 1).alias("words"))

    words = F.aggregate("lines", F.lit(0), lambda n, x: n + x["words"])
    return docs.where(F.col(id_col).isNotNull() & (F.col(text_col) != "")).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("key"), _digest(F.col(text_col)).alias("copy"),
        F.transform(_lines(F.col(text_col)), facts).alias("lines"),
    ).where(words >= min_words)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _arrays(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Places where lists of structs begin and end, and the structs' fields."""
    begin = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(begin[0], begin[-1] - begin[0])
    return begin - begin[0], {f.name: flat.field(i).to_numpy() for i, f in enumerate(flat.type)}


def _runs(originals: DataFrame, min_words: int) -> DataFrame:
    """(doc, run): the hashes of each document's runs, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            begin, of = _arrays(batch.column(1))
            first, _, name = _run_hashes(begin, of["line"], of["words"], min_words)
            doc = np.searchsorted(begin, first, "right") - 1
            order = np.lexsort((name, doc))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(doc[order]) != 0) | (name[order][1:] != name[order][:-1])
            order = order[new]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[order])), pa.array(name[order])], ["doc", "run"])

    return originals.select("doc", "lines").mapInArrow(run, "doc struct<key:bigint,copy:binary>, run bigint")


def _pairs(originals: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Each (doc, earliest, fan) of documents that overlap, and the table that it is read from.

    A fan holds some of the documents paired with an earlier one: `FANS` of
    them if each run's documents were all there are.
    """
    held = scratch.table(_runs(originals, min_words), "held-runs")
    # a count for each run, added up before the shuffle: a run in every document is one row a task
    shared = held.groupBy("run").agg(F.count("*").alias("docs"), F.min("doc").alias("earliest")).where("docs > 1")
    # written first: joined as it comes, its partitioning would be kept, and a frequent run's rows stay in one task
    shared = scratch.table(shared, "shared-runs")
    found = held.join(shared, "run").where(F.col("earliest") != F.col("doc"))
    pairs = found.groupBy("doc", "earliest").agg(F.max("docs").alias("docs"))
    fans = F.ceil(F.col("docs") / F.lit(FANS)).cast("long")
    fan = F.struct(fans.alias("fans"), F.pmod(F.xxhash64("doc"), fans).alias("nth"))
    return scratch.table(pairs.select("doc", "earliest", fan.alias("fan")), "pairs"), held


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """(key, copy, whole, drop): for documents that lose lines, whether all go, or the places of those that do."""
    bounded(docs.sparkSession)
    profile = scratch.table(_profile(docs, id_col, text_col, min_words), "line-profile")
    # equal texts are told by row and by (key, copy), so that no task gets all of them
    firsts = profile.groupBy("copy").agg(F.min(F.struct("key", "row")).alias("first"))
    firsts = scratch.table(firsts.select("copy", "first.key", "first.row"), "firsts")
    originals = profile.join(firsts.select("row"), "row", "left_semi").select(F.struct("key", "copy").alias("doc"), "lines")
    originals = scratch.table(originals, "originals")
    copies = profile.select("key", "copy").distinct().join(firsts.select("key", "copy"), ["key", "copy"], "left_anti")
    pairs, held = _pairs(originals, min_words)
    later = originals.select("doc", F.col("lines").alias("own"))
    other = F.transform("lines", lambda x: F.struct(x["line"], x["words"]))
    earlier = originals.select(F.col("doc").alias("earliest"), other.alias("other"))
    # an earlier document's lines go once to each of its fans, not all its pairs to one task
    fanned = pairs.select("earliest", "fan").distinct().join(earlier, "earliest")
    sides = pairs.join(fanned, ["earliest", "fan"]).join(later, "doc").select("doc", "own", "other")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            (own, mine), (other, theirs) = _arrays(batch.column(1)), _arrays(batch.column(2))
            drops = []
            for p, q, r, s in zip(own[:-1], own[1:], other[:-1], other[1:]):
                gone = common_blocks(mine["line"][p:q], mine["words"][p:q], theirs["line"][r:s], theirs["words"][r:s], min_words)
                drops.append(mine["at"][p:q][gone])
            begin = _begins([len(d) for d in drops])
            flat = np.concatenate(drops).astype(np.int32) if drops else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc", "drop"])

    aligned = sides.mapInArrow(align, "doc struct<key:bigint,copy:binary>, drop array<int>").where(F.size("drop") > 0)
    cut = aligned.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("drop"))).alias("drop"))
    whole = copies.select("key", "copy", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("drop"))
    out = scratch.table(cut.select("doc.key", "doc.copy", F.lit(False).alias("whole"), "drop").union(whole), "deletions")
    scratch.drop(profile, firsts, originals, held, pairs)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, count_col: str = "n_deleted") -> DataFrame:
    """`docs` without the common blocks of later documents, and the number of lines each lost."""
    names = [n for n in docs.columns if n != count_col]
    key, copy, whole, drop = (scratch.unused(docs, n) for n in ("_key", "_copy", "_whole", "_drop"))
    gone = deletions(docs, id_col, text_col, min_words)
    gone = gone.select(F.col("key").alias(key), F.col("copy").alias(copy), F.col("whole").alias(whole), F.col("drop").alias(drop))
    at = (F.col(id_col).cast("long") == F.col(key)) & (F.when(F.col(text_col) != "", _digest(F.col(text_col))) == F.col(copy))
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    kept = F.transform(F.filter(lines, lambda x: ~F.array_contains(F.col(drop), x["at"])), lambda x: x["line"])
    # what is left of a text of which only blank lines remain is empty
    left = F.array_join(kept, "\n")
    left = F.when(F.trim(F.replace(left, F.lit("\n"), F.lit(" ")), F.lit(_BLANKS)) == "", "").otherwise(left)
    text = F.when(F.col(whole).isNull(), F.col(text_col)).when(F.col(whole), "").otherwise(left)
    # always by a shuffle: the table of deletions grows with the documents
    out = docs.join(gone.hint("merge"), at, "left")
    count = F.when(F.col(whole).isNull(), 0).when(F.col(whole), F.size(_lines(F.col(text_col)))).otherwise(F.size(drop)).cast("int")
    return out.select(*[text.alias(n) if n == text_col else F.col(n) for n in names], count.alias(count_col))
