"""Exact n-gram Jaccard links between documents, through a token-group matrix.

Two documents link when the Jaccard similarity of their shingle sets is at
least `percent` / 100; the result is each document's component of links.  All
links between different sets count; none is looked for by chance.

1. Equal sets are one *class*, however many documents hold it.
2. Shingles have one global order: by hash, but the heaviest ones (a bounded
   list, counted over all documents) last.  Two sets that link share at least
   `slack(n)` shingles among the first `prefix(n)` of each, so only those
   shingles are shuffled, once, and only the ones that two classes share stay.
   Classes with too few of them link with nothing and are done.
3. The other classes are partitioned into groups by the smallest shared
   shingle under several hashes, groups into blocks of about `block` classes.
   A block's sets form a matrix of classes and shingles; its products give all
   overlaps in the block.  Links merge classes into components.
4. What may still link lies in two components and shares a prefix shingle.
   Groups are now the components, again in blocks.  The place of a shingle in a
   set's order bounds the size of sets that it can link with through that
   shingle; places that reach no set of another component go.  The union of each
   group's other prefix shingles is stored, with bounds on sizes.  Only groups
   that a query class meets there, each within the other's reach, in another
   component, are opened: their sets and those of the queries meet, a query's
   overlap with the union of the whole sets bounds its overlap with every
   member, and the overlaps that are left are counted exactly.

A large group of near copies becomes one component in step 3, where each class
meets about `block` others a round.  Copies with so many shingles of their own
that they can't link have all of the group's shingles out of reach.  So neither
costs step 4 anything; sets that stay just below the threshold among each other,
without a common set that they link with, do meet there, by class and block.

Shingles are compared by 64-bit hashes, classes by a 64-bit hash of their set.

Defined results: null text is an empty one; texts without words have an empty
set and are a component of their own; documents with null keys are left out of
links and have a null component; repeated keys and rows stay rows of their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import scratch
from millrace.llm.components import components
from millrace.llm.shingles import shingle_sets
from millrace.llm.tokens import _begins, bounded, column_runs, forget

#: Heaviest shingles that go last in the order; a bound on what is broadcast.
HEAVY = 1 << 16
#: A shingle counts as heavy in a run of texts from so many documents on.
HEAVY_IN_RUN = 4
RUN_BYTES = 8_000_000
#: Queries that meet one group in a task.
ASKS = 256
#: Bits of the map of wanted keys: 2 MB, whatever the table.
WANTED_BITS = 1 << 24


@dataclass(frozen=True)
class Rule:
    """Shingle length and threshold, with the sizes that follow from them."""

    words: int = 4
    percent: int = 85
    slack_share: float = 0.08

    def least(self, n):
        """Shingles that a set of n must share with any set it links with."""
        return -(-self.percent * n // 100)

    def slack(self, n):
        """Prefix shingles that two linked sets of at least n shingles share."""
        return 1 + (n * self.slack_share).astype(int) if isinstance(n, np.ndarray) else 1 + int(n * self.slack_share)

    def prefix(self, n: int) -> int:
        return min(n, n - self.least(n) + self.slack(n))

    def links(self, overlap, n, m):
        """Whether sets of n and m shingles with that overlap link: exact, in whole numbers."""
        return (100 + self.percent) * overlap >= self.percent * (n + m)


def _signature(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _members(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows of documents (key, class, size), and of heavy shingles of a run of texts (shingle, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keys = batch.column(0)
            for of, texts in column_runs(batch.column(1), RUN_BYTES):
                sets = shingle_sets(texts, rule.words)
                n = [len(s) for s in sets]
                classes = [_signature(s) for s in sets]
                distinct = list({c: s for c, s in zip(classes, sets)}.values())
                shingle, count = np.unique(np.concatenate(distinct), return_counts=True)
                heavy = count >= HEAVY_IN_RUN
                m = int(heavy.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([keys[of.start : of.stop], pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(classes, pa.int64()), pa.array(_signed(shingle[heavy]))]),
                    pa.concat_arrays([pa.array(n, pa.int64()), pa.array(count[heavy])]),
                    pa.array([False] * len(n) + [True] * m),
                ], ["key", "class", "n", "heavy"])

    return docs.mapInArrow(run, "key long, class long, n long, heavy boolean")


def _prefixes(docs: DataFrame, rule: Rule, heavy: np.ndarray) -> DataFrame:
    """Prefix shingles of every class, as (shingle, class, place); a task gives a class once.

    `place` is the shingle's in the class's order, from 1.  It is negative unless
    the shingle is known to be shared: heavy ones are, and those that two classes
    of a run of texts have.  Of such a pair or more, one row goes with a negative
    place too, so that other runs meet it: those rows of a shingle are one a run
    at most.
    """
    order = np.argsort(heavy)
    shared = docs.sparkSession.sparkContext.broadcast((heavy[order], order))  # at most HEAVY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavies, rank = shared.value
        seen: set[int] = set()
        forget()
        for batch in batches:
            for _, texts in column_runs(batch.column(1), RUN_BYTES):
                if len(seen) > 2_000_000:
                    seen.clear()
                out, classes, sizes = [], [], []
                for s in shingle_sets(texts, rule.words):
                    if not len(s) or (c := _signature(s)) in seen:
                        continue
                    seen.add(c)
                    at = s >> np.uint64(1)
                    if len(heavies):
                        spot = np.minimum(np.searchsorted(heavies, s), len(heavies) - 1)
                        is_heavy = heavies[spot] == s
                        at = np.where(is_heavy, np.uint64(1 << 63) + rank[spot].astype(np.uint64), at)
                    first = s[np.argsort(at, kind="stable")[: rule.prefix(len(s))]]
                    out.append(first)
                    classes.append(c)
                    sizes.append(len(first))
                if not out:
                    continue
                flat, of = np.concatenate(out), np.repeat(np.array(classes, np.int64), sizes)
                place = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes])
                order = np.argsort(flat, kind="stable")
                flat, of, place = flat[order], of[order], place[order]
                same = np.zeros(len(flat) + 1, bool)  # as the one before
                same[1:-1] = flat[1:] == flat[:-1]
                known = np.isin(flat, heavies) | same[:-1] | same[1:]
                some = np.flatnonzero(same[1:] & ~same[:-1] & ~np.isin(flat, heavies))
                place = np.where(known, place, -place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate([flat, flat[some]]))), pa.array(np.concatenate([of, of[some]])), pa.array(np.concatenate([place, -place[some]]))],
                    ["shingle", "class", "place"],
                )

    return docs.mapInArrow(run, "shingle long, class long, place int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The distinct (shingle, class, place) of which a shingle has two classes.

    What a task can tell needs no window, so a frequent shingle has few rows in its own.
    """
    of = Window.partitionBy("shingle")
    rare = prefixes.where("place < 0").select(
        "shingle", "class", (-F.col("place")).alias("place"), F.min("class").over(of).alias("lo"), F.max("class").over(of).alias("hi")
    )
    rare = rare.where("lo <> hi").select("shingle", "class", "place")
    return rare.union(prefixes.where("place > 0")).distinct()


def _wanted(active: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of wanted keys: `WANTED_BITS` bits, whatever the number of keys.

    As it fills, more keys pass that nobody wants; their sets are left unread.
    """
    at = F.pmod(F.xxhash64("key", F.lit("wanted")), F.lit(WANTED_BITS))
    words = active.select((at / 32).cast("long").alias("word"), F.pow(F.lit(2.0), at % 32).cast("long").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(WANTED_BITS // 32, np.uint32)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return bits


def _sets(docs: DataFrame, active: DataFrame, rule: Rule) -> DataFrame:
    """(class, row, n, set) of at least the documents that stand for active classes.

    The scan is filtered by the bitmap, so no text is shuffled.  A task gives a
    class once, several tasks may give the same one: `_once` picks its row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_wanted(active))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        seen: set[int] = set()
        for batch in batches:
            at = batch.column(2).to_numpy()
            pick = np.flatnonzero(bits[at >> 5] >> (at & 31).astype(np.uint32) & 1)
            rows = batch.column(3).take(pa.array(pick)).to_pylist()
            for of, texts in column_runs(batch.column(1).take(pa.array(pick)), RUN_BYTES):
                sets, classes, places = [], [], []
                for s, row in zip(shingle_sets(texts, rule.words), rows[of]):
                    if not len(s) or (c := _signature(s)) in seen:
                        continue
                    seen.add(c)
                    sets.append(s)
                    classes.append(c)
                    places.append(row)
                if len(seen) > 2_000_000:
                    seen.clear()
                begin = _begins([len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(classes, pa.int64()), pa.array(places, pa.int64()), pa.array(np.diff(begin)),
                    pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(_signed(flat))),
                ], ["class", "row", "n", "set"])

    at = F.pmod(F.xxhash64("key", F.lit("wanted")), F.lit(WANTED_BITS))
    rows = docs.where("key is not null").select("key", "text", at.alias("at"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "class long, row long, n long, set array<long>")


def _once(active: DataFrame, sets: DataFrame) -> DataFrame:
    """`active` with the one row of `sets` that stands for the class; no set is shuffled for it."""
    return active.join(sets.groupBy("class").agg(F.min("row").alias("row")), "class")


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Classes, sizes, and the (row, column) ones of the matrix for shingles that two rows hold."""
    table = table.combine_chunks()
    lists = table["set"].chunk(0)
    begin = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()[begin[0] : begin[-1]]
    row = np.repeat(np.arange(len(lists)), np.diff(begin))
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    renamed = np.cumsum(count > 1) - 1
    return table["class"].to_numpy(), table["n"].to_numpy(), np.array([row[keep], renamed[column[keep]]]), int((count > 1).sum())


def _overlaps(ones: np.ndarray, n_rows: int, n_columns: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Overlaps of the `rows` with the `columns` (rows too), by products of slices of the matrix."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(ones[1], kind="stable")
    row, column = ones[0][order], ones[1][order]
    step = max(1 << 10, (1 << 21) // max(1, n_rows))  # slices of about 8 MB
    for lo in range(0, n_columns, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((n_rows, min(step, n_columns - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part[rows] @ part[columns].T
    return out


def _forest(links: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links: as good for components as all of them."""
    n = len(names)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(links)):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(names[i]), int(names[j])))
    return out


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*found) if found else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _block_links(blocks: DataFrame, rule: Rule) -> DataFrame:
    """Links in each block: every pair of its classes is compared."""

    def compare(table: pa.Table) -> pa.Table:
        if len(table) < 2:
            return _edges([])
        names, n, ones, columns = _matrix(table)
        every = np.arange(len(n))
        overlap = _overlaps(ones, len(n), columns, every, every)
        return _edges(_forest(np.triu(rule.links(overlap, n[:, None], n[None, :]), 1), names))

    return blocks.groupBy("r", "group", "block").applyInArrow(compare, "a long, b long")


def _pair_links(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links of queries with members of a group, rows of (one, other, class, n, set, asks, member)."""

    def compare(table: pa.Table) -> pa.Table:
        names, n, ones, columns = _matrix(table)
        asks, member = (table[c].to_numpy().astype(bool) for c in ("asks", "member"))
        queries, group = np.flatnonzero(asks), np.flatnonzero(member)
        # the bound again, by whole sets: a query's overlap with the group's token union
        union = np.zeros(columns, bool)
        union[ones[1][member[ones[0]]]] = True
        bound = np.bincount(ones[0][union[ones[1]]], minlength=len(n))
        queries = queries[bound[queries] >= rule.least(n[queries])]
        if not len(queries) or not len(group):
            return _edges([])
        overlap = _overlaps(ones, len(n), columns, queries, group)
        linked = np.zeros((len(n), len(n)), bool)
        linked[np.ix_(queries, group)] = rule.links(overlap, n[queries][:, None], n[group][None, :])
        np.fill_diagonal(linked, False)
        return _edges(_forest(linked, names))

    return rows.groupBy("one", "other").applyInArrow(compare, "a long, b long")


def _in_blocks(classes: DataFrame, by: list[str], seed: int, block: int) -> DataFrame:
    """Adds `block`: a group's classes, dealt by hash into blocks of about that size.

    Sizes are written first: joined as they come, their partitioning would be
    kept, and a large group's rows could not be split between tasks.
    """
    sizes = scratch.table(classes.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1"), "group-sizes")
    parts = F.ceil(F.col("_n") / F.lit(block)).cast("long")
    return classes.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("class", F.lit(seed)), parts)).drop("_n")


def _reach(spots: DataFrame, rule: Rule) -> DataFrame:
    """Spots (shingle, class, place, n) with `most`: the largest size of a set that links through the spot.

    Sets of n and m that link share o >= (n + m) * percent / (100 + percent)
    shingles; the first of these stands at place n - o + 1 or before in the one,
    m - o + 1 or before in the other.  So a later place is for smaller sets only.
    """
    most = F.floor((F.col("n") - F.col("place") + 1) * (100 + rule.percent) / rule.percent) - F.col("n")
    return spots.withColumn("most", most).where(F.col("most") * 100 >= F.col("n") * rule.percent)


def _open(spots: DataFrame) -> DataFrame:
    """The spots whose shingle a set of another component has, too, as far as sizes allow a link."""
    facts = spots.groupBy("shingle").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("smallest"), F.max("most").alias("largest")
    )
    facts = facts.where("lo <> hi").select("shingle", "smallest", "largest")
    found = spots.join(facts, "shingle").where("smallest <= most and n <= largest")
    return found.select("shingle", "class", "n", "most", "component", "id")


def _unions(spots: DataFrame) -> DataFrame:
    """Each group's union of shingles, with bounds on its sets that have the shingle."""
    return spots.groupBy("shingle", "id").agg(
        F.min("component").alias("c_lo"), F.max("component").alias("c_hi"),
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("most").alias("most"),
    )


def _candidates(asks: DataFrame, unions: DataFrame, rule: Rule) -> DataFrame:
    """(one, class): a group, and a class that may link with one of its sets in another component."""
    x, y = asks.alias("x"), unions.alias("y")
    apart = (
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") <= F.col("y.id"))
        & ((F.col("x.component") != F.col("y.c_lo")) | (F.col("x.component") != F.col("y.c_hi")))
        & (F.col("x.n") * 100 >= F.col("y.n_lo") * rule.percent) & (F.col("y.n_hi") * 100 >= F.col("x.n") * rule.percent)
        & (F.col("y.n_lo") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most"))
    )
    return x.join(y, apart).select(F.col("y.id").alias("one"), F.col("x.class").alias("class")).distinct()


def linked(
    docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
    block: int = 48, rounds: int = 3, slack_share: float = 0.08,
) -> DataFrame:
    """(key, class, n_shingles, component): component is the smallest key reachable by links."""
    rule = Rule(words, percent, slack_share)
    bounded(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    first = scratch.table(_members(base, rule), "classes")
    members = first.where("not heavy").select("key", "class", "n")
    heaviest = (
        first.where("heavy").groupBy("class").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "class").limit(HEAVY).toArrow()
    )
    heavy = heaviest["class"].to_numpy()[::-1].view(np.uint64).copy()  # the heaviest last

    shared = scratch.table(_shared(_prefixes(base, rule, heavy)), "shared")
    # only keys make a document reachable; of a class, its smallest key
    classes = members.where("key is not null and n > 0").groupBy("class").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    smallest = F.floor(F.col("n") * percent / 100)
    needed = 1 + F.floor(smallest * F.lit(rule.slack_share)).cast("long")
    counts = shared.groupBy("class").agg(
        F.count("*").alias("shared"),
        *[F.min_by("shingle", F.xxhash64("shingle", F.lit(r))).alias(f"group{r}") for r in range(rounds)],
    )
    wanted = scratch.table(counts.join(classes, "class").where(F.col("shared") >= needed), "wanted")
    sets = scratch.table(_sets(base, wanted, rule), "sets")
    active = scratch.table(_once(wanted, sets), "active")

    # step 3: rounds of blocks by smallest shared shingle
    tagged = active.select(
        "class", "row", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"group{r}").alias("group")) for r in range(rounds)])).alias("g")
    ).select("class", "row", "g.r", "g.group")
    dealt = _in_blocks(tagged, ["r", "group"], 1, block)
    inner = scratch.table(_block_links(dealt.join(sets, ["class", "row"]).drop("row"), rule), "inner-links")
    merged = scratch.table(components(inner), "merged")

    # step 4: what may link across components
    of = active.join(merged.withColumnRenamed("node", "class"), "class", "left")
    of = of.select("class", "row", "n", "group0", F.coalesce("component", "class").alias("component"), F.col("component").isNotNull().alias("large"))
    of = of.withColumn("group", F.when(F.col("large"), F.col("component")).otherwise(F.col("group0")))
    size = scratch.table(of.groupBy("large", "group").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("parts")), "group-sizes")
    named = of.join(size, ["large", "group"]).withColumn("part", F.pmod(F.xxhash64("class", F.lit(2)), "parts"))
    named = scratch.table(named.withColumn("id", F.xxhash64("large", "group", "part")).select("class", "row", "n", "component", "id"), "blocks")
    near = scratch.table(_open(_reach(shared.join(named, "class"), rule)), "near")
    asks = scratch.table(_open(near), "open")  # again, without the spots that reached nothing
    unions = scratch.table(_unions(asks), "unions")
    found = scratch.table(_candidates(asks, unions, rule), "pairs")
    parts = scratch.table(found.groupBy("one").agg(F.ceil(F.count("*") / F.lit(ASKS)).cast("long").alias("parts")), "parts")
    query = found.join(parts, "one").join(named.select("class", "row"), "class").select(
        "one", F.pmod(F.xxhash64("class", F.lit(3)), "parts").alias("other"), "class", "row", F.lit(1).alias("asks"), F.lit(0).alias("member")
    )
    members_of = parts.join(named, parts["one"] == named["id"]).select(
        "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"), "class", "row", F.lit(0), F.lit(1)
    )
    roles = query.union(members_of).groupBy("one", "other", "class", "row").agg(F.max("asks").alias("asks"), F.max("member").alias("member"))
    rows = roles.join(sets, ["class", "row"]).drop("row")
    across = _pair_links(rows, rule)
    # components of step 3 are nodes now: their stars and the new links
    stars = merged.select(F.col("node").alias("a"), F.col("component").alias("b"))
    last = components(across.union(stars))

    # names: a component's smallest key
    keyed = classes.select("class", "key").join(last.withColumnRenamed("node", "class"), "class", "left")
    keyed = keyed.withColumn("component", F.coalesce("component", "class"))
    least = keyed.groupBy("component").agg(F.min("key").alias("least"))
    names = scratch.table(keyed.join(least, "component").select("class", "least"), "names")
    scratch.drop(shared, wanted, active, sets, inner, merged, named, near, asks, unions, found, parts)
    out = members.join(names, "class", "left")
    component = F.when(F.col("n") == 0, F.col("key")).when(F.col("key").isNotNull(), F.col("least"))
    out = out.select("key", "class", F.col("n").alias("n_shingles"), component.alias("component"))
    out.millrace_reads = [first, names]  # what the result is read from
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    found = linked(docs, id_col=id_col, text_col=text_col, **how)
    return found.select(F.col("key").alias(id_col), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest key.

    Rows of one key stay or go together; rows with null keys stay.
    """
    found = linked(docs, id_col=id_col, text_col=text_col, **how)
    gone = found.where("key is not null").groupBy("key").agg(F.max(F.col("component") == F.col("key")).alias("stays"))
    name = scratch.unused(docs, "key")
    gone = scratch.table(gone.where("not stays").select(F.col("key").alias(name)), "near-copies")
    scratch.drop(*found.millrace_reads)
    return docs.join(gone.hint("merge"), F.col(id_col).cast("long") == F.col(name), "left_anti")
