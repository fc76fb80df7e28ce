"""Nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on the driver to a bounded sample of the vectors
(`sample_rows`, those with the smallest key hashes); every vector is then put
into a leaf.  A query walks the tree best bin first: a priority queue holds
nodes by what their rows may reach, the inner product of query and centre and a
share (`reach`) of the query's length times the node's spread.  The best node is
opened next, and leaves come out in the order in which they are visited.

How many leaves to visit is calibrated against brute force: for a bounded set
of query vectors the true neighbours among *all* rows are found in one pass,
and visits are widened until the walk would have met `target` of them.

Equal vectors are folded into one before anything else: of a vector's rows only
the `k + 1` with the smallest keys can be among `k` nearest, so a vector that
holds a third of all rows costs no more than another.  Leaves lie in *bundles*
of about `block_rows` rows; a leaf with more rows is cut into blocks.  A query
goes once to each bundle in which it visits a leaf, is scored against the rows
of those leaves only, and leaves its `k` best rows of the bundle.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do those whose dimension is not the commonest
(the smaller one on a tie), nor rows with a null key.  Rows with one key and
one vector are one row.  A query finds no row with its own key.  Ties go to the
smaller key.  Without vectors or queries there are no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import scratch
from millrace.llm.tokens import bounded

#: Queries that meet a bundle in one task.
ASKS = 512


class Tree:
    """Centres and spreads of a hierarchical k-means; children of a node are numbered on."""

    def __init__(self, vectors: np.ndarray, branches: int = 8, leaf_rows: int = 12, reach: float = 0.3, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.reach = reach
        self.centres: list[np.ndarray] = [vectors.mean(axis=0)]
        self.spreads: list[float] = [_spread(vectors, self.centres[0])]
        self.children: list[list[int]] = [[]]
        todo = [(0, vectors)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            label, centres = _k_means(rows, branches, rng)
            if len(centres) < 2:
                continue
            for k, centre in enumerate(centres):
                held = rows[label == k]
                self.centres.append(centre)
                # a leaf of few rows says little about its spread: the node above has a part in it
                own, share = _spread(held, centre), 1 / len(held)
                self.spreads.append((own**2 * (1 - share) + self.spreads[node] ** 2 * share) ** 0.5)
                self.children.append([])
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, held))
        self.points, self.wide = np.array(self.centres), np.array(self.spreads)
        self.leaves = [i for i, c in enumerate(self.children) if not c]

    def in_order(self) -> list[int]:
        """The leaves from left to right: neighbours in the tree stand together."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            todo += self.children[node][::-1]
            if not self.children[node]:
                out.append(node)
        return out

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every node."""
        at = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                continue
            centres = self.points[kids]
            near = ((centres**2).sum(axis=1) - 2 * vectors[rows] @ centres.T).argmin(axis=1)
            at[rows] = np.array(kids)[near]
            todo += [(kid, rows[near == k]) for k, kid in enumerate(kids)]
        return at

    def walk(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves that a best-bin-first walk visits."""
        score = self.points @ query + self.reach * np.linalg.norm(query) * self.wide
        queue, out = [(-score[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-score[kid], kid))
            else:
                out.append(node)
        return out


def _spread(rows: np.ndarray, centre: np.ndarray) -> float:
    return float(np.sqrt(((rows - centre) ** 2).sum(axis=1).mean()))


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12):
    """Labels and centres of Lloyd's method; empty clusters are left out."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        label = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
        used = np.unique(label)
        new = np.array([rows[label == j].mean(axis=0) for j in used])
        if len(new) == len(centres) and np.allclose(new, centres):
            break
        centres = new
    label = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
    used = np.unique(label)
    return np.searchsorted(used, label), centres[used]


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, and one that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def folded(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest keys, as (v, keys)."""
    order = Window.partitionBy("v").orderBy("key")
    least = rows.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(scores: np.ndarray, keys: list[list[int]], own: int, k: int) -> Iterator[tuple[int, float]]:
    """The k best (key, score) of one query, ties to the smaller key."""
    wide, found = k + 1, []
    while len(found) < k:  # a row more than k, as one may be the query's own
        wide = min(len(scores), wide)
        bound = np.partition(scores, len(scores) - wide)[len(scores) - wide]
        found = [(-float(scores[i]), key) for i in np.flatnonzero(scores >= bound) for key in keys[i] if key != own]
        if wide == len(scores):
            break
        wide *= 2
    for s, key in heapq.nsmallest(k, found):
        yield key, -s


def _bundles(tree: Tree, sizes: dict[int, int], block_rows: int) -> tuple[dict[int, int], list[int]]:
    """The bundle of each leaf, and the row blocks of each bundle: leaves in tree order, about `block_rows` rows each."""
    of, blocks, held = {}, [], 0
    for leaf in tree.in_order():
        n = sizes.get(leaf, 0)
        if not blocks or held + n > block_rows:
            blocks.append(1)
            held = 0
        of[leaf] = len(blocks) - 1
        held += n
        if n > block_rows:  # alone in its bundle
            blocks[-1] = -(-n // block_rows)
            held = block_rows
    return of, blocks


def _meeting(points: np.ndarray, leaf: np.ndarray, keys: list[list[int]], asks: np.ndarray, visits: list[list[int]], own: list[int], k: int) -> Iterator[tuple[int, int, float]]:
    """(query, key, score): each query's k best rows among those of the leaves that it visits."""
    order = np.argsort(leaf, kind="stable")
    names, first = np.unique(leaf[order], return_index=True)
    ends = np.append(first[1:], len(order))
    where = {int(name): i for i, name in enumerate(names)}
    askers: list[list[int]] = [[] for _ in names]
    for q, some in enumerate(visits):
        for name in some:
            if name in where:
                askers[where[name]].append(q)
    found_q, found_r, found_s = [], [], []
    for a, b, some in zip(first, ends, askers):
        if some:
            rows = order[a:b]
            found_s.append((asks[some] @ points[rows].T).ravel())
            found_q.append(np.repeat(some, b - a))
            found_r.append(np.tile(rows, len(some)))
    if not found_q:
        return
    q, r, s = np.concatenate(found_q), np.concatenate(found_r), np.concatenate(found_s)
    order = np.lexsort((-s, q))
    q, r, s = q[order], r[order], s[order]
    edges = np.flatnonzero(np.append(True, q[1:] != q[:-1])).tolist() + [len(q)]
    for a, b in zip(edges, edges[1:]):
        ask = own[q[a]]
        wide, stop, best = k, a, []
        while len(best) < k and stop < b:  # a row more than k, as one may be the query's own, and all that tie with the last
            stop = a + int(np.searchsorted(-s[a:b], -s[min(b - 1, a + wide)], "right"))
            best = heapq.nsmallest(k, ((-float(s[i]), key) for i in range(a, stop) for key in keys[r[i]] if key != ask))
            wide *= 2
        yield from ((ask, key, -t) for t, key in best)


def search(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = 20, target: float = 0.95, sample_rows: int = 16_384, calibration_rows: int = 256,
    branches: int = 8, leaf_rows: int = 12, reach: float = 0.3, block_rows: int = 4_096,
) -> DataFrame:
    """Each query's k nearest rows; `queries` is a condition on the key `id_col`."""
    spark = vectors.sparkSession
    bounded(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    base = vectors.where(queries.isNotNull()).select(
        F.col(id_col).cast("long").alias("key"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks")
    ).where(F.col("key").isNotNull() & usable(F.col("v")))
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0].d
    base = scratch.table(base.where(F.size("v") == dim), "vectors")
    distinct = scratch.table(folded(base.select("key", "v"), k), "distinct-vectors")

    # the tree: a bounded sample, the same whatever the partitions
    sample = distinct.orderBy(F.xxhash64("v"), F.col("keys")[0]).select("v").limit(sample_rows).toArrow()
    tree = Tree(_matrix(sample.column(0).combine_chunks()), branches, leaf_rows, reach)
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaf = shared.value.leaf(_matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["v", "keys", "leaf"])

    placed = scratch.table(distinct.mapInArrow(place, "v array<double>, keys array<long>, leaf long"), "leaves")
    # a number a leaf, and no more leaves than rows of the sample
    sizes_of = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    bundle_of, blocks_of = _bundles(tree, sizes_of, block_rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt over tasks: the scan of a table of vectors may be a single one
    asked = base.where("asks").select("key", "v").distinct().repartition(parts, "key")
    visits = _calibrate(placed, asked, tree, k, target, calibration_rows)
    plan = spark.sparkContext.broadcast((tree, bundle_of))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bundle_of = plan.value
        for batch in batches:
            row, bundle, leaves = [], [], []
            for i, q in enumerate(_matrix(batch.column(1)) if len(batch) else ()):
                some: dict[int, list[int]] = {}
                for leaf in tree.walk(q, visits):
                    some.setdefault(bundle_of[leaf], []).append(leaf)
                row += [i] * len(some)
                bundle += some
                leaves += some.values()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(take) for c in batch.columns), pa.array(bundle, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["key", "v", "bundle", "leaves"]
            )

    visited = scratch.table(asked.mapInArrow(visit, "key long, v array<double>, bundle long, leaves array<long>"), "visits")
    asks_of = {r.bundle: r.n for r in visited.groupBy("bundle").agg(F.count("*").alias("n")).collect()}

    # row blocks and query blocks of bounded size meet: each row goes to all query blocks of its bundle, and back
    cuts = [(bundle, blocks_of[bundle], -(-n // ASKS)) for bundle, n in asks_of.items()]
    split = F.broadcast(spark.createDataFrame(cuts, "bundle long, blocks int, parts int"))  # a row a bundle
    names = spark.createDataFrame(list(bundle_of.items()), "leaf long, bundle long")  # a row a leaf
    rows = placed.join(F.broadcast(names), "leaf").join(split, "bundle").select(
        "bundle", F.pmod(F.xxhash64(F.col("keys")[0]), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "v", "keys", "leaf",
    )
    asks = visited.join(split, "bundle").select(
        "bundle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), "key", "v", "leaves",
    )
    pair = ["bundle", "block", "part"]

    def meet(of_rows: pa.Table, of_asks: pa.Table) -> pa.Table:
        found = []
        if len(of_rows) and len(of_asks):
            of_rows, of_asks = of_rows.combine_chunks(), of_asks.combine_chunks()
            found = list(_meeting(
                _matrix(of_rows["v"].chunk(0)), of_rows["leaf"].to_numpy(), of_rows["keys"].to_pylist(),
                _matrix(of_asks["v"].chunk(0)), of_asks["leaves"].to_pylist(), of_asks["key"].to_pylist(), k,
            ))
        columns = zip(*found) if found else [()] * 3
        types = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["query_id", "vec_id", "score"])

    met = rows.groupBy(*pair).cogroup(asks.groupBy(*pair)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a key with several vectors counts by its best one
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _calibrate(placed: DataFrame, asked: DataFrame, tree: Tree, k: int, target: float, most: int) -> int:
    """Leaves to visit so that a walk meets `target` of the true neighbours of some queries.

    The queries are at most `most`; their neighbours are those among all rows.
    """
    some = asked.orderBy(F.xxhash64("key"), "key").limit(most).collect()
    if not some:
        return 1
    shared = placed.sparkSession.sparkContext.broadcast((np.array([r.v for r in some], float), [r.key for r in some]))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = shared.value
        for batch in batches:
            if not len(batch):
                continue
            scores, keys, leaf = queries @ _matrix(batch.column(0)).T, batch.column(1).to_pylist(), batch.column(2).to_pylist()
            of = {key: leaf[i] for i, each in enumerate(keys) for key in each}
            found = [(n, key, of[key], s) for n, row in enumerate(scores) for key, s in _best(row, keys, own[n], k)]
            columns = zip(*found) if found else [()] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["n", "key", "leaf", "score"])

    order = Window.partitionBy("n").orderBy(F.desc("score"), "key")
    near = placed.mapInArrow(nearest, "n long, key long, leaf long, score double")
    true = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("n", "leaf").collect()
    rank_of = [{leaf: i for i, leaf in enumerate(tree.walk(np.array(r.v, float), len(tree.leaves)))} for r in some]
    met = np.sort([rank_of[r.n][r.leaf] for r in true])
    return int(met[min(len(met) - 1, int(np.ceil(target * len(met))) - 1)]) + 1 if len(met) else 1
