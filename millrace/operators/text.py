"""Corpora: dictionaries, co-occurrence, PMI, BM25, embeddings, analogies.

Tokens are words between spaces and line feeds that hold a letter, in lower
case without marks at their ends.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import vectors as V
from millrace.lineage import cut

#: Weight of a pair of words by their distance.
WEIGHTS = {"FIXED": lambda d: F.lit(1.0), "LINEAR": lambda d: 1 / d.cast("double"), "EXP": lambda d: F.exp(-0.1 * d)}


def normalized(word: Column) -> Column:
    """A word without marks at its ends, in lower case."""
    return V.normalize_word(word)


def tokens(df: DataFrame, key: str, text: str, letters: bool = True) -> DataFrame:
    """(key, line, pos, word): words of each line of each text."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "_line"))
    words = F.transform(F.filter(F.split("_line", " +"), lambda w: w.rlike(r"\p{L}") if letters else w != ""), normalized)
    return lines.select(key, "line", F.posexplode(words).alias("pos", "word"))


def dictionary(words: DataFrame, least: int = 5) -> DataFrame:
    """Words with their counts and a number by falling count, ties by the word."""
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1)


def cooccurrence(df: DataFrame, key: str, text: str, left: int, right: int, weight: str = "FIXED", vocabulary: DataFrame | None = None) -> DataFrame:
    """(a, b, x): weight of b in the window of a, over lines.

    A word pairs with the next `right` words of its line, and is paired by the
    next `left`.  Windows are made inside a row, so nothing is joined to itself.
    """
    lines = df.select(F.explode(F.split(text, "\n")).alias("_line"))
    words = F.transform(F.filter(F.split("_line", " +"), lambda w: w.rlike(r"\p{L}")), normalized)
    rows = lines.select(words.alias("w")).where(F.size("w") > 1)
    reach = max(left, right)

    def pairs(w: Column, i: Column) -> Column:
        ahead = F.slice(F.col("w"), i + 2, F.lit(reach))

        def both(v: Column, j: Column) -> Column:
            d = j + 1
            x = WEIGHTS[weight](d)
            one = F.when(d <= right, F.struct(w.alias("a"), v.alias("b"), x.alias("x")))
            other = F.when(d <= left, F.struct(v.alias("a"), w.alias("b"), x.alias("x")))
            return F.array(one, other)

        return F.flatten(F.transform(ahead, both))

    flat = rows.select(F.explode(F.flatten(F.transform("w", pairs))).alias("p")).where("p is not null").select("p.*")
    if vocabulary is not None:
        flat = flat.join(vocabulary.select(F.col("word").alias("a")), "a", "left_semi").join(vocabulary.select(F.col("word").alias("b")), "b", "left_semi")
    return flat.groupBy("a", "b").agg(F.sum("x").alias("x"))


def marginals(cooc: DataFrame) -> DataFrame:
    """(word, as_left, as_right): sums of rows and columns."""
    both = cooc.select(F.col("a").alias("word"), F.col("x").alias("l"), F.lit(0.0).alias("r")).union(
        cooc.select(F.col("b"), F.lit(0.0), F.col("x"))
    )
    return both.groupBy("word").agg(F.sum("l").alias("as_left"), F.sum("r").alias("as_right"))


def pmi(cooc: DataFrame) -> DataFrame:
    """(a, b, x, pmi): ln x - ln left(a) - ln right(b) + ln total."""
    left = cooc.groupBy("a").agg(F.sum("x").alias("l"))
    right = cooc.groupBy("b").agg(F.sum("x").alias("r"))
    total = cooc.agg(F.sum("x").alias("t"))
    out = cooc.join(left, "a").join(right, "b").crossJoin(F.broadcast(total))  # one row
    return out.select("a", "b", "x", (F.log("x") - F.log("l") - F.log("r") + F.log("t")).alias("pmi"))


def bm25(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, tf, weight): tf / (tf + 2 + length / 300) / ln(frequency + 2)."""
    words = tokens(df, key, text)
    tf = words.groupBy(key, "word").agg(F.count("*").alias("tf"))
    size = words.groupBy(key).agg(F.count("*").alias("size"))
    frequency = tf.groupBy("word").agg(F.sum("tf").alias("frequency"))
    out = tf.join(size, key).join(frequency, "word")
    weight = F.col("tf") / (F.col("tf") + 2 + F.col("size") / 300.0) / F.log(F.col("frequency") + 2.0)
    return out.select(key, "word", "tf", weight.alias("weight"))


def trigrams(words: DataFrame) -> DataFrame:
    """Character trigrams of words between # marks, with counts."""
    marked = F.concat(F.lit("#"), F.col("word"), F.lit("#"))
    grams = F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substring(marked, i, F.lit(3)))
    return words.where(F.length("word") > 0).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def pair_merges(df: DataFrame, text: str, steps: int) -> list[tuple[str, str]]:
    """A dictionary of variable-length grams: the most frequent neighbours merge, step by step.

    Each step counts pairs in one aggregation; the driver sees one pair.
    """
    rows = df.select(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.struct(c.alias("s"))).alias("w"))
    merges: list[tuple[str, str]] = []
    for _ in range(steps):
        pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(x["s"].alias("a"), F.element_at("w", i + 2)["s"].alias("b")))
        best = rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").count().orderBy(F.desc("count"), "a", "b").limit(1).collect()
        if not best or best[0]["count"] < 2:
            break
        a, b = best[0].a, best[0].b
        merges.append((a, b))
        rows = rows.select(F.expr(_merge_sql(a, b)).alias("w"))
    return merges


def _merge_sql(a: str, b: str) -> str:
    """SQL that puts neighbours a, b of the array w together, from the left."""
    x, y = (v.replace("\\", "\\\\").replace("'", "\\'") for v in (a, b))
    joined = f"concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', concat('{x}', '{y}'))))"
    return (
        "aggregate(w, cast(array() as array<struct<s:string>>), (acc, c) -> "
        f"case when size(acc) > 0 and element_at(acc, -1).s = '{x}' and c.s = '{y}' then {joined} else concat(acc, array(c)) end)"
    )


def mean_vectors(words: DataFrame, vectors: DataFrame, key: str, width: int) -> DataFrame:
    """(key, vector): sum of the words' vectors over 0.5 + their number."""
    held = words.join(vectors, "word")
    parts = held.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.element_at("vector", i + 1)).alias(f"v{i}") for i in range(width)])
    return parts.select(key, F.array(*[F.col(f"v{i}") / (F.col("n") + 0.5) for i in range(width)]).alias("vector"))


def _in_slices(asked: DataFrame, vectors: DataFrame, key: str, k: int, slice_rows: int) -> DataFrame:
    """(query, rank, key, similarity) of rows of `asked` (query, ask, own): the k nearest vectors by cosine, none of `own`.

    Queries go in slices of about `slice_rows` by hash, whatever their number;
    a slice is on every executor, a task keeps the k best of its rows for each
    query, and only those are shuffled.
    """
    kind = vectors.schema[key].dataType.simpleString()
    query_kind = asked.schema["query"].dataType.simpleString()
    asked = cut(asked)
    parts = max(1, -(-asked.count() // slice_rows))
    schema = f"query {query_kind}, {key} {kind}, similarity double"
    out = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).collect()
        if not some:
            continue
        asks = np.array([r.ask for r in some], float).reshape(len(some), -1)
        long = np.linalg.norm(asks, axis=1)
        # a slice of queries, of bounded size
        shared = vectors.sparkSession.sparkContext.broadcast(([r.query for r in some], asks, long, [set(r.own) for r in some]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, asks, long, own = shared.value
            best: list[list[tuple[float, object]]] = [[] for _ in names]
            for pdf in batches:
                rows = np.array(pdf["_v"].tolist(), float).reshape(len(pdf), -1)
                size, keys = np.linalg.norm(rows, axis=1), pdf[key].tolist()
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = asks @ rows.T / (long[:, None] * size)
                for i, each in enumerate(near):
                    fit = np.flatnonzero(np.isfinite(each))
                    wide = k + len(own[i])
                    if len(fit) > wide:  # products of a matrix differ in the last places: the choice is made with some room
                        fit = fit[each[fit] >= np.partition(each[fit], len(fit) - wide)[len(fit) - wide] - 1e-9]
                    exact = (rows[fit] * asks[i]).sum(axis=1) / (size[fit] * long[i])
                    found = [(-s, keys[j]) for j, s in zip(fit.tolist(), exact.tolist()) if keys[j] not in own[i]]
                    best[i] = heapq.nsmallest(k, best[i] + found)
            rows = [(names[i], name, -s) for i, each in enumerate(best) for s, name in each]
            yield pd.DataFrame(rows, columns=["query", key, "similarity"])

        found = vectors.select(key, F.col("vector").alias("_v")).where(F.col(key).isNotNull() & F.col("_v").isNotNull()).mapInPandas(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", key, "similarity")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "id", slice_rows: int = 4_096) -> DataFrame:
    """(query, rank, key, similarity): the k rows nearest to each query vector by cosine, ties to the smaller key.

    A row is no neighbour of its own key; null and zero vectors, and null keys, take no part.
    """
    asked = queries.where(F.col(key).isNotNull() & F.col("vector").isNotNull()).select(
        F.col(key).alias("query"), F.col("vector").alias("ask"), F.array(key).alias("own")
    )
    return _in_slices(asked, vectors, key, k, slice_rows)


def analogies(questions: DataFrame, vectors: DataFrame, k: int = 5, slice_rows: int = 4_096) -> DataFrame:
    """(question, rank, word): nearest to v2 - v1 + v3, none of the three; questions have (question, w1, w2, w3).

    Questions with a word that has no vector have no rows.
    """
    v = vectors.select("word", "vector")
    q = questions
    for i in (1, 2, 3):
        q = q.join(v.select(F.col("word").alias(f"w{i}"), F.col("vector").alias(f"v{i}")), f"w{i}")
    minus = F.zip_with("v2", "v1", lambda a, b: a - b)
    asked = q.select(F.col("question").alias("query"), F.zip_with(minus, F.col("v3"), lambda a, b: a + b).alias("ask"), F.array("w1", "w2", "w3").alias("own"))
    return _in_slices(asked, v, "word", k, slice_rows).withColumnRenamed("query", "question")


def glove(cooc: pd.DataFrame, words: int, width: int = 16, rounds: int = 25, rate: float = 0.05, seed: int = 1, skew: int = 0, pmi_target: bool = True) -> np.ndarray:
    """Vectors from aggregated co-occurrence (a, b, x, pmi) by AdaGrad on weighted squares.

    The target is the PMI (or ln x with biases), the weight (x / 10)^0.75 up to
    1.  With `skew` > 0 that many more dimensions model sign(a < b) and are
    left out of the result.  Input is a vocabulary's pairs, not a corpus.
    """
    rng = np.random.default_rng(seed)
    a, b = cooc["a"].to_numpy(), cooc["b"].to_numpy()
    x, t = cooc["x"].to_numpy(float), (cooc["pmi"] if pmi_target else np.log(cooc["x"])).to_numpy(float)
    f = np.minimum((x / 10) ** 0.75, 1.0)
    p = {"L": rng.uniform(-0.5, 0.5, (words, width)) / width, "R": rng.uniform(-0.5, 0.5, (words, width)) / width,
         "S": rng.uniform(-0.5, 0.5, (words, max(skew, 1))) / max(skew, 1), "bl": np.zeros(words), "br": np.zeros(words)}
    g = {k: np.full_like(v, 1e-2) for k, v in p.items()}
    sign = np.sign(b - a).astype(float)
    for _ in range(rounds):
        order = rng.permutation(len(a))
        for i in range(0, len(order), 1024):
            s = order[i : i + 1024]
            u, v = a[s], b[s]
            left, right = p["L"][u], p["L"][v] if skew else p["R"][v]
            guess = (left * right).sum(1) + (0 if pmi_target else p["bl"][u] + p["br"][v])
            if skew:
                guess = guess + sign[s] * (p["S"][u] * p["S"][v]).sum(1)
            d = f[s] * (guess - t[s])
            steps = [("L", u, d[:, None] * right), ("L" if skew else "R", v, d[:, None] * left)]
            if skew:
                steps += [("S", u, (d * sign[s])[:, None] * p["S"][v]), ("S", v, (d * sign[s])[:, None] * p["S"][u])]
            if not pmi_target:
                steps += [("bl", u, d), ("br", v, d)]
            for name, rows, grad in steps:
                np.add.at(g[name], rows, grad * grad)
                np.add.at(p[name], rows, -rate * grad / np.sqrt(g[name][rows]))
    return p["L"] if skew else p["L"] + p["R"]
