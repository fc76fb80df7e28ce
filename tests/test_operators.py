import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import clustering as C
from millrace.operators import factorization as Z
from millrace.operators import pool as P
from millrace.operators import sampling as S
from millrace.operators import sequences as Q
from millrace.operators import text as X
from millrace.operators import windows as W


def test_pool_roles_and_vectors(spark):
    df = spark.createDataFrame([(1, 2.0, [3.0, 4.0], "t", 5.0)], "row_id long, a double, v array<double>, s string, y double")
    df = P.with_role(P.with_role(P.with_role(df, "a", "feature"), "v", "feature"), "y", "target", "the price")
    assert P.roles(df, "feature") == ["a", "v"] and P.target(df) == "y" and P.target(df, "y") == "y"
    assert df.schema["y"].metadata["description"] == "the price"
    assert P.features(df).first().features == [2.0, 3.0, 4.0]
    assert P.extend(P.features(df), "features", F.lit(9)).first().features[-1] == 9.0
    with pytest.raises(KeyError):
        P.target(df, "no")
    assert P.point(df, 1, "a").first().a == 2.0
    both = P.joined(df.select(F.col("row_id").alias("item_id"), F.col("v").alias("features")), df.select(F.col("row_id").alias("item_id"), F.array("a").alias("features")))
    assert both.first().features == [3.0, 4.0, 2.0]


def test_numbering_is_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    rows = P.numbered(df, "k").orderBy("k").collect()
    assert [r.row_id for r in rows] == list(range(1000))


def test_labels(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([15] * 5 + [8] * 4 + [3] * 3 + [2, 2, 1, 0])], "row_id int, label int")
    assert P.n_classes(df, "label").first().n_classes == 16
    first_seen = [r.label for r in P.class_counts(df, "label").orderBy("first_row").collect()]
    assert first_seen == [15, 8, 3, 2, 1, 0]
    classes = {r.label: r["class"] for r in P.normalized_labels(df, "label").collect()}
    assert [classes[x] for x in first_seen] == [5, 4, 3, 2, 1, 0]
    minus = spark.createDataFrame([(5,), (-1,), (2,)], "label int")
    assert {r.label: r["class"] for r in P.normalized_labels(minus, "label").collect()} == {2: 0, 5: 1, -1: 2}
    assert P.check(df.withColumn("item_id", F.lit(1))).first().problem == "repeated keys"


def test_runs_and_sessions(spark):
    rows = [(1, "a", 0.0), (1, "a", 0.2), (1, "a", 1.0), (1, "b", 1.1), (1, "b", 1.2), (2, "a", 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, user int, item string, ts double")
    got = [(r.i, round(r.delta, 3)) for r in W.runs(df, "user", "item", "ts", "i", 0.5).orderBy("i").collect()]
    assert got == [(0, -1.0), (2, 0.8), (3, 0.1), (5, -1.0)]
    assert [r.session for r in W.sessions(df, "user", "ts", "i", 0.5).orderBy("i").collect()] == [1, 1, 2, 2, 2, 1]
    assert {(r.user, r.intensity > 0) for r in __import__("millrace.streaming.events", fromlist=["x"]).batch_intensity(df, "user", ["ts", "i"]).collect()} == {(1, True), (2, True)}


def test_return_rates_of_a_perfect_prediction_have_no_error(spark):
    rows = [(0, 0, 0.0), (0, 0, 1.0), (0, 1, 1.0), (0, 0, 2.0), (0, 1, 2.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, user int, item int, ts double")
    d = W.previous_delta(df, ["user", "item"], "ts", "i").withColumn("p", F.lit(1.0))
    assert max(r.error for r in W.rate_error(d, ["user", "item"], "p", "delta", ["ts", "i"]).collect()) < 1e-9


def test_as_of_takes_the_next_value(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("z", 1)], "k string, t int")
    right = spark.createDataFrame([("k", 1, "a"), ("k", 6, "b")], "k string, t int, v string")
    got = {(r.k, r.t): r.v for r in W.as_of_next(left, right, ["k"], "t", "v", "v").collect()}
    assert got == {("k", 1): "a", ("k", 5): "b", ("k", 9): None, ("z", 1): None}


def test_histogram_prefixes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    b, y = rng.integers(0, 4, (200, 2)), rng.normal(size=200)
    df = spark.createDataFrame([([int(v) for v in r], float(t)) for r, t in zip(b, y)], "bins array<int>, y double").repartition(4)
    for r in A.splits(A.histogram(df, "bins", F.col("y"))).collect():
        left = b[:, r.feature] <= r.bin
        assert r.left_s == pytest.approx(y[left].sum()) and r.right_n == (~left).sum()
    whole, half = A.histogram(df, "bins", F.col("y")), A.histogram(df.where("y > 0"), "bins", F.col("y"))
    assert A.removed(whole, half).agg(F.sum("n")).first()[0] == 2 * (y <= 0).sum()
    assert A.merged(whole, half).agg(F.sum("n")).first()[0] == 2 * (200 + (y > 0).sum())


def test_kernel_sums():
    v, d = [1.0, 2.0, 0.5, 3.0], 0.3
    want = [sum(np.exp(-d * abs(i - j)) * x for j, x in enumerate(v)) for i in range(4)]
    assert A.kernel_sums(v, d) == pytest.approx(want)


def test_task_means_shrink(spark):
    rng = np.random.default_rng(2)
    rows = [(t, float(v)) for t in range(8) for v in rng.normal(0.1 * t, 1.0, 30)]
    df = spark.createDataFrame(rows, "t int, y double")
    for got in (A.stein_means(df, "t", "y"), A.stein_means(df, "t", "y", prior=0.0), A.multi_task_means(df, "t", "y"), A.multi_task_means(df, "t", "y", "minimax")):
        r = got.collect()
        assert np.var([x.shrunk for x in r]) <= np.var([x["mean"] for x in r]) + 1e-12
    few = A.stein_means(df.where("t < 3"), "t", "y").collect()
    assert all(r.shrunk == pytest.approx(r["mean"]) for r in few)


def test_mixtures_find_their_components():
    rng = np.random.default_rng(3)
    rows = [(int(rng.binomial(20, p)), 20, 1) for p in [0.1] * 200 + [0.7] * 100]
    q, theta = A.binomial_mixture(rows, 2)
    assert theta == pytest.approx([0.1, 0.7], abs=0.05) and q == pytest.approx([2 / 3, 1 / 3], abs=0.07)
    q, a, b = A.beta_binomial_mixture(rows, 2, pull=0.01)
    assert sorted(a / (a + b)) == pytest.approx([0.1, 0.7], abs=0.08) and q.sum() == pytest.approx(1)
    assert A.digamma(np.array([1.0])) == pytest.approx([-0.5772156649], abs=1e-8)


def test_class_hierarchy_balances():
    tree = A.class_hierarchy([(0, 10), (1, 10), (2, 5), (3, 15)])
    assert tree["left"]["classes"] == [0, 1] and tree["right"]["classes"] == [2, 3]
    assert "left" not in A.class_hierarchy([(0, 10), (1, 1)], least=1)


def test_folds_cover_exactly(spark):
    df = spark.range(300).withColumnRenamed("id", "row_id")
    parts = [(a.count(), {r.row_id for r in b.collect()}) for a, b in S.folds(df, "row_id", 4)]
    assert sum(len(b) for _, b in parts) == 300 and set.union(*[b for _, b in parts]) == set(range(300))
    assert all(a + len(b) == 300 for a, b in parts)
    w = [r.weight for r in S.bootstrap(df, "row_id").collect()]
    assert 0.8 < np.mean(w) < 1.2 and min(w) == 0
    assert S.parse_ranges("a=1:2:0.5; b=3,4") == {"a": [1.0, 1.5, 2.0], "b": [3.0, 4.0]}
    assert len(S.grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    assert S.signed_rank([1, 2, 3], [1, 2, 3]) == 1.0 and S.signed_rank(range(20), range(1, 21)) < 0.01
    assert sorted(S.gibbs_permutation([1.0, 2.0, 3.0], 50)) == [0, 1, 2]


def test_core_reaches_a_fixpoint(spark):
    rows = [(0, 1, "a"), (1, 1, "a"), (2, 2, "a"), (3, 1, "b"), (4, 3, "b")]
    df = spark.createDataFrame(rows, "i int, u int, t string")
    got = W.core(df, F.col("i") % 2 == 0, "u", "t", rounds=4).collect()
    assert sorted(r.i for r in got) == [0, 1]


VERSE = "one two three two\nthree - two, One!"


def test_cooccurrence_windows(spark):
    df = spark.createDataFrame([(1, VERSE)], "k int, text string")
    got = {(r.a, r.b): r.x for r in X.cooccurrence(df, "k", "text", 0, 2).collect()}
    assert got == {("one", "two"): 1.0, ("one", "three"): 1.0, ("two", "three"): 1.0, ("two", "two"): 1.0, ("three", "two"): 2.0, ("three", "one"): 1.0, ("two", "one"): 1.0}
    both = X.cooccurrence(df, "k", "text", 2, 2)
    assert all(got2.x == other.x for got2 in both.collect() for other in both.where((F.col("a") == got2.b) & (F.col("b") == got2.a)).collect())
    words = X.tokens(df, "k", "text")
    assert [(r.word, r.n, r.id) for r in X.dictionary(words, 2).orderBy("id").collect()] == [("two", 3, 0), ("one", 2, 1), ("three", 2, 2)]
    assert X.pair_merges(spark.createDataFrame([("abab abab",)], "t string"), "t", 2) == [("a", "b"), ("ab", "ab")]
    vectors = spark.createDataFrame([("one", [1.0, 0.0]), ("two", [0.0, 1.0])], "word string, vector array<double>")
    assert X.mean_vectors(words, vectors, "k", 2).first().vector == pytest.approx([2 / 5.5, 3 / 5.5])


@pytest.mark.parametrize("how", [{}, {"skew": 2}, {"pmi_target": False}])
def test_glove_fits_its_targets(how):
    rng = np.random.default_rng(1)
    rows = [(i, j, float(rng.integers(1, 20)), float(rng.normal())) for i in range(6) for j in range(6) if i != j]
    v = X.glove(pd.DataFrame(rows, columns=["a", "b", "x", "pmi"]), 6, 4, rounds=30, **how)
    assert v.shape == (6, 4) and np.isfinite(v).all()


def test_clustering(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, (np.array([0.0, 0]) if i % 2 else np.array([5.0, 5])) + 0.1 * rng.normal(size=2)) for i in range(60)]
    df = spark.createDataFrame([(i, g, v.tolist()) for i, g, v in rows], "id long, g int, v array<double>")
    centres = sorted(C.k_means(df, "v", "id", 2))
    assert np.allclose(centres, [[0, 0], [5, 5]], atol=0.2)
    for member in (False, True):
        got = C.leader(df, "g", "id", "v", eps=1.5, ratio=0.8, nearest_member=member).collect()
        assert len({r.cluster for r in got}) == 2
    assert len(set(C.spheres(np.array([[1, 0], [0.9, 0.1], [0, 1.0]]), 0.3))) == 2
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (4, 12)], "id long, dim int")
    assert {r.id: r.component for r in C.shared_components(links, "id", "dim").collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_rank_one_factors(spark):
    u, v = [1.0, 2.0, -1.0], [3.0, 0.5]
    cells = spark.createDataFrame([(i, j, a * b) for i, a in enumerate(u) for j, b in enumerate(v)], "i int, j int, x double")
    found_u, found_v = Z.als(cells, rounds=2)
    uu, vv = {r.i: r.u for r in found_u.collect()}, {r.j: r.v for r in found_v.collect()}
    assert all(uu[i] * vv[j] == pytest.approx(a * b, abs=1e-5) for i, a in enumerate(u) for j, b in enumerate(v))
    sparse_u, _ = Z.soft_als(cells, rounds=2, shrink=0.1)
    assert sparse_u.count() == 3
    h, b = Z.gradient_factors(np.outer(u, v))
    assert np.outer(h, b) == pytest.approx(np.outer(u, v))


def test_automata(spark):
    seqs = [[0, 0, 1], [1, 1, 1], [], [0, 1, 0, 1, 1], [1, 1]]
    df = spark.createDataFrame([(i, s, float(sum(s) % 3 == 0)) for i, s in enumerate(seqs)], "i int, s array<int>, y double")
    table = [[0, 1], [1, 2], [2, 0]]
    got = [r.state for r in df.select("i", Q.run_dfa(F.col("s"), table).alias("state")).orderBy("i").collect()]
    assert got == [sum(s) % 3 for s in seqs]
    assert sum(r.cost for r in Q.state_cost(df, "s", "y", table).collect()) == pytest.approx(0)
    learned, values = Q.learn_dfa(df, "s", "y", 2, states=3)
    assert sum(r.cost for r in Q.state_cost(df, "s", "y", learned).collect()) < 1.2 and values
    lost = spark.createDataFrame([([7],), ([-1],)], "s array<int>").select(Q.run_dfa(F.col("s"), table).alias("x")).collect()
    assert [r.x for r in lost] == [-1, -1]
    _, _, _, history = Q.baum_welch(df, "i", "s", 2, 2, rounds=4)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    _, _, loss = Q.fit_pnfa([np.array(s) for s in seqs if s], np.array([1.0, 1, 1, 0]), 2, 2, rounds=60)
    assert loss[-1] < loss[0]


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, i % 5, float(i * 37 % 11)) for i in range(200)], "i int, k int, v double")
    one, many = df.coalesce(1), df.repartition(8)
    for f in (
        lambda d: W.average_ranks(d, "k", "v"), lambda d: W.running_rate(d, "k", ["i"], F.col("v") > 5), lambda d: S.time_split(d, "i", 0.6),
        lambda d: W.rolling_volatility(d, "k", ["i"], "v", 5), lambda d: A.smoothed_rates(d, "k", "v", F.col("i") > 100),
    ):
        a, b = ([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f(d).collect()] for d in (one, many))
        assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_numbering_with_a_payload_and_small_shuffle_partitions(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("payload")).repartition(7)
        rows = P.numbered(df, "k").orderBy("k").select("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert [r.row_id for r in rows] == list(range(40_000))


def test_every_query_vector_is_searched_for(spark):
    v = spark.range(10_001).select("id", F.array(F.cos("id"), F.sin("id")).alias("vector"))
    found = X.nearest(v, v, 1, slice_rows=3_000)
    assert found.count() == 10_001 and found.where("similarity < 0.999").count() == 0
    q = v.limit(50).select(F.col("id").alias("question"), F.col("id").alias("w1"), (F.col("id") + 1).alias("w2"), (F.col("id") + 2).alias("w3"))
    assert X.analogies(q, v.withColumnRenamed("id", "word"), 2, slice_rows=7).count() == 100


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("k"), F.explode(F.array("id", F.col("id") + 1)).alias("dim"))
    assert {r.component for r in C.shared_components(links, "k", "dim").collect()} == {0}


def test_wide_features_have_the_same_borders(spark):
    from millrace.operators import grid

    rng = np.random.default_rng(4)
    rows = [(i, [float(rng.normal()), float(rng.integers(0, 40)), 1.0, float("nan")]) for i in range(3_000)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>").repartition(5)
    assert grid.fit(df, "x", 12, local_values=20).borders == grid.fit(df, "x", 12).borders
    assert len(grid.fit(df, "x", 12).borders[0]) == 11
