import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import grid as G
from millrace.plans import clicks, ensembles, linear, models, multiclass, neural, optimizers, scheme, selection, trees
from millrace.plans.models import Ensemble, Linear, ObliviousTree


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)).round(3)
    y = 2 * (x[:, 0] > 0.2) - 3 * (x[:, 1] > -0.1) + 0.5 * x[:, 2] + 0.01 * rng.normal(size=400)
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, features array<double>, target double").repartition(3).cache()


@pytest.fixture(scope="module")
def context(pool):
    return scheme.Context(G.fit(pool, "features", 8), 4)


def score(df, model):
    return df.agg(F.sqrt(F.avg(F.pow(F.col("target") - model.column(F.col("features")), 2)))).first()[0]


def test_grid_borders():
    assert G.log_sum_borders([0, 0.1, 0.2, 0.3, 0.5, 0.6, 0.7, 0.8], [1] * 8, 3) == [0.2, 0.5]
    assert G.log_sum_borders([0.0, 1.0], [2, 6], 32) == [0.0]
    assert G.log_sum_borders([1.0], [8], 32) == [] and G.log_sum_borders([], [], 32) == []
    assert G.log_sum_borders([0.0, 1.0], [1, 7], 32) == [] and G.log_sum_borders([0, 0.3, 0.5], [1, 1, 1], 32) == [0.3]


def test_grid_fit_bins_and_text(spark, pool, context):
    grid = context.grid
    assert all(r == sorted(r) and len(r) <= 7 for r in grid.borders)
    assert G.Grid.from_text(grid.to_text()).borders == grid.borders
    row = pool.select("features", grid.bins(F.col("features")).alias("b")).first()
    assert list(row.b) == [sum(x > b for b in r) for x, r in zip(row.features, grid.borders)]
    twice = pool.withColumn("features", F.concat("features", F.array(F.col("features")[0])))
    assert G.fit(twice, "features", 8).borders[4] == []  # the same partitions as the first feature's
    levels = spark.createDataFrame([(i, [float(i % 3)]) for i in range(9)], "row_id long, features array<double>")
    assert G.one_hot(levels, "features", 0) == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        G.one_hot(levels, "features", 0, most=2)
    hot = G.Grid([[0.0, 1.0, 2.0]], {0})
    assert sorted({r.b[0] for r in levels.select(hot.bins(F.col("features")).alias("b")).collect()}) == [1, 2, 3]


def test_tree_finds_the_best_splits(pool, context):
    rows = trees.binned(pool, context.grid)
    tree = trees.ObliviousTreeLearner(context.grid, depth=2, criterion="L2").fit(rows, F.col("target"))
    data = rows.select("bins", "target").collect()
    b, y = np.array([r.bins for r in data]), np.array([r.target for r in data])

    def cost(masks):
        leaf = sum(m * (1 << i) for i, m in enumerate(masks))
        return sum(-y[leaf == k].sum() ** 2 / max((leaf == k).sum(), 1) for k in range(1 << len(masks)))

    options = [(f, k) for f, row in enumerate(context.grid.borders) for k in range(len(row))]
    first = min(options, key=lambda o: cost([(b[:, o[0]] > o[1]).astype(int)]))
    taken = (b[:, first[0]] > first[1]).astype(int)
    second = min((o for o in options if o != first), key=lambda o: cost([taken, (b[:, o[0]] > o[1]).astype(int)]))
    assert tree.conditions == [(f, context.grid.borders[f][k]) for f, k in (first, second)]
    leaf = 2 * taken + (b[:, second[0]] > second[1])
    assert tree.values == pytest.approx([y[leaf == k].mean() for k in range(4)])


@pytest.mark.parametrize("text", [
    "GradientBoosting(weak=GreedyObliviousTree(depth=2), iterations=6, step=0.5)", "RandomForest(weak=GreedyObliviousTree(depth=3, loss=L2), count=3)",
    "RidgeRegression(alpha=0.1)", "ElasticNet(penalty=0.01, mix=0.5)", "LARS()", "LASSO(steps=400)", "RVM()", "WeakLeastAngle()",
    "RidgeRegressionLeavesObliviousTree(depth=2)", "RegGreedyObliviousTree(depth=2, lambda=0.1)", "GreedyTDRegion(depth=3)",
    "GreedyTDBumpyRegion(depth=3)", "GreedyTDCherryRegion(clauses=2)", "RegionForest(count=2)", "LassoGradientBoosting(weak=GreedyObliviousTree(depth=2), iterations=2)",
    "Bootstrap(weak=GreedyObliviousTree(depth=2))",
])
def test_every_learner_beats_nothing(pool, context, text):
    rows = trees.binned(pool, context.grid)
    model = scheme.build(text, context).fit(rows, F.col("target"))
    base = rows.agg(F.sqrt(F.avg(F.col("target") * F.col("target")))).first()[0]
    assert score(rows, model) < base
    if type(model).__name__ != "Single":
        again, _ = models.from_json(models.to_json(model))
        assert score(rows, again) == pytest.approx(score(rows, model))


def test_scheme_parser():
    call = scheme.parse("A(x=1, y=-2.5e1, z=true, s='a b', n=B(k=C))")
    assert (call.name, call.parameters["x"], call.parameters["y"], call.parameters["z"], call.parameters["s"]) == ("A", 1, -25.0, True, "a b")
    assert call.parameters["n"].parameters == {"k": "C"}
    for bad in ("", "A(", "A(x)", "A(x=1", "A() B", "1(x=2)"):
        with pytest.raises(ValueError):
            scheme.parse(bad)
    assert scheme.target_spec("L2") == ("L2", None) and scheme.target_spec("LLLogit(price)") == ("LLLogit", "price")
    with pytest.raises(KeyError):
        scheme.build("NoSuch()", scheme.Context(G.Grid([]), 0))


def test_compiled_ensemble_equals_the_ensemble(spark):
    rng = np.random.default_rng(5)
    found = []
    for _ in range(6):
        n = int(rng.integers(0, 5))
        conditions = [(int(rng.integers(0, 3)), float(rng.integers(-2, 3))) for _ in range(n)]
        found.append(ObliviousTree(conditions, rng.normal(size=1 << n).tolist()))
    ensemble = Ensemble(found, rng.normal(size=6).tolist(), 0.5)
    points = [(float(a), float(b), float(c)) for a, b, c in itertools.product(np.arange(-2.5, 3, 1.0), repeat=3)]
    df = spark.createDataFrame([(list(p),) for p in points], "x array<double>")
    rules, binary = models.compiled(ensemble), models.from_binary(models.to_binary(ensemble))
    x = F.col("x")
    for a, b, c in df.select(ensemble.column(x), models.rules_column(rules, x), binary.column(x)).collect():
        assert a == pytest.approx(b) == pytest.approx(c)
    top = models.strongest(rules, ensembles.support(df, rules, "x"), 3)
    assert len(top) <= 3 and all(abs(p[1]) >= abs(q[1]) for p, q in zip(top, top[1:]))


def test_tree_values(spark):
    tree = ObliviousTree([(0, 1.5), (1, 1.5)], [1.0, 2.0, 3.0, 4.0])
    df = spark.createDataFrame([([float(a), float(b)],) for a, b in ((1, 1), (1, 2), (2, 1), (2, 2), (float("nan"), 2))], "x array<double>")
    assert [r[0] for r in df.select(tree.column(F.col("x"))).collect()] == [1.0, 2.0, 3.0, 4.0, 2.0]


def test_other_models(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    x, quad = F.col("x"), models.Quadratic([1.0, 0.0, 1.0, 0.0, 0.0, 1.0], [0, 1])
    for model, want in (
        (quad, 6.0), (models.Shifted(Linear([1.0, 1.0]), 0.5), 3.5), (models.Scaled(models.Constant(2.0), [1.0, 2.0]), [2.0, 4.0]),
        (models.Concat([models.Join([models.Constant(1.0)]), models.Join([models.Constant(2.0)])]), [1.0, 2.0]),
        (models.VectorTree([(0, 0.5)], [[0.0, 0.0], [1.0, 2.0]]), [1.0, 2.0]), (models.PolynomialRegion(models.Region([(0, 0.5, True)], 1.0), quad), 6.0),
        (models.ExponentialTree([(0, 0.5)], [quad, models.Quadratic([2.0], [])], 1e6), 2.0),
        (models.MultiClass(models.Join([models.Constant(-1.0), models.Constant(-2.0)])), 2), (models.OneVsRest(models.Join([models.Constant(1.0), models.Constant(3.0)])), 1),
        (models.CodingMatrix([[1, 1], [-1, 1]], models.Join([models.Constant(-1.0), models.Constant(1.0)])), 1),
        (models.MultiLabel(models.Join([models.Constant(1.0), models.Constant(-1.0)])), [1, 0]),
        (models.LabelSets(models.Constant(1.0), [[0, 0], [1, 0]]), [1, 0]),
        (models.ThresholdLabels(models.MultiClass(models.Join([models.Constant(2.0)])), 0.5, True), [1]),
        (models.Hierarchy(models.Constant(1.0), [models.Constant(0.0), models.Constant(2.0)]), 2),
    ):
        got = df.select(model.column(x).alias("v")).first().v
        assert got == (pytest.approx(want, abs=1e-6) if isinstance(want, float) else want)
        assert df.select(models.from_json(models.to_json(model))[0].column(x).alias("v")).first().v == got
    assert models.validate("{}")[0] is False and models.validate(models.to_json(quad)) == (True, "")


def test_ridge_equals_numpy(pool):
    x = np.array([r.features for r in pool.select("features", "target").collect()])
    y = np.array([r.target for r in pool.select("features", "target").collect()])
    assert linear.Ridge(4, 0.5).fit(pool, F.col("target")).weights == pytest.approx(np.linalg.solve(x.T @ x + 0.5 * np.eye(4), x.T @ y).tolist())
    model = linear.ValidatedRidge(4).fit(pool, F.col("target"), F.col("row_id") % 3 > 0)
    assert isinstance(model, Linear)
    noise = pool.withColumn("target", F.lit(0.0))
    assert isinstance(linear.ValidatedRidge(4).fit(noise, F.col("target"), F.col("row_id") % 3 > 0), models.Constant)
    frame = linear.by_task(pool.withColumn("task", F.col("row_id") % 2), "task", "features", F.col("target"), 4)
    assert len(frame) == 2 and linear.shared_alpha(list(linear.gram(pool, "features", F.col("target"), 4).values())) > 0


def test_multiclass(spark, pool, context):
    label = F.when(F.col("features")[0] > 0.3, 2).when(F.col("features")[1] > 0, 1).otherwise(0)
    rows = trees.binned(pool, context.grid).withColumn("label", label)
    weak = trees.ObliviousTreeLearner(context.grid, 2, "L2")

    def accuracy(model):
        return rows.agg(F.avg(F.when(model.column(F.col("features")) == F.col("label"), 1.0).otherwise(0.0))).first()[0]

    for mode in ("plain", "factored", "weighted", "filtered", "scaled"):
        m = multiclass.MultiClassBoosting(weak, 3, iterations=4, step=1.5, mode=mode, cut_every=2).fit(rows, F.col("label"))
        assert accuracy(m) > 0.5, mode
    assert accuracy(multiclass.OneVsRestLearner(lambda: weak, 3).fit(rows, F.col("label"))) > 0.7
    codes = multiclass.coding_matrix(np.array([[1, 0.5, 0.1], [0.5, 1, 0.2], [0.1, 0.2, 1.0]]), 3)
    assert codes.shape[0] == 3 and all((c > 0).any() and (c < 0).any() for c in codes.T)
    one = np.array([[1.0, -1, -1], [-1, 1, -1], [-1, -1, 1]])
    assert accuracy(multiclass.CodedLearner(lambda: weak, one).fit(rows, F.col("label"))) > 0.6
    tree = {"classes": [0, 1, 2], "n": 3, "left": {"classes": [0], "n": 1}, "right": {"classes": [1, 2], "n": 2, "left": {"classes": [1], "n": 1}, "right": {"classes": [2], "n": 1}}}
    assert accuracy(multiclass.HierarchyLearner(lambda: weak).fit(rows, F.col("label"), tree)) > 0.6
    sets = spark.createDataFrame([(0, [1, 0]), (1, [0, 1]), (2, [1, 0]), (3, [0, 0])], "row_id long, y array<int>")
    assert multiclass.powerset(sets, "y")[1] == [[1, 0], [0, 1], [0, 0]] and multiclass.powerset(sets, "y", 1)[1] == [[1, 0]]
    assert sorted((r.row_id, r["class"]) for r in multiclass.conflicts(sets, "y").collect()) == [(0, 0), (1, 1), (2, 0), (3, 2)]


def test_selection(pool, context):
    rows = trees.binned(pool, context.grid)
    table = selection.compare(rows, F.col("target"), ["RidgeRegression()", "WeakLeastAngle()"], context, k=3)
    assert table[0][2] == 0 and table[1][2] > 0 and 0 <= table[1][3] <= 1
    best = selection.search(rows, rows, F.col("target"), "RidgeRegression(alpha={a})", {"a": [0.01, 1e6]}, context)
    assert best["L2"][1] == {"a": 0.01}


def test_optimizers_reach_the_minimum():
    rng = np.random.default_rng(3)
    q = rng.normal(size=(6, 6))
    a, w = q @ q.T + np.eye(6), rng.normal(size=6)
    value, grad = optimizers.quadratic(a, w)
    best, top, x = np.linalg.solve(-(a + a.T), w), float(np.linalg.eigvalsh(a + a.T)[-1]), np.zeros(6)
    parts = [q[:, [i]] @ q[:, [i]].T + np.eye(6) / 6 for i in range(6)]

    def part(v, k):
        return 6 * (2 * parts[k] @ v + w / 6)

    for found in (
        optimizers.gradient_descent(grad, x, top), optimizers.nesterov(grad, x, top), optimizers.nesterov(grad, x, top, 2.0),
        optimizers.flexible(value, grad, x, eps=1e-14), optimizers.adam(lambda v, _: grad(v), x, 20_000, 1e-2),
        optimizers.saga(part, 6, x, 4_000, 0.3 / (6 * top)), optimizers.by_sign(grad, x),
    ):
        assert found == pytest.approx(best, abs=2e-2)
    assert value(optimizers.stochastic(part, 6, x, 300, 0.2 / (6 * top))) < value(x)
    assert optimizers.restarts(lambda i: (abs(i - 2), np.array([i])), 5).tolist() == [2]


def test_networks(spark):
    rng = np.random.default_rng(1)
    net = neural.Network([neural.Conv(2, 3, 1, 1, "tanh"), neural.Pool(2), neural.Dense(3, "sigmoid"), neural.Dense(1, "identity")], (4, 4, 1))
    x, y = rng.normal(size=(5, 4, 4, 1)), rng.normal(size=(5, 1))
    net.gradient(x, y)
    for layer in (net.layers[0], net.layers[2], net.layers[3]):
        grad = layer.gw.copy()
        for i in [(0, 0), tuple(n - 1 for n in layer.w.shape)]:
            layer.w[i] += 1e-5
            up = net.gradient(x, y)
            layer.w[i] -= 2e-5
            down = net.gradient(x, y)
            layer.w[i] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(grad[i], abs=1e-4)
    net.fit(x, y, 60)
    assert net.history[-1] < net.history[0]
    df = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "i int, features array<double>")
    got = neural.predict(df, net).orderBy("i").collect()
    assert [r.output[0] for r in got] == pytest.approx(net.apply(x)[:, 0].tolist())
    assert neural.Lstm(2, 3).run(rng.normal(size=(4, 2))).shape == (4, 3)


def test_click_walk(spark):
    theta = np.zeros(clicks.FEATURES)
    moves = clicks.transitions(np.zeros(3, int), np.zeros(3, int), np.zeros(3, bool), theta)
    assert moves.sum(axis=1) == pytest.approx(np.ones(5)) and moves[0, 1:4] == pytest.approx([0.25] * 3)
    rows = [(s, p, 0, p % 3, False) for s in (1, 2) for p in range(3)]
    df = spark.createDataFrame(rows, "session int, position int, type int, grade int, clicked boolean")
    got = clicks.walk(df, "session", theta, {0: 0.5}).collect()
    assert len(got) == 6 and all(r.view > 0 and 0 <= r.click <= 1 for r in got)
    chain = np.array([[0, 0.5, 0.5, 0], [0, 0, 0.5, 0.5], [0, 0, 0, 1.0], [0, 0, 0, 0]])
    found = clicks.routes(chain, 0, 3)
    assert found[0][0] == 0.5 and sum(p for p, _ in found) == pytest.approx(1.0)
    learned = clicks.learn_chain([[0, 1, 3]] * 20 + [[0, 2, 3]] * 5, (chain > 0).astype(float), 3)
    assert learned[0, 1] > learned[0, 2]
