import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import blockwise as B
from millrace.functions import losses as L
from millrace.functions import metrics as M
from millrace.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_vector_functions(spark):
    x = V.weights([1.0, -2.0, 3.0])
    want = {
        "total": (V.total(x), 2.0), "dot": (V.dot(x, V.weights([2, 1, 1])), 3.0), "linear": (V.linear(x, [1, 1, 1], 0.5), 2.5),
        "relu": (V.relu(F.lit(-3.0)), 0.0), "sigmoid": (V.sigmoid(F.lit(0.0)), 0.5), "power": (V.power(F.lit(3.0), 2, 2), 18.0),
        "log": (V.log_linear(F.lit(1.0), 2, 1), math.log(3)), "logit": (V.logit(F.lit(1.0)), -math.log1p(math.e)),
        "noisy": (V.noisy_or(V.weights([0.5, 0.5])), 0.75), "norm": (V.norm(V.weights([3, 4])), 5.0),
        "cosine": (V.cosine(V.weights([1, 0]), V.weights([2, 0])), 1.0), "sum": (V.sum_sigmoid(V.weights([1, -1])), 0.5),
        "fm": (V.factorization_machine(V.weights([1, 2]), 1.0, [1, 1], [[1, 2]]), 8.0),
        "normal": (V.normalized_linear(V.weights([1, 2]), [1, 1], [2, 2], [1, 1], 0.5), 8.5),
        "ensemble": (V.ensemble([(0.5, F.lit(2.0)), (2.0, F.lit(1.0))]), 3.0), "distance": (V.distance(V.weights([0, 0]), V.weights([3, 4])), 5.0),
    }
    for name, (column, expected) in want.items():
        assert value(spark, column) == pytest.approx(expected), name
    assert value(spark, V.part(x, 1, 2)) == [-2.0, 3.0]
    assert value(spark, V.scaled(F.lit(2.0), [1, 3])) == [2.0, 6.0]
    assert value(spark, V.parallel(x, V.relu)) == [1.0, 0.0, 3.0]
    assert value(spark, V.cosine(V.weights([0, 0]), V.weights([1, 0]))) is None


def test_extreme_logits_stay_finite(spark):
    assert value(spark, V.sigmoid(F.lit(-1000.0))) == 0.0 and value(spark, V.sigmoid(F.lit(1000.0))) == 1.0
    assert value(spark, V.log_sigmoid(F.lit(-1000.0))) == -1000.0
    p = value(spark, V.reference_probabilities(V.weights([1000.0, -1000.0])))
    assert p == pytest.approx([1.0, 0.0, 0.0])


def test_reference_class(spark):
    for logits, loose, strict in (([1.0, 2.0], 1, 1), ([0.0, -1.0], 0, 2), ([-1.0, -2.0], 2, 2), ([3.0, 3.0], 0, 0)):
        assert value(spark, V.reference_class(V.weights(logits))) == loose
        assert value(spark, V.reference_class(V.weights(logits), strict=True)) == strict


@pytest.mark.parametrize(("text", "code"), [("", 0), ("a", 97), ("hello", 99162322), ("polygenelubricants", -2147483648), ("é", 233), ("\U0001F600", 1772899)])
def test_java_hash(spark, text, code):
    assert value(spark, V.java_hash(F.lit(text))) == code


def test_regression_to_classes(spark):
    y = [0.0, 0.0, 0.33, 0.33, 0.66, 0.66, 1.0, 1.0]
    borders = V.equal_borders(min(y), max(y), 4)
    assert borders == [0.25, 0.5, 0.75, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "i int, y double").select("i", V.bucket(F.col("y"), borders).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert V.equal_borders(2.0, 4.0, 2, from_least=False) == [1.0, 2.0]


def test_words_and_bins(spark):
    assert value(spark, V.normalize_word(F.lit("«Hello,»"))) == "hello"
    assert [value(spark, V.bin_of(F.lit(x), [0.2, 0.5])) for x in (0.0, 0.2, 0.3, 0.6, float("nan"))] == [0, 0, 1, 2, 0]


def test_criteria_agree_on_numbers_and_columns(spark):
    rows = [(float(n), float(s), float(s2)) for n, s, s2 in ((0, 0, 0), (1, 2, 4), (2, 3, 5), (3, 3, 9), (100, 20, 50))]
    df = spark.createDataFrame(rows, "n double, s double, s2 double")
    for name, c in L.CRITERIA.items():
        got = df.select("n", c.score(F.col("n"), F.col("s"), F.col("s2")).alias("score"), c.leaf(F.col("n"), F.col("s")).alias("leaf")).collect()
        for (n, s, s2), r in zip(rows, got):
            assert r.score == pytest.approx(c.score(n, s, s2)), name
            assert r.leaf == pytest.approx(c.leaf(n, s)), name


def test_steps_are_gradients(spark):
    h = 1e-6
    for name in ("L2", "LLLogit"):
        t = L.TARGETS[name]
        for y, p in ((1.0, 0.3), (0.0, -0.7)):
            df = spark.createDataFrame([(y, p - h, p + h, p)], "y double, a double, b double, p double")
            r = df.agg(t.value(F.col("y"), F.col("a")).alias("a"), t.value(F.col("y"), F.col("b")).alias("b"), F.first(t.step(F.col("y"), F.col("p"))).alias("s")).first()
            slope = (r.b**2 - r.a**2) / (4 * h) if name == "L2" else -(math.log(r.b) - math.log(r.a)) / (2 * h)
            assert r.s == pytest.approx(-slope, abs=1e-4)


def test_confusion_counts(spark):
    pairs = list(zip([0, 0, 0, 0, 1, 1, 2, 2], [0, 1, 2, 0, 1, 2, 2, 2]))
    df = spark.createDataFrame(pairs, "y int, p int")
    by = {r.c: (r.tp, r.fp, r.fn) for r in M._by_class(df, "y", "p").collect()}
    assert by == {0: (2, 0, 2), 1: (1, 1, 1), 2: (2, 2, 0)}
    macro = M.macro(df, "y", "p").first()
    assert macro.precision == pytest.approx((1 + 0.5 + 0.5) / 3) and macro.recall == pytest.approx((0.5 + 0.5 + 1) / 3)
    assert M.kappa(df, "y", "y").first().kappa == 1.0


def test_macro_means_differ(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, -1)], "y int, p int")
    assert M.macro(df, "y", "p").first().precision == pytest.approx(0.5)
    assert M.macro(df, "y", "p", all_classes=True).first().precision == pytest.approx(0.5 / 3)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(0, 6)), int(rng.integers(0, 2))) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    got = M.auc(spark.createDataFrame(rows, "s double, y int").repartition(5), "s", F.col("y") == 1).first()
    assert got.auc == pytest.approx(want)


def test_pfound_walks_down(spark):
    rows = [(1, 3.0, 0, 0.5), (1, 2.0, 1, 0.5), (1, 1.0, 2, 1.0), (2, 1.0, 0, 0.25)]
    df = spark.createDataFrame(rows, "g int, s double, t int, r double")
    one = 0.5 + 0.85 * 0.5 * 0.5 + 0.85**2 * 0.25 * 1.0
    assert M.pfound(df, "g", "s", "r", "t").first().pfound == pytest.approx((one + 0.25) / 2)


def test_zero_scores_are_wrong(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 0), (1.0, 1), (-1.0, 0)], "s double, y int")
    assert M.binary(df, F.col("s"), F.col("y") == 1).first().accuracy == 0.5
    none = M.binary(df.where("s = 0"), F.col("s"), F.col("y") == 1).first()
    assert none.precision is None and none.recall == 0.0


def test_blocks_of_outputs(spark):
    """Large logits, ties, the reference class, rows of weight 0."""
    rows = spark.createDataFrame([(0, [1000.0, -1000.0]), (2, [-1000.0, -2000.0]), (1, [3.0, 3.0]), (2, [0.0, 0.0])], "y int, x array<double>").coalesce(1)
    y, x, labels = F.col("y"), F.col("x"), F.array(F.lit(1.0), F.lit(0.0))
    out = rows.select(
        B.class_likelihood(y, x).alias("value"), B.class_step(y, x).alias("step"), B.predicted_class(x).alias("predicted"),
        B.label_set_likelihood(labels, x).alias("labels"), B.weighted_row(B.squares, F.lit(0))(labels, x).alias("none"),
        B.weighted_step(B.square_step, F.lit(0))(labels, x).alias("still"),
    ).collect()
    assert [r["predicted"] for r in out] == [0, 2, 0, 2]
    assert [r["value"] for r in out] == pytest.approx([0.0, 0.0, 3 - math.log(1 + 2 * math.exp(3)), -math.log(3)])
    assert out[3]["step"] == pytest.approx([1 / 3, 1 / 3]) and out[0]["step"] == pytest.approx([0.0, 0.0])
    assert out[3]["labels"] == pytest.approx(-math.log(5)) and out[0]["labels"] == pytest.approx(0.0)
    assert all(r["none"] == 0.0 and r["still"] == [0.0, 0.0] for r in out)
