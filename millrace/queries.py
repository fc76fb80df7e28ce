"""Queries over the driver's tables, one or more an operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import blockwise as B
from millrace.functions import losses as L
from millrace.functions import metrics as M
from millrace.functions import vectors as V
from millrace.operators import aggregates as A
from millrace.operators import clustering as C
from millrace.operators import factorization as Z
from millrace.operators import pool as P
from millrace.operators import sampling as S
from millrace.operators import sequences as Q
from millrace.operators import text as X
from millrace.operators import windows as W
from millrace.operators.grid import Grid
from millrace.plans import models as K
from millrace.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def _r(c, n: int = 6):
    return F.round(c, n)


def _line_features() -> list:
    return [F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")]


#: Borders of the four line features in the queries that fix a grid.
GRID = Grid([[10.0, 25.0, 40.0], [0.02, 0.05], [0.03], [2.0, 4.0]])
_ROW = "l_orderkey * 10 + l_linenumber"
_BINS_SQL = {
    0: "(l_quantity > 10)::INT + (l_quantity > 25)::INT + (l_quantity > 40)::INT",
    1: "(l_discount > 0.02)::INT + (l_discount > 0.05)::INT",
    2: "(l_tax > 0.03)::INT",
    3: "(l_linenumber > 2)::INT + (l_linenumber > 4)::INT",
}
_LONG_SQL = " UNION ALL ".join(
    f"SELECT {f} AS feature, {b} AS bin, l_extendedprice AS y FROM lineitem" for f, b in _BINS_SQL.items()
)
_HIST_SQL = f"SELECT feature, bin, COUNT(*)::DOUBLE AS n, SUM(y) AS s, SUM(y * y) AS s2 FROM ({_LONG_SQL}) GROUP BY feature, bin"


_R_ITEMS = "FROM lineitem WHERE l_returnflag = 'R'"


def _binned(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", F.array(*_line_features()).alias("features"))
    return rows.withColumn("bins", GRID.bins(F.col("features")))


# --- pools and projections -------------------------------------------------


@query(f"""SELECT {_ROW} AS row_id, ROUND(l_quantity + 2 * l_discount + 3 * l_tax + 4 * l_linenumber, 6) AS weighted, 4 AS width FROM lineitem""")
def pool_assemble(spark, d):
    """Columns as one vector, seen through a weighted sum and its width."""
    v = P.assemble("l_quantity", "l_discount", "l_tax", "l_linenumber")
    return _items(spark, d).select(F.expr(_ROW).alias("row_id"), _r(V.linear(v, [1, 2, 3, 4])).alias("weighted"), F.size(v).alias("width"))


@query("""SELECT * FROM (VALUES (0, 'r_regionkey', 'INTS'), (1, 'r_name', 'CHAR_SEQ')) t(position, name, kind) CROSS JOIN (SELECT COUNT(*) AS n_rows FROM region)""")
def pool_info(spark, d):
    """Columns, their pool types and the number of rows."""
    return P.info(table(spark, d, "region"))


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 7 = 3 AND r < 700""")
def sub_rows(spark, d):
    """Rows by a list of row ids."""
    pool = P.numbered(table(spark, d, "orders"), "o_orderkey")
    wanted = spark.range(700).where("id % 7 = 3").select(F.col("id").alias("row_id"), F.col("id").alias("position"))
    return P.sub(pool, wanted).select("o_orderkey", "o_totalprice")


@query("""SELECT label, COUNT(*) AS n, MIN(vec_id) AS first_row FROM embeddings GROUP BY label""")
def class_counts(spark, d):
    """Rows of each class and the first row that has it."""
    return P.class_counts(table(spark, d, "embeddings").withColumn("row_id", F.col("vec_id")), "label")


@query("""SELECT (MAX(label) + 1)::INT AS n_classes FROM embeddings""")
def count_classes(spark, d):
    """Largest label and one."""
    return P.n_classes(table(spark, d, "embeddings"), "label")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 4 ELSE p_size % 5 - 1 END AS class FROM part""")
def normalize_labels(spark, d):
    """Labels 1..4 and -1 (for 0) numbered from 0, -1 last."""
    labelled = table(spark, d, "part").withColumn("label", F.when(F.col("p_size") % 5 == 0, -1).otherwise(F.col("p_size") % 5))
    return P.normalized_labels(labelled, "label").select("p_partkey", "class")


@query("""SELECT vec_id, CASE WHEN label = 3 THEN 1.0 ELSE -1.0 END::DOUBLE AS target FROM embeddings""")
def ovr_target(spark, d):
    """One class against the others."""
    return table(spark, d, "embeddings").select("vec_id", P.one_vs_rest(F.col("label"), 3).alias("target"))


@query("""SELECT vec_id, CASE label WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 10 END AS mapped FROM embeddings""")
def map_labels(spark, d):
    """Labels by a dictionary."""
    return table(spark, d, "embeddings").select("vec_id", P.mapped(F.col("label"), {0: 10, 1: 11, 2: 10}).alias("mapped"))


@query("""SELECT label, vec_id AS row_id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings""")
def class_rows(spark, d):
    """Row ids by class."""
    return P.class_rows(table(spark, d, "embeddings").withColumn("row_id", F.col("vec_id")), "label").withColumn("place", F.col("place").cast("long"))


@query("""WITH m AS (SELECT MIN(o_totalprice) lo, MAX(o_totalprice) hi FROM orders)
SELECT o_orderkey, LEAST(3, (o_totalprice > lo + (hi - lo) / 4 * 1)::INT + (o_totalprice > lo + (hi - lo) / 4 * 2)::INT + (o_totalprice > lo + (hi - lo) / 4 * 3)::INT + (o_totalprice > lo + (hi - lo) / 4 * 4)::INT)::INT AS class FROM orders, m""")
def regression_to_mc(spark, d):
    """A regression target as four classes of equal width."""
    o = table(spark, d, "orders")
    m = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).first()
    return o.select("o_orderkey", V.bucket(F.col("o_totalprice"), V.equal_borders(m.lo, m.hi, 4)).cast("int").alias("class"))


@query("""SELECT c.c_custkey, ROUND(c_acctbal, 6) AS f0, ROUND(COALESCE(s, 0), 2) AS f1 FROM customer c JOIN (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def joined_feature_sets(spark, d):
    """Two feature sets of the same items as one."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.array("c_acctbal").alias("features"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(F.array(F.sum("o_totalprice")).alias("features"))
    j = P.joined(a, b)
    return j.select(F.col("item_id").alias("c_custkey"), _r(F.col("features")[0]).alias("f0"), _r(F.col("features")[1], 2).alias("f1"))


# --- losses ---------------------------------------------------------------

_PRED = "1000 * l_quantity"


@query(f"""SELECT ROUND(SQRT(AVG(POWER(l_extendedprice - {_PRED}, 2))), 4) AS rmse FROM lineitem""")
def l2_rmse(spark, d):
    """L2 as a value: the root of the mean square."""
    return _items(spark, d).agg(_r(L.rmse(F.col("l_extendedprice"), F.expr(_PRED)), 4).alias("rmse"))


_LEAF_SQL = """SELECT l_returnflag, l_linestatus, COUNT(*)::DOUBLE AS n, SUM(l_discount) AS s, SUM(l_discount * l_discount) AS s2 FROM lineitem GROUP BY ALL"""


def _leaves(spark, d):
    return _items(spark, d).groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").cast("double").alias("n"), F.sum("l_discount").alias("s"), F.sum(F.col("l_discount") * F.col("l_discount")).alias("s2")
    )


def _scores(name: str):
    def run(spark, d):
        c = L.CRITERIA[name]
        n, s, s2 = F.col("n"), F.col("s"), F.col("s2")
        return _leaves(spark, d).select("l_returnflag", "l_linestatus", _r(c.score(n, s, s2), 4).alias("score"), _r(c.leaf(n, s)).alias("leaf"))

    return run


for _name, _score, _leaf in (
    ("l2", "-s * s / n", "s / n"),
    ("satl2", "CASE WHEN n > 2 THEN n * (n - 2) / (n * n - 3 * n + 1) * (s2 - s * s / n) ELSE s2 END", "CASE WHEN n > 2 THEN s / n ELSE 0 END"),
    ("loo", "CASE WHEN n > 1 THEN -s * s / n * (n / (n - 1)) * (n / (n - 1)) ELSE 0 END", "s / n"),
    ("logl2", "-s * s / n * LN(n + 1)", "s / n"),
    ("corrl2", "CASE WHEN n > 2 THEN n / (n - 1) * (s2 - s * s / n) ELSE s2 END", "s / n"),
    ("combl2", "CASE WHEN n > 1 THEN -s * s / n * (n / (n - 1)) * (n / (n - 1)) * (1 + 2 * LN(n + 1)) ELSE 0 END", "s / n"),
    ("l2reg", "CASE WHEN n > 2 THEN -s * s / n * n * (n - 2) / (n * n - 3 * n + 1) * (1 + 2 * LN(n + 1)) ELSE 0 END", "s / (n + 1)"),
):
    _criterion = {"l2": "L2", "satl2": "SatL2", "loo": "LOOL2", "logl2": "LogL2", "corrl2": "CorrL2", "combl2": "CombL2", "l2reg": "L2Reg"}[_name]
    QUERIES[f"{_name}_leaf_scores"] = _scores(_criterion)
    ORACLES[f"{_name}_leaf_scores"] = f"SELECT l_returnflag, l_linestatus, ROUND({_score}, 4) AS score, ROUND({_leaf}, 6) AS leaf FROM ({_LEAF_SQL})"


@query(f"""WITH r AS (SELECT l_orderkey, l_extendedprice - {_PRED} AS e FROM lineitem), g AS (SELECT e - AVG(e) OVER (PARTITION BY l_orderkey) AS e FROM r) SELECT ROUND(SQRT(AVG(e * e)), 4) AS grouped_rmse FROM g""")
def grouped_l2(spark, d):
    """Root mean square after each group's mean residual is taken out."""
    from pyspark.sql.window import Window

    rows = _items(spark, d).select("l_orderkey", (F.col("l_extendedprice") - F.expr(_PRED)).alias("e"))
    free = rows.select((F.col("e") - F.avg("e").over(Window.partitionBy("l_orderkey"))).alias("e"))
    return free.agg(_r(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("grouped_rmse"))


@query("""SELECT ROUND(SQRT(SUM(l_quantity * POWER(l_discount - 0.05, 2)) / SUM(l_quantity)), 8) AS wrmse FROM lineitem""")
def weighted_l2(spark, d):
    """Weighted root mean square."""
    return _items(spark, d).agg(_r(L.weighted_rmse(F.col("l_discount"), F.lit(0.05), F.col("l_quantity")), 8).alias("wrmse"))


_Y, _SCORE = "(l_returnflag = 'R')::INT", "(l_quantity - 25) / 10"
_LOGLIK = f"CASE WHEN {_Y} = 1 THEN -LN(1 + EXP(-({_SCORE}))) ELSE -LN(1 + EXP({_SCORE})) END"


def _labelled(spark, d):
    return _items(spark, d).select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), ((F.col("l_quantity") - 25) / 10).alias("x")
    )


@query(f"""SELECT ROUND(EXP(AVG({_LOGLIK})), 6) AS llogit FROM lineitem""")
def llogit(spark, d):
    """exp of the mean log-likelihood of logits."""
    return _labelled(spark, d).agg(_r(L.likelihood(F.col("y"), F.col("x"))).alias("llogit"))


@query(f"""SELECT ROUND(EXP(SUM(l_tax * {_LOGLIK}) / SUM(l_tax)), 6) AS value FROM lineitem""")
def weighted_llogit(spark, d):
    """The same with row weights."""
    rows = _items(spark, d).select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), ((F.col("l_quantity") - 25) / 10).alias("x"), "l_tax")
    return rows.agg(_r(L.weighted_likelihood(F.col("y"), F.col("x"), F.col("l_tax"))).alias("value"))


@query(f"""SELECT ROUND(SUM(CASE WHEN {_Y} = 1 THEN LN(0.1 + l_discount) ELSE LN(0.9 - l_discount) END), 4) AS ll FROM lineitem""")
def ll_probabilities(spark, d):
    """Sum of log-likelihoods of probabilities."""
    rows = _items(spark, d).select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), (F.col("l_discount") + 0.1).alias("p"))
    return rows.agg(_r(L.log_loss(F.col("y"), F.col("p")), 4).alias("ll"))


@query(f"""SELECT ROUND(AVG(CASE WHEN {_Y} = 1 THEN 1 - 1 / (1 + EXP(-({_SCORE}))) ELSE 1 / (1 + EXP(-({_SCORE}))) END), 6) AS ce FROM lineitem""")
def celogit(spark, d):
    """Mean probability of the wrong class."""
    return _labelled(spark, d).agg(_r(L.misclassification(F.col("y"), F.col("x"))).alias("ce"))


@query(f"""WITH p AS (SELECT {_Y} AS y, 0.2 + 0.8 / (1 + EXP(-({_SCORE}))) AS p, 0.3 / (1 + EXP(-({_SCORE}))) + 0.7 / (1 + EXP({_SCORE})) AS q, 0.6 * (0.25 + 0.75 / (1 + EXP(-({_SCORE})))) AS e FROM lineitem)
SELECT ROUND(EXP(AVG(CASE WHEN y = 1 THEN LN(p) ELSE LN(1 - p) END)), 6) AS complement, ROUND(EXP(AVG(CASE WHEN y = 1 THEN LN(q) ELSE LN(1 - q) END)), 6) AS choice, ROUND(EXP(AVG(CASE WHEN y = 1 THEN LN(e) ELSE LN(1 - e) END)), 6) AS exclusive FROM p""")
def mixture_logits(spark, d):
    """Likelihoods of the three mixtures."""
    y, x = F.col("y"), F.col("x")
    return _labelled(spark, d).agg(
        _r(L.mixture(y, x, F.lit(0.2))).alias("complement"), _r(L.choice_mixture(y, x, F.lit(0.3))).alias("choice"),
        _r(L.exclusive_mixture(y, x, F.lit(0.6), 0.25)).alias("exclusive"),
    )


# --- metrics --------------------------------------------------------------


@query(f"""WITH c AS (SELECT COUNT(*) FILTER ({_Y} = 1 AND l_quantity > 25) tp, COUNT(*) FILTER ({_Y} = 0 AND l_quantity > 25) fp, COUNT(*) FILTER ({_Y} = 1 AND l_quantity <= 25) fn, AVG(CASE WHEN ({_Y} = 1 AND l_quantity > 25) OR ({_Y} = 0 AND l_quantity < 25) THEN 1.0 ELSE 0 END) a FROM lineitem)
SELECT tp, fp, fn, ROUND(a, 6) AS accuracy, ROUND(tp / (tp + fp), 6) AS "precision", ROUND(tp / (tp + fn), 6) AS recall, ROUND(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f_score FROM c""")
def precision_recall_f(spark, d):
    """Accuracy, precision, recall and F2 at a score of 0."""
    m = M.binary(_labelled(spark, d), F.col("x"), F.col("y") > 0, beta=2.0)
    return m.select("tp", "fp", "fn", *[_r(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f_score")])


@query(f"""WITH g AS (SELECT {_SCORE} AS s, SUM({_Y}) AS p, SUM(1 - {_Y}) AS n FROM lineitem GROUP BY 1), u AS (SELECT p, n, COALESCE(SUM(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM g)
SELECT ROUND((SUM(p * (under + n / 2)) / (SUM(p) * SUM(n)))::DOUBLE, 6) AS auc, SUM(p)::BIGINT AS n_pos, SUM(n)::BIGINT AS n_neg FROM u""")
def auc(spark, d):
    """Area under the ROC curve, ties shared."""
    return M.auc(_labelled(spark, d), "x", F.col("y") > 0).withColumn("auc", _r(F.col("auc")))


_RANKED = "SELECT l_orderkey AS g, l_extendedprice AS s, l_linenumber AS t, l_linenumber % 5 AS y, l_suppkey % 3 AS sub FROM lineitem"


def _ranked(spark, d):
    return _items(spark, d).select(
        F.col("l_orderkey").alias("g"), F.col("l_extendedprice").alias("s"), F.col("l_linenumber").alias("t"),
        (F.col("l_linenumber") % 5).alias("y"), (F.col("l_suppkey") % 3).alias("sub"),
    )


@query(f"""WITH b AS ({_RANKED}), r AS (SELECT g, y, POWER(2, y) - 1 AS gain, ROW_NUMBER() OVER (PARTITION BY g ORDER BY s DESC, t) a, ROW_NUMBER() OVER (PARTITION BY g ORDER BY y DESC, t) i FROM b),
q AS (SELECT g, SUM(gain / LN(a + 1)) d, SUM(gain / LN(i + 1)) m FROM r GROUP BY g HAVING MIN(y) <> MAX(y)) SELECT ROUND(AVG(CASE WHEN m > 0 THEN d / m ELSE 0 END), 6) AS ndcg, COUNT(*) AS n_groups FROM q""")
def ndcg(spark, d):
    """Mean NDCG of orders."""
    return M.ndcg(_ranked(spark, d), "g", "s", "y", "t").withColumn("ndcg", _r(F.col("ndcg")))


_PF = """SELECT ROUND(AVG(pf), 6) AS pfound, COUNT(*) AS n_groups FROM (SELECT g, SUM(r * COALESCE(l, 1)) AS pf FROM (SELECT g, r, EXP(SUM(LN(0.85 * (1 - r))) OVER (PARTITION BY g ORDER BY s DESC, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS l FROM {src}) GROUP BY g)"""


@query(f"WITH b AS (SELECT *, y / 8.0 AS r FROM ({_RANKED})) " + _PF.format(src="b"))
def pfound(spark, d):
    """Probability that a user finds what is relevant, walking down."""
    return M.pfound(_ranked(spark, d).withColumn("r", F.col("y") / 8.0), "g", "s", "r", "t").withColumn("pfound", _r(F.col("pfound")))


@query(f"WITH a AS (SELECT *, y / 8.0 AS r, ROW_NUMBER() OVER (PARTITION BY g, sub ORDER BY s DESC, t) AS k FROM ({_RANKED})), b AS (SELECT * FROM a WHERE k = 1) " + _PF.format(src="b"))
def pfound_sbg(spark, d):
    """The same over the best row of each subgroup."""
    return M.pfound_subgroups(_ranked(spark, d).withColumn("r", F.col("y") / 8.0), "g", "sub", "s", "r", "t").withColumn("pfound", _r(F.col("pfound")))


@query(f"""WITH b AS (SELECT g, t, s / 100000 AS s, y FROM ({_RANKED})), p AS (SELECT ABS(a.y - c.y) AS w, SIGN(a.y - c.y) * (a.s - c.s) AS m FROM b a JOIN b c ON a.g = c.g AND a.t < c.t AND a.y <> c.y) SELECT ROUND(EXP(SUM(-w * LN(1 + EXP(-m))) / COUNT(*)), 6) AS pairwise_ll, COUNT(*) AS n_pairs FROM p""")
def pairwise_ll(spark, d):
    """Pairwise likelihood inside groups."""
    rows = _ranked(spark, d).withColumn("s", F.col("s") / 100000)
    return M.pairwise_likelihood(rows, "g", "s", "y", "t").withColumn("pairwise_ll", _r(F.col("pairwise_ll")))


_MC = "SELECT l_linenumber % 4 AS y, CASE WHEN l_quantity < 5 THEN -1 ELSE (l_quantity::INT) % 4 END AS p FROM lineitem"


def _classes(spark, d):
    q = F.col("l_quantity").cast("int") % 4
    return _items(spark, d).select((F.col("l_linenumber") % 4).alias("y"), F.when(F.col("l_quantity") < 5, -1).otherwise(q).alias("p"))


@query(f"SELECT y AS label, p AS predicted, COUNT(*) AS n FROM ({_MC}) GROUP BY ALL")
def confusion(spark, d):
    """Counts of (label, prediction)."""
    return M.confusion(_classes(spark, d), "y", "p")


@query(f"""WITH c AS (SELECT COUNT(*) FILTER (y = p) tp, COUNT(*) FILTER (y <> p AND p <> -1) fp, COUNT(*) FILTER (y <> p) fn FROM ({_MC})) SELECT ROUND(tp / (tp + fp), 6) AS "precision", ROUND(tp / (tp + fn), 6) AS recall, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def micro_prf(spark, d):
    """Micro precision, recall, F1; -1 abstains."""
    return M.micro(_classes(spark, d), "y", "p").select(*[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH c AS (SELECT k, COUNT(*) FILTER (y = k AND p = k) tp, COUNT(*) FILTER (p = k) pp, COUNT(*) FILTER (y = k) yy FROM ({_MC}), (SELECT UNNEST([0, 1, 2, 3]) AS k) GROUP BY k), m AS (SELECT AVG(tp / NULLIF(pp, 0)) p, AVG(tp / NULLIF(yy, 0)) r FROM c) SELECT ROUND(p, 6) AS "precision", ROUND(r, 6) AS recall, ROUND(2 * p * r / (p + r), 6) AS f1 FROM m""")
def macro_prf(spark, d):
    """Macro precision, recall, and their harmonic mean."""
    return M.macro(_classes(spark, d), "y", "p").select(*[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH b AS ({_MC}), n AS (SELECT COUNT(*) n, COUNT(*) FILTER (y = p) h FROM b), e AS (SELECT SUM(a.c * b.c) AS x FROM (SELECT y, COUNT(*) c FROM b GROUP BY y) a JOIN (SELECT p, COUNT(*) c FROM b GROUP BY p) b ON a.y = b.p) SELECT ROUND(((h / n - x / (n * n)) / (1 - x / (n * n)))::DOUBLE, 6) AS kappa, ROUND(h / n, 6) AS accuracy FROM n, e""")
def cohen_kappa(spark, d):
    """Cohen's kappa."""
    return M.kappa(_classes(spark, d), "y", "p").select(_r(F.col("kappa")).alias("kappa"), _r(F.col("accuracy")).alias("accuracy"))


_ML = "SELECT quality AS y0, toxic AS y1, (doc_id % 3 > 0)::INT AS p0, (doc_id % 7 = 0)::INT AS p1 FROM labels"


def _multilabel(spark, d):
    p = [F.when(F.col("doc_id") % 3 > 0, 1).otherwise(0), F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)]
    return table(spark, d, "labels").select(F.array("quality", "toxic").alias("y"), F.array(*p).alias("p"))


@query(f"""SELECT ROUND(AVG((y0 = p0 AND y1 = p1)::INT), 6) AS exact_match, ROUND(AVG(((y0 <> p0)::INT + (y1 <> p1)::INT) / 2), 6) AS hamming_loss, ROUND((SUM(y0 * p0) / (SUM(p0) + SUM(y0)) + SUM(y1 * p1) / (SUM(p1) + SUM(y1)))::DOUBLE, 6) AS macro_f, ROUND((2 * (SUM(y0 * p0) + SUM(y1 * p1)) / (SUM(p0) + SUM(p1) + SUM(y0) + SUM(y1)))::DOUBLE, 6) AS micro_f FROM ({_ML})""")
def multilabel_metrics(spark, d):
    """Exact match, Hamming loss, macro and micro F of two labels."""
    m = M.multilabel(_multilabel(spark, d), "y", "p")
    return m.select(*[_r(F.col(c)).alias(c) for c in ("exact_match", "hamming_loss", "macro_f", "micro_f")])


@query("""WITH c AS (SELECT LEAST(FLOOR(l_discount * 10 * 10), 10)::INT b, COUNT(*) n, SUM((l_returnflag = 'R')::INT) p FROM lineitem GROUP BY 1), g AS (SELECT k AS b, COALESCE(n, 0) n, COALESCE(p, 0) p FROM (SELECT UNNEST(RANGE(11))::INT AS k) LEFT JOIN c ON c.b = k)
SELECT b / 10.0 AS threshold, ROUND((SUM(p) OVER w / NULLIF(SUM(n) OVER w, 0))::DOUBLE, 6) AS "precision", ROUND((SUM(p) OVER w / (SELECT SUM(p) FROM g))::DOUBLE, 6) AS recall FROM g WINDOW w AS (ORDER BY b DESC)""")
def threshold_curve(spark, d):
    """Precision and recall by threshold."""
    m = M.threshold_curve(_items(spark, d), F.col("l_returnflag") == "R", F.col("l_discount") * 10, 10)
    return m.select(F.col("threshold"), _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"))


# --- windows, events ------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - 1 AS place FROM lineitem""")
def argsort(spark, d):
    """Place of each row in its group."""
    return W.argsort(_items(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_extendedprice", "l_linenumber").drop("l_extendedprice")


@query("""SELECT l_orderkey, l_linenumber, RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 + 0.5 * COUNT(*) OVER (PARTITION BY l_returnflag, l_quantity) AS avg_rank FROM lineitem""")
def avg_rank(spark, d):
    """Ranks with ties shared."""
    rows = _items(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return W.average_ranks(rows, "l_returnflag", "l_quantity").select("l_orderkey", "l_linenumber", F.col("avg_rank").cast("double"))


_EV = "SELECT event_id, user_id, event_type, value, EPOCH(ts) / 3600.0 AS h FROM events"


def _events(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", (seconds / 3600.0).alias("h"))


@query(f"SELECT event_id, ROUND(h - LAG(h) OVER (PARTITION BY user_id, event_type ORDER BY h, event_id), 4) AS delta FROM ({_EV})")
def prev_delta(spark, d):
    """Time since the previous event of a user and type."""
    return W.previous_delta(_events(spark, d), ["user_id", "event_type"], "h", "event_id").select("event_id", _r(F.col("delta"), 4).alias("delta"))


@query(f"""WITH l AS (SELECT *, LAG(event_type) OVER w AS p, h - LAG(h) OVER w AS s FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY h, event_id)) SELECT event_id, ROUND(COALESCE(s, -1), 4) AS delta FROM l WHERE s IS NULL OR event_type IS DISTINCT FROM p OR s > 0.5""")
def event_runs(spark, d):
    """Events that begin a run."""
    return W.runs(_events(spark, d), "user_id", "event_type", "h", "event_id", 0.5).select("event_id", _r(F.col("delta"), 4).alias("delta"))


_SESS = f"""SELECT event_id, user_id, h, SUM(n) OVER (PARTITION BY user_id ORDER BY h, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN COALESCE(h - LAG(h) OVER (PARTITION BY user_id ORDER BY h, event_id) > 0.5, TRUE) THEN 1 ELSE 0 END AS n FROM ({_EV}))"""


@query(f"SELECT event_id, session FROM ({_SESS})")
def sessions(spark, d):
    """Sessions by gaps of half an hour."""
    return W.sessions(_events(spark, d), "user_id", "h", "event_id", 0.5).select("event_id", "session")


@query(f"SELECT user_id, session, COUNT(*) AS n_events, ROUND(MAX(h) - MIN(h), 4) AS length FROM ({_SESS}) GROUP BY ALL")
def session_stats(spark, d):
    """Events and length of sessions."""
    s = W.session_stats(W.sessions(_events(spark, d), "user_id", "h", "event_id", 0.5), "user_id", "h")
    return s.withColumn("length", _r(F.col("length"), 4))


@query(f"WITH e AS ({_EV}) SELECT user_id, event_type, COUNT(*) AS n, ROUND(COUNT(*) / ((MAX(h) - (SELECT MIN(h) FROM e) + 24 - 1e-6) / 24), 6) AS per_unit FROM e GROUP BY ALL")
def spu_pairs(spark, d):
    """Events a day of each user and type."""
    return W.sessions_per_unit(_events(spark, d), ["user_id", "event_type"], "h", 24.0).withColumn("per_unit", _r(F.col("per_unit")))


@query(f"""WITH x AS (SELECT event_id, user_id, event_type, h, h - LAG(h) OVER (PARTITION BY user_id ORDER BY h, event_id) AS a, value / 10 + 1 AS p FROM ({_EV})), y AS (SELECT user_id, a, LAG(p) OVER (PARTITION BY user_id ORDER BY h, event_id) AS m FROM x)
SELECT user_id, ROUND(AVG(ABS(1 / m - 1 / a)), 5) AS error, COUNT(*) AS n FROM y WHERE m IS NOT NULL AND m > 0 AND a > 0.001 AND a <= 336 GROUP BY user_id""")
def spu_error(spark, d):
    """Error of predicted rates by user, gaps of more than two weeks left out."""
    rows = W.previous_delta(_events(spark, d), ["user_id"], "h", "event_id").withColumn("p", F.col("value") / 10 + 1)
    rows = rows.withColumn("delta", F.when(F.col("delta") > 0.001, F.col("delta")).otherwise(0.0))
    return W.rate_error(rows, ["user_id"], "p", "delta", ["h", "event_id"], most=336.0).withColumn("error", _r(F.col("error"), 5))


@query("""WITH c AS (SELECT user_id, EXTRACT(hour FROM ts)::INT AS hour, COUNT(*) n FROM events GROUP BY ALL), g AS (SELECT u.user_id, k AS hour, COALESCE(n, 0) n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT UNNEST(RANGE(24))::INT AS k) LEFT JOIN c ON c.user_id = u.user_id AND c.hour = k) SELECT user_id, FIRST(hour ORDER BY n, hour) AS quiet_hour FROM g GROUP BY user_id""")
def quiet_hours(spark, d):
    """Each user's quietest hour of the day."""
    return W.quiet_hour(table(spark, d, "events"), "user_id", F.hour("ts"))


@query(f"""WITH x AS (SELECT LAG(event_type) OVER w AS previous, event_type AS current, h - LAG(h) OVER w AS s FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY h, event_id)) SELECT previous, current, COUNT(*) AS n FROM x WHERE s < 24 AND previous <> current GROUP BY ALL""")
def query_transitions(spark, d):
    """Transitions between consecutive types of a user within a day."""
    return W.transitions(_events(spark, d), "user_id", "event_type", "h", "event_id", 24.0)


@query(f"""SELECT event_id, ROUND((COALESCE(SUM((event_type = 'purchase')::INT) OVER w, 0) + 1) / (COUNT(*) OVER w + 2), 6) AS rate FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY h, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_ctr(spark, d):
    """Rate of purchases among a user's earlier events."""
    r = W.running_rate(_events(spark, d), "user_id", ["h", "event_id"], F.col("event_type") == "purchase")
    return r.select("event_id", _r(F.col("rate")).alias("rate"))


@query("""SELECT o_orderkey, ROUND((SUM(o_totalprice / m) OVER w + 1) / (COUNT(*) OVER w + 1), 6) AS multiplier FROM orders, (SELECT AVG(o_totalprice) m FROM orders) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def district_multiplier(spark, d):
    """Running price level of each priority."""
    r = W.running_multiplier(table(spark, d, "orders"), "o_orderpriority", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return r.select("o_orderkey", _r(F.col("multiplier")).alias("multiplier"))


@query(f"""SELECT event_id, ROUND(SQRT(GREATEST(SUM(value * value) OVER w / COUNT(*) OVER w - POWER(SUM(value) OVER w / COUNT(*) OVER w, 2), 0)), 3) AS volatility FROM ({_EV}) WINDOW w AS (PARTITION BY event_type ORDER BY h, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rolling_volatility(spark, d):
    """Deviation over a key's last 30 rows."""
    r = W.rolling_volatility(_events(spark, d), "event_type", ["h", "event_id"], "value")
    return r.select("event_id", _r(F.col("volatility"), 3).alias("volatility"))


@query("""WITH m AS (SELECT o_orderpriority AS k, o_orderdate AS t, MAX(o_totalprice) AS v FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL) SELECT o_orderkey, v AS macro FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) o LEFT JOIN LATERAL (SELECT v FROM m WHERE m.k = o.o_orderpriority AND m.t >= o.o_orderdate ORDER BY m.t LIMIT 1) ON TRUE""")
def asof_forward(spark, d):
    """The value at or next after each row's time."""
    o = table(spark, d, "orders")
    right = o.where("o_orderkey % 5 = 0").groupBy("o_orderpriority", "o_orderdate").agg(F.max("o_totalprice").alias("v"))
    left = o.where("o_orderkey % 5 <> 0").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return W.as_of_next(left, right, ["o_orderpriority"], "o_orderdate", "v", "macro").select("o_orderkey", "macro")


@query("SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def topk_users(spark, d):
    """The 20 users with the most events."""
    return W.top(table(spark, d, "events"), "user_id", 20)


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY MD5('x' || user_id::VARCHAR), user_id LIMIT 20")
def random_users(spark, d):
    """20 users by hash."""
    return W.some(table(spark, d, "events"), "user_id", 20, "x")


_CORE = ["events"]
for _i in range(2):
    for _k in ("user_id", "event_type"):
        _CORE.append(f"(SELECT * FROM {_CORE[-1]} WHERE {_k} IN (SELECT {_k} FROM {_CORE[-1]} GROUP BY {_k} HAVING BOOL_OR(event_id % 3 = 0) AND BOOL_OR(event_id % 3 <> 0)))")


@query(f"SELECT event_id, user_id FROM {_CORE[-1]}")
def core_filter(spark, d):
    """Events of users and types that occur in both halves, two rounds."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return W.core(e, F.col("event_id") % 3 == 0, "user_id", "event_type", rounds=2).select("event_id", "user_id")


@query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, COUNT(*) n, SUM((o_totalprice > 150000)::INT) c FROM orders GROUP BY ALL), p AS (SELECT o_orderpriority, SUM(n) pn, SUM(c) pc FROM c GROUP BY 1), g AS (SELECT SUM(pc) / SUM(pn) AS p0 FROM p)
SELECT o_orderpriority, o_orderstatus, n, ROUND(((c + 10 * (pc + 10 * p0) / (pn + 10)) / (n + 10))::DOUBLE, 6) AS rate FROM c JOIN p USING (o_orderpriority), g""")
def smoothed_ctr_backoff(spark, d):
    """Rates of (priority, status), smoothed by those of the priority and of all."""
    r = A.smoothed_rates(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", F.col("o_totalprice") > 150000)
    return r.withColumn("rate", _r(F.col("rate")))


# --- sampling -------------------------------------------------------------

_UNIT = "(('0x' || SUBSTRING(MD5({salt} || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"


@query(f"SELECT o_orderkey, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.8 THEN 1 ELSE 2 END AS part FROM (SELECT o_orderkey, {_UNIT.format(salt=repr(''), key='o_orderkey')} AS u FROM orders)")
def hash_split(spark, d):
    """Rows dealt to three parts."""
    return table(spark, d, "orders").select("o_orderkey", S.assigned(F.col("o_orderkey"), [0.5, 0.3, 0.2]).alias("part"))


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_UNIT.format(salt=repr('g'), key='l_orderkey')} < 0.8")
def group_split(spark, d):
    """The learn side of a split by whole orders."""
    return S.split(_items(spark, d).select("l_orderkey", "l_linenumber"), "l_orderkey", 0.8, "g")[0]


@query(f"SELECT FLOOR({_UNIT.format(salt=repr('k'), key='o_orderkey')} * 5)::INT AS fold, COUNT(*) AS n FROM orders GROUP BY 1")
def kfold_sizes(spark, d):
    """Rows of each of five folds."""
    return table(spark, d, "orders").groupBy(S.fold(F.col("o_orderkey"), 5, "k").alias("fold")).agg(F.count("*").alias("n"))


@query(f"""WITH u AS (SELECT o_orderkey, {_UNIT.format(salt=repr('b'), key='o_orderkey')} AS u FROM orders) SELECT o_orderkey, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.73575888234288467 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.98101184312384626 THEN 3 WHEN u < 0.99634015317265634 THEN 4 WHEN u < 0.99940581518241833 THEN 5 WHEN u < 0.99991675885071199 THEN 6 ELSE 7 END AS weight FROM u""")
def poisson_bootstrap(spark, d):
    """Bootstrap weights."""
    return table(spark, d, "orders").select("o_orderkey", S.poisson(F.col("o_orderkey"), "b").alias("weight"))


@query("""WITH b AS (SELECT ts AS border FROM (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS r, COUNT(*) OVER () AS n FROM events) WHERE r = FLOOR(n * 0.7) + 1) SELECT event_id, ts <= border AS train FROM events, b""")
def time_split(spark, d):
    """Train and test by one border in time."""
    return S.time_split(table(spark, d, "events"), "ts", 0.7).select("event_id", "train")


@query("""WITH r AS (SELECT event_id, FLOOR(COUNT(*) OVER (PARTITION BY user_id, event_type) * 0.5) AS k, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT event_id, n <= k AS train FROM r WHERE k >= 2""")
def prefix_split(spark, d):
    """Train as the first half of each pair's events."""
    return S.prefix_split(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], 0.5).select("event_id", "train")


# --- quantisation, statistics, trees ---------------------------------------


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"({b})::INT AS b{f}" for f, b in _BINS_SQL.items()) + " FROM lineitem")
def binarize_fixed_borders(spark, d):
    """Bins by given borders."""
    return _binned(spark, d).select("l_orderkey", "l_linenumber", *[F.col("bins")[i].alias(f"b{i}") for i in range(4)])


@query(f"SELECT feature, bin, n, ROUND(s, 2) AS s, ROUND(s2 / 1e6, 1) AS s2 FROM ({_HIST_SQL})")
def feature_histogram(spark, d):
    """Sums of each (feature, bin)."""
    h = A.histogram(_binned(spark, d), "bins", F.col("l_extendedprice"))
    return h.select("feature", "bin", "n", _r(F.col("s"), 2).alias("s"), _r(F.col("s2") / 1e6, 1).alias("s2"))


_SPLIT_SQL = f"""SELECT feature, bin, SUM(n) OVER u AS ln, SUM(s) OVER u AS ls, SUM(s2) OVER u AS ls2, SUM(n) OVER w - SUM(n) OVER u AS rn, SUM(s) OVER w - SUM(s) OVER u AS rs, SUM(s2) OVER w - SUM(s2) OVER u AS rs2 FROM ({_HIST_SQL}) WINDOW u AS (PARTITION BY feature ORDER BY bin), w AS (PARTITION BY feature)"""


@query(f"SELECT feature, bin, ln AS left_n, ROUND(ls, 2) AS left_s, rn AS right_n, ROUND(rs, 2) AS right_s FROM ({_SPLIT_SQL})")
def split_scan(spark, d):
    """Left and right sums of each split."""
    s = A.splits(A.histogram(_binned(spark, d), "bins", F.col("l_extendedprice")))
    return s.select("feature", "bin", "left_n", _r(F.col("left_s"), 2).alias("left_s"), "right_n", _r(F.col("right_s"), 2).alias("right_s"))


@query(f"SELECT feature, bin, ROUND(-ls * ls / ln / 1e6 - CASE WHEN rn > 1e-8 THEN rs * rs / rn ELSE 0 END / 1e6, 2) AS score FROM ({_SPLIT_SQL}) ORDER BY -ls * ls / ln - CASE WHEN rn > 1e-8 THEN rs * rs / rn ELSE 0 END, feature, bin LIMIT 3")
def best_split(spark, d):
    """The three splits with the best L2 score."""
    s = A.scored_splits(A.histogram(_binned(spark, d), "bins", F.col("l_extendedprice")), "L2")
    return s.orderBy("score", "feature", "bin").limit(3).select("feature", "bin", _r(F.col("score") / 1e6, 2).alias("score"))


@query(f"""WITH h AS ({_HIST_SQL}), t AS (SELECT a.feature, a.bin AS first_bin, b.bin AS last_bin, SUM(c.n) AS in_n, SUM(c.s) AS in_s FROM h a JOIN h b ON a.feature = b.feature AND a.bin <= b.bin JOIN h c ON c.feature = a.feature AND c.bin BETWEEN a.bin AND b.bin GROUP BY ALL) SELECT t.feature, first_bin, last_bin, in_n, ROUND(in_s, 2) AS in_s, n - in_n AS out_n FROM t JOIN (SELECT feature, SUM(n) AS n FROM h GROUP BY 1) USING (feature)""")
def bin_intervals(spark, d):
    """Sums inside and outside every interval of bins."""
    i = A.intervals(A.histogram(_binned(spark, d), "bins", F.col("l_extendedprice")))
    return i.select("feature", "first_bin", "last_bin", "in_n", _r(F.col("in_s"), 2).alias("in_s"), "out_n")


@query(f"""WITH h AS (SELECT feature, bin, COUNT(*)::DOUBLE n FROM ({_LONG_SQL}) GROUP BY ALL), p AS (SELECT feature, bin, COUNT(*)::DOUBLE m FROM ({_LONG_SQL.replace('FROM lineitem', _R_ITEMS)}) GROUP BY ALL) SELECT feature, bin, n - COALESCE(m, 0) AS n FROM h LEFT JOIN p USING (feature, bin)""")
def histogram_difference(spark, d):
    """A histogram without some of its rows, by subtraction."""
    rows = _binned(spark, d)
    whole, part = (A.histogram(r, "bins", F.lit(1.0)) for r in (rows, rows.where("l_returnflag = 'R'")))
    return A.removed(whole, part).select("feature", "bin", "n")


_TREE = K.ObliviousTree([(0, 25.0), (1, 0.05)], [1.0, 2.0, 3.0, 4.0])


def _scored(spark, d, column):
    x = F.array(*_line_features())
    return _items(spark, d).select("l_orderkey", "l_linenumber", _r(column(x)).alias("value"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN CASE WHEN l_discount > 0.05 THEN 4.0 ELSE 3.0 END ELSE CASE WHEN l_discount > 0.05 THEN 2.0 ELSE 1.0 END END::DOUBLE AS value FROM lineitem")
def tree_apply(spark, d):
    """An oblivious tree as an expression."""
    return _scored(spark, d, _TREE.column)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity <= 25)::INT + (l_discount > 0.05)::INT + (l_tax <= 0.03)::INT <= 1 THEN 7.0 ELSE -1.0 END::DOUBLE AS value FROM lineitem")
def region_apply(spark, d):
    """A region that lets one condition fail."""
    return _scored(spark, d, K.Region([(0, 25.0, True), (1, 0.05, False), (2, 0.03, True)], 7.0, -1.0, 1).column)


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN (({_BINS_SQL[0]}) IN (0, 3) OR ({_BINS_SQL[1]}) = 2) AND ({_BINS_SQL[3]}) IN (1, 2) THEN 2.5 ELSE 0.0 END::DOUBLE AS value FROM lineitem")
def cnf_apply(spark, d):
    """A conjunction of disjunctions of bins."""
    cnf = K.Cnf([[(0, GRID.borders[0], [0, 3]), (1, GRID.borders[1], [2])], [(3, GRID.borders[3], [1, 2])]], 2.5)
    return _scored(spark, d, cnf.column)


@query("SELECT l_orderkey, l_linenumber, ROUND(1 + CASE WHEN l_quantity > 25 THEN 0.5 + CASE WHEN l_discount <= 0.05 THEN 0.25 ELSE 0 END ELSE 0 END, 6)::DOUBLE AS value FROM lineitem")
def bumpy_apply(spark, d):
    """Increments of the leading conditions that hold."""
    return _scored(spark, d, K.Bumpy([(0, 25.0, True), (1, 0.05, False)], [0.5, 0.25], 1.0).column)


_ENSEMBLE = K.Ensemble([_TREE, K.ObliviousTree([(0, 40.0), (3, 2.0)], [0.5, -0.5, 1.5, 2.5])], [0.1, 0.2], 3.0)
_ENS_SQL = "3 + 0.1 * (1 + 2 * (l_quantity > 25)::INT + (l_discount > 0.05)::INT) + 0.2 * CASE WHEN l_quantity > 40 THEN CASE WHEN l_linenumber > 2 THEN 2.5 ELSE 1.5 END ELSE CASE WHEN l_linenumber > 2 THEN -0.5 ELSE 0.5 END END"


@query(f"SELECT l_orderkey, l_linenumber, ROUND({_ENS_SQL}, 6)::DOUBLE AS value FROM lineitem")
def ensemble_apply(spark, d):
    """A weighted sum of trees."""
    return _scored(spark, d, _ENSEMBLE.column)


@query(f"SELECT l_orderkey, l_linenumber, ROUND({_ENS_SQL}, 6)::DOUBLE AS value FROM lineitem")
def compiled_rules(spark, d):
    """The same ensemble as a sum of rules."""
    rules = K.compiled(_ENSEMBLE)
    return _scored(spark, d, lambda x: K.rules_column(rules, x))


@query("SELECT l_orderkey, l_linenumber, ROUND(0.5 + 2 * l_quantity - 3 * l_discount + 0.25 * l_linenumber, 6) AS value FROM lineitem")
def linear_apply(spark, d):
    """A linear model."""
    return _scored(spark, d, K.Linear([2.0, -3.0, 0.0, 0.25], 0.5).column)


@query("SELECT l_orderkey, l_linenumber, ROUND(0.5 + 0.1 * l_quantity + 0.2 * l_discount + 0.5 * (POWER(0.3 * l_quantity + 0.4 * l_discount, 2) - 0.09 * POWER(l_quantity, 2) - 0.16 * POWER(l_discount, 2)), 6) AS value FROM lineitem")
def fm_value(spark, d):
    """A factorisation machine with one factor."""
    return _scored(spark, d, K.Machine(0.5, [0.1, 0.2, 0.0, 0.0], [[0.3, 0.4, 0.0, 0.0]]).column)


@query("SELECT l_orderkey, l_linenumber, ROUND(1 - (1 - l_discount) * (1 - l_tax), 6) AS value FROM lineitem")
def noisy_or(spark, d):
    """Chain of probabilities."""
    return _items(spark, d).select("l_orderkey", "l_linenumber", _r(V.noisy_or(F.array("l_discount", "l_tax"))).alias("value"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, EXP(10 * l_discount - 0.5) a, EXP(10 * l_tax - 0.5) b, 10 * l_discount - 0.5 AS x, 10 * l_tax - 0.5 AS y FROM lineitem) SELECT l_orderkey, l_linenumber, ROUND(a / (1 + a + b), 6) AS p0, ROUND(b / (1 + a + b), 6) AS p1, ROUND(1 / (1 + a + b), 6) AS p2, CASE WHEN GREATEST(x, y) > 1e-12 THEN CASE WHEN x >= y THEN 0 ELSE 1 END ELSE 2 END AS class FROM e""")
def multilogit_probs(spark, d):
    """Probabilities and class of logits with a reference class."""
    x = F.array(10 * F.col("l_discount") - 0.5, 10 * F.col("l_tax") - 0.5)
    p = V.reference_probabilities(x)
    clean = F.transform(x, lambda v: F.when(F.abs(v) < 1e-12, 0.0).otherwise(v))
    return _items(spark, d).select("l_orderkey", "l_linenumber", *[_r(p[i]).alias(f"p{i}") for i in range(3)], V.reference_class(clean, strict=True).cast("int").alias("class"))


@query("""WITH s AS (SELECT COUNT(*) n, SUM(l_quantity * l_quantity) aa, SUM(l_quantity * l_discount) ab, SUM(l_discount * l_discount) bb, SUM(l_quantity * l_extendedprice) ay, SUM(l_discount * l_extendedprice) b_y FROM lineitem) SELECT ROUND(aa / n, 6) AS g00, ROUND(ab / n, 6) AS g01, ROUND(bb / n, 8) AS g11, ROUND(ay / n, 3) AS y0, ROUND(b_y / n, 3) AS y1 FROM s""")
def ridge_gram(spark, d):
    """Gram matrix and moments with the target."""
    from millrace.plans.linear import gram

    rows = _items(spark, d).select(F.array("l_quantity", "l_discount").alias("features"), "l_extendedprice")
    g = gram(rows, "features", F.col("l_extendedprice"), 2)[None]
    v = [float(x) for x in (g.xx[0, 0], g.xx[0, 1], g.xx[1, 1], g.xy[0], g.xy[1])]
    out = spark.createDataFrame([tuple(x / g.n for x in v)], "g00 double, g01 double, g11 double, y0 double, y1 double")
    return out.select(*[_r(F.col(c), k).alias(c) for c, k in (("g00", 6), ("g01", 6), ("g11", 8), ("y0", 3), ("y1", 3))])


@query("""WITH s AS (SELECT SUM(l_extendedprice * l_extendedprice) yy, SUM(l_quantity * l_quantity) a2, SUM(l_quantity * l_extendedprice) a, SUM(l_discount * l_discount) b2, SUM(l_discount * l_extendedprice) b FROM lineitem), c AS (SELECT 0 AS feature, ABS(a) / SQRT(a2 * yy) AS cosine, a / a2 AS weight FROM s UNION ALL SELECT 1, ABS(b) / SQRT(b2 * yy), b / b2 FROM s) SELECT feature, ROUND(weight, 4) AS weight FROM c ORDER BY cosine DESC LIMIT 1""")
def least_angle_best(spark, d):
    """The single best feature and its weight."""
    from millrace.plans.linear import BestSingle

    rows = _items(spark, d).select(F.array("l_quantity", "l_discount").alias("features"), "l_extendedprice")
    m = BestSingle(2).fit(rows, F.col("l_extendedprice"))
    return spark.createDataFrame([(m.index, round(m.weight, 4))], "feature int, weight double")


@query("""WITH m AS (SELECT l_suppkey AS k, COUNT(*) n, AVG(l_discount) mean, VAR_POP(l_discount) / COUNT(*) e FROM lineitem GROUP BY 1), f AS (SELECT COUNT(*) t, SUM(e) se, MAX(e) me, SUM(mean * n) / SUM(n) c FROM m), p AS (SELECT SUM(CASE WHEN e > 0 THEN POWER(mean - c, 2) / e END) s FROM m, f) SELECT k AS l_suppkey, n, ROUND(c + CASE WHEN t < 4 OR s <= 0 OR s IS NULL THEN 1 ELSE GREATEST(1 - (se / me - 3) / s, 0) END * (mean - c), 8) AS shrunk FROM m, f, p""")
def stein_means(spark, d):
    """Supplier means drawn to the grand mean."""
    return A.stein_means(_items(spark, d), "l_suppkey", "l_discount").select("l_suppkey", "n", _r(F.col("shrunk"), 8).alias("shrunk"))


@query("""WITH x AS (SELECT l_returnflag i, l_linenumber j, SUM(l_extendedprice) / 1e6 x FROM lineitem GROUP BY ALL), v AS (SELECT DISTINCT j, 1.0 AS v FROM x), n AS (SELECT j, v / SQRT(SUM(v * v) OVER ()) AS v FROM v), u AS (SELECT i, SUM(x * v) AS u FROM x JOIN n USING (j) GROUP BY i), s AS (SELECT SUM(u * u) AS s FROM u) SELECT j, ROUND(SUM(x * u) / ANY_VALUE(s), 6) AS v FROM x JOIN u USING (i), s GROUP BY j""")
def als_rank1_iter(spark, d):
    """One alternating step of a rank-1 factorisation."""
    cells = _items(spark, d).groupBy(F.col("l_returnflag").alias("i"), F.col("l_linenumber").alias("j")).agg((F.sum("l_extendedprice") / 1e6).alias("x"))
    v = Z.normalised(cells.select("j").distinct().withColumn("v", F.lit(1.0)))
    return Z.als_step(cells, v)[1].select("j", _r(F.col("v")).alias("v"))


@query()
def boosting_prediction(spark, d):
    """Boosted oblivious trees on a fixed grid: error before and after, by iteration."""
    from millrace.plans.ensembles import Boosting
    from millrace.plans.trees import ObliviousTreeLearner

    rows = _binned(spark, d).withColumn("y", F.col("l_extendedprice") / 1000).cache()
    out: list = []

    def listen(i, model, now):
        out.append((i + 1, round(float(now.agg(L.rmse(F.col("_y"), F.col("_cursor"))).first()[0]), 4)))

    Boosting(ObliviousTreeLearner(GRID, depth=2, criterion="L2"), iterations=4, step=0.5, cut_every=2, listeners=(listen,)).fit(rows, F.col("y"))
    return spark.createDataFrame(out, "iteration int, rmse double")


def _tree_sql() -> str:
    """Both levels of the greedy tree: every condition's score, then every second condition's under the best first."""
    tests = [(f, b, f"{c} > {x}") for f, (c, row) in enumerate(zip(("l_quantity", "l_discount", "l_tax", "l_linenumber"), GRID.borders)) for b, x in enumerate(row)]
    borders = " UNION ALL ".join(f"SELECT {f} AS f, {b} AS b, {GRID.borders[f][b]}::DOUBLE AS x" for f, b, _ in tests)
    rows = "SELECT l_extendedprice AS y, " + ", ".join(f"({t})::INT AS t{f}_{b}" for f, b, t in tests) + " FROM lineitem"
    one = " UNION ALL ".join(f"SELECT {f} AS f, {b} AS b, -SUM(y * t{f}_{b}) * SUM(y * t{f}_{b}) / SUM(t{f}_{b}) - SUM(y * (1 - t{f}_{b})) * SUM(y * (1 - t{f}_{b})) / SUM(1 - t{f}_{b}) AS score FROM r" for f, b, _ in tests)
    pick = "CASE " + " ".join(f"WHEN p.f = {f} AND p.b = {b} THEN t{f}_{b}" for f, b, _ in tests) + " END"
    two = " UNION ALL ".join(
        f"SELECT {f} AS f, {b} AS b, SUM(CASE WHEN n > 0 THEN -s * s / n ELSE 0 END) AS score FROM (SELECT leaf, t{f}_{b}, COUNT(*) AS n, SUM(y) AS s FROM l GROUP BY ALL)"
        for f, b, _ in tests
    )
    return f"""WITH r AS ({rows}), x AS ({borders}), p AS (SELECT * FROM ({one}) ORDER BY score, f, b LIMIT 1), l AS (SELECT r.*, {pick} AS leaf FROM r, p),
    q AS (SELECT u.* FROM ({two}) u, p WHERE NOT (u.f = p.f AND u.b = p.b) ORDER BY u.score, u.f, u.b LIMIT 1)
    SELECT 0 AS level, p.f AS feature, x.x AS border FROM p JOIN x ON x.f = p.f AND x.b = p.b UNION ALL SELECT 1, q.f, x.x FROM q JOIN x ON x.f = q.f AND x.b = q.b"""


@query(_tree_sql())
def oblivious_tree_depth2(spark, d):
    """The conditions of a tree of depth two for the price."""
    from millrace.plans.trees import ObliviousTreeLearner

    rows = _binned(spark, d)
    tree = ObliviousTreeLearner(GRID, depth=2, criterion="L2").fit(rows, F.col("l_extendedprice"))
    return spark.createDataFrame([(i, f, b) for i, (f, b) in enumerate(tree.conditions)], "level int, feature int, border double")


# --- multilabel, hierarchy -------------------------------------------------


@query("SELECT quality, toxic, COUNT(*) AS n, MIN(doc_id) AS first_row FROM labels GROUP BY ALL HAVING COUNT(*) > 3")
def label_powerset(spark, d):
    """Distinct label vectors with more than three rows."""
    g = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_row"))
    return g.where("n > 3")


@query("SELECT doc_id, label FROM (SELECT doc_id, UNNEST(CASE WHEN quality = 0 AND toxic = 0 THEN [2] ELSE LIST_FILTER([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END], lambda x: x IS NOT NULL) END) AS label FROM labels)")
def conflict_explode(spark, d):
    """A row a positive label; a class of its own without any."""
    one = F.filter(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)), lambda v: v.isNotNull())
    return table(spark, d, "labels").select("doc_id", F.explode(F.when(F.size(one) == 0, F.array(F.lit(2))).otherwise(one)).alias("label"))


@query()
def hier_tree_counts(spark, d):
    """A balanced binary hierarchy over the classes of embeddings: (depth, first class, last class, rows)."""
    counts = [(r.label, r.n) for r in table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()]
    rows: list = []

    def walk(node: dict, depth: int) -> None:
        rows.append((depth, node["classes"][0], node["classes"][-1], node["n"]))
        for side in ("left", "right"):
            if side in node:
                walk(node[side], depth + 1)

    walk(A.class_hierarchy(counts), 0)
    return spark.createDataFrame(rows, "depth int, first_class int, last_class int, n long")


# --- text -----------------------------------------------------------------

_TOK = r"""SELECT conv_id * 1000 + turn AS key, l.i AS line, w FROM (SELECT conv_id, turn, UNNEST(LIST_ZIP(RANGE(LEN(STR_SPLIT(text, chr(10)))), STR_SPLIT(text, chr(10)))) AS lz FROM conversations) t, LATERAL (SELECT lz[1] AS i, lz[2] AS s) l, LATERAL (SELECT UNNEST(LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(l.s, ' +'), lambda x: REGEXP_MATCHES(x, '\p{L}'))) AS w) u"""
_NORM = r"LOWER(REGEXP_REPLACE(REGEXP_REPLACE(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', ''))"


def _talk(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")


@query(f"""SELECT word, n, ROW_NUMBER() OVER (ORDER BY n DESC, word) - 1 AS id FROM (SELECT {_NORM} AS word, COUNT(*) AS n FROM ({_TOK}) GROUP BY 1 HAVING COUNT(*) >= 5)""")
def dictionary(spark, d):
    """Words that occur five times or more."""
    words = X.dictionary(X.tokens(_talk(spark, d), "key", "text"), 5)
    return words.select("word", "n", F.col("id").cast("long"))


_LINES_SQL = r"""SELECT LIST_TRANSFORM(LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(s, ' +'), lambda x: REGEXP_MATCHES(x, '\p{L}')), lambda w: LOWER(REGEXP_REPLACE(REGEXP_REPLACE(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', ''))) AS w FROM (SELECT UNNEST(STR_SPLIT(text, chr(10))) AS s FROM conversations)"""
_PAIRS_SQL = f"""SELECT w[i] AS a, w[i + k] AS b, k FROM (SELECT w, UNNEST(RANGE(1, LEN(w) + 1)) AS i FROM ({_LINES_SQL})), (SELECT UNNEST([1, 2, 3]) AS k) WHERE i + k <= LEN(w)"""


def _cooc_sql(weight: str, left: int, right: int) -> str:
    return f"SELECT a, b, ROUND(SUM(x), 6) AS x FROM (SELECT a, b, {weight} AS x FROM ({_PAIRS_SQL}) WHERE k <= {right} UNION ALL SELECT b, a, {weight} FROM ({_PAIRS_SQL}) WHERE k <= {left}) GROUP BY ALL"


@query(_cooc_sql("1.0::DOUBLE", 2, 2))
def cooc_fixed(spark, d):
    """Words within two of each other."""
    return X.cooccurrence(_talk(spark, d), "key", "text", 2, 2).withColumn("x", _r(F.col("x")))


@query(_cooc_sql("1.0::DOUBLE / k", 1, 3))
def cooc_linear(spark, d):
    """Directed windows with weights 1 / distance."""
    return X.cooccurrence(_talk(spark, d), "key", "text", 1, 3, "LINEAR").withColumn("x", _r(F.col("x")))


@query(f"SELECT COALESCE(l.a, r.b) AS word, COALESCE(l.x, 0) AS as_left, COALESCE(r.x, 0) AS as_right FROM (SELECT a, ROUND(SUM(x), 4) x FROM ({_cooc_sql('1.0::DOUBLE', 0, 2)}) GROUP BY a) l FULL JOIN (SELECT b, ROUND(SUM(x), 4) x FROM ({_cooc_sql('1.0::DOUBLE', 0, 2)}) GROUP BY b) r ON l.a = r.b")
def cooc_marginals(spark, d):
    """Row and column sums of co-occurrence."""
    m = X.marginals(X.cooccurrence(_talk(spark, d), "key", "text", 0, 2))
    return m.select("word", _r(F.col("as_left"), 4).alias("as_left"), _r(F.col("as_right"), 4).alias("as_right"))


@query(f"""WITH c AS ({_cooc_sql('1.0::DOUBLE', 2, 2)}), l AS (SELECT a, SUM(x) l FROM c GROUP BY a), r AS (SELECT b, SUM(x) r FROM c GROUP BY b) SELECT a, b, ROUND(LN(x) - LN(l) - LN(r) + LN((SELECT SUM(x) FROM c)), 6) AS pmi FROM c JOIN l USING (a) JOIN r USING (b)""")
def pmi(spark, d):
    """Pointwise mutual information."""
    return X.pmi(X.cooccurrence(_talk(spark, d), "key", "text", 2, 2)).select("a", "b", _r(F.col("pmi")).alias("pmi"))


@query(f"""WITH t AS (SELECT key, {_NORM} AS word FROM ({_TOK})), f AS (SELECT key, word, COUNT(*) AS tf FROM t GROUP BY ALL), s AS (SELECT key, COUNT(*) AS size FROM t GROUP BY key), q AS (SELECT word, SUM(tf) AS fr FROM f GROUP BY word) SELECT key, word, tf, ROUND(tf / (tf + 2 + size / 300.0) / LN(fr + 2), 6) AS weight FROM f JOIN s USING (key) JOIN q USING (word)""")
def bm25(spark, d):
    """Weights of words in turns."""
    return X.bm25(_talk(spark, d), "key", "text").withColumn("weight", _r(F.col("weight")))


@query(f"SELECT DISTINCT w AS raw, {_NORM} AS word FROM ({_TOK})")
def word_norm(spark, d):
    """Words without marks at their ends."""
    lines = _talk(spark, d).select(F.explode(F.split("text", "\n")).alias("l"))
    words = lines.select(F.explode(F.filter(F.split("l", " +"), lambda w: w.rlike(r"\p{L}"))).alias("raw")).distinct()
    return words.select("raw", X.normalized(F.col("raw")).alias("word"))


@query(f"""WITH t AS (SELECT '#' || {_NORM} || '#' AS m FROM ({_TOK}) WHERE LENGTH({_NORM}) > 0) SELECT SUBSTRING(m, i, 3) AS gram, COUNT(*) AS n FROM (SELECT m, UNNEST(RANGE(1, LENGTH(m) - 1)) AS i FROM t) GROUP BY 1""")
def trigram_counts(spark, d):
    """Character trigrams of words."""
    return X.trigrams(X.tokens(_talk(spark, d), "key", "text"))


# --- vectors --------------------------------------------------------------

_COS = "LIST_DOT_PRODUCT({a}, {b}) / (SQRT(LIST_DOT_PRODUCT({a}, {a})) * SQRT(LIST_DOT_PRODUCT({b}, {b})))"
_EMB = "SELECT vec_id, label, LIST_TRANSFORM(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


@query(f"""WITH e AS ({_EMB}), p AS (SELECT q.vec_id AS query, e.vec_id AS id, {_COS.format(a='q.v', b='e.v')} AS s FROM e JOIN e q ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY s DESC, id)::INT AS rank FROM p) SELECT query, rank, id, ROUND(s, 6) AS similarity FROM r WHERE rank <= 5""")
def cosine_topk(spark, d):
    """The five vectors nearest to each whose id is divisible by 50, among all."""
    v = _vectors(spark, d)
    return X.nearest(v.where("id % 50 = 0"), v, 5).withColumn("similarity", _r(F.col("similarity")))


@query(f"""WITH e AS ({_EMB}), u AS (SELECT vec_id, label, LIST_TRANSFORM(v, lambda x: x / SQRT(LIST_DOT_PRODUCT(v, v))) AS v FROM e), l AS (SELECT label, UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS i FROM u), m AS (SELECT label, i, AVG(x) AS m FROM l GROUP BY ALL) SELECT a.label AS one, b.label AS other, ROUND(SUM(a.m * b.m), 6) AS similarity FROM m a JOIN m b ON a.i = b.i GROUP BY ALL""")
def class_similarity(spark, d):
    """Mean cosine between classes."""
    return C.class_similarity(_vectors(spark, d), "label", "vector").withColumn("similarity", _r(F.col("similarity")))


@query(f"""WITH e AS ({_EMB}), q AS (SELECT k AS question, a.vec_id AS i1, b.vec_id AS i2, c.vec_id AS i3, LIST_TRANSFORM(LIST_ZIP(a.v, b.v, c.v), lambda x: x[2] - x[1] + x[3]) AS q FROM (SELECT vec_id AS k FROM e WHERE vec_id % 50 = 0) JOIN e a ON a.vec_id = k JOIN e b ON b.vec_id = k + 10 JOIN e c ON c.vec_id = k + 20), p AS (SELECT question, vec_id AS word, {_COS.format(a='q', b='v')} AS s FROM e JOIN q ON vec_id NOT IN (i1, i2, i3)), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY question ORDER BY s DESC, word)::INT AS rank FROM p) SELECT question, rank, word, ROUND(s, 6) AS similarity FROM r WHERE rank <= 5""")
def word_analogy(spark, d):
    """Nearest to v2 - v1 + v3, a question for each id divisible by 50."""
    words = _vectors(spark, d).select(F.col("id").alias("word"), "vector")
    w = F.col("word")
    q = words.where("word % 50 = 0").select(w.alias("question"), w.alias("w1"), (w + 10).alias("w2"), (w + 20).alias("w3"))
    return X.analogies(q, words).withColumn("similarity", _r(F.col("similarity")))


@query(f"""WITH e AS ({_EMB}) SELECT a.vec_id AS id, {_COS.format(a='a.v', b='b.v')} > {_COS.format(a='a.v', b='c.v')} AS closer FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2""")
def closer_further(spark, d):
    """Is the next vector nearer than the one after?"""
    v = _vectors(spark, d).select("id", "vector")
    b, c = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("b")), v.select((F.col("id") - 2).alias("id"), F.col("vector").alias("c"))
    return v.join(b, "id").join(c, "id").select("id", (V.cosine(F.col("vector"), F.col("b")) > V.cosine(F.col("vector"), F.col("c"))).alias("closer"))


@query(f"""WITH e AS ({_EMB}), p AS (SELECT e.vec_id, c.vec_id AS k, LIST_DISTANCE(e.v, c.v) AS s FROM e JOIN e c ON c.vec_id < 4), r AS (SELECT vec_id, k, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY s, k) AS n FROM p), l AS (SELECT k AS cluster, UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS i FROM r JOIN e USING (vec_id) WHERE n = 1) SELECT cluster::INT AS cluster, COUNT(*) FILTER (i = 0) AS n, ROUND(AVG(x) FILTER (i = 0), 6) AS c0, ROUND(AVG(x) FILTER (i = 1), 6) AS c1 FROM l GROUP BY 1""")
def kmeans_step(spark, d):
    """One step of k-means from the first four vectors."""
    v = _vectors(spark, d)
    centres = [list(r.vector) for r in v.where("id < 4").orderBy("id").collect()]
    s = C.k_means_step(v, "vector", centres)
    return s.select("cluster", "n", _r(F.col("centre")[0]).alias("c0"), _r(F.col("centre")[1]).alias("c1"))


@query(f"""WITH RECURSIVE e AS ({_EMB}), l AS (SELECT vec_id, UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS i FROM e), t AS (SELECT vec_id, i FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY ABS(x) DESC, i) AS n FROM l) WHERE n <= 2),
k AS (SELECT vec_id, i FROM t WHERE i IN (SELECT i FROM t GROUP BY i HAVING COUNT(*) < 0.05 * (SELECT COUNT(*) FROM e))), m AS (SELECT vec_id, MIN(vec_id) OVER (PARTITION BY i) AS b FROM k), g AS (SELECT vec_id AS a, b FROM m UNION SELECT b, vec_id FROM m),
r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b) SELECT a AS id, MIN(b) AS component FROM r GROUP BY a""")
def connected_components_k(spark, d):
    """Components of vectors over shared strong dimensions."""
    return C.shared_components(C.strong_dimensions(_vectors(spark, d), "id", "vector", 2, 0.05), "id", "dim")


@query()
def leader_cluster(spark, d):
    """Leader clustering in each class, in order of the key."""
    return C.leader(_vectors(spark, d), "label", "id", "vector", eps=1.0, ratio=0.9)


# --- sequences, clicks ------------------------------------------------------


@query(f"""WITH s AS (SELECT user_id, LIST(CASE WHEN value > 50 THEN 1 ELSE 0 END ORDER BY h, event_id) AS s FROM ({_EV}) GROUP BY user_id) SELECT user_id, LIST_REDUCE(LIST_PREPEND(0, s), lambda a, c: CASE WHEN c = 1 THEN (a + 1) % 3 ELSE a END)::INT AS state FROM s""")
def dfa_run(spark, d):
    """An automaton that counts large values modulo three."""
    e = _events(spark, d).select("user_id", F.struct("h", "event_id", F.when(F.col("value") > 50, 1).otherwise(0).alias("c")).alias("x"))
    seqs = e.groupBy("user_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("user_id", F.transform("x", lambda v: v["c"]).alias("s"))
    return seqs.select("user_id", Q.run_dfa(F.col("s"), [[0, 1], [1, 2], [2, 0]]).cast("int").alias("state"))


@query(f"""WITH x AS (SELECT LAG(event_type) OVER (PARTITION BY user_id ORDER BY h, event_id) AS a, event_type AS b FROM ({_EV})) SELECT a, b, COUNT(*) AS n FROM x WHERE a IS NOT NULL GROUP BY ALL""")
def ngram_transitions(spark, d):
    """Neighbours in users' sequences of types."""
    e = _events(spark, d).select("user_id", F.struct("h", "event_id", "event_type").alias("x"))
    seqs = e.groupBy("user_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return Q.ngram_transitions(seqs.select(F.transform("x", lambda v: v["event_type"]).alias("s")), "s")


# --- functions of numbers and vectors ----------------------------------------


@query("""SELECT l_orderkey, l_linenumber, ROUND(LN(2 * l_quantity + 1), 6) AS log_linear, ROUND(3 * SQRT(l_quantity), 6) AS power, GREATEST(x, 0) AS relu, ROUND(1 / (1 + EXP(-x)), 6) AS sigmoid, ROUND(-LN(1 + EXP(-x)), 6) AS log_sigmoid, ROUND(-LN(1 + EXP(2 * x + 1)), 6) AS logit, ROUND((EXP(x) - EXP(-x)) / (EXP(x) + EXP(-x)), 6) AS tanh FROM (SELECT *, (l_quantity - 25) / 10 AS x FROM lineitem)""")
def scalar_functions(spark, d):
    """Elementary functions of a number."""
    x, q = (F.col("l_quantity") - 25) / 10, F.col("l_quantity")
    found = {"log_linear": V.log_linear(q, 2, 1), "power": V.power(q, 3, 0.5), "sigmoid": V.sigmoid(x), "log_sigmoid": V.log_sigmoid(x), "logit": V.logit(x, 2, 1), "tanh": 2 * V.sigmoid(2 * x) - 1}
    return _items(spark, d).select("l_orderkey", "l_linenumber", V.relu(x).alias("relu"), *[_r(c).alias(n) for n, c in found.items()])


@query("""SELECT l_orderkey, l_linenumber, ROUND(a + b + c + e, 6) AS total, ROUND(1 / (1 + EXP(-(a / 50 + b + c + e / 7))), 6) AS sum_sigmoid, ROUND(SQRT(a * a + b * b + c * c + e * e), 6) AS norm, ROUND(1 * (0.5 * a + 1) + 2 * (2 * b - 1) + 3 * (c + 0.25) + 4 * (0.1 * e) + 7, 6) AS normalized_linear, ROUND(b + c, 6) AS part, ROUND(3 * (a * 2 - b), 6) AS scaled, ROUND(2 * a - 0.5 * b, 6) AS ensemble, CASE WHEN a >= GREATEST(b, c, e) THEN 0 WHEN b >= GREATEST(c, e) THEN 1 WHEN c >= e THEN 2 ELSE 3 END AS argmax, ROUND(SQRT(POWER(a - 10, 2) + POWER(b - 0.05, 2) + POWER(c, 2) + POWER(e - 3, 2)), 6) AS distance, ROUND(a * a + b * b + c * c + e * e, 6) AS squares FROM (SELECT *, l_quantity AS a, l_discount AS b, l_tax AS c, l_linenumber::DOUBLE AS e FROM lineitem)""")
def vector_functions(spark, d):
    """Functions of a vector of four features."""
    v = F.array(*_line_features())
    a, b = F.element_at(v, 1), F.element_at(v, 2)
    scaled = F.zip_with(v, V.weights([1 / 50, 1, 1, 1 / 7]), lambda x, w: x * w)
    found = {
        "total": V.total(v), "sum_sigmoid": V.sum_sigmoid(scaled), "norm": V.norm(v),
        "normalized_linear": V.normalized_linear(v, [1, 2, 3, 4], [0.5, 2, 1, 0.1], [1, -1, 0.25, 0], 7), "part": V.total(V.part(v, 1, 2)),
        "scaled": V.total(V.join_vectors(V.scaled(a, [2.0, 4.0]), V.scaled(b, [-1.0, -2.0]))), "ensemble": V.ensemble([(2.0, a), (-0.5, b)]),
        "distance": V.distance(v, V.weights([10, 0.05, 0, 3])), "squares": V.total(V.parallel(V.join_scalars(*_line_features()), lambda x: x * x)),
    }
    return _items(spark, d).select("l_orderkey", "l_linenumber", V.argmax(v).alias("argmax"), *[_r(c).alias(n) for n, c in found.items()])


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, EXP(2 * l_discount * 10) AS p, EXP(-1 * l_tax * 10) AS q, EXP(0.5 * l_linenumber) AS r, EXP(l_discount * 10) AS a, EXP(l_tax * 10) AS b, EXP(l_linenumber) AS c, l_linenumber % 3 AS y FROM lineitem) SELECT l_orderkey, l_linenumber, ROUND(p / (1 + p + q + r), 6) AS p0, ROUND(q / (1 + p + q + r), 6) AS p1, ROUND(r / (1 + p + q + r), 6) AS p2, ROUND(LN((CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END) / (a + b + c)), 6) AS log_softmax FROM x""")
def softmax_functions(spark, d):
    """Softmax of weighted logits with a reference class, and the log-probability of a class."""
    v = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_linenumber").cast("double"))
    p = V.weighted_multi_logit(v, [2.0, -1.0, 0.5])
    parts = [_r(F.element_at(p, i + 1)).alias(f"p{i}") for i in range(3)]
    return _items(spark, d).select("l_orderkey", "l_linenumber", *parts, _r(V.log_softmax(v, F.col("l_linenumber") % 3)).alias("log_softmax"))


@query("""WITH h AS (SELECT p_partkey, LIST_REDUCE(LIST_PREPEND(0::HUGEINT, LIST_TRANSFORM(RANGE(1, LEN(p_name) + 1), lambda i: ASCII(p_name[i])::HUGEINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM part) SELECT p_partkey, ROUND((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::DOUBLE / 4294967296, 9) AS category FROM h""")
def categorical_hash(spark, d):
    """A text feature as a number."""
    return table(spark, d, "part").select("p_partkey", _r(V.categorical(F.col("p_name")), 9).alias("category"))


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, {_Y} AS y, {_SCORE} AS x, l_discount + 0.1 AS p FROM lineitem) SELECT l_orderkey, l_linenumber, ROUND(y - x, 6) AS l2, ROUND(y - 1 / (1 + EXP(-x)), 6) AS llogit, ROUND((2 * y - 1) / (1 + EXP(-x)) * (1 - 1 / (1 + EXP(-x))), 6) AS celogit, ROUND(CASE WHEN y = 1 THEN 1 / p ELSE -1 / (1 - p) END, 6) AS ll FROM r""")
def loss_gradients(spark, d):
    """Antigradients of the losses that boosting follows, by row."""
    y, x = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0), (F.col("l_quantity") - 25) / 10
    rows = _items(spark, d).select("l_orderkey", "l_linenumber", y.alias("y"), x.alias("x"), (F.col("l_discount") + 0.1).alias("p"))
    y, x = F.col("y"), F.col("x")
    steps = {"l2": L.TARGETS["L2"].step(y, x), "llogit": L.TARGETS["LLLogit"].step(y, x), "celogit": L.TARGETS["CELogit"].step(y, x), "ll": L.TARGETS["LL"].step(y, F.col("p"))}
    return rows.select("l_orderkey", "l_linenumber", *[_r(c).alias(n) for n, c in steps.items()])


@query("""SELECT l_returnflag, ROUND(SQRT(SUM(l_tax * POWER(l_discount - 0.04, 2)) / SUM(l_tax)), 8) AS weighted FROM lineitem GROUP BY 1""")
def weighted_loss(spark, d):
    """A loss with row weights, in groups."""
    loss = L.weighted(L.weighted_rmse, F.col("l_tax"))
    return _items(spark, d).groupBy("l_returnflag").agg(_r(loss(F.col("l_discount"), F.lit(0.04)), 8).alias("weighted"))


# --- pools on disk ------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    from uuid import uuid4

    from millrace.lineage import folder

    return f"{folder(spark).rstrip('/')}/millrace-{name}-{uuid4().hex}"


_POOL_SQL = "SELECT l_orderkey, l_extendedprice AS target, l_quantity AS f0, l_discount AS f1, l_tax AS f2, l_linenumber::DOUBLE AS f3 FROM lineitem"


def _pool(spark, d):
    return _items(spark, d).select(
        F.col("l_orderkey").alias("row_id"), F.col("l_extendedprice").alias("target"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("url"),
        F.col("l_suppkey").alias("group_id"), F.array(*_line_features()).alias("features"),
    )


@query("""SELECT l_orderkey::VARCHAR AS query_id, l_extendedprice AS target, l_orderkey || '-' || l_linenumber AS url, l_suppkey::VARCHAR AS group_id, l_orderkey || '-' || l_linenumber || '@' || l_orderkey AS item_id, l_quantity AS f0, l_discount AS f1, l_tax AS f2, l_linenumber::DOUBLE AS f3 FROM lineitem""")
def features_txt_round_trip(spark, d):
    """A pool written as features.txt and read again."""
    from millrace.sources import readers, writers

    path = _place(spark, "features")
    writers.features_txt(_pool(spark, d), path, url="url", group="group_id")
    back = readers.features_txt(spark, path)
    return back.select("query_id", "target", "url", "group_id", "item_id", *[F.element_at("features", i + 1).alias(f"f{i}") for i in range(4)])


@query("""SELECT l_extendedprice AS target, l_quantity AS f0, l_discount AS f1, l_tax AS f2, l_linenumber::DOUBLE AS f3 FROM lineitem""")
def libsvm_round_trip(spark, d):
    """A pool written as libsvm, zeros left out, and read again."""
    from millrace.sources import readers, writers

    path = _place(spark, "libsvm")
    writers.libsvm(_pool(spark, d), path)
    v = readers.dense(F.col("features"), 4)
    return readers.libsvm(spark, path).select("target", *[F.element_at(v, i + 1).alias(f"f{i}") for i in range(4)])


@query("""SELECT l_linenumber::DOUBLE AS target, l_orderkey::VARCHAR AS group_id, 'D' || l_partkey AS item_id, l_quantity AS f0, l_discount AS f1 FROM lineitem""")
def letor_lines(spark, d):
    """LETOR lines, read."""
    from millrace.sources import readers

    path, c = _place(spark, "letor"), lambda n: F.col(n).cast("string")
    line = F.concat(c("l_linenumber"), F.lit(" qid:"), c("l_orderkey"), F.lit(" 1:"), c("l_quantity"), F.lit(" 2:"), c("l_discount"), F.lit(" #docid = D"), c("l_partkey"))
    _items(spark, d).select(line.alias("value")).write.text(path)
    return readers.letor(spark, path).select("target", "group_id", "item_id", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("""SELECT p_retailprice AS target, p_partkey::VARCHAR AS item_id, p_size::DOUBLE AS f0 FROM part""")
def catboost_pool(spark, d):
    """Delimited columns by a column description, read."""
    from millrace.sources import readers

    path, columns = _place(spark, "catboost"), _place(spark, "columns")
    table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size", "p_brand").write.csv(path, sep="\t")
    spark.createDataFrame([("0\tDocId",), ("1\tTarget",), ("2\tNum",), ("3\tAuxiliary",)], "value string").coalesce(1).write.text(columns)
    return readers.catboost(spark, path, columns).select("target", "item_id", F.col("features")[0].alias("f0"))


@query("""SELECT l_shipmode AS v, n FROM (SELECT l_returnflag AS l_shipmode, COUNT(*) AS n FROM lineitem GROUP BY 1)""")
def value_frequencies(spark, d):
    """Values and their counts, written as a table with a header and read again."""
    from millrace.sources import writers

    path = _place(spark, "frequencies")
    writers.frequencies(_items(spark, d), path, "l_returnflag")
    return spark.read.csv(path, header=True, schema="v string, n long")


@query("""SELECT l_orderkey || '-' || l_linenumber AS item, ROUND(2 * l_quantity + 100 * l_discount, 4) AS value FROM lineitem""")
def applied_predictions(spark, d):
    """A model's values for every item, written as lines and read again."""
    from millrace.sources import writers

    path = _place(spark, "predictions")
    writers.predictions(_pool(spark, d), path, "url", V.linear(F.col("features"), [2.0, 100.0, 0.0, 0.0]))
    return spark.read.csv(path, sep="\t", schema="item string, value double").withColumn("value", _r(F.col("value"), 4))


@query(f"""SELECT l_orderkey, target, f0, f1, f2, f3, f0 * f1 AS f4 FROM ({_POOL_SQL})""")
def extended_pool(spark, d):
    """A pool with one more feature, its columns taken apart again."""
    pool = P.extend(_pool(spark, d), "features", F.element_at("features", 1) * F.element_at("features", 2))
    return pool.select(F.col("row_id").alias("l_orderkey"), "target", *[F.element_at("features", i + 1).alias(f"f{i}") for i in range(5)])


# --- grids and statistics -------------------------------------------------------

_BORDER_SQL = """SELECT {k} AS feature, CASE WHEN r1 > 0 AND (LN(n - r1) + LN(r1) >= CASE WHEN r2 > 0 AND r2 < n - 1 THEN LN(n - r2) + LN(r2) ELSE 0 END) AND LN(n - r1) + LN(r1) > 0 THEN below WHEN r2 > 0 AND r2 < n - 1 AND LN(n - r2) + LN(r2) > 0 THEN m END AS border FROM (SELECT COUNT(*) AS n, ANY_VALUE(m) AS m, COUNT(*) FILTER (x < m) - 1 AS r1, COUNT(*) FILTER (x <= m) - 1 AS r2, MAX(x) FILTER (x < m) AS below FROM (SELECT {c}::DOUBLE AS x FROM lineitem), (SELECT x AS m FROM (SELECT {c}::DOUBLE AS x, ROW_NUMBER() OVER (ORDER BY {c}) - 1 AS i, COUNT(*) OVER () AS n FROM lineitem) WHERE i = n // 2))"""


@query("SELECT * FROM (" + " UNION ALL ".join(_BORDER_SQL.format(k=k, c=c) for k, c in enumerate(("l_quantity", "l_discount", "l_tax", "l_extendedprice"))) + ") WHERE border IS NOT NULL")
def greedy_border(spark, d):
    """The first border of each feature that the greedy search finds."""
    from millrace.operators import grid

    rows = _items(spark, d).select(F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")]).alias("features"))
    found = grid.fit(rows, "features", bins=2)
    return spark.createDataFrame([(f, b) for f, _, b in found.conditions()], "feature int, border double")


@query("""SELECT hits, trials, COUNT(*) AS n FROM (SELECT user_id, SUM((event_type = (SELECT MIN(event_type) FROM events))::INT)::BIGINT AS hits, COUNT(*) AS trials FROM events GROUP BY 1) GROUP BY ALL""")
def hit_counts(spark, d):
    """How many users have each number of hits and trials: what mixtures are fitted to."""
    e = table(spark, d, "events")
    return A.hit_counts(e, "user_id", F.col("event_type") == e.agg(F.min("event_type")).first()[0])


@query("""SELECT a AS alpha, b AS bins, c AS loss FROM (VALUES (0.1), (0.5), (1.0)) x(a), (VALUES (16), (32)) y(b), (VALUES ('L2'), ('SatL2')) z(c)""")
def parameter_grid(spark, d):
    """Every choice of a grid of parameters."""
    rows = S.grid({"alpha": [0.1, 0.5, 1.0], "bins": [16, 32], "loss": ["L2", "SatL2"]})
    return spark.createDataFrame([(r["alpha"], r["bins"], r["loss"]) for r in rows], "alpha double, bins int, loss string")


@query("""WITH s AS (SELECT l_returnflag AS task, SUM(l_quantity * l_quantity) + 10 AS a, SUM(l_quantity * l_linenumber) AS b, SUM(l_linenumber * l_linenumber) + 10 AS c, SUM(l_quantity * l_extendedprice) AS u, SUM(l_linenumber * l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT task, ROUND((c * u - b * v) / (a * c - b * b), 4) AS w0, ROUND((a * v - b * u) / (a * c - b * b), 4) AS w1 FROM s""")
def ridge_by_task(spark, d):
    """A ridge regression of the price for each return flag, from one aggregation."""
    import numpy as np

    from millrace.plans import linear

    rows = _items(spark, d).select("l_returnflag", "l_extendedprice", F.array("l_quantity", F.col("l_linenumber").cast("double")).alias("features"))
    sums = linear.gram(rows, "features", F.col("l_extendedprice"), 2, by="l_returnflag")
    found = [(task, *np.linalg.solve(g.xx + 10 * np.eye(2), g.xy).tolist()) for task, g in sums.items()]
    return spark.createDataFrame([(t, round(a, 4), round(b, 4)) for t, a, b in found], "task string, w0 double, w1 double")


@query("""WITH n AS (SELECT *, UPPER(p_name) AS up, REPLACE(p_name, ' ', '') AS tight, '7' || p_name AS more FROM part) SELECT p_partkey, 0.0::DOUBLE AS of_case, ROUND(0.2 * (LEN(p_name) - LEN(tight)), 6) AS of_spaces, 0.9::DOUBLE AS of_insert, 10.0::DOUBLE AS of_delete FROM n""")
def name_edit_costs(spark, d):
    """What it costs to turn a part's name into upper case, to leave out its spaces, to add and to remove a digit."""
    from millrace.operators.similarity import with_edit_cost

    name = F.col("p_name")
    out = table(spark, d, "part").select("p_partkey", "p_name", F.upper(name).alias("up"), F.replace(name, F.lit(" "), F.lit("")).alias("tight"), F.concat(F.lit("7"), name).alias("more"))
    for source, target, cost in (("p_name", "up", "of_case"), ("p_name", "tight", "of_spaces"), ("p_name", "more", "of_insert"), ("more", "p_name", "of_delete")):
        out = with_edit_cost(out, source, target, cost)
    return out.select("p_partkey", *[_r(F.col(c)).alias(c) for c in ("of_case", "of_spaces", "of_insert", "of_delete")])


# --- losses of blocks of outputs -----------------------------------------------

_BLOCK = "SELECT *, l_discount * 10 AS a, l_tax * 20 - 1 AS b, l_linenumber % 3 AS y FROM lineitem"
_BLOCK_Z = f"SELECT *, 1 + EXP(a) + EXP(b) AS z FROM ({_BLOCK})"


def _blocks(spark, d):
    x = F.array(F.col("l_discount") * 10, F.col("l_tax") * 20 - 1)
    return _items(spark, d).withColumns({"x": x, "y": F.col("l_linenumber") % 3, "labels": F.array((F.col("l_returnflag") == "R").cast("double"), (F.col("l_linestatus") == "O").cast("double"))})


@query(f"""SELECT l_returnflag, ROUND(EXP(AVG(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE 0 END - LN(z))), 6) AS value, ROUND(AVG((y = CASE WHEN a > 0 AND a >= b THEN 0 WHEN b > 0 THEN 1 ELSE 2 END)::INT), 6) AS accuracy FROM ({_BLOCK_Z}) GROUP BY 1""")
def class_logit(spark, d):
    """Likelihood and accuracy of logits of all classes but the reference, in groups."""
    y, x = F.col("y"), F.col("x")
    return _blocks(spark, d).groupBy("l_returnflag").agg(_r(B.class_value(y, x)).alias("value"), _r(B.class_accuracy(y, x)).alias("accuracy"))


@query(f"""SELECT l_orderkey, l_linenumber, ROUND(EXP(a) / z - (y = 0)::INT, 6) AS g0, ROUND(EXP(b) / z - (y = 1)::INT, 6) AS g1 FROM ({_BLOCK_Z})""")
def class_logit_steps(spark, d):
    """Gradient by each logit of several classes, by row."""
    g = B.class_step(F.col("y"), F.col("x"))
    return _blocks(spark, d).select("l_orderkey", "l_linenumber", *[_r(g[i]).alias(f"g{i}") for i in range(2)])


@query(f"""SELECT l_orderkey, l_linenumber, ROUND((l_returnflag = 'R')::INT * a + (l_linestatus = 'O')::INT * b - LN(1 + (1 + EXP(a)) * (1 + EXP(b))), 6) AS value, ROUND((EXP(a) + EXP(a + b)) / (1 + EXP(a) + EXP(b) + EXP(a + b)) - (l_returnflag = 'R')::INT, 6) AS g0, ROUND((EXP(b) + EXP(a + b)) / (1 + EXP(a) + EXP(b) + EXP(a + b)) - (l_linestatus = 'O')::INT, 6) AS g1 FROM ({_BLOCK})""")
def label_set_logit(spark, d):
    """Log-likelihood of a row's set of labels among all sets, and its gradient."""
    y, x = F.col("labels"), F.col("x")
    g = B.label_set_step(y, x)
    return _blocks(spark, d).select("l_orderkey", "l_linenumber", _r(B.label_set_likelihood(y, x)).alias("value"), *[_r(g[i]).alias(f"g{i}") for i in range(2)])


@query(f"""SELECT ROUND((EXP(AVG(-LN(1 + EXP(CASE WHEN l_returnflag = 'R' THEN -a ELSE a END)))) + EXP(AVG(-LN(1 + EXP(CASE WHEN l_linestatus = 'O' THEN -b ELSE b END))))) / 2, 6) AS value FROM ({_BLOCK})""")
def one_vs_rest_logit(spark, d):
    """Mean likelihood of two labels, each by its own logit."""
    return _blocks(spark, d).agg(_r(B.one_vs_rest_value(F.col("labels"), F.col("x"), 2)).alias("value"))


@query(f"""SELECT l_returnflag, ROUND(SQRT(SUM(POWER(a - r, 2) + POWER(b - o, 2)) / (2 * COUNT(*))), 6) AS value, ROUND(SUM(y * (POWER(a - r, 2) + POWER(b - o, 2))), 3) AS weighted, ROUND(SUM(y * 2 * (a - r)), 3) AS g0, ROUND(SUM(y * 2 * (b - o)), 3) AS g1 FROM (SELECT *, (l_returnflag = 'R')::INT AS r, (l_linestatus = 'O')::INT AS o FROM ({_BLOCK})) GROUP BY 1""")
def block_squares(spark, d):
    """Root mean square of blocks, and squares and steps under whole-number weights."""
    y, x, w = F.col("labels"), F.col("x"), F.col("y")
    g = B.weighted_step(B.square_step, w)(y, x)
    return _blocks(spark, d).groupBy("l_returnflag").agg(
        _r(B.square_value(y, x)).alias("value"), _r(F.sum(B.weighted_row(B.squares, w)(y, x)), 3).alias("weighted"), *[_r(F.sum(g[i]), 3).alias(f"g{i}") for i in range(2)]
    )


@query("""SELECT l_linestatus, ROUND(-SUM(CASE WHEN l_returnflag = 'R' THEN -POWER(l_tax + 1, 2) ELSE LN(1 - EXP(-POWER(l_tax + 1, 2))) END), 4) AS value FROM lineitem GROUP BY 1""")
def bell_likelihood(spark, d):
    """Negative log-likelihood with probabilities e^-(x + 1)^2, in groups."""
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return _items(spark, d).groupBy("l_linestatus").agg(_r(L.likelihood_x2(y, F.col("l_tax")), 4).alias("value"))
