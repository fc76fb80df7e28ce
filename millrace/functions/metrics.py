"""Metrics of whole tables: ranking, binary, multiclass, multilabel.

Each takes a DataFrame and column names and gives a DataFrame (one row, unless
said otherwise); sequences inside a group are ordered with explicit ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for b = 0."""
    return F.when(b != 0, a / b)


def ndcg(df: DataFrame, group: str, score: str, label: str, tie: str) -> DataFrame:
    """Mean NDCG (gain 2^label - 1, discount ln(place + 2)) of groups with two labels or more.

    A group without any gain scores 0.
    """
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    by_score = Window.partitionBy(group).orderBy(F.desc(score), tie)
    by_label = Window.partitionBy(group).orderBy(F.desc(label), tie)
    ranked = df.select(
        group, label, gain.alias("gain"), F.row_number().over(by_score).alias("at"), F.row_number().over(by_label).alias("best")
    )
    sums = ranked.groupBy(group).agg(
        F.sum(F.col("gain") / F.log(F.col("at") + 1.0)).alias("dcg"), F.sum(F.col("gain") / F.log(F.col("best") + 1.0)).alias("ideal"),
        F.min(label).alias("lo"), F.max(label).alias("hi"),
    ).where("lo <> hi")
    each = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)
    return sums.agg(F.avg(each).alias("ndcg"), F.count("*").alias("n_groups"))


def _cascade(ordered: Column, leave: float) -> Column:
    zero = F.struct(F.lit(0.0).alias("found"), F.lit(1.0).alias("look"))
    return F.aggregate(
        ordered, zero,
        lambda a, r: F.struct((a["found"] + a["look"] * r).alias("found"), (a["look"] * (1 - leave) * (1 - r)).alias("look")),
        lambda a: a["found"],
    )


def pfound(df: DataFrame, group: str, score: str, relevance: str, tie: str, leave: float = 0.15) -> DataFrame:
    """Mean probability that a user who walks down each group's ranking finds what is relevant."""
    rows = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"), F.col(relevance).cast("double").alias("r"))
    lists = df.groupBy(group).agg(F.sort_array(F.collect_list(rows)).alias("rows"))
    found = _cascade(F.transform("rows", lambda x: x["r"]), leave)
    return lists.agg(F.avg(found).alias("pfound"), F.count("*").alias("n_groups"))


def pfound_subgroups(df: DataFrame, group: str, subgroup: str, score: str, relevance: str, tie: str) -> DataFrame:
    """`pfound` over the best-scored row of each subgroup."""
    best = Window.partitionBy(group, subgroup).orderBy(F.desc(score), tie)
    first = df.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return pfound(first, group, score, relevance, tie)


def pairwise_likelihood(df: DataFrame, group: str, score: str, label: str, place: str) -> DataFrame:
    """exp of the mean of -|dy| ln(1 + e^(-sign(dy) dx)) over pairs of a group with different labels.

    Pairs grow with the square of a group; groups here are queries, which are small.
    """
    a, b = df.select(group, place, score, label).alias("a"), df.select(group, place, score, label).alias("b")
    on = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{place}") < F.col(f"b.{place}")) & (F.col(f"a.{label}") != F.col(f"b.{label}"))
    dy, dx = F.col(f"a.{label}") - F.col(f"b.{label}"), F.col(f"a.{score}") - F.col(f"b.{score}")
    margin = F.when(dy > 0, dx).otherwise(-dx)
    loss = -F.abs(dy) * (F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))))
    return a.join(b, on).agg(F.exp(F.sum(loss) / F.count("*")).alias("pairwise_ll"), F.count("*").alias("n_pairs"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve with ties shared, from counts of each distinct score.

    Counts go through one aggregation, so the ordered window sees distinct
    scores and not rows.
    """
    counts = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("pos"), F.sum(F.when(positive, 0).otherwise(1)).alias("neg")
    )
    below = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    area = F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2.0))
    return steps.agg(ratio(area, F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def binary(df: DataFrame, score: Column, positive: Column, beta: float = 1.0) -> DataFrame:
    """Accuracy, precision, recall and F at a score of 0; a score of exactly 0 is right for neither class."""
    hit = (score > 0) & positive
    f = F.sum(F.when(hit, 1).otherwise(0)), F.sum(F.when((score > 0) & ~positive, 1).otherwise(0)), F.sum(F.when((score <= 0) & positive, 1).otherwise(0))
    sums = df.agg(
        f[0].alias("tp"), f[1].alias("fp"), f[2].alias("fn"),
        F.avg(F.when(hit | ((score < 0) & ~positive), 1.0).otherwise(0.0)).alias("accuracy"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    b = beta * beta
    return sums.select("tp", "fp", "fn", "accuracy", p.alias("precision"), r.alias("recall"), ratio((1 + b) * p * r, b * p + r).alias("f_score"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Count of each (label, prediction)."""
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def _by_class(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """tp, fp, fn of each class; a prediction of -1 abstains."""
    both = confusion(df, label, predicted)
    pairs = both.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("c"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"),
                     F.lit(0).cast("long").alias("fp"), F.when(F.col("label") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn")),
            F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("tp"),
                     F.when((F.col("label") != F.col("predicted")) & (F.col("predicted") != -1), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
        )).alias("x")
    ).select("x.*").where("c <> -1")
    return pairs.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def micro(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Micro precision, recall and F1."""
    s = _by_class(df, label, predicted).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def macro(df: DataFrame, label: str, predicted: str, all_classes: bool = False) -> DataFrame:
    """Macro precision, recall, and the harmonic mean of the two (0 if both are 0).

    Classes that are never predicted (never occur) leave the mean of precision
    (recall), unless `all_classes`: then they count as 0.
    """
    c = _by_class(df, label, predicted)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    if all_classes:
        p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    s = c.agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return s.select("precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"))


def kappa(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Cohen's kappa."""
    both = confusion(df, label, predicted)
    rows = both.groupBy("label").agg(F.sum("n").alias("a"))
    columns = both.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("b"))
    chance = rows.join(columns, "label").agg(F.sum(F.col("a") * F.col("b")).alias("chance"))
    s = both.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    po, pe = F.col("hit") / F.col("n"), F.coalesce(F.col("chance"), F.lit(0)) / (F.col("n") * F.col("n"))
    return s.crossJoin(chance).select(ratio(po - pe, 1 - pe).alias("kappa"), po.alias("accuracy"))  # one row by one row


def multilabel(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Exact match, Hamming loss, micro and macro F of arrays of 0 and 1 of equal length."""
    cells = F.zip_with(truth, predicted, lambda a, b: F.when(a != b, 1).otherwise(0))
    rows = df.select(
        F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0).alias("exact"),
        (F.aggregate(cells, F.lit(0), lambda a, v: a + v) / F.size(truth)).alias("hamming"),
    ).agg(F.avg("exact").alias("exact_match"), F.avg("hamming").alias("hamming_loss"))
    at = df.select(F.posexplode(F.arrays_zip(F.col(truth).alias("y"), F.col(predicted).alias("p"))).alias("j", "x")).select("j", "x.y", "x.p")
    by = at.groupBy("j").agg(F.sum(F.col("y") * F.col("p")).alias("tp"), F.sum("p").alias("p"), F.sum("y").alias("y"))
    f = F.coalesce(ratio(F.col("tp"), F.col("p") + F.col("y")), F.lit(0.0))
    labels = by.agg(
        (2 * F.avg(f)).alias("macro_f"), F.coalesce(ratio(2 * F.sum("tp"), F.sum("p") + F.sum("y")), F.lit(0.0)).alias("micro_f")
    )
    return rows.crossJoin(labels)  # one row by one row


def threshold_curve(df: DataFrame, label: Column, probability: Column, buckets: int) -> DataFrame:
    """Precision and recall at thresholds 0, 1/buckets .. 1.

    Rows are counted by bucket first, so thresholds meet counts and not rows.
    """
    bucket = F.least(F.floor(probability * buckets), F.lit(buckets)).cast("int")
    counts = df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.sum(F.when(label, 1).otherwise(0)).alias("pos"))
    grid = df.sparkSession.range(buckets + 1).select(F.col("id").cast("int").alias("b"))
    filled = grid.join(counts, "b", "left").fillna(0)
    up = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    s = filled.select("b", F.sum("n").over(up).alias("said"), F.sum("pos").over(up).alias("hit"), F.sum("pos").over(every).alias("all"))
    return s.select(
        (F.col("b") / F.lit(float(buckets))).alias("threshold"), ratio(F.col("hit"), F.col("said")).alias("precision"),
        ratio(F.col("hit"), F.col("all")).alias("recall"),
    )
