"""python -m millrace.cli <mode>: pools, learning, scoring and model files from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.losses import TARGETS
from millrace.operators import grid as G
from millrace.operators import pool as P
from millrace.operators.sampling import parse_ranges, split
from millrace.plans import ensembles, models, scheme, selection
from millrace.plans.trees import binned
from millrace.session import session
from millrace.sources import readers, writers


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("mode", choices=sorted(MODES))
    p.add_argument("-f", "--learn", help="learn pool")
    p.add_argument("-t", "--test", help="test pool")
    p.add_argument("--format", default="features", choices=sorted(readers.READERS))
    p.add_argument("--description", help="column description of a CatBoost pool")
    p.add_argument("-O", "--scheme", default=scheme.DEFAULT)
    p.add_argument("-T", "--target", default="L2")
    p.add_argument("-M", "--metrics", default="L2", help="losses between commas")
    p.add_argument("-x", "--bins", type=int, default=32)
    p.add_argument("-m", "--model", help="model file")
    p.add_argument("-o", "--out", help="where results go")
    p.add_argument("-X", "--share", type=float, help="learn share of a cross-validated pool")
    p.add_argument("-r", "--ranges", default="", help="name=a:b:step;...")
    p.add_argument("-k", "--folds", type=int, default=5)
    p.add_argument("--top", type=int, default=10)
    return p


def _read(spark: SparkSession, a: argparse.Namespace, path: str) -> DataFrame:
    how = {"description": a.description} if a.format == "catboost" else {}
    df = readers.read(spark, path, a.format, **how)
    if a.format in ("libsvm", "extreme"):
        width = df.agg(F.max(F.array_max(F.map_keys("features"))).alias("w")).first().w
        df = df.withColumn("features", readers.dense(F.col("features"), (width or 0) + 1))
    return df


def _pools(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    learn = _read(spark, a, a.learn)
    if a.share:
        return split(learn, "row_id", a.share, "cli")
    return learn, _read(spark, a, a.test) if a.test else learn


def _context(learn: DataFrame, a: argparse.Namespace) -> scheme.Context:
    found = G.fit(learn, "features", a.bins)
    return scheme.Context(found, len(found.borders))


def _save(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _model(spark: SparkSession, a: argparse.Namespace) -> models.Model:
    return models.from_json("\n".join(r.value for r in spark.read.text(a.model).collect()))[0]  # one line


def _values(df: DataFrame, model: models.Model, a: argparse.Namespace) -> dict:
    p = model.column(F.col("features"))
    row = df.agg(*[TARGETS[n].value(F.col("target"), p).alias(n) for n in a.metrics.split(",")]).first()
    return row.asDict()


def fit(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Learns a model and writes it beside its grid."""
    learn, test = _pools(spark, a)
    context = _context(learn, a)
    learner = scheme.build(a.scheme, context)
    if hasattr(learner, "loss"):
        learner.loss = scheme.target_spec(a.target)[0]
    model = learner.fit(binned(learn, context.grid), F.col("target"))
    if a.out:
        _save(spark, models.to_json(model), f"{a.out}.model")
        _save(spark, context.grid.to_text(), f"{a.out}.grid")
    return {"learn": _values(learn, model, a), "test": _values(test, model, a)}


def apply(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Scores a pool into item and value."""
    df = _read(spark, a, a.learn)
    item = "item_id" if "item_id" in df.columns else "row_id"
    writers.predictions(df, f"{a.out}.values", item, _model(spark, a).column(F.col("features")))
    return {"rows": df.count()}


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Metrics of a saved model."""
    return _values(_read(spark, a, a.learn), _model(spark, a), a)


def cross_validate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Folds of one scheme, or a comparison of schemes between |."""
    learn = _read(spark, a, a.learn)
    context = _context(learn, a)
    rows = binned(learn, context.grid)
    found = selection.compare(rows, F.col("target"), a.scheme.split("|"), context, a.metrics.split(",")[0], a.folds)
    return {"schemes": [dict(zip(("scheme", "mean", "difference", "p"), f)) for f in found]}


def grid_search(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The best of all combinations of ranges."""
    learn, test = _pools(spark, a)
    context = _context(learn, a)
    parts = binned(learn, context.grid), binned(test, context.grid)
    return selection.search(*parts, F.col("target"), a.scheme, parse_ranges(a.ranges), context, a.metrics.split(","))


def interpret(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The strongest rules of a tree ensemble, by weight and support."""
    rules = models.compiled(_model(spark, a))
    support = ensembles.support(_read(spark, a, a.learn), rules)
    return {"rules": [{"conditions": c, "effect": e} for c, e in models.strongest(rules, support, a.top)]}


def info(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Columns and size of a pool."""
    return {"columns": [r.asDict() for r in P.info(_read(spark, a, a.learn)).collect()]}


def split_pool(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Two pools from one, as Parquet."""
    learn, test = split(_read(spark, a, a.learn), "row_id", a.share or 0.8, "cli")
    learn.write.mode("overwrite").parquet(f"{a.out}.learn")
    test.write.mode("overwrite").parquet(f"{a.out}.test")
    return {"out": a.out}


def validate_model(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Whether a model file can be read."""
    ok, why = models.validate("\n".join(r.value for r in spark.read.text(a.model).collect()))
    return {"valid": ok, "why": why}


def validate_pool(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Problems of a pool."""
    df = _read(spark, a, a.learn)
    key = "item_id" if "item_id" in df.columns else "row_id"
    return {"problems": [r.asDict() for r in P.check(df, key).collect()]}


def convert(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A pool as libsvm text."""
    writers.libsvm(_read(spark, a, a.learn), a.out)
    return {"out": a.out}


def convert_features(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A pool as features text."""
    writers.features_txt(_read(spark, a, a.learn), a.out)
    return {"out": a.out}


MODES = {
    "fit": fit, "apply": apply, "evaluate-model": evaluate, "cross-validation": cross_validate, "grid-search": grid_search,
    "interpret-model": interpret, "print-pool-info": info, "split-json-pool": split_pool, "validate-model": validate_model,
    "validate-pool": validate_pool, "convert-pool-libsvm": convert, "convert-pool-features": convert_features,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs a mode and prints its result as JSON."""
    a = _parser().parse_args(argv)
    result = MODES[a.mode](spark or session("millrace-cli"), a)
    print(json.dumps(result, default=str))
    return result


if __name__ == "__main__":
    main()
