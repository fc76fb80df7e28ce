"""Writers of pool formats: lines are expressions, files are Spark's."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(v: Column) -> Column:
    """Up to eight decimals, no trailing zeros."""
    fixed = F.call_function("format_number", v, F.lit("###0.########"))
    return F.regexp_replace(F.when(v.isNull() | F.isnan(v), "NaN").otherwise(fixed), r"^-0$", "0")


def features_txt(df: DataFrame, path: str, target: str = "target", url: str | None = None, group: str | None = None, features: str = "features") -> None:
    """Row number, target, url, group and features between tabs."""
    numbers = F.array_join(F.transform(features, _number), "\t")
    line = F.concat_ws("\t", F.col("row_id").cast("string"), _number(F.col(target).cast("double")), F.col(url) if url else F.lit("url"), F.col(group).cast("string") if group else F.lit("0"), numbers)
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def libsvm(df: DataFrame, path: str, target: str = "target", features: str = "features") -> None:
    """Target and i:v of the non-zero features between tabs, indices from 0."""
    cells = F.transform(features, lambda v, i: F.when(v != 0, F.concat(i.cast("string"), F.lit(":"), _number(v))))
    line = F.concat_ws("\t", _number(F.col(target).cast("double")), F.array_join(F.filter(cells, lambda c: c.isNotNull()), "\t"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def json_pool(df: DataFrame, path: str, item: str, features: list[str], targets: list[str], name: str = "pool") -> None:
    """The self-describing format, a line a column.

    A line holds a whole column, so this is for pools that fit a task; Parquet
    is the format for others.
    """

    def line(role: str, meta: dict, column: str) -> DataFrame:
        values = F.transform(F.array_sort(F.collect_list(F.struct("row_id", F.col(column).alias("v")))), lambda x: x["v"])
        return df.agg(F.concat_ws("\t", F.lit(role), F.lit(json.dumps(meta)), F.to_json(values)).alias("value"))

    from millrace.operators.pool import kind_of

    out = line("items", {"id": name, "type": "FAKE"}, item)
    for role, names in (("feature", features), ("target", targets)):
        for n in names:
            out = out.unionAll(line(role, {"id": n, "description": df.schema[n].metadata.get("description", ""), "type": kind_of(df.schema[n])}, n))
    out.coalesce(1).write.mode("overwrite").text(path)


def predictions(df: DataFrame, path: str, item: str, value: Column) -> None:
    """Item and value between a tab."""
    df.select(F.concat_ws("\t", F.col(item).cast("string"), _number(value)).alias("value")).write.mode("overwrite").text(path)


def frequencies(df: DataFrame, path: str, key: str) -> None:
    """Values and their counts, most frequent first."""
    df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).write.mode("overwrite").csv(path, header=True)
