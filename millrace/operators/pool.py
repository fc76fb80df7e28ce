"""Pools: tables with feature and target columns, and their projections and splits.

A pool is a DataFrame; the role, description and type of a column are in its
field's metadata, a stable row order is in `row_id`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.lineage import cut

#: Column types of a pool and the Spark types that hold them.
KINDS = {
    "VEC": T.DoubleType(), "SPARSE_VEC": T.MapType(T.IntegerType(), T.DoubleType()), "INTS": T.IntegerType(),
    "VEC_SEQ": T.ArrayType(T.DoubleType()), "CHAR_SEQ": T.StringType(),
}


def kind_of(field: T.StructField) -> str | None:
    """The pool type of a Spark column; null for columns that no pool type holds."""
    t = field.dataType
    if isinstance(t, T.MapType):
        return "SPARSE_VEC"
    if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
        return "INTS"
    if isinstance(t, (T.DoubleType, T.FloatType, T.LongType, T.DecimalType)):
        return "VEC"
    if isinstance(t, T.ArrayType):
        return "VEC_SEQ"
    return "CHAR_SEQ" if isinstance(t, T.StringType) else None


def with_role(df: DataFrame, column: str, role: str, description: str = "", **more: str) -> DataFrame:
    """`df` with the role ("feature" or "target") and description of a column in its metadata."""
    field = df.schema[column]
    meta = {**field.metadata, "role": role, "description": description, "kind": kind_of(field) or "", **more}
    return df.withColumn(column, F.col(column).alias(column, metadata=meta))


def roles(df: DataFrame, role: str) -> list[str]:
    """Columns with a role, in order."""
    return [f.name for f in df.schema if f.metadata.get("role") == role]


def target(df: DataFrame, name: str | None = None) -> str:
    """The target column of a name, or the last one."""
    found = roles(df, "target")
    if name is not None:
        if name not in found:
            raise KeyError(f"no target {name!r}; there are {found}")
        return name
    if not found:
        raise KeyError("the pool has no target")
    return found[-1]


def info(df: DataFrame) -> DataFrame:
    """Size of a pool, and the type of each column, a row a column."""
    spark = df.sparkSession
    kinds = spark.createDataFrame([(i, f.name, kind_of(f)) for i, f in enumerate(df.schema)], "position int, name string, kind string")
    return kinds.crossJoin(df.agg(F.count("*").alias("n_rows")))  # a row a column by one row


def assemble(*columns: str | Column) -> Column:
    """Feature columns, scalars and vectors, as one vector."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat(*[F.array(c.cast("double")) for c in parts])


def features(df: DataFrame, out: str = "features") -> DataFrame:
    """`df` with its numeric and vector feature columns as one vector, in order."""
    names = roles(df, "feature") or [f.name for f in df.schema if kind_of(f) in ("VEC", "VEC_SEQ")]
    parts = []
    for n in names:
        kind = kind_of(df.schema[n])
        if kind == "VEC_SEQ":
            parts.append(F.col(n).cast("array<double>"))
        elif kind in ("VEC", "INTS"):
            parts.append(F.array(F.col(n).cast("double")))
    return df.withColumn(out, F.concat(*parts) if parts else F.array().cast("array<double>"))


def extend(df: DataFrame, vector: str, *columns: Column) -> DataFrame:
    """Columns appended to the feature vector."""
    return df.withColumn(vector, F.concat(F.col(vector), F.array(*[c.cast("double") for c in columns])))


def sub(df: DataFrame, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows by a table of row ids, with `position` in its order; ids given twice come twice."""
    return rows.select(F.col(row_id), F.col("position")).join(df, row_id)


def point(df: DataFrame, row_id: int, column: str) -> DataFrame:
    """One value of one row."""
    return df.where(F.col("row_id") == row_id).select(column)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `row_id` from 0 in an order.

    Rows are sorted over ranges and counted a range at a time, so no task holds them all.  The dealt rows are
    written before they are counted: dealt twice, ranges could be cut at other rows.
    """
    keys = [F.asc_nulls_first(c) for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    inside = cut(dealt.withColumn("_at", F.monotonically_increasing_id() - F.col("_part").cast("long") * (1 << 33)))
    counts = sorted((r["_part"], r["n"]) for r in inside.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, n = [], 0
    for part, many in counts:
        before.append((part, n))
        n += many
    bases = df.sparkSession.createDataFrame(before, "_part int, _base long")
    # a row a partition
    return inside.join(F.broadcast(bases), "_part").withColumn("row_id", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def joined(*sets: DataFrame, key: str = "item_id", vector: str = "features") -> DataFrame:
    """Feature sets of the same items as one set: vectors are concatenated in order."""
    renamed = [s.select(key, F.col(vector).alias(f"_v{i}")) for i, s in enumerate(sets)]
    wide = reduce(lambda a, b: a.join(b, key), renamed)
    return wide.select(key, F.concat(*[F.col(f"_v{i}") for i in range(len(sets))]).alias(vector))


def one_vs_rest(label: Column, c: object) -> Column:
    """1 for a class, -1 for the others."""
    return F.when(label == c, 1.0).otherwise(-1.0)


def normalized_labels(df: DataFrame, label: str, out: str = "class") -> DataFrame:
    """`df` with labels numbered from 0 in ascending order; -1 is the last class.

    The numbering is made on the distinct labels and joined back.
    """
    distinct = df.select(label).distinct()
    order = Window.orderBy(F.when(F.col(label) == -1, 1).otherwise(0), label)
    return df.join(distinct.withColumn(out, (F.row_number().over(order) - 1).cast("int")), label)


def mapped(label: Column, mapping: Mapping[int, int]) -> Column:
    """Labels by a dictionary; null for labels that it lacks."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[label]


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows of each class, and the first row that has it (labels in first-seen order)."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def n_classes(df: DataFrame, label: str) -> DataFrame:
    """The largest label and one: classes that don't occur count too."""
    return df.agg((F.max(label) + 1).cast("int").alias("n_classes"))


def class_rows(df: DataFrame, label: str) -> DataFrame:
    """Row ids of each class, a row a row id with its place in the class."""
    at = Window.partitionBy(label).orderBy("row_id")
    return df.select(F.col(label).alias("label"), "row_id", (F.row_number().over(at) - 1).alias("place"))


def check(df: DataFrame, key: str = "item_id") -> DataFrame:
    """Problems of a pool: repeated keys and vectors of other widths, a row a problem."""
    repeated = df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n"))
    out = repeated.select(F.lit("repeated keys").alias("problem"), "n")
    vectors: Sequence[str] = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    for v in vectors:
        widths = df.groupBy(F.size(v).alias("w")).count().agg(F.count("*").alias("n"))
        out = out.union(widths.select(F.lit(f"widths of {v} beyond one"), F.greatest(F.col("n") - 1, F.lit(0))))
    return out.where("n > 0")
