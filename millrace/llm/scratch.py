"""Tables that cut lineage: written to the shared folder that the cluster names.

The folder is read from ``spark.checkpoint.dir``.  Only where that setting is
unset and there is no cluster (tests, a laptop) does the session get a folder of
its own.  Every table
is written by Spark's own committer, so a lost executor costs a task retry and
never a half-read file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.lineage import folder as shared_folder

SETTING = "spark.checkpoint.dir"


def root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as a path that Spark can read."""
    folder = shared_folder(spark)
    if not spark.conf.get(SETTING, None):
        spark.conf.set(SETTING, folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{root(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: a cut in the lineage."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.millrace_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by `table` that no later read needs."""
    for df in tables:
        path = getattr(df, "millrace_path", None)
        if path is None:
            continue
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
