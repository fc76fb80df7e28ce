"""Readers of pool formats: text lines become columns by expressions, nothing is parsed on the driver.

Compressed files (.gz) are read by Spark's own codecs.  Every reader gives
`row_id` where the format's order matters.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from millrace.functions.vectors import categorical


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with a number that ascends along each file."""
    text = spark.read.text(path)
    return text.where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("row_id"))


def checked_width(df: DataFrame, vector: str = "features") -> DataFrame:
    """`df`, with an error where a vector's width isn't that of the first row."""
    first = df.orderBy("row_id").select(F.size(vector).alias("w")).limit(1).collect()
    if not first:
        return df
    w = first[0].w
    message = F.concat(F.lit(f"a row has another width than {w}: "), F.size(vector).cast("string"))
    # an expression of the column itself, so that no plan can leave the check out
    return df.withColumn(vector, F.when(F.size(vector) == w, F.col(vector)).otherwise(F.raise_error(message)))


def features_txt(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """query, target, url, group and features between tabs."""
    parts = F.split("value", "\t")
    df = _lines(spark, path).select(
        "row_id", parts[0].alias("query_id"), parts[1].cast("double").alias("target"), parts[2].alias("url"), parts[3].alias("group_id"),
        F.transform(F.slice(parts, F.lit(5), F.greatest(F.size(parts) - 4, F.lit(0))), lambda v: v.cast("double")).alias("features"),
    ).withColumn("item_id", F.concat("url", F.lit("@"), "query_id"))
    return checked_width(df) if check else df


def letor(spark: SparkSession, path: str) -> DataFrame:
    """label qid:n i:v ... #docid = x; values are taken in order, whatever their written index."""
    tokens = F.filter(F.split(F.regexp_replace("value", "#.*$", ""), " +"), lambda t: t.rlike(r"^\d+:"))
    return _lines(spark, path).select(
        "row_id", F.regexp_extract("value", r"^\s*(\S+)", 1).cast("double").alias("target"),
        F.regexp_extract("value", r"qid:(\d+)", 1).alias("group_id"), F.regexp_extract("value", r"docid\s*=\s*([A-Za-z0-9-]+)", 1).alias("item_id"),
        F.transform(tokens, lambda t: F.split(t, ":")[1].cast("double")).alias("features"),
    )


def _pairs(tokens: Column) -> Column:
    held = F.filter(tokens, lambda t: t.contains(":"))
    return F.map_from_entries(F.transform(held, lambda t: F.struct(F.split(t, ":")[0].cast("int").alias("k"), F.split(t, ":")[1].cast("double").alias("v"))))


def dense(entries: Column, width: int) -> Column:
    """A sparse vector as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at(entries, i), F.lit(0.0)))


def libsvm(spark: SparkSession, path: str) -> DataFrame:
    """target i:v ..., indices from 0; features as a map."""
    tokens = F.filter(F.split("value", r"\s+"), lambda t: t != "")
    return _lines(spark, path).select("row_id", tokens[0].cast("double").alias("target"), _pairs(tokens).alias("features"))


def extreme(spark: SparkSession, path: str) -> DataFrame:
    """Header "rows features labels", then l1,l2 i:v ...; a line may have no labels."""
    lines = _lines(spark, path)
    header = lines.agg(F.min("row_id").alias("row_id"))
    tokens = F.filter(F.split("value", r"\s+"), lambda t: t != "")
    labelled = ~tokens[0].contains(":")
    labels = F.when(labelled, F.transform(F.split(tokens[0], ","), lambda v: v.cast("int"))).otherwise(F.array().cast("array<int>"))
    return lines.join(F.broadcast(header), "row_id", "left_anti").select("row_id", labels.alias("labels"), _pairs(tokens).alias("features"))  # one row


def column_description(text: str, width: int) -> list[tuple[str, str]]:
    """(kind, name) of each column of a column description; columns it doesn't name are numbers, the first the target."""
    kinds = {i: ("Num", "") for i in range(width)}
    given = [line.split("\t") for line in text.splitlines() if line.strip()]
    for parts in given:
        kind = {"Label": "Target"}.get(parts[1], parts[1])
        if kind not in {"Num", "Categ", "Target", "Auxiliary", "DocId", "QueryId", "Weight"}:
            raise ValueError(f"unknown column type {kind}")
        kinds[int(parts[0])] = (kind, parts[2] if len(parts) > 2 else "")
    if not any(k == "Target" for k, _ in kinds.values()):
        if given:
            raise ValueError("no target column")
        kinds[0] = ("Target", "")
    found = [k for k, _ in kinds.values()]
    if found.count("Target") != 1 or found.count("Weight") > 1 or not {"Num", "Categ"} & set(found):
        raise ValueError("a pool has one target, at most one weight and some feature")
    return [kinds[i] for i in sorted(kinds)]


def catboost(spark: SparkSession, path: str, description: str | None = None, sep: str = "\t", header: bool = False) -> DataFrame:
    """Delimited columns by a column description (its path); categories become numbers by their Java hash."""
    raw = spark.read.csv(path, sep=sep, header=header)
    text = "\n".join(r.value for r in spark.read.text(description).collect()) if description else ""  # a line a column
    kinds = column_description(text, len(raw.columns))
    cols = dict(zip(raw.columns, kinds))
    parts = [F.col(f"`{c}`").cast("double") if k == "Num" else categorical(F.col(f"`{c}`")) for c, (k, _) in cols.items() if k in ("Num", "Categ")]
    out = [F.monotonically_increasing_id().alias("row_id"), F.array(*parts).alias("features")]
    for kind, name, of in (("Target", "target", "double"), ("Weight", "weight", "double"), ("QueryId", "group_id", "string"), ("DocId", "item_id", "string")):
        out += [F.col(f"`{c}`").cast(of).alias(name) for c, (k, _) in cols.items() if k == kind]
    return raw.select(*out)


def json_pool(spark: SparkSession, path: str) -> DataFrame:
    """A self-describing pool, a line a column: items, features, targets with their meta and values.

    Columns are exploded with positions and brought together by a pivot on the position.
    """
    parts = F.split("value", "\t", 3)
    lines = _lines(spark, path).select(parts[0].alias("role"), parts[1].alias("meta"), parts[2].alias("values"))
    names = lines.select("role", "meta").collect()  # a line a column
    options = {"allowUnquotedFieldNames": "true"}
    out = None
    for i, r in enumerate(names):
        loose = spark.range(1).select(F.from_json(F.lit(r.meta), "map<string,string>", options).alias("m")).first().m or {}
        kind, name = loose.get("type", ""), loose.get("id") or f"{r.role}{i}"
        of = {"VEC": "array<double>", "INTS": "array<int>", "VEC_SEQ": "array<array<double>>"}.get(kind, "array<string>")
        mine = lines.where((F.col("role") == r.role) & (F.col("meta") == r.meta))
        values = F.from_json("values", of if r.role != "items" else "array<string>", options)
        meta = {"role": {"feature": "feature", "target": "target"}.get(r.role, "item"), "description": loose.get("description", ""), "kind": kind}
        column = mine.select(F.posexplode(values).alias("row_id", "_v"))
        label = "item" if r.role == "items" else name
        column = column.select(F.col("row_id").cast("long"), F.col("_v").alias(label, metadata=meta))
        out = column if out is None else out.join(column, "row_id")
    if out is None:
        raise ValueError("an empty pool file")
    return out


def event_log(spark: SparkSession, path: str, kind: str = "plain", most: int | None = None) -> DataFrame:
    """(user, item, ts in hours, user_id, item_id, delta) of an event log.

    "plain" lines are user, item, hours; "lastfm" lines are user, ISO time, _,
    item.  Broken lines are left out.  Users and items are numbered in order of
    appearance; delta is the time since the pair's previous event.
    """
    from pyspark.sql.window import Window

    text = spark.read.text(path)
    if most is not None:
        text = text.limit(most)
    p = F.split("value", "\t")
    if kind == "lastfm":
        hours = F.unix_timestamp(F.try_to_timestamp(p[1])) / 3600.0
        rows = text.select(p[0].alias("user"), F.get(p, 3).alias("item"), hours.alias("ts"))
    else:
        rows = text.select(p[0].alias("user"), F.get(p, 1).alias("item"), F.get(p, 2).try_cast("double").alias("ts"))
    rows = rows.where("user is not null and item is not null and ts is not null")
    for key in ("user", "item"):
        seen = rows.groupBy(key).agg(F.min("ts").alias("first"))
        ids = seen.select(key, (F.row_number().over(Window.orderBy("first", key)) - 1).alias(f"{key}_id"))
        rows = rows.join(ids, key)
    along = Window.partitionBy("user", "item").orderBy("ts")
    return rows.withColumn("delta", F.col("ts") - F.lag("ts").over(along))


SESSION_SCHEMA = (
    "uid string, timestamp long, reqid string, user_region int, query string, sntypes array<string>, rel array<string>, "
    "clicks array<int>, clicks_dwelltime array<int>"
)


def click_log(spark: SparkSession, path: str) -> DataFrame:
    """Search sessions, a JSON object a line: (uid, reqid, query, position, type, grade, clicked)."""
    s = spark.read.text(path).select(F.from_json("value", SESSION_SCHEMA).alias("s")).select("s.*").dropna("all")
    rows = s.select("uid", "reqid", "query", "clicks", F.posexplode(F.arrays_zip("sntypes", "rel")).alias("position", "r"))
    return rows.select("uid", "reqid", "query", "position", F.col("r.sntypes").alias("type"), F.col("r.rel").alias("grade"), F.array_contains("clicks", F.col("position")).alias("clicked"))


def session_archive(spark: SparkSession, path: str) -> DataFrame:
    """Steps of recorded sessions in zip archives: (session, step, features, target), the target 1 on the last step.

    An archive is one file for one task; archives are the unit of work.
    """
    import io
    import zipfile

    import pandas as pd

    def steps(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.rsplit("/", 1)[-1].startswith("session")):
                        rows = [[float(v) for v in line.split()] for line in z.read(name).decode().splitlines() if line.strip()]
                        yield pd.DataFrame({
                            "session": name, "step": range(len(rows)), "features": rows,
                            "target": [1.0 if i == len(rows) - 1 else 0.0 for i in range(len(rows))],
                        })

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(steps, "session string, step int, features array<double>, target double")


def delimited(spark: SparkSession, path: str, schema: str, defaults: dict | None = None, keep: Column | None = None) -> DataFrame:
    """CSV with a header and a schema, missing values by column, a condition of validity."""
    df = spark.read.schema(schema).csv(path, header=True)
    df = df.fillna(defaults) if defaults else df
    return df.where(keep) if keep is not None else df


READERS: dict[str, Callable[..., DataFrame]] = {
    "features": features_txt, "letor": letor, "libsvm": libsvm, "extreme": extreme, "catboost": catboost, "json": json_pool,
}


def read(spark: SparkSession, path: str, kind: str = "features", **how) -> DataFrame:
    """A pool in one of the formats."""
    if kind not in READERS:
        raise KeyError(f"no reader {kind!r}; there are {sorted(READERS)}")
    return READERS[kind](spark, path, **how)


def learn_and_test(spark: SparkSession, learn: str, test: str | None = None, kind: str = "features", **how) -> tuple[DataFrame, DataFrame]:
    """Two pools; the test pool is the learn pool where none is given."""
    a = read(spark, learn, kind, **how)
    return a, a if test in (None, learn) else read(spark, test, kind, **how)


def columns_in_first_line(spark: SparkSession, path: str, sep: str = "\t") -> int:
    """Columns of the first line."""
    first = spark.read.text(path).limit(1).collect()
    return len(first[0].value.split(sep)) if first else 0


def parse_meta(text: str) -> dict:
    """Meta of a pool column from strict JSON."""
    return json.loads(text)
