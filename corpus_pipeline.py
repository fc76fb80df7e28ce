"""A training corpus from raw documents in four stages.

Every stage takes (spark, docs, sf_dir), with `docs` as its predecessor wrote
them, and returns a DataFrame; all but the last return the columns of
`documents`.  `run` writes each stage's rows as Parquet to the shared folder and
reads them again for the next.

Defined results: the first stage keeps a document of null or empty text if the
model's score for it is high enough; line dedup keeps those, as they lose
nothing, and drops documents that it empties; near copies keeps documents
without words, and those with null keys, which link with nothing; packing
gives a document without text its end id alone.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, ngram_join, packing, quality, scratch

#: Documents with a score below it go.
KEEP_FROM = 0.3
#: Bytes for what a worker's encoder remembers: executors have held three other stages by then.
MEMO_BYTES = 64 << 20


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels)
    return quality.score(docs, model).where(F.col("score") >= KEEP_FROM).select(*docs.columns)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks that an earlier one has; those of which nothing is left go."""
    left = line_dedup.dedup(docs).where((F.col("n_deleted") == 0) | (F.col("text") != ""))
    chars = F.when(F.col("n_deleted") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 alike."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that remain, packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memo_bytes=MEMO_BYTES)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from `documents` on."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Patience alignment and a learned model have no SQL form.
ORACLE_SQL = None
