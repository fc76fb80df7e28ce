"""The queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are 85 % alike."""
    from millrace.llm import ngram_join

    return ngram_join.join(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the aligned common blocks of later ones."""
    from millrace.llm import line_dedup

    return line_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_deleted")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to containers and read back."""
    from millrace.llm import token_store

    return token_store.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' word-BPE ids and of the texts decoded from them."""
    from millrace.llm import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels that aren't held out."""
    from millrace.llm import quality

    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from millrace.llm import html_text

    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of all documents."""
    from millrace.llm import licenses

    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    from millrace.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every query vector by inner product."""
    from pyspark.sql import functions as F

    from millrace.llm import ann

    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    from millrace.llm import fingerprints

    return fingerprints.edits(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_patience_line_dedup": op2_patience_line_dedup,
    "op3_token_store": op3_token_store,
    "op4_backtracking_bpe": op4_backtracking_bpe,
    "op5_attention_quality": op5_attention_quality,
    "op6_page_text": op6_page_text,
    "op7_licence_rules": op7_licence_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_kmeans_tree_search": op9_kmeans_tree_search,
    "op10_multiset_fingerprints": op10_multiset_fingerprints,
}

#: Queries that DuckDB can run on the same tables.
ORACLES: dict[str, str] = {}
