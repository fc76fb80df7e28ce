"""Vector best-fit packing of documents into sequences.

A document's ids (with its end id) become pieces of at most `max_tokens`; only
longer documents are cut, the first piece taking the remainder.  A piece asks
for a vector: its tokens, one document, and an attention cost (its length
squared).  Every sequence has a capacity in each of the three.  Pieces go in
descending length to the open sequence that fits under every constraint and
scores best, by the smallest weighted residual norm or the largest weighted
dot product of demand and residual.

A piece's vector depends on its length alone, so the plan is made on the count
of pieces of each length (at most `max_tokens` numbers on the driver, whatever
the table's size): sequences with the same content are one *class* with a
count.  The plan says which ranks of a length go to which sequences and at
what offset; pieces then look up their place by a join.  The result is the one
that best fit over all pieces would give, without blocks packed apart.

Defined results: null or empty text is a document of its end id only; a null
doc_id or a repeated row is a document like any other; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import scratch
from millrace.llm.tokens import MEMO_BYTES, bounded, column_runs, encoder

#: Bytes of text encoded at once.
RUN_BYTES = 4_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def pieces(
    docs: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", memo_bytes: int = MEMO_BYTES,
) -> DataFrame:
    """Each piece of each document; `nth` numbers a part's pieces of one length."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = encoder(tokenizer, memo_bytes), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for run_of, texts in column_runs(batch.column(1), RUN_BYTES):
                ids, begin = encode.batch(texts)
                raw, rows = memoryview(ids.tobytes()), []
                for key, a, b in zip(keys[run_of], begin[:-1].tolist(), begin[1:].tolist()):
                    n = b - a + 1
                    at, stop = 0, n % max_tokens or max_tokens
                    for piece in range(-(-n // max_tokens)):
                        if stop < n:
                            crc = zlib.crc32(raw[4 * (a + at) : 4 * (a + stop)])
                        else:
                            crc = zlib.crc32(end, zlib.crc32(raw[4 * (a + at) : 4 * b]))
                        length = stop - at
                        rows.append((key, piece, at, length, crc, part, seen[length]))
                        seen[length] += 1
                        at, stop = stop, stop + max_tokens
                columns = zip(*rows)
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PIECES.split(", ")])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, PIECES)


def plan(
    counts: dict[int, int], max_tokens: int = 1024, max_docs: int | None = None,
    max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.25, 0.25),
    rule: str = "norm",
) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, rank, count, sequence, offset) from the number of pieces of each length.

    Pieces `rank .. rank + count - 1` of that length lie at `offset` of the
    sequences `sequence .. sequence + count - 1`.
    """
    room = np.array([max_tokens, max_docs or max_tokens, max_cost or max_tokens**2], float)
    weight = np.array(weights)
    classes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual: runs (first sequence, how many)
    out, sequences = [], 0

    def put(length: int, rank: int, left: tuple[int, int, int], first: int, n: int) -> None:
        out.append((length, rank, n, first, max_tokens - left[0]))
        rest = (left[0] - length, left[1] - 1, left[2] - length * length)
        if rest[0] > 0 and rest[1] > 0 and rest[2] > 0:
            classes.setdefault(rest, []).append((first, n))

    for length in sorted(counts, reverse=True):
        ask = np.array([length, 1, length * length], float)
        if (ask > room).any():
            raise ValueError(f"a piece of {length} tokens is beyond a sequence's capacity")
        rank, total = 0, counts[length]
        while rank < total:
            keys = np.array(list(classes), float).reshape(-1, 3)
            fits = np.flatnonzero((keys >= ask).all(axis=1))
            if len(fits):
                scaled = keys[fits] / room
                if rule == "norm":
                    score = ((scaled - ask / room) ** 2 * weight).sum(axis=1)
                else:
                    score = -(scaled * (ask / room) * weight).sum(axis=1)
                left = tuple(int(x) for x in keys[fits[np.lexsort((keys[fits, 0], score))[0]]])
                first, n = classes[left].pop()
                take = min(n, total - rank)
                if take < n:
                    classes[left].append((first + take, n - take))
                if not classes[left]:
                    del classes[left]
            else:
                left, first = tuple(int(x) for x in room), sequences
                # as many new sequences as this length fills alone: each takes all it can hold
                fit = int(min(room[0] // length, room[1], room[2] // (length * length)))
                take = -(-(total - rank) // fit)
                sequences += take
            put(length, rank, left, first, take)
            rank += take
    return out


def pack(
    docs: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", memo_bytes: int = MEMO_BYTES, **limits,
) -> DataFrame:
    """Pack all documents; a row a piece with its sequence and its offset there.

    `max_docs` and `max_cost` bound a sequence's documents and its attention
    cost.  By default neither can bind before the tokens do, so that sequences
    are as few as tokens allow.
    """
    spark = docs.sparkSession
    cut = scratch.table(pieces(docs, tokenizer, max_tokens, end_id, id_col, text_col, memo_bytes), "pieces")
    there = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in there.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(counts, max_tokens, **limits)
    places = spark.createDataFrame(
        rows or [], "length long, lo long, many long, first_sequence long, offset long"
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = there.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    # the plan's rows are bounded by the lengths, not by the table: at most two for each class it opens or closes
    r, p = ranked.alias("r"), F.broadcast(places).alias("p")
    at = (
        (F.col("r.length") == F.col("p.length"))
        & (F.col("rank") >= F.col("lo"))
        & (F.col("rank") < F.col("lo") + F.col("many"))
    )
    return r.join(p, at).select(
        F.col("doc_id").alias(id_col), "piece", "start", "r.length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
    )
