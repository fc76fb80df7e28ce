"""Token ids on disk: bit-plane shuffled blocks, zstandard, and a chunk index.

A *container* is one file.  It holds the ids of consecutive whole documents:

    magic, version, plane mode, part, number in the part, ids, documents, block length, blocks
    document table   zstandard of: id known (u1), doc_id (i8), length (u4), each as one column
    chunk index      for each block and plane: compressed size (u4); places follow by addition
    planes           each block's planes, compressed one by one

A block is a fixed number of ids.  It is transposed into four byte planes or 32
bit planes before compression, so that the bytes (bits) of equal weight stand
together.  The chunk index lets a reader open single blocks (`read_ids`).

Files are written through Spark's own text writer, one record a file, so they
go wherever Spark can write and appear only when their task is committed.  The
record separator leaves one line feed after the container, which readers skip.

Defined results: null text is an empty document (its end id only); rows with a
null doc_id come first; repeated doc_ids stay separate documents, ordered by
the text's hash, then by text, and may lie in several containers; an empty table gives no file and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import scratch
from millrace.llm.tokens import bounded, column_runs, encoder

MAGIC = b"MRTOKENS"
HEAD = struct.Struct("<8sBBIIQIII")
BYTE_PLANES, BIT_PLANES = 4, 32
#: Bytes of text encoded at once.
RUN_BYTES = 8_000_000


def to_planes(block: np.ndarray, planes: int) -> list[bytes]:
    """A block of ids as byte planes or bit planes, lowest weight first."""
    octets = np.ascontiguousarray(block.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if planes == BYTE_PLANES:
        return [row.tobytes() for row in octets]
    bits = np.unpackbits(octets[:, :, None], axis=2, bitorder="little")
    return [np.packbits(bits[i // 8, :, i % 8]).tobytes() for i in range(BIT_PLANES)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The inverse of `to_planes` for a block of n ids."""
    if len(planes) == BYTE_PLANES:
        octets = np.frombuffer(b"".join(planes), np.uint8).reshape(4, n)
    else:
        octets = np.zeros((4, n), np.uint8)
        for i, plane in enumerate(planes):
            octets[i // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (i % 8)
    return np.ascontiguousarray(octets.T).view("<u4").reshape(n)


def pack(
    part: int, number: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray,
    block_ids: int = 1 << 16, planes: int = BYTE_PLANES, level: int = 1,
) -> bytes:
    """One container with these documents."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level).compress
    blocks = [ids[i : i + block_ids] for i in range(0, len(ids), block_ids)]
    pressed = [[press(p) for p in to_planes(b, planes)] for b in blocks]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    docs = press(known.tobytes() + keys.tobytes() + lengths.astype("<u4").tobytes())
    sizes = np.array([[len(p) for p in b] for b in pressed], "<u4").tobytes()
    head = HEAD.pack(MAGIC, 1, planes, part, number, len(ids), len(doc_ids), block_ids, len(blocks))
    return b"".join([head, struct.pack("<I", len(docs)), docs, sizes, *(p for b in pressed for p in b)])


@dataclass
class Container:
    """An opened container: its document table and chunk index, ids on demand."""

    raw: bytes

    def __post_init__(self):
        import zstandard

        self._open = zstandard.ZstdDecompressor().decompress
        magic, version, self.planes, self.part, self.number, self.n_ids, n, self.block_ids, self.blocks = HEAD.unpack_from(self.raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token container")
        (size,) = struct.unpack_from("<I", self.raw, HEAD.size)
        at = HEAD.size + 4
        docs = self._open(self.raw[at : at + size])
        known, keys = np.frombuffer(docs, np.uint8, n), np.frombuffer(docs, "<i8", n, n)
        self.doc_ids = [int(k) if ok else None for ok, k in zip(known, keys)]
        self.lengths = np.frombuffer(docs, "<u4", n, 9 * n).astype(np.int64)
        sizes = np.frombuffer(self.raw, "<u4", self.blocks * self.planes, at + size)
        first = at + size + sizes.nbytes
        self.places = first + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def block(self, k: int) -> np.ndarray:
        """The ids of block k; only its planes are opened."""
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        p = self.places[k * self.planes : (k + 1) * self.planes + 1]
        return from_planes([self._open(self.raw[a:b]) for a, b in zip(p[:-1], p[1:])], n)

    def read_ids(self, start: int, length: int) -> np.ndarray:
        """Ids start to start + length of this container, by the chunk index."""
        if length <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (start + length - 1) // self.block_ids
        ids = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return ids[start - first * self.block_ids :][:length]


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", container_ids: int = 1 << 21, block_ids: int = 1 << 16,
    planes: int = BYTE_PLANES, level: int = 1, partitions: int | None = None,
) -> None:
    """Encode every whole text, append `end_id`, and write containers in ascending id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys, lengths, kept, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            raw = pack(part, number, keys, np.concatenate(lengths), np.concatenate(kept), block_ids, planes, level)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["container"])

        for batch in batches:
            all_keys = batch.column(0).to_pylist()
            for run_of, texts in column_runs(batch.column(1), RUN_BYTES):
                ids, begin = encode.batch(texts)
                kept.append(np.insert(ids, begin[1:], end_id).astype("<u4", copy=False))
                lengths.append(np.diff(begin) + 1)
                keys += all_keys[run_of]
                n += len(kept[-1])
                if n >= container_ids:
                    yield close()
                    number, n = number + 1, 0
                    keys, lengths, kept = [], [], []
        if keys:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    bounded(docs.sparkSession)
    split = [partitions] if partitions else []
    # the digest parts the rows of a repeated key
    order = [F.asc_nulls_first("k"), F.asc_nulls_first("h"), F.asc_nulls_first("t")]
    dealt = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(*split, *order[:2]).sortWithinPartitions(*order).drop("h")
    (
        dealt.mapInArrow(run, "container binary")
        .select(F.col("container").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("compression", "none")
        .text(path)
    )


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Each document of the containers under `path`, from the files alone.

    part, number: its container; pos: its place there; rel_start: ids before it
    there; n_tokens; ids_crc32 of its ids as little-endian u4.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                box = Container(raw.as_buffer().to_pybytes())
                ends = np.cumsum(box.lengths)
                ids = np.concatenate([box.block(k) for k in range(box.blocks)] or [np.zeros(0, "<u4")])
                view, n = memoryview(ids.tobytes()), len(ends)
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends - box.lengths, ends)]
                columns = [
                    pa.array([box.part] * n, pa.int64()), pa.array([box.number] * n, pa.int64()),
                    pa.array(range(n), pa.int64()), pa.array(box.doc_ids, pa.int64()),
                    pa.array(ends - box.lengths), pa.array(box.lengths), pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "number", "pos", id_col, "rel_start", "n_tokens", "ids_crc32"])

    schema = f"part long, number long, pos long, {id_col} long, rel_start long, n_tokens long, ids_crc32 long"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def with_starts(found: DataFrame) -> DataFrame:
    """Adds `start`: the ids of all documents before.

    Totals are added up for each writing task, so the driver holds one number
    a task and nothing for a document.
    """
    spark = found.sparkSession
    boxes = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))
    totals = sorted((r.part, r.ids) for r in boxes.groupBy("part").agg(F.sum("ids").alias("ids")).collect())
    before, sums = [], 0
    for part, ids in totals:
        before.append((part, sums))
        sums += ids
    bases = spark.createDataFrame(before, "part long, part_base long")
    earlier = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    places = boxes.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0))).join(bases, "part")
    places = places.select("part", "number", (F.col("base") + F.col("part_base")).alias("base"))
    return found.join(places, ["part", "number"]).withColumn("start", F.col("base") + F.col("rel_start"))


def round_trip(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write the texts' ids to containers, read them back, and give each document's digest."""
    spark = docs.sparkSession
    path = scratch.fresh(spark, "tokens")
    write(docs, path, tokenizer, **how)
    found = scratch.table(read(spark, path), "token-rows")
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")
