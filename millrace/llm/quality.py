"""Document quality by attention over passages.

A document is a bag of passages, `PASSAGE_WORDS` words each, over its whole
text.  Every passage is encoded as a vector of how its words look: shares of
capitals, symbols, digits, repeated words, word lengths, and a histogram of
word shapes.  A gated attention layer weighs the passages, their weighted sum
represents the document, and a logistic output scores it:

    h = tanh(x W + b)          passage
    e = (tanh(h V) * sigmoid(h U)) w,  a = softmax of e over the document
    score = sigmoid((sum of a h) c + d)

All parameters are learned together from document labels alone (Adam on the
log loss), on the driver, from a bounded sample of the labelled documents: at
most `sample_docs` of them, those with the smallest key hashes, whole, until
they have `sample_passages` passages (the document that reaches that number is
whole too).  Scoring reads every passage of every document.

Defined results: null or empty text has one passage of zeros and so the score
that the model gives to it; a null key is scored but never learned from; of
several labels of one key the smallest counts, null labels don't; without both
labels in the sample every score is the share of label 1 (0.5 without any);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from millrace.llm import scratch
from millrace.llm.tokens import _begins, bounded, column_runs, forget

PASSAGE_WORDS = 64
#: Bytes of text encoded at once: some hundred bytes of memory each.
RUN_BYTES = 150_000
SHAPES = 48
WIDTH = 10 + SHAPES

_UPPER, _SYMBOL, _DIGIT, _SPACE = 1, 2, 3, 4


def _byte_classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        kinds[b] = _UPPER if c.isupper() else _DIGIT if c.isdigit() else _SPACE if c.isspace() else 0 if c.islower() else _SYMBOL
    return kinds


_CLASS = _byte_classes()
#: Random words for hashing bytes by their place in a word.
_MIX = np.random.default_rng(11).integers(0, 1 << 63, 64 * 256, dtype=np.uint64)


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of all texts, and n + 1 places where documents begin and end."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = _CLASS[data]
    space = kind == _SPACE
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    size = (end - start).astype(np.float64)
    doc_at = _begins([len(r) + 1 for r in raw])
    doc = np.searchsorted(doc_at, start, "right") - 1
    words_of = np.bincount(doc, minlength=len(texts))
    first_word = _begins(words_of)
    passages_of = np.maximum(1, -(-words_of // PASSAGE_WORDS))
    begin = _begins(passages_of)
    out = np.zeros((int(begin[-1]), WIDTH), np.float32)
    if not len(start):
        return out, begin

    def each(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[end] - total[start]).astype(np.float64)

    upper, symbol, digit = each(kind == _UPPER), each(kind == _SYMBOL), each(kind == _DIGIT)
    wide = (end - start).astype(np.int64)
    letters = data[~space]
    at = np.arange(len(letters)) - np.repeat(_begins(wide)[:-1], wide)
    mixed = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(_MIX[(at & 63) << 8 | letters], out=mixed[1:])
    place = _begins(wide)
    name = mixed[place[1:]] - mixed[place[:-1]]
    again = np.zeros(len(start))
    again[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    echo = np.zeros(len(start))
    echo[2:] = (name[2:] == name[:-2]) & (doc[2:] == doc[:-2])

    shout = (upper >= 2) & (upper * 2 >= size - symbol)
    symbols, lengths = np.minimum(symbol, 3).astype(int), np.minimum(size // 4, 2).astype(int)
    shape = ((symbols * 3 + lengths) * 2 + shout) * 2 + (symbol == size)  # 48 shapes
    passage = begin[doc] + (np.arange(len(start)) - first_word[doc]) // PASSAGE_WORDS
    n = len(out)
    words = np.bincount(passage, minlength=n)
    full = np.maximum(words, 1)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, values, n) / full

    chars = np.maximum(np.bincount(passage, size, n), 1)
    out[:, 0] = np.bincount(passage, upper, n) / chars
    out[:, 1] = np.bincount(passage, symbol, n) / chars
    out[:, 2] = np.bincount(passage, digit, n) / chars
    out[:, 3], out[:, 4] = mean(again), mean(echo)
    out[:, 5], out[:, 6] = mean(size) / 10, mean(size * size) / 200
    out[:, 7], out[:, 8] = mean(symbol > 0), mean(shout)
    out[:, 9] = np.minimum(words / PASSAGE_WORDS, 1)
    tally = np.bincount(passage * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
    out[:, 10:] = tally / full[:, None]
    return out, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class GatedAttention:
    """The model; `fit` learns it, `score` applies it."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return rng.normal(0, (1 / shape[0]) ** 0.5, shape)

        self.prior: float | None = None
        self.mean, self.spread = np.zeros(width), np.ones(width)
        self.p = {
            "W": start(width, hidden), "b": np.zeros(hidden), "V": start(hidden, gate),
            "U": start(hidden, gate), "w": start(gate), "c": start(hidden), "d": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, begin[:-1]
        bag = np.repeat(np.arange(len(first)), np.diff(begin))
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "y": _sigmoid(z @ p["c"] + p["d"][0])}

    def _gradient(self, f: dict, label: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, bag, a, h = self.p, f["bag"], f["a"], f["h"]
        dy = (f["y"] - label) / len(label)
        dz = dy[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        dg = dh * (1 - h**2)
        return {
            "W": f["x"].T @ dg, "b": dg.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds,
            "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": np.array([dy.sum()]),
        }

    def fit(self, x: np.ndarray, begin: np.ndarray, label: np.ndarray, rounds: int = 40, batch: int = 256,
            rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> GatedAttention:
        """Adam over shuffled batches of documents."""
        if len(set(label.tolist())) < 2:
            self.prior = float(label.mean()) if len(label) else 0.5
            return self
        self.mean, self.spread = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 0.05
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for turn in range(rounds):
            order = rng.permutation(len(label))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                rows = np.concatenate([np.arange(begin[j], begin[j + 1]) for j in some])
                places = _begins([begin[j + 1] - begin[j] for j in some])
                grad = self._gradient(self._forward((x[rows] - self.mean) / self.spread, places), label[some], places[:-1])
                step += 1
                now = rate * (1 - turn / rounds)
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A score for each document."""
        if self.prior is not None:
            return np.full(len(begin) - 1, self.prior)
        return self._forward((x - self.mean) / self.spread, begin)["y"]


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample_docs: int = 6_000, sample_passages: int = 200_000,
) -> GatedAttention:
    """A model from a bounded sample of the labelled documents that aren't held out."""
    key = F.col(id_col)
    known = labels.where(key.isNotNull() & F.col(label_col).isNotNull() & ~held_out(key))
    some = known.groupBy(key.cast("long").alias("k")).agg(F.min(label_col).cast("double").alias("y"))
    texts = docs.select(key.cast("long").alias("k"), F.col(text_col).alias("t"))
    # the sample: keys with the smallest hashes among labelled keys, so at most sample_docs rows of keys
    picked = F.broadcast(some.orderBy(F.xxhash64("k"), "k").limit(sample_docs))

    bounded(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for of, some_texts in column_runs(batch.column(1), RUN_BYTES):
                x, begin = passages(some_texts)
                rows = [x[a:b].astype("<f4").tobytes() for a, b in zip(begin[:-1], begin[1:])]
                columns = [batch.column(0)[of], batch.column(2)[of], pa.array(np.diff(begin)), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "y", "n", "x"])

    rows = texts.join(picked, "k").select("k", "t", "y").mapInArrow(encode, "k long, y double, n long, x binary")
    held = scratch.table(rows, "sample")
    # a window over the sampled documents only, of which there are `sample_docs` at most
    order = [F.xxhash64("k"), F.col("k"), F.col("x")]
    before = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = held.orderBy(*order).limit(sample_docs).withColumn("before", before).where(F.col("before") < sample_passages)
    found = found.orderBy(*order).select("y", "x").collect()
    scratch.drop(held)
    bags = [np.frombuffer(r.x, "<f4").reshape(-1, WIDTH) for r in found]
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH), "<f4")
    return GatedAttention().fit(x, _begins([len(b) for b in bags]), np.array([r.y for r in found], float))


def score(docs: DataFrame, model: GatedAttention, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score: each row's other columns go along, one of the score's name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    bounded(docs.sparkSession)
    docs = docs.drop(score_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [shared.value.score(*passages(texts)) for _, texts in column_runs(batch.column(at), RUN_BYTES)]
            values = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **sample,
) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels, id_col, text_col, **sample)
    scored = score(docs.select(F.col(id_col), F.col(text_col)), model, text_col)
    return scored.select(
        F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
