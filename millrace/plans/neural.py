"""Small feed-forward networks: trained on the driver's samples, applied on the executors in batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

ACTIVATIONS = {
    "identity": (lambda x: x, lambda y: np.ones_like(y)),
    "relu": (lambda x: np.maximum(x, 0), lambda y: (y > 0).astype(float)),
    "sigmoid": (lambda x: 0.5 * (1 + np.tanh(x / 2)), lambda y: y * (1 - y)),
    "tanh": (np.tanh, lambda y: 1 - y * y),
}


def fill(shape: tuple[int, ...], kind: str, rng: np.random.Generator, value: float = 0.0) -> np.ndarray:
    """Initial weights: "const", "normal" or "xavier"."""
    if kind == "const":
        return np.full(shape, value)
    spread = 1.0 if kind == "normal" else np.sqrt(2.0 / (shape[0] + shape[-1]))
    return rng.normal(0, spread, shape)


@dataclass
class Dense:
    """A fully connected layer."""

    n: int
    activation: str = "relu"
    filler: str = "xavier"

    def start(self, width: tuple, rng: np.random.Generator) -> tuple:
        self.w, self.b = fill((int(np.prod(width)), self.n), self.filler, rng), np.zeros(self.n)
        return (self.n,)

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = x.reshape(len(x), -1)
        self.shape = x.shape
        self.y = ACTIVATIONS[self.activation][0](self.x @ self.w + self.b)
        return self.y

    def backward(self, d: np.ndarray) -> np.ndarray:
        d = d * ACTIVATIONS[self.activation][1](self.y)
        self.gw, self.gb = self.x.T @ d, d.sum(axis=0)
        return (d @ self.w.T).reshape(self.shape)


@dataclass
class Conv:
    """A convolution over (height, width, channels)."""

    n: int
    size: int = 3
    stride: int = 1
    pad: int = 0
    activation: str = "relu"

    def start(self, width: tuple, rng: np.random.Generator) -> tuple:
        h, w, c = width
        self.w, self.b = fill((self.size * self.size * c, self.n), "xavier", rng), np.zeros(self.n)
        return ((h + 2 * self.pad - self.size) // self.stride + 1, (w + 2 * self.pad - self.size) // self.stride + 1, self.n)

    def _patches(self, x: np.ndarray) -> np.ndarray:
        p = np.pad(x, ((0, 0), (self.pad, self.pad), (self.pad, self.pad), (0, 0)))
        v = np.lib.stride_tricks.sliding_window_view(p, (self.size, self.size), axis=(1, 2))[:, :: self.stride, :: self.stride]
        self.padded = p.shape
        return v.transpose(0, 1, 2, 4, 5, 3).reshape(*v.shape[:3], -1)

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = self._patches(x)
        self.y = ACTIVATIONS[self.activation][0](self.x @ self.w + self.b)
        return self.y

    def backward(self, d: np.ndarray) -> np.ndarray:
        d = d * ACTIVATIONS[self.activation][1](self.y)
        self.gw = np.tensordot(self.x, d, axes=([0, 1, 2], [0, 1, 2]))
        self.gb = d.sum(axis=(0, 1, 2))
        back = (d @ self.w.T).reshape(*d.shape[:3], self.size, self.size, -1)
        out = np.zeros(self.padded)
        for i in range(self.size):
            for j in range(self.size):
                out[:, i : i + self.stride * d.shape[1] : self.stride, j : j + self.stride * d.shape[2] : self.stride] += back[:, :, :, i, j]
        return out[:, self.pad : out.shape[1] - self.pad, self.pad : out.shape[2] - self.pad]


@dataclass
class Pool:
    """The maximum of squares."""

    size: int = 3

    def start(self, width: tuple, rng: np.random.Generator) -> tuple:
        return (width[0] // self.size, width[1] // self.size, width[2])

    def forward(self, x: np.ndarray) -> np.ndarray:
        n, h, w, c = x.shape
        self.shape, k = x.shape, self.size
        v = x[:, : h // k * k, : w // k * k].reshape(n, h // k, k, w // k, k, c)
        y = v.max(axis=(2, 4))
        self.mask = v == y[:, :, None, :, None]
        return y

    def backward(self, d: np.ndarray) -> np.ndarray:
        n, h, w, c = self.shape
        k, out = self.size, np.zeros(self.shape)
        share = self.mask / np.maximum(self.mask.sum(axis=(2, 4), keepdims=True), 1)
        out[:, : h // k * k, : w // k * k] = (share * d[:, :, None, :, None]).reshape(n, h // k * k, w // k * k, c)
        return out


@dataclass
class Network:
    """Layers in sequence, trained on squares."""

    layers: list
    width: tuple
    seed: int = 1
    history: list[float] = field(default_factory=list)

    def __post_init__(self):
        rng, width = np.random.default_rng(self.seed), self.width
        for layer in self.layers:
            width = layer.start(width, rng)

    def apply(self, x: np.ndarray) -> np.ndarray:
        y = x.reshape(len(x), *self.width)
        for layer in self.layers:
            y = layer.forward(y)
        return y

    def gradient(self, x: np.ndarray, y: np.ndarray) -> float:
        out = self.apply(x)
        d = 2 * (out - y) / len(x)
        for layer in reversed(self.layers):
            d = layer.backward(d)
        return float(((out - y) ** 2).sum() / len(x))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 100, rate: float = 0.05) -> Network:
        for _ in range(rounds):
            self.history.append(self.gradient(x, y))
            for layer in self.layers:
                if hasattr(layer, "gw"):
                    layer.w -= rate * layer.gw
                    layer.b -= rate * layer.gb
        return self

    def weights(self) -> np.ndarray:
        """All weights as one vector."""
        return np.concatenate([p.ravel() for layer in self.layers if hasattr(layer, "w") for p in (layer.w, layer.b)])


def predict(df: DataFrame, network: Network, features: str = "features", out: str = "output") -> DataFrame:
    """`df` with the network's outputs; weights are broadcast (they don't grow with rows)."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = shared.value.apply(np.array(pdf[features].tolist(), float)) if len(pdf) else np.zeros((0, 1))
            yield pdf.assign(**{out: y.reshape(len(pdf), -1).tolist()})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))


class Lstm:
    """One LSTM cell along a sequence."""

    def __init__(self, width: int, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.n, self.w, self.b = n, rng.normal(0, 0.2, (width + n, 4 * n)), np.zeros(4 * n)

    def run(self, x: np.ndarray) -> np.ndarray:
        """States h of each step."""
        h, c, out, n = np.zeros(self.n), np.zeros(self.n), [], self.n
        for v in x:
            z = np.concatenate([v, h]) @ self.w + self.b
            i, f, o = (0.5 * (1 + np.tanh(z[k * n : (k + 1) * n] / 2)) for k in range(3))
            c = f * c + i * np.tanh(z[3 * n :])
            h = o * np.tanh(c)
            out.append(h)
        return np.array(out)
