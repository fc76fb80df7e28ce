"""Edit distances with costs of their own, for short strings such as product names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

#: Costs of a change of case, of one digit for another, of any other change.
CASE, DIGIT, CHANGE = 0.0, 0.5, 10.0
#: Costs of an insertion and of a deletion, and of either where the character is no letter or digit.
INSERT, DELETE, MARK = 0.9, 10.0, 0.2

_LETTER, _DIGIT, _OTHER, _NONE = 0, 1, 2, 3


def _kinds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code's upper case, and whether it is a letter, a digit, another character, or none (-1)."""
    found, at = np.unique(codes, return_inverse=True)
    upper, kind = found.copy(), np.full(len(found), _NONE, np.int8)
    for i, code in enumerate(found.tolist()):
        if code >= 0:
            c = chr(code)
            u = c.upper()
            upper[i] = ord(u) if len(u) == 1 else code
            kind[i] = _DIGIT if c.isdecimal() else _LETTER if c.isalpha() else _OTHER
    return upper[at].reshape(codes.shape), kind[at].reshape(codes.shape)


def _codes(texts: list[str]) -> np.ndarray:
    wide = max(map(len, texts), default=0)
    out = np.full((len(texts), wide), -1, np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def edit_costs(sources: list[str], targets: list[str]) -> np.ndarray:
    """The least cost of turning each source into its target.

    A step takes the next character of all sources at once.  A run of
    insertions costs a difference of sums, so the best one into every place is
    a running minimum.
    """
    a, b = _codes(sources), _codes(targets)
    n, m = np.array([len(t) for t in sources], np.int64), np.array([len(t) for t in targets], np.int64)
    (a_up, a_kind), (b_up, b_kind) = _kinds(a), _kinds(b)
    into = np.zeros((len(targets), b.shape[1] + 1))
    np.cumsum(np.where(b_kind == _OTHER, MARK, INSERT), axis=1, out=into[:, 1:])
    row, rows = into.copy(), np.arange(len(sources))
    out = row[rows, m]
    for i in range(a.shape[1]):
        off = np.where(a_kind[:, i] == _OTHER, MARK, DELETE)[:, None]
        digits = (a_kind[:, i] == _DIGIT)[:, None] & (b_kind == _DIGIT)
        change = np.where(a[:, i, None] == b, 0.0, np.where(a_up[:, i, None] == b_up, CASE, np.where(digits, DIGIT, CHANGE)))
        best = row + off
        best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + change)
        row = into + np.minimum.accumulate(best - into, axis=1)
        done = n == i + 1
        out[done] = row[done, m[done]]
    return out


def edit_cost(source: str, target: str) -> float:
    """The least cost of turning one string into another."""
    return float(edit_costs([source], [target])[0])


def with_edit_cost(pairs: DataFrame, source: str, target: str, out: str = "cost", cells: int = 1 << 20) -> DataFrame:
    """`pairs` with the cost of each pair; null where either string is null.

    Pairs of an Arrow batch go together, shorter targets first, as many as have about `cells` places in a table.
    """
    names = pairs.columns
    at = names.index(source), names.index(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in at)
            known = sorted((i for i in range(len(a)) if a[i] is not None and b[i] is not None), key=lambda i: (len(b[i]), len(a[i])))
            costs: list[float | None] = [None] * len(a)
            first = 0
            while first < len(known):
                stop = first + 1
                while stop < len(known) and (stop - first + 1) * (len(b[known[stop]]) + 1) <= cells:
                    stop += 1
                some = known[first:stop]
                for i, cost in zip(some, edit_costs([a[i] for i in some], [b[i] for i in some]).tolist()):
                    costs[i] = cost
                first = stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.float64())], [*names, out])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField(out, DoubleType())]))
