"""Click models: a random walk over a session's blocks, with linear edge features.

A session is a group of (position, type, grade, clicked).  Its walk starts at
Q, moves between neighbouring results, and ends at E; the attractiveness of an
edge is exp(theta phi).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES, GRADES, POSITIONS = 6, 6, 10
FEATURES = TYPES + GRADES + 2 + 2 * POSITIONS + 4


def edge_features(types: np.ndarray, grades: np.ndarray, source: int, to: int, clicked: bool) -> np.ndarray:
    """Features of the edge between two nodes: -1 is the start, n the end."""
    n, out = len(types), np.zeros(FEATURES)
    if 0 <= to < n:
        out[int(types[to]) % TYPES] = 1
        out[TYPES + int(grades[to]) % GRADES] = 1
        if source >= 0:
            out[TYPES + GRADES + (0 if to > source else 1)] = 1
        else:
            out[TYPES + GRADES + 2 + min(to, POSITIONS - 1)] = 1
    elif to == n:
        out[TYPES + GRADES + 2 + 2 * POSITIONS + (0 if clicked else 1)] = 1
        if source >= 0:
            out[TYPES + GRADES + 2 + POSITIONS + min(source, POSITIONS - 1)] = 1
    return out


def transitions(types: np.ndarray, grades: np.ndarray, clicked: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Moves between nodes 0 (start), 1..n (results), n + 1 (end, absorbing)."""
    n = len(types)
    m = np.zeros((n + 2, n + 2))
    for s in range(-1, n):
        targets = range(n) if s < 0 else [t for t in (s - 1, s + 1) if 0 <= t < n]
        targets = [*targets, n]
        was = bool(clicked[s]) if s >= 0 else False
        w = np.array([np.exp(np.clip(theta @ edge_features(types, grades, s, t, was), -30, 30)) for t in targets])
        for t, v in zip(targets, w / w.sum()):
            m[s + 1, t + 1] = v
    m[n + 1, n + 1] = 1.0
    return m


def attention(moves: np.ndarray, steps: int = 15) -> np.ndarray:
    """Expected visits of each result in so many steps from the start."""
    at, seen = np.zeros(len(moves)), np.zeros(len(moves))
    at[0] = 1.0
    for _ in range(steps):
        at = at @ moves
        seen += at
    return seen[1:-1]


def walk(df: DataFrame, session: str, theta: np.ndarray, click_rate: dict[int, float], default: float = 0.1) -> DataFrame:
    """(session, position, view, click): expected attention, and it times the grade's click rate.

    A session's results are one small group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        types, grades, clicked = (pdf[c].to_numpy() for c in ("type", "grade", "clicked"))
        seen = attention(transitions(types, grades, clicked, theta))
        rate = np.array([click_rate.get(int(g), default) for g in grades])
        return pd.DataFrame({session: pdf[session], "position": pdf["position"], "view": seen, "click": np.minimum(seen * rate, 1.0)})

    kind = df.schema[session].dataType.simpleString()
    cols = [session, F.col("position").cast("int"), F.col("type").cast("int"), F.col("grade").cast("int"), F.col("clicked").cast("boolean")]
    return df.select(*cols).groupBy(session).applyInPandas(run, f"{session} {kind}, position int, view double, click double")


def routes(moves: np.ndarray, start: int, end: int, mass: float = 0.999, least: float = 1e-6) -> list[tuple[float, list[int]]]:
    """Routes of a Markov chain from start to end by falling probability, until they make up `mass`."""
    import heapq

    queue, found, total = [(-1.0, [start])], [], 0.0
    while queue and total < mass:
        p, path = heapq.heappop(queue)
        if -p < least:
            break
        if path[-1] == end:
            found.append((-p, path))
            total += -p
            continue
        for t in np.flatnonzero(moves[path[-1]]):
            heapq.heappush(queue, (p * moves[path[-1], t], [*path, int(t)]))
    return found


def learn_chain(observations: list[list[int]], allowed: np.ndarray, end: int, rounds: int = 10, prior: float = 1.0) -> np.ndarray:
    """A chain from routes seen in part (some nodes, in order) by EM: each is filled by its most probable route."""
    m = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        counts, known = prior * (allowed > 0).astype(float), {}
        for seen in observations:
            key = tuple(seen)
            if key not in known:
                fits = [r for r in routes(m, seen[0], end) if _subsequence(seen, r[1])]
                known[key] = fits[0][1] if fits else None
            path = known[key]
            for a, b in zip(path or [], (path or [])[1:]):
                counts[a, b] += 1
        new = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-12)
        if np.allclose(new, m, atol=1e-9):
            break
        m = new
    return m


def _subsequence(short: list[int], long: list[int]) -> bool:
    it = iter(long)
    return all(x in it for x in short)
