"""Sequences: automata as folds, hidden Markov models, probabilistic automata."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_dfa(seq: Column, table: Sequence[Sequence[int]], start: int = 0) -> Column:
    """Final state of a deterministic automaton; `table[state][symbol]`, -1 for no transition (stays lost)."""
    symbols = len(table[0])
    flat = F.array(*[F.lit(int(s)) for row in table for s in row])
    return F.aggregate(
        seq, F.lit(start),
        lambda s, c: F.when((s < 0) | (c < 0) | (c >= symbols), -1).otherwise(F.element_at(flat, F.greatest(s * symbols + c, F.lit(0)).cast("int") + 1)),
    )


def state_cost(df: DataFrame, seq: str, y: str, table: Sequence[Sequence[int]]) -> DataFrame:
    """(state, n, mean, cost) of the sequences that end in each state; cost is the sum of squared deviations."""
    ended = df.withColumn("state", run_dfa(F.col(seq), table))
    by = ended.groupBy("state").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("s2"))
    return by.select("state", "n", "mean", (F.col("s2") - F.col("s") * F.col("s") / F.col("n")).alias("cost"))


def learn_dfa(df: DataFrame, seq: str, y: str, symbols: int, states: int = 4, rounds: int = 20) -> tuple[list[list[int]], dict[int, float]]:
    """An automaton grown by single edits (another target, a new state) while the cost falls.

    Each round evaluates all edits in one aggregation a candidate set; the
    driver sees the candidates' costs.
    """
    table = [[0] * symbols]
    cost = _costs(df, seq, y, [table])[0]
    for _ in range(rounds):
        edits = []
        for s in range(len(table)):
            for c in range(symbols):
                targets = [t for t in range(len(table)) if t != table[s][c]]
                if len(table) < states:
                    targets.append(len(table))
                for t in targets:
                    new = [list(r) for r in table] + ([list(table[table[s][c]])] if t == len(table) else [])
                    new[s][c] = t
                    edits.append(new)
        if not edits:
            break
        costs = _costs(df, seq, y, edits)
        best = int(np.argmin(costs))
        if costs[best] >= cost - 1e-9:
            break
        table, cost = edits[best], costs[best]
    values = {r.state: r["mean"] for r in state_cost(df, seq, y, table).collect()}
    return table, values


def _costs(df: DataFrame, seq: str, y: str, tables: list) -> list[float]:
    ends = F.array(*[run_dfa(F.col(seq), t) for t in tables])
    long = df.select(F.posexplode(ends).alias("k", "state"), y)
    by = long.groupBy("k", "state").agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("s2"))
    found = by.groupBy("k").agg(F.sum(F.col("s2") - F.col("s") * F.col("s") / F.col("n")).alias("cost")).collect()
    cost = {r.k: r.cost for r in found}
    return [cost.get(k, 0.0) for k in range(len(tables))]


def forward_backward(seq: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Scaled posteriors of states and of moves, and the log-likelihood."""
    n, k = len(seq), len(start)
    a, scale = np.zeros((n, k)), np.zeros(n)
    for t in range(n):
        a[t] = (start if t == 0 else a[t - 1] @ move) * emit[:, seq[t]]
        scale[t] = max(a[t].sum(), 1e-300)
        a[t] /= scale[t]
    b = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        b[t] = move @ (emit[:, seq[t + 1]] * b[t + 1]) / scale[t + 1]
    moves = np.zeros((k, k))
    for t in range(n - 1):
        moves += np.outer(a[t], emit[:, seq[t + 1]] * b[t + 1]) * move / scale[t + 1]
    return a * b, moves, float(np.log(scale).sum())


def baum_welch(df: DataFrame, key: str, seq: str, states: int, symbols: int, rounds: int = 10, seed: int = 1):
    """(start, move, emit, log-likelihood by round) of a hidden Markov model by EM.

    The E-step runs on the executors, a batch of sequences at a time; what
    comes back are sums of states and symbols.  Negative symbols are left out.
    """
    rng = np.random.default_rng(seed)
    start = rng.dirichlet(np.ones(states))
    move, emit = rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states)
    rows, history = df.select(F.filter(seq, lambda c: c >= 0).alias("s")).where(F.size("s") > 0), []
    for _ in range(rounds):
        model = (start, move, emit)

        def expect(batches, model=model):
            s, m, e, ll = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols)), 0.0
            for pdf in batches:
                for x in pdf["s"]:
                    x = np.asarray(x, int)
                    post, moves, value = forward_backward(x, *model)
                    s, m, ll = s + post[0], m + moves, ll + value
                    np.add.at(e.T, x, post)
            yield pd.DataFrame({"i": range(states), "s": s, "m": m.tolist(), "e": e.tolist(), "ll": [ll] + [0.0] * (states - 1)})

        found = rows.mapInPandas(expect, "i int, s double, m array<double>, e array<double>, ll double").collect()  # states a task
        s, m, e, ll = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols)), 0.0
        for r in found:
            s[r.i] += r.s
            m[r.i] += r.m
            e[r.i] += r.e
            ll += r.ll
        start, move, emit = (np.maximum(x, 1e-12) / np.maximum(x, 1e-12).sum(axis=-1, keepdims=True) for x in (s, m, e))
        history.append(ll)
    return start, move, emit, history


def ngram_transitions(df: DataFrame, seq: str) -> DataFrame:
    """(a, b, n): counts of neighbours in sequences."""
    pairs = F.transform(F.slice(seq, F.lit(1), F.greatest(F.size(seq) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.element_at(seq, i + 2).alias("b")))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def pnfa_state(seq: np.ndarray, w: np.ndarray) -> np.ndarray:
    """States of a probabilistic automaton along a sequence, from uniform: s <- W[c] s."""
    states = [np.full(w.shape[1], 1.0 / w.shape[1])]
    for c in seq:
        states.append(w[c] @ states[-1])
    return np.array(states)


def fit_pnfa(seqs: list, y: np.ndarray, states: int, symbols: int, rounds: int = 200, rate: float = 0.1, seed: int = 1):
    """(W, V): column-stochastic moves (softmax of parameters) and output weights by gradient descent on squares."""
    rng = np.random.default_rng(seed)
    beta, v, history = rng.normal(0, 1, (symbols, states, states)), rng.normal(0, 0.1, states), []
    for _ in range(rounds):
        e = np.exp(beta - beta.max(axis=1, keepdims=True))
        w = e / e.sum(axis=1, keepdims=True)
        gw, gv, loss = np.zeros_like(w), np.zeros_like(v), 0.0
        for s, t in zip(seqs, y):
            path = pnfa_state(s, w)
            error = v @ path[-1] - t
            loss += error * error
            gv += 2 * error * path[-1]
            back = 2 * error * v
            for i in range(len(s) - 1, -1, -1):
                gw[s[i]] += np.outer(back, path[i])
                back = w[s[i]].T @ back
        beta -= rate / len(seqs) * w * (gw - (gw * w).sum(axis=1, keepdims=True))
        v -= rate / len(seqs) * gv
        history.append(loss / len(seqs))
    return w, v, history
