"""The scheme language: Name(key=value, other=Nested(...)) names a learner and its parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from millrace.operators.grid import Grid
from millrace.plans import ensembles, linear, trees

_TOKEN = re.compile(r"\s*(?:([A-Za-z_][\w.]*)|(-?\d+\.?\d*(?:[eE][+-]?\d+)?)|'([^']*)'|\"([^\"]*)\"|([(),=]))")


@dataclass
class Call:
    """A name with parameters."""

    name: str
    parameters: dict[str, Any] = field(default_factory=dict)


def parse(text: str) -> Call:
    """The call that a scheme spells."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {text[at:at + 20]!r}")
        tokens.append((m.lastindex, m.group(m.lastindex)))
        at = m.end()
    place = 0

    def peek() -> tuple:
        return tokens[place] if place < len(tokens) else (0, "")

    def take(expected: str | None = None) -> tuple:
        nonlocal place
        kind, value = peek()
        if not kind or (expected and value != expected):
            raise ValueError(f"expected {expected or 'a value'}, found {value!r}")
        place += 1
        return kind, value

    def value() -> Any:
        kind, word = take()
        if kind == 2:
            return float(word) if re.search(r"[.eE]", word) else int(word)
        if kind in (3, 4):
            return word
        if kind != 1:
            raise ValueError(f"unexpected {word!r}")
        if word.lower() in ("true", "false"):
            return word.lower() == "true"
        if peek() == (5, "("):
            return call(word)
        return word

    def call(name: str) -> Call:
        out = Call(name)
        take("(")
        while peek() != (5, ")"):
            _, key = take()
            take("=")
            out.parameters[key] = value()
            if peek() == (5, ","):
                take(",")
        take(")")
        return out

    kind, name = take()
    if kind != 1:
        raise ValueError("a scheme begins with a name")
    result = call(name) if peek() == (5, "(") else Call(name)
    if place != len(tokens):
        raise ValueError(f"unexpected {tokens[place][1]!r}")
    return result


def target_spec(text: str) -> tuple[str, str | None]:
    """Loss and target column of "Loss" or "Loss(target)"."""
    m = re.fullmatch(r"\s*([\w-]+)\s*(?:\(\s*([^()]+?)\s*\))?\s*", text)
    if not m:
        raise ValueError(f"not a target: {text!r}")
    return m[1], m[2]


@dataclass
class Context:
    """What learners need beside their parameters."""

    grid: Grid
    width: int
    key: str = "row_id"


def build(scheme: str | Call, context: Context) -> Any:
    """The learner of a scheme."""
    call = parse(scheme) if isinstance(scheme, str) else scheme
    if call.name not in LEARNERS:
        raise KeyError(f"no learner {call.name!r}; there are {sorted(LEARNERS)}")
    built = {k: build(v, context) if isinstance(v, Call) and v.name in LEARNERS else v for k, v in call.parameters.items()}
    return LEARNERS[call.name](context, **built)


def _name(v: Any, default: str) -> str:
    return v.name if isinstance(v, Call) else v or default


def _tree(c: Context, depth: int = 6, loss: Any = None, **more: Any):
    return trees.ObliviousTreeLearner(c.grid, depth, _name(loss, "SatL2"), **more)


def _boosting(c: Context, weak: Any = None, local: Any = None, step: float = 0.005, iterations: int = 200, loss: str = "L2"):
    weak = weak or _tree(c, loss=local)
    if local is not None and hasattr(weak, "criterion"):
        weak.criterion = _name(local, weak.criterion)
    return ensembles.Boosting(weak, loss, iterations, step)


LEARNERS = {
    "GreedyObliviousTree": _tree,
    "RegGreedyObliviousTree": lambda c, depth=6, lambda_=0.1, **k: _tree(c, depth, known_penalty=k.get("lambda", lambda_)),
    "RidgeRegressionLeavesObliviousTree": lambda c, depth=6, ridge=1.0: _tree(c, depth, linear_leaves=True, ridge=ridge),
    "GreedyTDRegion": lambda c, depth=6, failures=0: trees.RegionLearner(c.grid, depth, failures=failures),
    "GreedyTDBumpyRegion": lambda c, depth=6: trees.RegionLearner(c.grid, depth, nested=True),
    "GreedyTDCherryRegion": lambda c, clauses=4, rate=0.1: trees.CnfLearner(c.grid, clauses, rate),
    "GradientBoosting": _boosting,
    "RandomForest": lambda c, weak=None, count=10: ensembles.Bagging(weak or _tree(c), count, c.key),
    "RegionForest": lambda c, weak=None, count=10: ensembles.Bagging(weak or trees.RegionLearner(c.grid), count, c.key),
    "LassoGradientBoosting": lambda c, weak=None, iterations=20, penalty=1e-3: ensembles.LassoBoosting(weak or _tree(c), iterations, penalty),
    "Bootstrap": lambda c, weak=None: ensembles.Bagging(weak or _tree(c), 1, c.key),
    "RidgeRegression": lambda c, alpha=1.0: linear.Ridge(c.width, alpha),
    "ElasticNet": lambda c, penalty=0.01, mix=0.5, steps=20: linear.ElasticNet(c.width, penalty, mix, steps),
    "LASSO": lambda c, steps=1000, step=0.01: linear.Stagewise(c.width, steps, step),
    "LARS": lambda c, steps=None: linear.LeastAngle(c.width, steps),
    "WeakLeastAngle": lambda c: linear.BestSingle(c.width),
    "RVM": lambda c, rounds=200: linear.RelevanceVectors(c.width, rounds),
}
#: The scheme of the command line where none is given.
DEFAULT = "GradientBoosting(local=SatL2, weak=GreedyObliviousTree(depth=6), step=0.02, iterations=1000)"
