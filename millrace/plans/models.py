"""Trained models as column expressions, with a JSON form.

Every model has `column(x)`: the prediction from a feature vector `x`
(`array<double>`).  So scoring is a projection that Catalyst compiles with the
rest of the plan.  `to_json` / `from_json` keep models as text.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import vectors as V

REGISTRY: dict[str, type] = {}


def feature(x: Column, i: int) -> Column:
    """Component i of a vector, from 0."""
    return F.element_at(x, i + 1)


class Model:
    """Base of all models."""

    kind: ClassVar[str] = ""

    def __init_subclass__(cls, **kw: Any):
        super().__init_subclass__(**kw)
        cls.kind = cls.__name__
        REGISTRY[cls.__name__] = cls

    def column(self, x: Column) -> Column:
        raise NotImplementedError

    def to_dict(self) -> dict:
        return {"kind": self.kind, **{k: _plain(v) for k, v in self.__dict__.items()}}


def _plain(v: Any) -> Any:
    if isinstance(v, Model):
        return v.to_dict()
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [_plain(x) for x in v]
    return v.item() if hasattr(v, "item") else v


def _load(v: Any) -> Any:
    if isinstance(v, dict) and "kind" in v:
        return REGISTRY[v["kind"]](**{k: _load(x) for k, x in v.items() if k != "kind"})
    if isinstance(v, dict):
        return {k: _load(x) for k, x in v.items()}
    return [_load(x) for x in v] if isinstance(v, list) else v


def to_json(model: Model, features: list[dict] | None = None) -> str:
    """A model, and what is known of its features, as text."""
    return json.dumps({"format": "millrace model 1", "features": features or [], "model": model.to_dict()})


def from_json(text: str) -> tuple[Model, list[dict]]:
    """The inverse of `to_json`."""
    spec = json.loads(text)
    if spec.get("format") != "millrace model 1":
        raise ValueError("not a model of this format")
    return _load(spec["model"]), spec["features"]


def validate(text: str) -> tuple[bool, str]:
    """Whether a text is a model, and why not."""
    try:
        from_json(text)
    except (ValueError, KeyError, TypeError) as e:
        return False, f"{type(e).__name__}: {e}"
    return True, ""


@dataclass
class Constant(Model):
    value: float

    def column(self, x: Column) -> Column:
        return F.lit(float(self.value))


@dataclass
class Linear(Model):
    """weights x + bias."""

    weights: list[float]
    bias: float = 0.0

    def column(self, x: Column) -> Column:
        used = [(i, w) for i, w in enumerate(self.weights) if w]
        return reduce(lambda a, iw: a + F.lit(float(iw[1])) * feature(x, iw[0]), used, F.lit(float(self.bias)))


@dataclass
class Single(Model):
    """weight x_i + bias, of one feature."""

    index: int
    weight: float
    bias: float = 0.0

    def column(self, x: Column) -> Column:
        return feature(x, self.index) * float(self.weight) + float(self.bias)


@dataclass
class Quadratic(Model):
    """Sum over j <= i of values[i (i + 1) / 2 + j] x_i x_j, with x_0 = 1 before the features."""

    values: list[float]
    features: list[int]

    def column(self, x: Column) -> Column:
        parts = [F.lit(1.0), *[feature(x, f) for f in self.features]]
        out = F.lit(0.0)
        for i in range(len(parts)):
            for j in range(i + 1):
                v = self.values[i * (i + 1) // 2 + j]
                if v:
                    out = out + F.lit(float(v)) * parts[i] * parts[j]
        return out


@dataclass
class ObliviousTree(Model):
    """One condition a level, (feature, border): is the value above it?  The first level is the highest bit of the leaf.

    `values` holds a number a leaf, `models` (if any) a model a leaf instead.
    """

    conditions: list[tuple[int, float]]
    values: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    models: list[Model] = field(default_factory=list)

    def leaf(self, x: Column) -> Column:
        n = len(self.conditions)
        bits = [F.when(above(feature(x, f), b), 1 << n - 1 - k).otherwise(0) for k, (f, b) in enumerate(self.conditions)]
        return reduce(lambda a, b: a + b, bits, F.lit(0))

    def column(self, x: Column) -> Column:
        if self.models:
            at = self.leaf(x)
            out = F.lit(0.0)
            for i, m in enumerate(self.models):
                out = F.when(at == i, m.column(x)).otherwise(out)
            return out
        return F.element_at(V.weights(self.values), self.leaf(x) + 1)


def above(value: Column, border: float) -> Column:
    """Whether a value is above a border; not-a-number isn't."""
    return (value > F.lit(float(border))) & ~F.isnan(value)


@dataclass
class VectorTree(Model):
    """An oblivious tree with a vector in each leaf."""

    conditions: list[tuple[int, float]]
    values: list[list[float]]

    def column(self, x: Column) -> Column:
        leaf = ObliviousTree(self.conditions).leaf(x)
        return F.element_at(F.array(*[V.weights(v) for v in self.values]), leaf + 1)


@dataclass
class Region(Model):
    """`inside` where at most `failures` conditions fail, else `outside`.

    A condition is (feature, border, above): is the value above the border, or not?
    """

    conditions: list[tuple[int, float, bool]]
    inside: float
    outside: float = 0.0
    failures: int = 0

    def contains(self, x: Column) -> Column:
        failed = [F.when(above(feature(x, f), b) == F.lit(bool(up)), 0).otherwise(1) for f, b, up in self.conditions]
        return reduce(lambda a, b: a + b, failed, F.lit(0)) <= self.failures

    def column(self, x: Column) -> Column:
        return F.when(self.contains(x), float(self.inside)).otherwise(float(self.outside))


@dataclass
class Cnf(Model):
    """A conjunction of clauses; a clause is a disjunction of (feature, its borders, bins that hold)."""

    clauses: list[list[tuple[int, list[float], list[int]]]]
    inside: float
    outside: float = 0.0

    def contains(self, x: Column) -> Column:
        held = []
        for clause in self.clauses:
            either = [V.bin_of(feature(x, f), borders).isin(list(bins)) for f, borders, bins in clause]
            held.append(reduce(lambda a, b: a | b, either, F.lit(False)))
        return reduce(lambda a, b: a & b, held, F.lit(True))

    def column(self, x: Column) -> Column:
        return F.when(self.contains(x), float(self.inside)).otherwise(float(self.outside))


@dataclass
class Bumpy(Model):
    """The increments of the leading conditions that hold, added up until the first fails."""

    conditions: list[tuple[int, float, bool]]
    values: list[float]
    bias: float = 0.0

    def column(self, x: Column) -> Column:
        out = F.lit(0.0)
        for (f, b, up), v in reversed(list(zip(self.conditions, self.values))):
            out = F.when(above(feature(x, f), b) == F.lit(bool(up)), out + float(v)).otherwise(0.0)
        return out + float(self.bias)


@dataclass
class PolynomialRegion(Model):
    """A quadratic polynomial inside a region, 0 outside."""

    region: Region
    polynomial: Quadratic

    def column(self, x: Column) -> Column:
        return F.when(self.region.contains(x), self.polynomial.column(x)).otherwise(0.0)


@dataclass
class ExponentialTree(Model):
    """Quadratic leaves, mixed with weights e^-(rate d), d the squared distance past the borders that keep x out."""

    conditions: list[tuple[int, float]]
    leaves: list[Quadratic]
    rate: float = 1.0

    def column(self, x: Column) -> Column:
        n, top, down = len(self.conditions), F.lit(0.0), F.lit(0.0)
        for i, leaf in enumerate(self.leaves):
            gone = F.lit(0.0)
            for k, (f, b) in enumerate(self.conditions):
                inside, v = bool(i >> n - 1 - k & 1), feature(x, f) - float(b)
                miss = F.least(v, F.lit(0.0)) if inside else F.greatest(v, F.lit(0.0))
                gone = gone + miss * miss
            w = F.exp(-self.rate * gone)
            top, down = top + w * leaf.column(x), down + w
        return top / down


@dataclass
class Ensemble(Model):
    """A weighted sum of models, scalars or vectors."""

    models: list[Model]
    weights: list[float]
    bias: float = 0.0

    def column(self, x: Column) -> Column:
        parts = [m.column(x) * float(w) for m, w in zip(self.models, self.weights)]
        return reduce(lambda a, b: a + b, parts, F.lit(float(self.bias)))


@dataclass
class Shifted(Model):
    """f(x) + shift."""

    model: Model
    shift: float

    def column(self, x: Column) -> Column:
        return self.model.column(x) + float(self.shift)


@dataclass
class Scaled(Model):
    """A scalar model times a vector."""

    model: Model
    vector: list[float]

    def column(self, x: Column) -> Column:
        return V.scaled(self.model.column(x), self.vector)


@dataclass
class Join(Model):
    """Scalar models as one vector."""

    models: list[Model]

    def column(self, x: Column) -> Column:
        return F.array(*[m.column(x) for m in self.models])


@dataclass
class Concat(Model):
    """Vector models, concatenated."""

    models: list[Model]

    def column(self, x: Column) -> Column:
        return F.concat(*[m.column(x) for m in self.models])


@dataclass
class VectorSum(Model):
    """A weighted sum of vector models of one width."""

    models: list[Model]
    weights: list[float]

    def column(self, x: Column) -> Column:
        parts = [_times(m.column(x), w) for m, w in zip(self.models, self.weights)]
        return reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p + q), parts)


def _times(x: Column, w: float) -> Column:
    return F.transform(x, lambda v: v * float(w))


@dataclass
class Machine(Model):
    """A factorisation machine."""

    w0: float
    w: list[float]
    v: list[list[float]]

    def column(self, x: Column) -> Column:
        return V.factorization_machine(x, self.w0, self.w, self.v)


@dataclass
class MultiClass(Model):
    """Classes from logits of all but the last class; `column` is the class, -1 never."""

    logits: Model

    def probabilities(self, x: Column) -> Column:
        return V.reference_probabilities(self.logits.column(x))

    def column(self, x: Column) -> Column:
        return V.reference_class(self.logits.column(x), strict=True)


@dataclass
class OneVsRest(Model):
    """Classes by the largest raw score."""

    scores: Join

    def probabilities(self, x: Column) -> Column:
        return F.transform(self.scores.column(x), V.sigmoid)

    def column(self, x: Column) -> Column:
        return V.argmax(self.scores.column(x))


@dataclass
class CodingMatrix(Model):
    """Classes by the code word nearest to the signs of the scores; codes near 0 are ignored."""

    codes: list[list[float]]
    scores: Join
    ignore: float = 0.1

    def column(self, x: Column) -> Column:
        s = F.transform(self.scores.column(x), lambda v: F.when(v > 0, 1.0).otherwise(-1.0))
        misses = []
        for code in self.codes:
            weight = V.weights([0.0 if abs(c) <= self.ignore else (1.0 if c > 0 else -1.0) for c in code])
            misses.append(V.total(F.zip_with(s, weight, lambda a, b: F.when(b != 0, (1 - a * b) / 2).otherwise(0.0))))
        d = F.array(*misses)
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")


@dataclass
class Hierarchy(Model):
    """A class of the tree's leaves: each node's model says which child is next; labels are leaves' classes."""

    model: Model
    children: list[Model]

    def column(self, x: Column) -> Column:
        at, out = self.model.column(x).cast("int"), F.lit(None).cast("int")
        for i, child in enumerate(self.children):
            out = F.when(at == i, child.column(x).cast("int")).otherwise(out)
        return out


@dataclass
class MultiLabel(Model):
    """A label where its score is above a threshold."""

    scores: Model
    threshold: float = 0.0

    def column(self, x: Column) -> Column:
        return F.transform(self.scores.column(x), lambda v: F.when(v > self.threshold, 1).otherwise(0))


@dataclass
class LabelSets(Model):
    """Label vectors of the classes of a multiclass model."""

    model: Model
    sets: list[list[int]]

    def column(self, x: Column) -> Column:
        table = F.array(*[F.array(*[F.lit(int(v)) for v in s]) for s in self.sets])
        return F.element_at(table, self.model.column(x).cast("int") + 1)


@dataclass
class ThresholdLabels(Model):
    """Labels whose probability reaches a threshold; none where the class of no labels, the last, wins."""

    model: MultiClass
    threshold: float = 0.5
    empty_class: bool = False

    def column(self, x: Column) -> Column:
        p = self.model.probabilities(x)
        labels = F.slice(p, F.lit(1), F.size(p) - 1) if self.empty_class else p
        found = F.transform(labels, lambda v: F.when(v >= self.threshold, 1).otherwise(0))
        if not self.empty_class:
            return found
        return F.when(V.argmax(p) == F.size(p) - 1, F.transform(labels, lambda v: F.lit(0))).otherwise(found)


def compiled(ensemble: Ensemble) -> list[tuple[tuple[tuple[int, float], ...], float]]:
    """An ensemble of oblivious trees as a sum of rules: (conditions that all hold, weight).

    A tree is a function of its bits; inclusion and exclusion over the subsets
    of conditions gives each subset's weight.  Conditions on one feature in a
    rule come down to the highest border, equal rules add up.
    """
    rules: dict[tuple, float] = {}
    for tree, w in zip(ensemble.models, ensemble.weights):
        n = len(tree.conditions)
        gain = [float(v) for v in tree.values]
        for bit in range(n):  # differences along each condition
            for at in range(1 << n):
                if at >> bit & 1:
                    gain[at] -= gain[at ^ 1 << bit]
        for at, value in enumerate(gain):
            if value:
                highest: dict[int, float] = {}
                for k, (f, b) in enumerate(tree.conditions):
                    if at >> n - 1 - k & 1:
                        highest[f] = max(b, highest.get(f, b))
                key = tuple(sorted(highest.items()))
                rules[key] = rules.get(key, 0.0) + w * value
    if ensemble.bias:
        rules[()] = rules.get((), 0.0) + ensemble.bias
    return sorted((k, v) for k, v in rules.items() if v)


def rules_column(rules: list, x: Column) -> Column:
    """The value of compiled rules."""
    out = F.lit(0.0)
    for conditions, weight in rules:
        held = reduce(lambda a, b: a & b, [above(feature(x, f), b) for f, b in conditions], F.lit(True))
        out = out + F.when(held, float(weight)).otherwise(0.0)
    return out


def strongest(rules: list, support: dict, k: int) -> list[tuple[tuple, float]]:
    """The k rules with the largest |weight| x share of rows that meet them."""
    scored = [(c, w * support.get(c, 0.0)) for c, w in rules if c]
    return sorted(scored, key=lambda x: (-abs(x[1]), x[0]))[:k]


def to_binary(ensemble: Ensemble) -> bytes:
    """An ensemble of oblivious trees as bytes: the conditions, then each tree's places in them and values.

    Every leaf is scaled by its tree's weight.
    """
    table = sorted({tuple(c) for t in ensemble.models for c in t.conditions})
    place = {c: i for i, c in enumerate(table)}
    out = [struct.pack("<dII", ensemble.bias, len(table), len(ensemble.models))]
    out += [struct.pack("<id", f, b) for f, b in table]
    for tree, w in zip(ensemble.models, ensemble.weights):
        out.append(struct.pack(f"<I{len(tree.conditions)}I", len(tree.conditions), *[place[tuple(c)] for c in tree.conditions]))
        out.append(struct.pack(f"<{len(tree.values)}d", *[w * v for v in tree.values]))
    return b"".join(out)


def from_binary(data: bytes) -> Ensemble:
    """The inverse of `to_binary`, with weights of 1."""
    bias, n, trees = struct.unpack_from("<dII", data)
    at = 16
    table = []
    for _ in range(n):
        table.append(struct.unpack_from("<id", data, at))
        at += 12
    models = []
    for _ in range(trees):
        (depth,) = struct.unpack_from("<I", data, at)
        places = struct.unpack_from(f"<{depth}I", data, at + 4)
        at += 4 + 4 * depth
        values = list(struct.unpack_from(f"<{1 << depth}d", data, at))
        at += 8 << depth
        models.append(ObliviousTree([table[i] for i in places], values))
    return Ensemble(models, [1.0] * trees, bias)
