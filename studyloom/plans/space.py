"""Search spaces: distributions, conditional parameters, and the encoders of structured choices."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..schema import InvalidDistribution, InvalidSpace, MissingParam, TypeMismatch

KINDS = {"float": float, "int": int, "categorical": str, "bool": bool}


def to_struct(value) -> dict:
    """A parameter value as the tagged struct of the history tables."""
    out = {"kind": None, "f": None, "i": None, "s": None, "b": None}
    if isinstance(value, bool):
        return out | {"kind": "bool", "b": value}
    if isinstance(value, int | np.integer):
        return out | {"kind": "int", "i": int(value)}
    if isinstance(value, float | np.floating):
        return out | {"kind": "float", "f": float(value)}
    return out | {"kind": "categorical", "s": str(value)}


def from_struct(s):
    s = s if isinstance(s, dict) else s.asDict()
    return s[{"float": "f", "int": "i", "categorical": "s", "bool": "b"}[s["kind"]]]


class ParamSet(dict):
    """name -> value, kept in order of names; typed access raises what is wrong."""

    def __init__(self, values=()) -> None:
        super().__init__(sorted(dict(values).items()))

    def _typed(self, name: str, kind: type, label: str):
        if name not in self:
            raise MissingParam(name)
        v = self[name]
        if isinstance(v, bool) != (kind is bool) or not isinstance(v, kind):
            raise TypeMismatch(name, label, type(v).__name__)
        return v

    def float(self, name: str):
        return self._typed(name, float, "float")

    def int(self, name: str):
        return self._typed(name, int, "int")

    def categorical(self, name: str):
        return self._typed(name, str, "categorical")

    def boolean(self, name: str):
        return self._typed(name, bool, "bool")

    def with_(self, name: str, value) -> ParamSet:
        return ParamSet({**self, name: value})


@dataclass(frozen=True)
class Distribution:
    kind: str
    low: float = 0.0
    high: float = 1.0
    log: bool = False
    step: float | None = None
    choices: tuple[str, ...] = ()

    @classmethod
    def float(cls, low, high, log=False, step=None):
        return cls("float", float(low), float(high), log, step)

    @classmethod
    def log_float(cls, low, high):
        return cls("float", float(low), float(high), True)

    @classmethod
    def stepped_float(cls, low, high, step):
        return cls("float", float(low), float(high), False, float(step))

    @classmethod
    def int(cls, low, high, step=1, log=False):
        return cls("int", int(low), int(high), log, int(step))

    @classmethod
    def log_int(cls, low, high):
        return cls("int", int(low), int(high), True, 1)

    @classmethod
    def categorical(cls, choices):
        return cls("categorical", choices=tuple(choices))

    @classmethod
    def boolean(cls):
        return cls("bool")

    def validate(self, name: str) -> None:
        def fail(why):
            raise InvalidDistribution(name, why)

        if self.kind == "categorical":
            if not self.choices:
                fail("no choices")
            return
        if self.kind == "bool":
            return
        if not (math.isfinite(self.low) and math.isfinite(self.high)):
            fail("bounds must be finite")
        if self.low > self.high:
            fail("low exceeds high")
        if self.log and self.low <= 0:
            fail("a logarithmic scale needs low > 0")
        if self.kind == "int" and self.step < 1:
            fail("the step must be 1 or more")
        if self.kind == "float" and self.step is not None and self.step <= 0:
            fail("the step must be positive")
        if self.kind == "float" and self.step is not None and self.log:
            fail("a step and a logarithmic scale exclude each other")

    def snap(self, raw):
        v = self.low + math.floor((raw - self.low) / self.step + 0.5) * self.step
        return min(max(v, self.low), self.high)

    def from_unit(self, u: float):
        """The value at u in [0, 1): the inverse of the cumulative distribution."""
        if self.kind == "bool":
            return u >= 0.5
        if self.kind == "categorical":
            return self.choices[min(int(u * len(self.choices)), len(self.choices) - 1)]
        if self.kind == "int":
            if self.log:
                return int(min(max(math.floor(math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) + 0.5), self.low), self.high))
            n = int((self.high - self.low) // self.step) + 1
            return int(self.low + min(int(u * n), n - 1) * self.step)
        if self.log:
            return min(max(math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))), self.low), self.high)
        raw = self.low + u * (self.high - self.low)
        return self.snap(raw) if self.step else raw

    def sample(self, rng: np.random.Generator):
        return self.from_unit(float(rng.random()))

    def grid(self, n: int = 5) -> list:
        """All values, or n evenly spaced ones of a float (on its scale); one float value is low. Integers go by their
        step, whatever the scale."""
        if self.kind == "bool":
            return [False, True]
        if self.kind == "categorical":
            return list(self.choices)
        if self.kind == "int":
            return list(range(int(self.low), int(self.high) + 1, int(self.step)))
        if n <= 1:
            return [self.low]
        lo, hi = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        points = [lo + (hi - lo) * k / (n - 1) for k in range(n)]
        return [self.snap(math.exp(p) if self.log else p) if self.step else (math.exp(p) if self.log else p) for p in points]

    def contains(self, value) -> bool:
        """Type and range; the step is not looked at."""
        if self.kind == "bool":
            return isinstance(value, bool)
        if self.kind == "categorical":
            return isinstance(value, str) and value in self.choices
        if isinstance(value, bool) or not isinstance(value, float if self.kind == "float" else int):
            return False
        eps = 1e-9 if self.kind == "float" else 0
        return self.low - eps <= value <= self.high + eps


@dataclass(frozen=True)
class Condition:
    parent: str
    equals: tuple

    def holds(self, params: dict) -> bool:
        """False where the parent is missing."""
        return self.parent in params and any(type(v) is type(params[self.parent]) and v == params[self.parent] for v in self.equals)


@dataclass(frozen=True)
class Param:
    name: str
    distribution: Distribution
    condition: Condition | None = None


@dataclass
class SearchSpace:
    params: list[Param] = field(default_factory=list)

    def add(self, name: str, distribution: Distribution, when: tuple[str, list] | None = None) -> SearchSpace:
        self.params.append(Param(name, distribution, Condition(when[0], tuple(when[1])) if when else None))
        return self

    def get(self, name: str) -> Param:
        found = next((p for p in self.params if p.name == name), None)
        if found is None:
            raise MissingParam(name)
        return found

    def active(self, p: Param, params: dict) -> bool:
        return p.condition is None or p.condition.holds(params)

    def validate(self) -> SearchSpace:
        seen: dict[str, Param] = {}
        for p in self.params:
            p.distribution.validate(p.name)
            if p.name in seen:
                raise InvalidSpace(f"{p.name} is declared twice")
            if p.condition:
                parent = seen.get(p.condition.parent)
                if parent is None:
                    raise InvalidSpace(f"{p.name} depends on {p.condition.parent}, which is not declared before it")
                if not all(parent.distribution.contains(v) for v in p.condition.equals):
                    raise InvalidSpace(f"{p.name} depends on a value that {parent.name} cannot take")
            seen[p.name] = p
        return self

    def sample(self, rng: np.random.Generator) -> ParamSet:
        out: dict = {}
        for p in self.params:
            if self.active(p, out):
                out[p.name] = p.distribution.sample(rng)
        return ParamSet(out)

    def valid(self, params: dict) -> bool:
        """Exactly the active parameters are there, each within its distribution."""
        return all((p.name in params) == self.active(p, params) and (p.name not in params or p.distribution.contains(params[p.name])) for p in self.params) and set(params) <= {p.name for p in self.params}

    def grid(self, n: int = 5) -> list[ParamSet]:
        """The conditional product; a parameter that is not active multiplies nothing."""
        rows: list[dict] = [{}]
        for p in self.params:
            rows = [r | {p.name: v} if on else r for r in rows for on in [self.active(p, r)] for v in (p.distribution.grid(n) if on else [None])]
        return [ParamSet(r) for r in rows]


# Structured spaces.


@dataclass(frozen=True)
class LayerSpace:
    """A chain of min to max layers, each with an operation, a width and perhaps a skip connection."""

    ops: tuple[str, ...]
    low: int
    high: int
    widths: tuple[int, ...]
    skips: bool = True

    @classmethod
    def of(cls, ops, low, high, widths, skips=True):
        ops = tuple(dict.fromkeys(ops))
        if not ops:
            raise InvalidSpace("no operations")
        low = max(1, low)
        return cls(ops, low, max(low, high), tuple(sorted({max(1, w) for w in widths})) or (1,), skips)

    def encode(self) -> SearchSpace:
        s = SearchSpace().add("depth", Distribution.int(self.low, self.high))
        for i in range(self.high):
            on = ("depth", list(range(max(i + 1, self.low), self.high + 1)))
            s.add(f"op{i}", Distribution.categorical(self.ops), on)
            s.add(f"width{i}", Distribution.categorical([str(w) for w in self.widths]), on)
            if self.skips:
                s.add(f"skip{i}", Distribution.boolean(), on)
        return s

    def decode(self, params: dict) -> list[tuple[str, int, bool]]:
        depth = min(max(params["depth"], self.low), self.high)
        return [(params[f"op{i}"], int(params[f"width{i}"]), params.get(f"skip{i}", False)) for i in range(depth)]

    def sample(self, rng) -> list[tuple[str, int, bool]]:
        return self.decode(self.encode().sample(rng))

    def mutate(self, layers, rng) -> list[tuple[str, int, bool]]:
        """One change: an operation, a width, a skip, a layer more or a layer less."""
        out = list(layers)
        k, what = int(rng.integers(len(out))), int(rng.integers(5))
        op, width, skip = out[k]
        if what == 0:
            out[k] = (str(rng.choice(self.ops)), width, skip)
        elif what == 1:
            out[k] = (op, int(rng.choice(self.widths)), skip)
        elif what == 2 and self.skips:
            out[k] = (op, width, not skip)
        elif what == 3 and len(out) < self.high:
            out.append((str(rng.choice(self.ops)), int(rng.choice(self.widths)), bool(self.skips and rng.random() < 0.5)))
        elif what == 4 and len(out) > self.low:
            out.pop()
        return out


def describe_layers(layers) -> str:
    return " -> ".join(f"{op}/{width}" + "+skip" * skip for op, width, skip in layers)


def pipeline_space(stages: dict[str, dict[str, dict[str, Distribution]]]) -> SearchSpace:
    """A categorical for each stage, and stage.component.param for each component's parameters."""
    s = SearchSpace()
    for stage, components in stages.items():
        s.add(stage, Distribution.categorical(components))
        for component, params in components.items():
            for name, d in params.items():
                s.add(f"{stage}.{component}.{name}", d, (stage, [component]))
    return s


def pipeline_plan(stages, params: dict) -> list[tuple[str, str, dict]]:
    return [(stage, params[stage], {n: params[f"{stage}.{params[stage]}.{n}"] for n in components[params[stage]]}) for stage, components in stages.items()]


def describe_plan(plan) -> str:
    return " · ".join(f"{stage}={component}" for stage, component, _ in plan)


def multimodal_space(modalities: dict[str, tuple[list[str], list[int]]], fusions=("concat", "mean", "sum")) -> SearchSpace:
    s = SearchSpace()
    for name, (encoders, dims) in modalities.items():
        s.add(f"{name}.encoder", Distribution.categorical(encoders)).add(f"{name}.dim", Distribution.categorical([str(d) for d in dims]))
    return s.add("fusion", Distribution.categorical(fusions))


def fused_dim(dims: list[int], fusion: str) -> int:
    """The length of the fused vector; mean and sum need equal ones."""
    if not dims:
        raise InvalidSpace("no modality")
    if fusion == "concat":
        return sum(dims)
    if len(set(dims)) > 1:
        raise InvalidSpace(f"{fusion} needs equal dimensions")
    return dims[0]
