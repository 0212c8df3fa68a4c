"""What is measured (variables), what it is grouped by (dimensions), and which pairs are kept jointly."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

GRANULARITIES = ("daily", "weekly", "monthly", "yearly")


class SchemaError(ValueError):
    """A declaration that cannot hold."""


@dataclass(frozen=True)
class Continuous:
    """Fixed-width bins over [low, high); no range means [0, 1)."""

    bins: int
    range: tuple[float, float] | None = None

    @property
    def low(self) -> float:
        return float(self.range[0]) if self.range else 0.0

    @property
    def high(self) -> float:
        return float(self.range[1]) if self.range else 1.0

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.bins

    @property
    def size(self) -> int:
        return self.bins

    def labels(self) -> list[str]:
        return [f"[{self.low + i * self.width:.2f}, {self.low + i * self.width + self.width:.2f})" for i in range(self.bins)]


@dataclass(frozen=True)
class Categorical:
    categories: tuple[str, ...]
    allow_unknown: bool = True

    @property
    def size(self) -> int:
        return len(self.categories)

    def labels(self) -> list[str]:
        return list(self.categories)


@dataclass(frozen=True)
class Variable:
    name: str
    kind: Continuous | Categorical


@dataclass(frozen=True)
class Dimension:
    name: str
    source: str
    granularity: str | None = None


@dataclass
class Schema:
    variables: list[Variable] = field(default_factory=list)
    dimensions: list[Dimension] = field(default_factory=list)
    joints: list[tuple[str, str]] = field(default_factory=list)

    def variable(self, name: str) -> Variable:
        for v in self.variables:
            if v.name == name:
                return v
        raise SchemaError(f"unknown variable '{name}'")

    def dimension(self, name: str) -> Dimension:
        for d in self.dimensions:
            if d.name == name:
                return d
        raise SchemaError(f"unknown dimension '{name}'")

    @property
    def dims(self) -> list[str]:
        return sorted(d.name for d in self.dimensions)

    @property
    def default_variable(self) -> str:
        if not self.variables:
            raise SchemaError("no variable is defined")
        return self.variables[0].name

    def define_variable(self, name: str, kind: Continuous | Categorical) -> Schema:
        if any(v.name == name for v in self.variables):
            raise SchemaError(f"variable '{name}' is defined already")
        if kind.size < 1:
            raise SchemaError(f"variable '{name}' needs at least one {'bin' if isinstance(kind, Continuous) else 'category'}")
        self.variables.append(Variable(name, kind))
        return self

    def define_dimension(self, name: str, source: str | None = None, granularity: str | None = None) -> Schema:
        if any(d.name == name for d in self.dimensions):
            raise SchemaError(f"dimension '{name}' is defined already")
        self.dimensions.append(Dimension(name, source or name, granularity))
        return self

    def define_joint(self, a: str, b: str) -> Schema:
        """Order does not matter, and neither does saying it twice."""
        self.variable(a), self.variable(b)
        pair = (min(a, b), max(a, b))
        if pair not in self.joints:
            self.joints.append(pair)
        return self

    def joint(self, a: str, b: str) -> tuple[str, str]:
        pair = (min(a, b), max(a, b))
        if pair not in self.joints:
            raise SchemaError(f"no joint distribution of '{a}' and '{b}' is defined")
        return pair

    def axes(self, pair: tuple[str, str]) -> tuple[Variable, Variable]:
        """The variables of a pair's rows and columns: of a mixed pair the categorical one has the rows."""
        a, b = (self.variable(x) for x in pair)
        mixed = isinstance(a.kind, Continuous) and isinstance(b.kind, Categorical)
        return (b, a) if mixed else (a, b)

    def to_json(self) -> str:
        def kind(k):
            return {"kind": type(k).__name__} | asdict(k)

        return json.dumps({"variables": [{"name": v.name, **kind(v.kind)} for v in self.variables], "dimensions": [asdict(d) for d in self.dimensions], "joints": self.joints})

    @classmethod
    def from_json(cls, text: str) -> Schema:
        raw = json.loads(text)
        out = cls()
        for v in raw["variables"]:
            if v["kind"] == "Continuous":
                kind: Continuous | Categorical = Continuous(v["bins"], tuple(v["range"]) if v["range"] else None)
            else:
                kind = Categorical(tuple(v["categories"]), v["allow_unknown"])
            out.define_variable(v["name"], kind)
        for d in raw["dimensions"]:
            out.define_dimension(d["name"], d["source"], d["granularity"])
        for a, b in raw["joints"]:
            out.define_joint(a, b)
        return out


def canonical_key(key: dict[str, str]) -> str:
    """``name:value`` parts in the order of names, joined by slashes."""
    return "/".join(f"{k}:{key[k]}" for k in sorted(key))
