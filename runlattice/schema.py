"""Declared parameters, axes and features; the schema is given, never inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Param:
    """One experiment parameter: ``kind`` is real, int, bool or category."""

    name: str
    kind: str = "real"
    lo: float | None = None
    hi: float | None = None
    vocab: tuple[str, ...] = ()
    digits: int | None = 3
    required: bool = True

    def __post_init__(self):
        if self.kind not in ("real", "int", "bool", "category"):
            raise ValueError(f"unknown kind {self.kind!r} for parameter {self.name!r}")
        if self.kind == "category" and not self.vocab:
            raise ValueError(f"category {self.name!r} needs a non-empty vocabulary")
        if self.lo is not None and self.hi is not None and self.lo > self.hi:
            raise ValueError(f"bounds of {self.name!r} are reversed")

    @property
    def spark_type(self) -> T.DataType:
        return {
            "real": T.DoubleType(),
            "int": T.LongType(),
            "bool": T.BooleanType(),
            "category": T.StringType(),
        }[self.kind]

    def field(self) -> T.StructField:
        meta = {"kind": self.kind, "vocab": list(self.vocab)}
        for key in ("lo", "hi", "digits"):
            if getattr(self, key) is not None:
                meta[key] = getattr(self, key)
        return T.StructField(self.name, self.spark_type, not self.required, meta)


@dataclass(frozen=True)
class Axis:
    """One domain axis: ``size`` names the column holding an experiment's own length,
    ``index`` the cell column; ``max_size`` is the declared upper bound."""

    size: str
    index: str
    max_size: int
    min_size: int = 1

    def __post_init__(self):
        if self.size == self.index:
            raise ValueError("an axis needs different names for its size and its index")


@dataclass(frozen=True)
class Feature:
    """A measured value over the first ``depth`` axes; ``context`` marks observed inputs."""

    name: str
    depth: int = 0
    context: bool = False


def struct_of(params: list[Param], axes: list[Axis] = ()) -> T.StructType:
    """Spark schema of an experiments table, constraints kept as column metadata."""
    fields = [T.StructField("exp_code", T.StringType(), False)]
    fields += [p.field() for p in params]
    fields += [
        T.StructField(a.size, T.IntegerType(), False, {"kind": "axis", "lo": a.min_size, "hi": a.max_size})
        for a in axes
    ]
    return T.StructType(fields)


def find_axis(axes: list[Axis], name: str) -> int:
    """Position of an axis given by either of its two names."""
    for pos, axis in enumerate(axes):
        if name in (axis.size, axis.index):
            return pos
    raise ValueError(f"no axis {name!r}")
