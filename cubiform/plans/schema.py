"""A discrete schema: ordered attributes with cardinalities, and its algebra."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import types as T

Attrs = str | Iterable[str]


def names(attrs: Attrs) -> tuple[str, ...]:
    """Attribute names as a tuple; a string is one name."""
    return (attrs,) if isinstance(attrs, str) else tuple(attrs)


@dataclass(frozen=True)
class Schema:
    """Attributes in order, with the number of codes of each; equality minds the order."""

    attrs: tuple[str, ...]
    sizes: tuple[int, ...]

    def __post_init__(self):
        object.__setattr__(self, "attrs", tuple(self.attrs))
        object.__setattr__(self, "sizes", tuple(map(int, self.sizes)))
        if len(self.attrs) != len(self.sizes):
            raise ValueError("attributes and cardinalities differ in number")
        if len(set(self.attrs)) != len(self.attrs):
            raise ValueError("attribute names must be unique")

    @classmethod
    def of(cls, config: Mapping[str, int]) -> Schema:
        return cls(tuple(config), tuple(config.values()))

    @classmethod
    def from_json(cls, text: str) -> Schema:
        """From ``{"attribute": cardinality}``; the order of keys is the order of attributes."""
        return cls.of(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(self.config)

    def to_struct(self) -> T.StructType:
        """Spark form: non-null integers that carry their cardinality as metadata."""
        return T.StructType([T.StructField(a, T.IntegerType(), False, {"cardinality": n}) for a, n in zip(self.attrs, self.sizes, strict=True)])

    @classmethod
    def from_struct(cls, struct: T.StructType) -> Schema:
        """The fields that carry a cardinality."""
        return cls.of({f.name: f.metadata["cardinality"] for f in struct if "cardinality" in f.metadata})

    @property
    def config(self) -> dict[str, int]:
        return dict(zip(self.attrs, self.sizes, strict=True))

    def project(self, attrs: Attrs) -> Schema:
        """In the requested order; unknown names raise."""
        own, wanted = self.config, names(attrs)
        if unknown := [a for a in wanted if a not in own]:
            raise ValueError(f"unknown attributes: {unknown}")
        return Schema(wanted, tuple(own[a] for a in wanted))

    def marginalize(self, attrs: Attrs) -> Schema:
        """Without ``attrs``; unknown names are ignored."""
        return self.project(self.invert(attrs))

    def invert(self, attrs: Attrs) -> list[str]:
        gone = set(names(attrs))
        return [a for a in self.attrs if a not in gone]

    def canonical(self, attrs: Attrs) -> tuple[str, ...]:
        wanted = set(names(attrs))
        return tuple(a for a in self.attrs if a in wanted)

    def contains(self, other: Schema) -> bool:
        return set(other.attrs) <= set(self.attrs)

    def intersect(self, other: Schema) -> Schema:
        return self.project(a for a in self.attrs if a in other)

    def axes(self, attrs: Attrs) -> tuple[int, ...]:
        return tuple(self.attrs.index(a) for a in names(attrs))

    def merge(self, other: Schema) -> Schema:
        """Own attributes, then the other's new ones; a shared attribute must agree in size."""
        both = self.config
        for a, n in other.config.items():
            if both.setdefault(a, n) != n:
                raise ValueError(f"attribute {a} has {both[a]} codes on one side and {n} on the other")
        return Schema.of(both)

    def size(self, attrs: Attrs | None = None) -> int:
        return math.prod(self.sizes if attrs is None else self.project(attrs).sizes)

    def strides(self, attrs: Attrs | None = None) -> tuple[int, ...]:
        """Row-major strides of a cell number over ``attrs`` in their order."""
        sizes = (self if attrs is None else self.project(attrs)).sizes
        return tuple(math.prod(sizes[k + 1 :]) for k in range(len(sizes)))

    def supports(self, attrs: Attrs) -> bool:
        return set(names(attrs)) <= set(self.attrs)

    def __contains__(self, attr: object) -> bool:
        return attr in self.attrs

    def __getitem__(self, attr: str) -> int:
        return self.config[attr]

    def __iter__(self) -> Iterator[str]:
        return iter(self.attrs)

    def __len__(self) -> int:
        return len(self.attrs)

    def __str__(self) -> str:
        return "Schema(" + ", ".join(f"{a}: {n}" for a, n in self.config.items()) + ")"
