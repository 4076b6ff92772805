"""Semantic types: named lists of documented fields, their JSON schema, and the check of what a model gives."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import types as T

from lucidframe.errors import SemanticError


@dataclass(frozen=True)
class FieldType:
    base: str  # text, int, real, bool, oneof, level
    variants: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    array: bool = False

    def spark(self) -> T.DataType:
        one = {"int": T.LongType(), "real": T.DoubleType(), "bool": T.BooleanType()}.get(self.base, T.StringType())
        return T.ArrayType(one) if self.array else one

    def schema(self) -> dict:
        one: dict = {"type": {"int": "integer", "real": "number", "bool": "boolean"}.get(self.base, "string")}
        if self.variants:
            one["enum"] = list(self.variants)
        return {"type": "array", "items": one} if self.array else one

    def render(self) -> str:
        text = self.base.upper()
        if self.variants:
            text += "(" + ", ".join(self.variants) + ")"
        if self.low is not None:
            text += f" CHECK ({self.low:g}..{self.high:g})"
        return text + "[]" * self.array

    def check(self, value):
        """The value to keep, or None if it doesn't fit."""
        if self.array:
            if not isinstance(value, list):
                return None
            one = FieldType(self.base, self.variants, self.low, self.high)
            return [v for v in map(one.check, value) if v is not None]
        if self.base == "bool":
            return value if isinstance(value, bool) else None
        if self.base == "int":
            return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None
        if self.base == "real":
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                return None
            inside = self.low is None or self.low <= value <= self.high
            return float(value) if inside else None
        if not isinstance(value, str):
            return None
        if self.variants:
            return next((v for v in self.variants if v.lower() == value.lower()), None)
        return value


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    doc: str

    def render(self) -> str:
        doc = self.doc.replace("'", "''")
        return f"{self.name} {self.type.render()} '{doc}'"


@dataclass
class SemanticType:
    name: str
    fields: list[Field]
    together: list[list[str]] = field(default_factory=list)

    def named(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SemanticError(f"type {self.name} has no field {name}")

    def units(self, wanted: list[str] | None = None) -> list[list[Field]]:
        """Groups of fields that are asked and stored as one, closed over TOGETHER."""
        out, seen = [], set()
        for f in self.fields:
            if f.name in seen:
                continue
            names = next((g for g in self.together if f.name in g), [f.name])
            seen |= set(names)
            if wanted is None or set(names) & set(wanted):
                out.append([self.named(x) for x in names])
        return out

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type.spark()) for f in self.fields])


def unit_key(unit: list[Field]) -> str:
    return hashlib.md5("; ".join(f.render() for f in unit).encode()).hexdigest()


class TypeRegistry:
    def __init__(self):
        self._types: dict[str, SemanticType] = {}

    def add(self, kind: SemanticType) -> None:
        if kind.name.lower() in self._types:
            raise SemanticError(f"semantic type {kind.name} is already defined")
        self._types[kind.name.lower()] = kind

    def get(self, name: str) -> SemanticType:
        if name.lower() not in self._types:
            raise SemanticError(f"unknown semantic type {name}: define it first with CREATE SEMANTIC TYPE")
        return self._types[name.lower()]

    def has(self, name: str) -> bool:
        return name.lower() in self._types
