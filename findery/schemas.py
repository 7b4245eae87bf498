"""Configurations, states and the schemas of every table that the engine keeps."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import types as T

from findery.errors import InvalidHnswConfig, NotYetImplemented

FORMAT_VERSION = 1


class VectorDistance(StrEnum):
    L2 = "l2"  # squared
    COSINE = "cosine"
    INNER_PRODUCT = "inner_product"  # negated


class Family(StrEnum):
    VECTOR = "vector"
    FTS = "fts"


class StateKind(StrEnum):
    ABSENT = "absent"
    ACTIVE = "active"
    DESTROYED = "destroyed"


class Transition(StrEnum):
    CREATE = "create"
    INSERT = "insert"
    REMOVE = "remove"
    REBUILD = "rebuild"
    DESTROY = "destroy"
    PUBLISH = "publish"
    RECOVER = "recover"


PERMITTED = {
    Transition.CREATE: {StateKind.ABSENT},
    Transition.INSERT: {StateKind.ACTIVE},
    Transition.REMOVE: {StateKind.ACTIVE},
    Transition.REBUILD: {StateKind.ACTIVE},
    Transition.DESTROY: {StateKind.ACTIVE},
    Transition.PUBLISH: {StateKind.ABSENT, StateKind.ACTIVE},
    Transition.RECOVER: set(StateKind),
}


def is_permitted_from(transition: Transition, state: StateKind) -> bool:
    return state in PERMITTED[transition]


@dataclass(frozen=True)
class HnswConfig:
    """Settings of a vector index. ``m_neighbours`` sizes the pool whose distances must fit 32 bits."""

    dimensions: int
    distance: VectorDistance = VectorDistance.L2
    ef_construction: int = 50
    m_neighbours: int = 16

    family = Family.VECTOR

    def check(self) -> None:
        for name in ("dimensions", "m_neighbours", "ef_construction"):
            if getattr(self, name) <= 0:
                raise InvalidHnswConfig(f"{name} must not be zero")

    def pool(self, k: int) -> int:
        return max(k, 8 * self.m_neighbours, 1)

    def to_json(self) -> dict:
        return {
            "family": "vector",
            "dimensions": self.dimensions,
            "distance": str(self.distance),
            "ef_construction": self.ef_construction,
            "m_neighbours": self.m_neighbours,
        }


@dataclass(frozen=True)
class TokenizerConfig:
    name: str
    args: tuple[str, ...] = ()


@dataclass(frozen=True)
class FtsConfig:
    tokenizer: TokenizerConfig = field(default_factory=lambda: TokenizerConfig("Simple"))
    filters: tuple[TokenizerConfig, ...] = ()

    family = Family.FTS

    @staticmethod
    def simple() -> FtsConfig:
        return FtsConfig()

    def check(self) -> None:
        if self != FtsConfig():
            raise NotYetImplemented("only the Simple tokenizer without arguments and filters")

    def to_json(self) -> dict:
        return {
            "family": "fts",
            "tokenizer": {"name": self.tokenizer.name, "args": list(self.tokenizer.args)},
            "filters": [{"name": f.name, "args": list(f.args)} for f in self.filters],
        }


def config_from_json(value: dict) -> HnswConfig | FtsConfig:
    if value["family"] == "vector":
        return HnswConfig(
            value["dimensions"], VectorDistance(value["distance"]), value["ef_construction"], value["m_neighbours"]
        )
    make = lambda t: TokenizerConfig(t["name"], tuple(t["args"]))
    return FtsConfig(make(value["tokenizer"]), tuple(make(f) for f in value["filters"]))


def member_table_schema(id_type: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("id", id_type)
        .add("provenance", T.StringType())
        .add("introduced", T.LongType())
        .add("supersedes", T.LongType())
    )

