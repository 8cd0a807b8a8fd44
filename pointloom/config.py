"""Settings of a collection, checked when made and fixed from then on."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from enum import StrEnum
from typing import Any


class Distance(StrEnum):
    """Higher scores are nearer: cosine, dot product, or the negative squared Euclidean distance."""

    COSINE = "cosine"
    DOT = "dot"
    EUCLID = "euclid"


class PayloadSchema(StrEnum):
    KEYWORD = "keyword"
    INTEGER = "integer"
    FLOAT = "float"
    BOOL = "bool"


# The settings' names and defaults are the interface. `least` and `most` bound a setting, `above` excludes
# a bound, `at_least` names the setting of the same group that is the least.


def _setting(default: float, **bounds) -> Any:
    return field(default=default, metadata=bounds)


_HOLDS = {
    "least": lambda value, bound, group: value >= bound,
    "most": lambda value, bound, group: value <= bound,
    "above": lambda value, bound, group: value > bound,
    "at_least": lambda value, other, group: value >= getattr(group, other),
}


class _Bounded:
    """Settings that are held against their bounds when made."""

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            for kind, bound in f.metadata.items():
                if not _HOLDS[kind](value, bound, self):
                    raise ValueError(f"{f.name} = {value!r} is not {kind.replace('_', ' ')} {bound}")


@dataclass(frozen=True)
class HnswConfig(_Bounded):
    m: int = _setting(16, least=2)
    ef_construct: int = _setting(100, at_least="m")
    ef_search: int = _setting(64, least=1)
    seed: int = 0


@dataclass(frozen=True)
class OptimizerConfig(_Bounded):
    flush_threshold_points: int = _setting(1000, least=1)
    indexing_threshold_points: int = _setting(2000, least=1)
    target_segment_count: int = _setting(4, least=1)
    deleted_ratio_threshold: float = _setting(0.2, above=0, most=1)


@dataclass(frozen=True)
class ScalarQuantizationConfig(_Bounded):
    oversampling: int = _setting(4, least=1)


@dataclass(frozen=True)
class CollectionConfig:
    dimension: int
    distance: Distance
    hnsw: HnswConfig = HnswConfig()
    optimizer: OptimizerConfig = OptimizerConfig()
    quantization: ScalarQuantizationConfig | None = None
    ids: str = "integer"  # whole numbers as longs; or `any`: unsigned 64-bit numbers and UUIDs, as texts

    def __post_init__(self) -> None:
        if self.ids not in ("integer", "any"):
            raise ValueError(f"ids are integer or any, not {self.ids!r}")
        if type(self.dimension) is not int or self.dimension < 1:
            raise ValueError(f"a dimension is a whole number from 1 on, not {self.dimension!r}")
        object.__setattr__(self, "distance", Distance(self.distance))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, stored: dict) -> CollectionConfig:
        groups = {"hnsw": HnswConfig, "optimizer": OptimizerConfig, "quantization": ScalarQuantizationConfig}
        return cls(**{name: groups[name](**value) if name in groups and value is not None else value for name, value in stored.items()})

    @property
    def fingerprint(self) -> str:
        """The same for equal settings, whatever the session: SHA-256 of their JSON."""
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()
