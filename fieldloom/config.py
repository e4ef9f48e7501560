"""What to score and how: a declarative tree in the shape of the documents, resolved on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any


class ExtraKeysPolicy(StrEnum):
    IGNORE = "ignore"
    PENALIZE = "penalize"


class ArrayStrategy(StrEnum):
    BY_INDEX = "by_index"
    BY_KEY = "by_key"
    HUNGARIAN = "hungarian"


class GradingMode(StrEnum):
    HARD = "hard"
    SOFT = "soft"


class WeightMode(StrEnum):
    NONE = "none"
    PROPORTIONAL = "proportional"


@dataclass(frozen=True)
class FieldConfig:
    metrics: Sequence[Any] | None = None
    key_metric: Any = None
    threshold: float | None = None
    weight: float = 1.0


@dataclass(frozen=True)
class ObjectFieldConfig:
    fields: Mapping[str, Any] = field(default_factory=dict)
    weight: float = 1.0
    threshold: float | None = None
    metrics: Sequence[Any] | None = None
    key_metric: Any = None

    def child(self, key: str) -> Any:
        """The configuration of a key; of dotted keys, those below it. A literal key wins."""
        if key in self.fields:
            return self.fields[key]
        below = {k[len(key) + 1 :]: v for k, v in self.fields.items() if k.startswith(key + ".")}
        return ObjectFieldConfig(fields=below) if below else None


@dataclass(frozen=True)
class ArrayFieldConfig:
    item: FieldConfig | ObjectFieldConfig | None = None
    strategy: ArrayStrategy = ArrayStrategy.BY_INDEX
    params: Mapping[str, Any] = field(default_factory=dict)
    weight: float = 1.0
    threshold: float | None = None
    metrics: Sequence[Any] | None = None
    key_metric: Any = None

    def __post_init__(self):
        if self.item is not None and not isinstance(self.item, (FieldConfig, ObjectFieldConfig)):
            raise TypeError("items of arrays are fields or objects")
        from fieldloom.operators.assign import PARAMS

        if str(self.strategy) not in PARAMS:
            raise ValueError(f"no alignment is named {self.strategy!r}; there are {', '.join(sorted(PARAMS))}")
        allowed = PARAMS[str(self.strategy)]
        if unknown := set(self.params) - set(allowed):
            raise TypeError(f"{self.strategy} takes no {', '.join(sorted(unknown))}")
        if self.params.get("key", ()) == []:
            raise ValueError("an alignment key needs a field")


@dataclass(frozen=True)
class EvalConfig:
    metrics: Sequence[Any] = ()
    fields: Mapping[str, Any] = field(default_factory=dict)
    root: Any = None
    key_metric: Any = None
    extra_keys: ExtraKeysPolicy = ExtraKeysPolicy.IGNORE
    default_scalar_metrics: Sequence[Any] | None = None
    default_object_metrics: Sequence[Any] | None = None
    default_array_metrics: Sequence[Any] | None = None

    def __post_init__(self):
        for name in ("default_scalar_metrics", "default_object_metrics", "default_array_metrics"):
            if getattr(self, name) is not None and not getattr(self, name):
                raise ValueError(f"{name} must name a metric")

    def top(self) -> Any:
        return self.root if self.root is not None else ObjectFieldConfig(fields=self.fields) if self.fields else None
