"""Definitions of features, hypotheses, outcomes and policies.

Definitions are small driver-side values. Their fingerprints are SHA-256 digests
of a readable canonical form, so the same definition has the same identity
everywhere.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from barloom.schemas import BASES, BAR_FIELDS, RAW


class DefinitionError(ValueError):
    """A definition that could not mean anything."""


def short_digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:16]


def render(value: Any) -> str:
    """One unambiguous spelling per parameter value."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float, str)):
        return repr(value)
    raise DefinitionError(f"unsupported parameter value {value!r}")


def require_count(value: Any, label: str, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise DefinitionError(f"{label} must be an int of at least {least}")
    return value


# --- fixed values: features and their default parameters --------------------
FEATURES: Mapping[str, Mapping[str, Any]] = {
    "simple_return": {"field": "close"},
    "log_return": {"field": "close"},
    "sma": {"period": None, "field": "close"},
    "ema": {"period": None, "field": "close"},
    "rsi": {"period": 14, "field": "close"},
    "realized_volatility": {"period": None, "field": "close"},
    "atr": {"period": 14},
    "average_volume": {"period": None},
    "relative_volume": {"period": None},
}


@dataclass(frozen=True)
class Feature:
    """A named feature with every parameter filled in."""

    name: str
    params: tuple[tuple[str, Any], ...]

    @property
    def key(self) -> str:
        return f"{self.name}({','.join(f'{k}={render(v)}' for k, v in self.params)})"

    def __getitem__(self, name: str) -> Any:
        return dict(self.params)[name]


def feature(name: str, **given: Any) -> Feature:
    """``feature('sma', period=20)`` with defaults resolved; unknown names refused."""
    if name not in FEATURES:
        raise DefinitionError(f"unknown feature {name!r}")
    known = FEATURES[name]
    extra = set(given) - set(known)
    if extra:
        raise DefinitionError(f"{name}: unknown parameters {sorted(extra)}")
    params = {**known, **given}
    missing = [k for k, v in params.items() if v is None]
    if missing:
        raise DefinitionError(f"{name}: missing parameters {missing}")
    if "period" in params:
        require_count(params["period"], f"{name} period", 2 if name == "realized_volatility" else 1)
    if "field" in params and params["field"] not in BAR_FIELDS:
        raise DefinitionError(f"{name}: unknown field {params['field']!r}")
    return Feature(name, tuple(sorted(params.items())))


@dataclass(frozen=True)
class Hypothesis:
    """A declarative classifier of evidence.

    ``classify(now, past, params)`` gets functions from feature to column (for
    the current row and ``k`` rows back) and returns (state, reason codes).
    """

    hypothesis_id: str
    version: int
    features: tuple[Feature, ...]
    classify: Callable[..., tuple[Any, Any]] = field(compare=False)
    lookback: int = 0
    parameters: Mapping[str, Any] = field(default_factory=dict)
    basis: str | None = None

    def __post_init__(self) -> None:
        if not self.hypothesis_id.strip() or not self.features:
            raise DefinitionError("a hypothesis needs an id and required features")
        require_count(self.version, "version")
        require_count(self.lookback, "lookback", 0)
        if len({f.key for f in self.features}) != len(self.features):
            raise DefinitionError(f"{self.hypothesis_id}: a feature is declared twice")
        if self.basis is not None and self.basis not in BASES:
            raise DefinitionError(f"unknown basis {self.basis!r}")

    @property
    def canonical_form(self) -> str:
        parts = (
            self.hypothesis_id,
            f"v{self.version}",
            f"basis={self.basis or 'any'}",
            f"lookback={self.lookback}",
            "params=" + ",".join(f"{k}={render(v)}" for k, v in sorted(self.parameters.items())),
            "features=" + ";".join(sorted(f.key for f in self.features)),
        )
        return "|".join(parts)

    @property
    def fingerprint(self) -> str:
        return short_digest(self.canonical_form)


@dataclass(frozen=True)
class OutcomeSpec:
    """Return from the next bar's open to ``future_field`` of bar ``horizon_bars``."""

    horizon_bars: int
    future_field: str = "close"
    basis: str = RAW

    def __post_init__(self) -> None:
        require_count(self.horizon_bars, "horizon_bars")
        if self.future_field not in ("open", "high", "low", "close"):
            raise DefinitionError(f"unknown price field {self.future_field!r}")
        if self.basis not in BASES:
            raise DefinitionError(f"unknown basis {self.basis!r}")

    @property
    def canonical_form(self) -> str:
        return "|".join(
            (
                "type=OutcomeType:forward_return",
                f"horizon_bars={self.horizon_bars}",
                "reference=ReferenceConvention:next_bar_open",
                f"future_field=PriceField:{self.future_field}",
                f"basis=PriceBasis:{self.basis}",
            )
        )

    @property
    def fingerprint(self) -> str:
        return short_digest(self.canonical_form)


@dataclass(frozen=True)
class Policy:
    """An exact ensemble of hypotheses and how many must have classified."""

    members: tuple[tuple[str, int, str], ...]
    minimum_sufficient: int = 1
    rule: str = "directional_presence_v1"

    def __post_init__(self) -> None:
        if not self.members or len(set(self.members)) != len(self.members):
            raise DefinitionError("the ensemble must be non-empty without repeats")
        require_count(self.minimum_sufficient, "minimum_sufficient")
        if self.minimum_sufficient > len(self.members):
            raise DefinitionError("minimum_sufficient exceeds the ensemble")
        if self.rule != "directional_presence_v1":
            raise DefinitionError(f"unknown aggregation rule {self.rule!r}")

    @classmethod
    def of(cls, hypotheses, minimum_sufficient: int = 1) -> "Policy":
        members = tuple((h.hypothesis_id, h.version, h.fingerprint) for h in hypotheses)
        return cls(members, minimum_sufficient)

    @property
    def canonical_form(self) -> str:
        names = ("hypothesis_id", "version", "fingerprint")
        payload = {
            "aggregation_rule": self.rule,
            "hypotheses": [dict(zip(names, member)) for member in sorted(self.members)],
            "minimum_sufficient_observations": self.minimum_sufficient,
        }
        return json.dumps(payload, separators=(",", ":"), sort_keys=True)

    @property
    def fingerprint(self) -> str:
        return short_digest(self.canonical_form)
