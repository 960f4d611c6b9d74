"""Limits and model settings, in one immutable record."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Default and allowed range of every adjustable limit.
RANGES = {
    "default_limit": (10, 1, 100),
    "max_limit": (100, 1, 1000),
    "max_content_length": (10000, 1, 100000),
    "max_tags": (20, 1, 100),
    "embed_retries": (3, 1, 10),
}

# Limits that cannot be adjusted.
TYPE_LENGTH = 50
SOURCE_LENGTH = 100
QUERY_LENGTH = 1000
BROWSE_LIMIT, BROWSE_MIN, BROWSE_MAX = 20, 1, 100


def clamp(name: str, value: object) -> int:
    """Read ``value`` as a limit: its leading integer moved into range, or the default."""
    default, low, high = RANGES[name]
    number = re.match(r"\s*[+-]?\d+", str(value)) if value not in (None, "") else None
    return max(low, min(high, int(number.group()))) if number else default


@dataclass(frozen=True)
class Options:
    default_limit: int = 10
    max_limit: int = 100
    max_content_length: int = 10000
    max_tags: int = 20
    embed_retries: int = 3
    dim: int = 384
    pooling: str = "mean"
    normalize: bool = True

    @classmethod
    def of(cls, settings: Mapping[str, object]) -> Options:
        """Options from loose settings (strings allowed); limits are clamped, not rejected."""
        unknown = set(settings) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        values = dict(settings)
        for name in RANGES.keys() & values.keys():
            values[name] = clamp(name, values[name])
        return cls(**values)
