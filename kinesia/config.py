"""Settings of the feature and visibility stages, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    """A setting that cannot be used."""


def _whole(name: str, value, least: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ConfigError(f"{name} must be a whole number of {least} or more")


def _share(name: str, value, most: float) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or not 0 <= value <= most:
        raise ConfigError(f"{name} must lie in 0..{most:g}")


@dataclass(frozen=True)
class GestureConfig:
    """``min_confidence`` is inclusive; ``max_gap`` counts frames; a smoothing window is odd and longer than its order."""

    min_confidence: float = 0.2
    max_gap: int = 3
    window: int = 7
    order: int = 2

    def __post_init__(self) -> None:
        _share("min_confidence", self.min_confidence, 1)
        _whole("max_gap", self.max_gap, 0)
        _whole("window", self.window, 3)
        _whole("order", self.order, 1)
        if self.window % 2 == 0:
            raise ConfigError("window must be odd")
        if self.order >= self.window:
            raise ConfigError("order must be less than window")

    @classmethod
    def of(cls, settings: dict) -> GestureConfig:
        """From a mapping; dashes and underscores are the same, and a name given twice or unknown is an error."""
        known = {f.name for f in fields(cls)}
        out: dict = {}
        for name, value in settings.items():
            plain = name.replace("-", "_")
            if plain not in known:
                raise ConfigError(f"unknown setting {name}")
            if plain in out and out[plain] != value:
                raise ConfigError(f"{plain} is given twice with different values")
            out[plain] = value
        return cls(**out)


def point_list(text: str) -> tuple[int, ...]:
    """BODY_25 points from a comma-separated list: whole numbers 0-24, at least one, none twice."""
    try:
        points = tuple(int(p.strip()) for p in text.split(","))
    except ValueError:
        raise ConfigError("points must be whole numbers") from None
    if not points or len(set(points)) != len(points) or not all(0 <= p <= 24 for p in points):
        raise ConfigError("points must be 0-24, each once")
    return points


@dataclass(frozen=True)
class VisibilityConfig:
    """A clip passes if each point is trusted in at least ``percent`` of its expected frames."""

    percent: int = 40
    points: tuple[int, ...] = (4, 7)
    min_confidence: float = 0.2

    def __post_init__(self) -> None:
        _share("percent", self.percent, 100)
        _share("min_confidence", self.min_confidence, 1)
        point_list(",".join(map(str, self.points)))
