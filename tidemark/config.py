"""Configuration: KPIs, windows and detector settings, with validation."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class KpiSpec:
    name: str
    direction: str = "higher_is_worse"
    clip: tuple[float, float] | None = None
    baseline: float = 0.0
    noise: float = 1.0
    amplitude: float = 0.0
    profile: str = "traffic"

    def __post_init__(self):
        if self.direction not in ("higher_is_worse", "lower_is_worse"):
            raise ValueError(f"{self.name}: unknown direction {self.direction}")


@dataclass(frozen=True)
class WindowSettings:
    """Count-based sliding window: rows a window holds, rows between emissions, and the aggregate."""

    size: int = 5
    stride: int = 1
    aggregate: str = "mean"

    def __post_init__(self):
        if self.size < 1 or self.stride < 1:
            raise ValueError("size and stride must be positive")


@dataclass(frozen=True)
class DetectorSettings:
    bucket_minutes: int = 30
    min_samples: int = 5
    z_threshold: float = 3.0
    alpha: float = 0.2
    persistence: int = 5
    warmup_rows: int = 0

    def __post_init__(self):
        if 1440 % self.bucket_minutes:
            raise ValueError("bucket_minutes must divide a day, or weekday and weekend buckets overlap")
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")


@dataclass(frozen=True)
class Settings:
    kpis: tuple[KpiSpec, ...]
    window: WindowSettings = field(default_factory=WindowSettings)
    detector: DetectorSettings = field(default_factory=DetectorSettings)

    @property
    def names(self) -> list[str]:
        return [k.name for k in self.kpis]


def load(path: str | Path) -> Settings:
    """Settings from YAML with the sections kpis (name -> fields), window and detector."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    kpis = tuple(KpiSpec(name=k, **{**v, **({"clip": tuple(v["clip"])} if v.get("clip") else {})}) for k, v in data["kpis"].items())
    return Settings(kpis, WindowSettings(**data.get("window", {})), DetectorSettings(**data.get("detector", {})))
