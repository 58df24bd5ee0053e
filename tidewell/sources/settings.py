"""Settings of a run: sources, limits, window (S19, S22, F2, F16). Needs a YAML library only to read YAML files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timedelta

KINDS = ("rss", "api", "html", "custom")


@dataclass(frozen=True)
class Source:
    id: str
    kind: str
    url: str
    enabled: bool = True
    rate_limit_qpm: int | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"source {self.id}: kind {self.kind} is none of {', '.join(KINDS)}")
        if "://" not in self.url:
            raise ValueError(f"source {self.id}: {self.url} is no URL")
        if self.rate_limit_qpm is not None and self.rate_limit_qpm <= 0:
            raise ValueError(f"source {self.id}: rate_limit_qpm must be positive")


@dataclass(frozen=True)
class RunSettings:
    """``as_of`` is the one clock of a run: no row ever takes the current time."""

    as_of: datetime
    window_days: int = 7
    max_items_per_run: int = 40
    max_items_per_source: int = 20
    threshold: float = 7.0
    sources: tuple[Source, ...] = field(default_factory=tuple)

    def window(self) -> tuple[datetime, datetime]:
        """From the start to the end of the look-back window, both inclusive."""
        return self.as_of - timedelta(days=max(0, self.window_days)), self.as_of


def load(path: str) -> dict:
    """A settings file, JSON or YAML by its ending."""
    with open(path, encoding="utf-8") as file:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("reading YAML needs the package yaml; JSON works without") from error
            return yaml.safe_load(file)
        return json.load(file)


def run_settings(values: dict, as_of: datetime) -> RunSettings:
    """Settings from a parsed file; unknown keys raise."""
    values = dict(values)
    sources = tuple(Source(**s) for s in values.pop("sources", []))
    return RunSettings(as_of=as_of, sources=sources, **values)
