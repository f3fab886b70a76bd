"""Operator configuration: frozen dataclasses filled from mappings, JSON or YAML."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class TimelineConfig:
    window: float = 2.0
    hop: float = 2.0
    max_gap: float = 1.5
    least: float = 0.5
    threshold: float = 0.35


@dataclass(frozen=True)
class RetrievalConfig:
    candidates: int = 50
    final_top_k: int = 10
    max_chunk_tokens: int = 128
    overlap_tokens: int = 32
    aggregation_method: str = "max"


@dataclass(frozen=True)
class ClusterConfig:
    eps: float = 0.2
    min_samples: int = 3
    same: float = 0.995
    attempts: int = 4


SECTIONS = {"timeline": TimelineConfig, "retrieval": RetrievalConfig, "clusters": ClusterConfig}
ALIASES = {"transcription": "transcribe", "classify_timeline": "timeline", "clustering": "clusters"}


def load(payload: str | Mapping[str, Any], name: str = "lumenflow") -> dict[str, Any]:
    """Sections of a configuration, at the top level or below ``name``; unknown sections and fields are errors, missing ones defaults."""
    if isinstance(payload, str):
        try:
            payload = json.loads(payload)
        except ValueError:
            import yaml

            payload = yaml.safe_load(payload) or {}
    given = payload.get(name, payload) if isinstance(payload, Mapping) else None
    if not isinstance(given, Mapping):
        raise ValueError("a configuration is a mapping of sections")
    out = {k: v() for k, v in SECTIONS.items()}
    for section, values in given.items():
        section = ALIASES.get(section, section)
        if section not in SECTIONS:
            raise ValueError(f"no section named {section}")
        known = {f.name: f.type for f in dataclasses.fields(SECTIONS[section])}
        if extra := set(values or {}) - set(known):
            raise ValueError(f"{section} has no {', '.join(sorted(extra))}")
        out[section] = SECTIONS[section](**(values or {}))
    return out
