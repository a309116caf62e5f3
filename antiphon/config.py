"""Driver-side configuration: validated dataclasses, TOML, fingerprints, file names."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import ConfigurationError


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigurationError(what)


@dataclass(frozen=True)
class Cleaning:
    """Page cleaning limits and phrases."""

    # The limits.
    min_text_length: int = 150
    max_text_length: int = 50_000
    min_word_count: int = 30
    # Phrases that reject a page, and those that drop a line.
    unwanted_keywords: tuple[str, ...] = ("404 not found", "access denied", "permission denied", "captcha verification")
    noise_line_keywords: tuple[str, ...] = ("cookie", "privacy policy", "newsletter", "subscribe", "sign up", "all rights reserved")

    def __post_init__(self) -> None:
        _need(min(self.min_text_length, self.max_text_length, self.min_word_count) >= 0, "cleaning limits must not be negative")


@dataclass(frozen=True)
class Keywords:
    top_k: int = 5
    min_n: int = 2
    max_n: int = 4
    stop_words: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _need(self.top_k >= 1, "top_k must be at least 1")
        _need(1 <= self.min_n <= self.max_n, "n-gram sizes must satisfy 1 <= min_n <= max_n")


@dataclass(frozen=True)
class Extraction:
    claim_threshold: float = 0.45
    evidence_threshold: float = 0.35

    def __post_init__(self) -> None:
        _need(0 <= self.claim_threshold <= 1 and 0 <= self.evidence_threshold <= 1, "thresholds must be in [0, 1]")


@dataclass(frozen=True)
class Cache:
    enabled: bool = True
    ttl_seconds: int = 7 * 24 * 60 * 60
    path: str = ""

    def __post_init__(self) -> None:
        _need(self.ttl_seconds >= 1, "ttl_seconds must be at least 1")


@dataclass(frozen=True)
class Encoder:
    """Layers of the encoder network; the last is the output's size."""

    layers: tuple[int, ...] = (48, 32, 10)
    dropout: float = 0.1
    device: str = "cpu"

    def __post_init__(self) -> None:
        _need(len(self.layers) >= 2 and all(n > 0 for n in self.layers), "an encoder needs two or more positive layers")
        _need(0 <= self.dropout < 1, "dropout must be in [0, 1)")
        _need(bool(re.fullmatch(r"cpu|cuda(:\d+)?|mps", self.device)), f"unknown device {self.device}")


@dataclass(frozen=True)
class Settings:
    """Everything that a run can set."""

    reference_text_max_length: int = 10_000
    max_candidates: int = 100
    seed: int | None = 42
    semantics_weight: float = 0.7
    max_results: int = 5
    version: str = "1"
    cleaning: Cleaning = field(default_factory=Cleaning)
    keywords: Keywords = field(default_factory=Keywords)
    extraction: Extraction = field(default_factory=Extraction)
    cache: Cache = field(default_factory=Cache)
    encoder: Encoder = field(default_factory=Encoder)

    def __post_init__(self) -> None:
        _need(self.reference_text_max_length > 0, "reference_text_max_length must be positive")
        _need(self.max_candidates > 0, "max_candidates must be positive")
        _need(0 <= self.semantics_weight <= 1, "semantics_weight must be in [0, 1]")


def _build(kind: type, values: dict[str, Any]) -> Any:
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := values.keys() - fields.keys():
        raise ConfigurationError(f"unknown keys: {sorted(unknown)}")
    out = {}
    for k, v in values.items():
        nested = {"cleaning": Cleaning, "keywords": Keywords, "extraction": Extraction, "cache": Cache, "encoder": Encoder}.get(k) if kind is Settings else None
        if nested and not isinstance(v, dict):
            raise ConfigurationError(f"{k} must be a table")
        out[k] = _build(nested, v) if nested else tuple(v) if isinstance(v, list) else v
    try:
        return kind(**out)
    except TypeError as e:
        raise ConfigurationError(str(e)) from e


def load(path: str | Path) -> Settings:
    """Settings from a TOML file; a missing or invalid file is a ConfigurationError."""
    try:
        return _build(Settings, tomllib.loads(Path(path).read_text(encoding="utf-8")))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigurationError(f"cannot read {path}: {e}") from e


def fingerprint(values: Any) -> str:
    """SHA-1 of the values as sorted, indented JSON."""
    if dataclasses.is_dataclass(values):
        values = dataclasses.asdict(values)
    return hashlib.sha1(json.dumps(values, sort_keys=True, indent=2, default=str).encode()).hexdigest()


def differences(a: dict[str, Any], b: dict[str, Any]) -> list[str]:
    """Keys whose values differ; floats within 1e-12 of each other do not."""
    out = []
    for k in sorted(a.keys() | b.keys()):
        x, y = a.get(k), b.get(k)
        same = math.isclose(x, y, rel_tol=0, abs_tol=1e-12) if isinstance(x, float) and isinstance(y, float) else x == y
        if not same:
            out.append(k)
    return out


def path_name(name: str) -> str:
    """Spaces and hyphens as underscores."""
    return re.sub(r"[ -]", "_", name)


def encoder_file(inputs: int, outputs: int) -> str:
    return f"mlp_encoder_in{inputs}_out{outputs}.pkl"


def files_digest(paths: list[str | Path]) -> str:
    """SHA-256 over each file's name and bytes, in the given order."""
    h = hashlib.sha256()
    for p in map(Path, paths):
        h.update(p.name.encode())
        h.update(p.read_bytes())
    return h.hexdigest()
