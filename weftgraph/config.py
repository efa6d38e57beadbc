"""Settings of a run: given values over a file over the environment over defaults, checked once."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from weftgraph.errors import ConfigurationError
from weftgraph.operators.lookup import validate_namespace

LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
PREFIX = "WEFTGRAPH_"


@dataclass
class Resolution:
    fuzzy_threshold: float = 0.85
    sequence_threshold: float = 0.75
    vector_threshold: float = 0.85
    vector_limit: int = 5

    def check(self) -> None:
        for name in ("fuzzy_threshold", "sequence_threshold", "vector_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ConfigurationError(f"{name} must be in 0 to 1")


@dataclass
class Run:
    min_confidence: float = 0.0
    skip_processed: bool = True
    max_failures: int = 5
    max_batch_docs: int | None = None

    def check(self) -> None:
        if not 0 <= self.min_confidence <= 1 or self.max_failures < 1:
            raise ConfigurationError("min_confidence must be in 0 to 1 and max_failures at least 1")


@dataclass
class Config:
    root: str = "graph"
    namespace: str = "default"
    log_level: str = "INFO"
    resolution: Resolution = field(default_factory=Resolution)
    run: Run = field(default_factory=Run)

    def check(self) -> None:
        try:
            validate_namespace(self.namespace)
        except ValueError as e:
            raise ConfigurationError(str(e)) from None
        if self.log_level not in LOG_LEVELS:
            raise ConfigurationError(f"log_level must be one of {LOG_LEVELS}")
        self.resolution.check()
        self.run.check()


def _cast(value, kind: str):
    if value is None or not isinstance(value, str):
        return value
    if "bool" in kind:
        return value.lower() in ("1", "true", "yes", "on")
    if "int" in kind:
        return int(value)
    return float(value) if "float" in kind else value


def _merge(target, values: dict, where: str = "") -> None:
    known = {f.name: f for f in fields(target)}
    for name, value in values.items():
        if name not in known:
            raise ConfigurationError(f"unknown setting {where}{name}")
        if is_dataclass(getattr(target, name)):
            _merge(getattr(target, name), value or {}, f"{where}{name}.")
        elif value is not None:
            setattr(target, name, _cast(value, str(known[name].type)))


def _from_environment(environment) -> dict:
    out: dict = {}
    for key, value in environment.items():
        if key.startswith(PREFIX):
            *path, last = key[len(PREFIX) :].lower().split("__")
            level = out
            for part in path:
                level = level.setdefault(part, {})
            level[last] = value
    return out


def load(given: dict | None = None, file: str | None = None, environment=os.environ) -> Config:
    """WEFTGRAPH_RUN__MAX_FAILURES=3 sets run.max_failures; a file is JSON, or YAML where that library is there."""
    config = Config()
    _merge(config, _from_environment(environment))
    if file and Path(file).exists():
        text = Path(file).read_text(encoding="utf-8")
        if file.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError:
                raise ConfigurationError("YAML settings need the yaml library") from None
            values = yaml.safe_load(text)
        else:
            values = json.loads(text)
        _merge(config, values or {})
    _merge(config, given or {})
    config.check()
    return config
