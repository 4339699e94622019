"""Application configuration: TOML or JSON over defaults, paths resolved beside the file."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import Any

# The defaults under every configuration.
DEFAULTS: dict[str, Any] = {
    "parallelism": 2,
    "search_orientation": "vertex",
    "response_persistence_policy": "persist_response_in_memory",
    "algorithm": {"type": "a*"},
    "label": {"type": "vertex"},
    "constraint": {"type": "no_restriction"},
    "mapping": {"queries_without_destinations": True, "matching_type": ["point", "vertex", "edge"]},
    "plugin": {"input_plugins": [], "output_plugins": []},
    "termination": {"type": "query_runtime", "limit": "00:01:00", "frequency": 100000},
}


class ConfigError(ValueError):
    """A configuration that lacks something or has it in the wrong form."""


def merge(base: dict, over: dict) -> dict:
    """``over`` before ``base``, tables merged key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path) -> dict:
    path = Path(path)
    try:
        text = path.read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigError(f"cannot read {path}: {e}") from e
    try:
        made = tomllib.loads(text) if path.suffix == ".toml" else json.loads(text)
    except ValueError as e:
        raise ConfigError(f"{path}: {e}") from e
    return resolved(merge(DEFAULTS, made), path.parent)


def resolved(config: Any, base: Path, key: str = "") -> Any:
    """Values under keys that end in input_file or input_files as paths beside the configuration; missing files are errors."""
    if isinstance(config, dict):
        return {k: resolved(v, base, k) for k, v in config.items()}
    if isinstance(config, list):
        return [resolved(v, base, key) for v in config]
    if isinstance(config, str) and key.endswith(("input_file", "input_files")):
        for p in (Path(config), base / config):
            if p.exists():
                return str(p)
        raise ConfigError(f"no file '{config}' for '{key}'")
    return config


_MISSING = object()


def get(config: dict, key: str, kind: type | tuple = object, default: Any = _MISSING) -> Any:
    """A typed value under a dotted key; an error if it is missing (without a default) or of another type."""
    at: Any = config
    for part in key.split("."):
        if not isinstance(at, dict) or part not in at:
            if default is _MISSING:
                raise ConfigError(f"'{key}' is missing")
            return default
        at = at[part]
    if kind is float and isinstance(at, int) and not isinstance(at, bool):
        return float(at)
    if not isinstance(at, kind) or (kind in (int, float) and isinstance(at, bool)):
        raise ConfigError(f"'{key}' is not {getattr(kind, '__name__', kind)}")
    return at


def section(config: dict, key: str) -> dict:
    return get(config, key, dict)


def path_of(config: dict, key: str) -> Path:
    p = Path(get(config, key, str))
    if not p.exists():
        raise ConfigError(f"'{key}': no file {p}")
    return p


def parsed(config: dict, key: str, of) -> Any:
    """A value through ``of``, whose ValueError becomes a ConfigError."""
    try:
        return of(get(config, key))
    except (ValueError, TypeError, KeyError) as e:
        raise ConfigError(f"'{key}': {e}") from e


def one_or_many(value: Any) -> list:
    return value if isinstance(value, list) else [value]
