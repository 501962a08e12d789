"""Settings: nested defaults, files, environment and literals."""

from __future__ import annotations

import json
import logging
import os
from pathlib import Path
from typing import Any

log = logging.getLogger("veldra")
#: Defaults of the pipeline.
DEFAULTS: dict[str, Any] = {
    "chunking": {"strategy": "recursive", "chunk_size": 512, "chunk_overlap": 50},
    "embedding": {"model": "hashing", "dim": 64},
    "index": {"kind": "exact", "lists": 0, "probes": 0, "share": 0.95, "rounds": 20, "links": 12, "candidates": 16, "ef": 100},
    "retrieval": {"top_k": 50, "final_k": 10},
    "reranking": {"model": "overlap", "enabled": True},
    "generation": {"strategy": "replug", "budget": 15_000},
    "llm": {"base_url": "", "model": "", "api_key": "", "max_tokens": 1024, "temperature": 0.0},
}


def warn(message: str) -> None:
    log.warning(message)


def coerce(value: str) -> Any:
    """A literal as bool, int, float or, if none fits, text."""
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def dotenv(path: str) -> dict[str, str]:
    """``key=value`` lines of a file; comments and other lines are skipped."""
    out: dict[str, str] = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, mark, value = line.strip().partition("=")
            if mark and not key.startswith("#"):
                out[key.strip()] = value.strip()
    return out


class Config:
    """Nested settings: defaults, then a JSON or YAML file, then ``PREFIX_SECTION_KEY`` of the environment."""

    def __init__(self, path: str | None = None, prefix: str = "VELDRA", environ: dict[str, str] | None = None):
        self.values = json.loads(json.dumps(DEFAULTS))
        if path and Path(path).is_file():
            self._merge(self.values, read_settings(path))
        for name, value in (os.environ if environ is None else environ).items():
            for section, keys in DEFAULTS.items():
                for key in keys:
                    if name == f"{prefix}_{section}_{key}".upper():
                        self.values[section][key] = coerce(value)

    def _merge(self, old: dict, new: dict) -> None:
        for key, value in new.items():
            if isinstance(value, dict) and isinstance(old.get(key), dict):
                self._merge(old[key], value)
            else:
                old[key] = value

    def get(self, *path: str, default: Any = None) -> Any:
        at: Any = self.values
        for key in path:
            if not isinstance(at, dict) or key not in at:
                return default
            at = at[key]
        return at


def read_settings(path: str) -> dict[str, Any]:
    """Settings of a JSON file, or of a YAML file if that library is there."""
    text = Path(path).read_text(encoding="utf-8")
    if not path.lower().endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need the library yaml") from e
    return yaml.safe_load(text) or {}


def load_given(path: str) -> dict[str, Any]:
    """Stored arguments of a tool; none if the file is missing."""
    return json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).is_file() else {}


def save_given(path: str, given: dict[str, Any]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(given, indent=2, sort_keys=True), encoding="utf-8")


def over_stored(stored: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """Given values over stored ones; None and False count as not given."""
    return stored | {k: v for k, v in given.items() if v is not None and v is not False}
