"""Settings files: JSON objects laid over defaults."""

from __future__ import annotations

import json

from tessera.sources import store


def laid_over(defaults: dict, own: dict) -> dict:
    """The defaults with what ``own`` sets; objects within are laid over each other likewise."""
    return defaults | {k: laid_over(defaults[k], v) if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v for k, v in own.items()}


def read_config(path: str, defaults: dict) -> dict:
    """The settings of a file, which may be absent or empty."""
    text = store.read_range(path, 0, store.size_of(path)).decode() if store.kind(path) == "file" else ""
    return laid_over(defaults, json.loads(text) if text.strip() else {})
