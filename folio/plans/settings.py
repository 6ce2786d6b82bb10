"""Settings from arguments, environment and a file: what a run is told, in that order."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping
from dataclasses import fields
from pathlib import Path


def load(path: str) -> dict:
    """A settings file. Missing, broken or no object: empty."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def save(path: str, settings: Mapping) -> None:
    """Replaces the file as a whole or not at all."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=at.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(dict(settings), f, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(beside, at)


def resolve(names: Mapping[str, str | None], defaults: Mapping, stored: Mapping, arguments: Mapping, environment: Mapping | None = None) -> dict:
    """A value for each name: default < stored < environment (its variable, if it has one) < argument. Null says nothing."""
    environment = os.environ if environment is None else environment
    out = {}
    for name, variable in names.items():
        values = [defaults.get(name), stored.get(name), environment.get(variable) if variable else None, arguments.get(name)]
        out[name] = next((v for v in reversed(values) if v is not None), None)
    return out


def known(kind: type, settings: Mapping) -> dict:
    """Those settings that a record has fields for; unknown ones are left out."""
    names = {f.name for f in fields(kind)}
    return {k: v for k, v in settings.items() if k in names}
