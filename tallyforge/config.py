"""Settings of an audit: defaults, what a JSON file puts over them, and what the environment puts over both."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from typing import Any

from tallyforge.functions.normalise import METHOD_NAMES, RESULT_NAMES
from tallyforge.operators.matching import RULES
from tallyforge.operators.rules import FINDINGS, SWITCHES
from tallyforge.sources.cells import DISCIPLINES, HEADERS

#: Prefix of variables that override a setting: TALLYFORGE_MATCHING__JUDGE_GAP=5 sets matching.judge_gap.
PREFIX = "TALLYFORGE_"


def defaults() -> dict[str, Any]:
    """All settings as the library has them."""
    return {
        "methods": {k: list(v) for k, v in METHOD_NAMES.items()},
        "results": {k: list(v) for k, v in RESULT_NAMES.items()},
        "disciplines": dict(DISCIPLINES),
        "headers": dict(HEADERS),
        "matching": {"rules": [list(r) for r in RULES], "thresholds": {"joint_no": 85, "ndt_method": 100, "welder_id": 90}, "candidates": 5, "judge": True, "judge_gap": 10, "hold_gap": 5},
        "weights": {name: weight for name, (weight, _) in FINDINGS.items()},
        "switches": dict(SWITCHES),
        "retry": {"attempts": 5, "first_seconds": 2, "most_seconds": 60},
        "providers": {},
        "stage_providers": {},
        "default_provider": None,
    }


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """base with the values of over in place of its own; tables within tables are merged alike."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def from_environment(settings: dict[str, Any], variables: dict[str, str]) -> dict[str, Any]:
    """Settings with those that variables name by path; values are read as JSON, or else as text. Unknown paths are an error."""
    for name, text in sorted(variables.items()):
        if not name.startswith(PREFIX):
            continue
        path = name[len(PREFIX) :].lower().split("__")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        place = settings
        for part in path[:-1]:
            place = place[part]
        if path[-1] not in place:
            raise KeyError(f"no setting {'.'.join(path)}")
        over: Any = value
        for part in reversed(path):
            over = {part: over}
        settings = merged(settings, over)
    return settings


@lru_cache(maxsize=8)
def _file(path: str, changed: float) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def settings(path: str | None = None, variables: dict[str, str] | None = None) -> dict[str, Any]:
    """Defaults, then a JSON file on the driver (read anew when it changes), then variables of the environment."""
    found = defaults()
    if path:
        found = merged(found, json.loads(_file(path, os.path.getmtime(path))))
    return from_environment(found, dict(os.environ) if variables is None else variables)


def provider(stage: str, found: dict[str, Any]) -> dict[str, Any]:
    """The provider of a stage, with its retry rule: the stage's own, else the default; an unknown name is an error."""
    name = found["stage_providers"].get(stage) or found["default_provider"]
    if name is None:
        return {"name": None, "retry": found["retry"]}
    if name not in found["providers"]:
        raise KeyError(f"no provider {name}; known: {', '.join(sorted(found['providers'])) or 'none'}")
    return {"name": name, "retry": found["retry"]} | found["providers"][name]
