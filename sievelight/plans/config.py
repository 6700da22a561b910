"""Project configuration: the nearest file upwards, or a key of package.json; unknown keys and wrong types are errors."""

from __future__ import annotations

import json
import os

from ..operators.model import is_severity

FILENAMES, PACKAGE_KEY = ("sievelight.config.json", ".sievelightrc.json", ".sievelightrc"), "sievelight"
_TEXTS, _FLAGS, _NUMBERS = ("exclude", "include", "rules", "disableRules", "allow"), ("respectGitignore", "followSymlinks"), ("maxFileSize", "concurrency")
KEYS = (*_TEXTS, *_FLAGS, *_NUMBERS, "severity", "failOn", "baseline")


def validate(value: object, source: str) -> dict:
    if not isinstance(value, dict):
        raise ValueError(f"{source} must hold a JSON object")
    for key, x in value.items():
        fine = {
            **{k: isinstance(x, list) and all(isinstance(y, str) for y in x) for k in _TEXTS},
            **{k: isinstance(x, bool) for k in _FLAGS},
            **{k: isinstance(x, (int, float)) and not isinstance(x, bool) and 0 < x < float("inf") for k in _NUMBERS},
            "severity": is_severity(x), "failOn": is_severity(x) or x == "never", "baseline": isinstance(x, str), "$schema": True,
        }
        if key not in fine:
            raise ValueError(f'{source}: unknown option "{key}"; valid options: {", ".join(KEYS)}')
        if not fine[key]:
            raise ValueError(f'{source}: "{key}" has a wrong value')
    return {k: v for k, v in value.items() if k != "$schema"}


def _json(path: str) -> object | None:
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        try:
            return json.load(f)
        except ValueError as e:
            raise ValueError(f"{path} is not valid JSON: {e}") from e


def load(start: str) -> tuple[dict, str | None]:
    """The configuration that holds for a folder, and the file it came from."""
    folder = os.path.abspath(start)
    while True:
        for name in FILENAMES:
            path = os.path.join(folder, name)
            value = _json(path)
            if value is not None:
                return validate(value, path), path
        path = os.path.join(folder, "package.json")
        package = _json(path)
        if isinstance(package, dict) and PACKAGE_KEY in package:
            return validate(package[PACKAGE_KEY], path), path
        parent = os.path.dirname(folder)
        if parent == folder:
            return {}, None
        folder = parent
