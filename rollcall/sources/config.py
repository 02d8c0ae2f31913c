"""SRC25: settings from defaults, a file's mapping and dotted overrides, in this order; unknown keys and wrong types are errors."""

from __future__ import annotations

import dataclasses
from typing import Any, TypeVar

C = TypeVar("C")


def _set(config: Any, path: list[str], value: Any) -> Any:
    names = {f.name: f for f in dataclasses.fields(config)}
    if path[0] not in names:
        raise KeyError(f"unknown setting {'.'.join(path)}")
    now = getattr(config, path[0])
    if len(path) > 1:
        return dataclasses.replace(config, **{path[0]: _set(now, path[1:], value)})
    if isinstance(value, dict) and dataclasses.is_dataclass(now):
        for k, v in value.items():
            now = _set(now, [k], v)
        return dataclasses.replace(config, **{path[0]: now})
    if isinstance(value, str) and not isinstance(now, str) and now is not None:
        value = {"true": True, "false": False}[value.lower()] if isinstance(now, bool) else type(now)(value)
    if isinstance(now, float) and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if now is not None and type(value) is not type(now):
        raise TypeError(f"{path[0]} is a {type(now).__name__}, not a {type(value).__name__}")
    return dataclasses.replace(config, **{path[0]: value})


def load(defaults: C, mapping: dict | None = None, overrides: list[str] | None = None) -> C:
    """defaults is a dataclass instance; overrides are like `model.width=64`."""
    out = defaults
    for k, v in (mapping or {}).items():
        out = _set(out, [k], v)
    for line in overrides or []:
        key, sign, value = line.partition("=")
        if not sign:
            raise ValueError(f"{line} has no value")
        out = _set(out, key.strip().split("."), value.strip())
    return out
