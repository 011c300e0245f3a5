"""Models of this Python worker. A module that tasks import, so that one load serves all tasks of
the process; what a function carries along is copied per task."""

from __future__ import annotations

from collections.abc import Callable

_LOADED: dict[str, object] = {}


def model(key: str, load: Callable[[], object]) -> object:
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]
