"""Caches of reused Python workers: only the family in use keeps its memory."""

from __future__ import annotations

from collections.abc import Callable

_CLEAR: dict[str, Callable[[], None]] = {}


def family(name: str, clear: Callable[[], None]) -> None:
    _CLEAR[name] = clear


def only(name: str) -> None:
    """Called where a task begins: empties the other families."""
    for other, clear in _CLEAR.items():
        if other != name:
            clear()
