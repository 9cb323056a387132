"""What Python workers keep between tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable


def worker_keeps(key: Hashable, make: Callable[[], object], most: int | None = None) -> object:
    """The value a Python worker keeps under ``key``, made by ``make`` where it has none yet.

    Functions of this package travel by value, and with each task come fresh globals; a module that is
    registered once per process outlives them. With ``most`` a worker keeps that many values of the
    key's first item and forgets the one unused for longest.
    """
    holder = sys.modules.setdefault("_stackscan_worker", types.ModuleType("_stackscan_worker"))
    kept = holder.__dict__.setdefault("kept", {})
    value = kept.pop(key, None)
    if value is None:
        value = make()
        if most is not None:
            alike = [k for k in kept if k[0] == key[0]]
            for old in alike[:len(alike) - most + 1]:
                del kept[old]
    kept[key] = value
    return value
