"""One large cache per Python worker.

Workers outlive their tasks, and a pipeline runs several operators in them. A cache of words is kept
for the operator's next task and dropped when another operator's task starts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_KEPT: dict[str, Any] = {}


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]
