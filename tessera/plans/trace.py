"""What was planned for the last operations, and the thresholds that a user may set.

Spark itself decides what stays in memory and what spills, so a threshold here
changes the reported route only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

_LAST: dict[str, dict] = {}
_ORDER: list[str] = []
_SETTINGS: dict[str, int | None] = {"memory": None, "streaming": None}


def note(op: str, route: str, **more) -> None:
    _LAST[op] = {"op": op, "route": route, **more}
    if op in _ORDER:
        _ORDER.remove(op)
    _ORDER.append(op)


def last_io_trace(op: str | None = None) -> dict | None:
    key = op or (_ORDER[-1] if _ORDER else None)
    return dict(_LAST[key]) if key in _LAST else None


def clear_io_traces() -> None:
    _LAST.clear()
    _ORDER.clear()


def last_kernel_trace() -> str:
    found = last_io_trace()
    return f"{found['op']}.{found['route']}" if found else ""


def get_memory_threshold() -> int | None:
    return _SETTINGS["memory"]


def set_memory_threshold(limit: int | None) -> int | None:
    _SETTINGS["memory"] = _limit(limit)
    return limit


def get_io_streaming_threshold() -> int | None:
    return _SETTINGS["streaming"]


def set_io_streaming_threshold(limit: int | None) -> int | None:
    _SETTINGS["streaming"] = _limit(limit)
    return limit


def _limit(limit):
    if limit is not None and (not isinstance(limit, int) or limit < 0):
        raise ValueError("a limit is a number of bytes, or None")
    return limit


def route(n_bytes: float, single_task: int) -> str:
    """Whether an operation with this payload goes to one task or is distributed."""
    limit = _SETTINGS["streaming"] if _SETTINGS["streaming"] is not None else _SETTINGS["memory"]
    return "distributed" if n_bytes > (single_task if limit is None else limit) else "single"


@dataclass
class Operation:
    """An operation that a user registers: how it is guarded and how large its blocks are."""

    name: str
    run: Callable
    guard: Callable[..., bool] = lambda *a: True
    block: Callable[..., int] = lambda *a: 256
    notes: dict = field(default_factory=dict)


class Registry:
    def __init__(self):
        self._found: dict[str, Operation] = {}

    def register(self, operation: Operation) -> None:
        self._found[operation.name] = operation

    def names(self) -> list[str]:
        return sorted(self._found)

    def run(self, name: str, *args):
        op = self._found[name]
        if not op.guard(*args):
            raise ValueError(f"{name} does not take these operands")
        note(name, "registered", block=op.block(*args))
        return op.run(*args)


registry = Registry()
