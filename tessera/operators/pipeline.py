"""Phases that build on one another, run in the order of their needs."""

from __future__ import annotations

import time
from typing import Protocol

from tessera.operators.views import topological_order


class Phase(Protocol):
    """A step with a ``name``, the names it ``needs`` and what it makes of the results so far."""

    name: str
    needs: tuple[str, ...]

    def run(self, state: dict[str, object]) -> object: ...


def run_phases(phases: list[Phase], state: dict[str, object] | None = None) -> tuple[dict[str, object], dict[str, float]]:
    """Results by phase, on top of ``state``, and the milliseconds that each took.

    Each phase runs once, after those it needs; of equally free ones the first given. A need that is no phase has to be in
    ``state``; a cycle, a missing need or two phases of one name are errors before anything runs.
    """
    results = dict(state or {})
    by_name = {p.name: p for p in phases}
    if len(by_name) < len(phases):
        raise ValueError("two phases have one name")
    order = topological_order({p.name: [n for n in p.needs if n in by_name or n not in results] for p in phases})
    took: dict[str, float] = {}
    for name in order:
        began = time.perf_counter()
        results[name] = by_name[name].run(results)
        took[name] = (time.perf_counter() - began) * 1000
    return results, took
