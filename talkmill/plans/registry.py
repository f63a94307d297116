"""All queries of the core library, by name."""

from __future__ import annotations

from talkmill.plans import agreement, files, general, items, names, privacy, reports, sampling, scoring, turns

MODULES = [general, items, turns, names, agreement, scoring, sampling, privacy, reports, files]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items() if sql}
