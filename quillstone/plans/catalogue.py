"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from . import chains, design, entries, evaluation, more, rankings, records, rounds, rules, searches, trajectories

MODULES = (evaluation, trajectories, rankings, searches, rules, more, records, entries, design, rounds, chains)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLES.items()}
