"""All queries over the synthetic tables with their SQL."""

from __future__ import annotations

from histframe.plans import content, graph, integrity, logs, lookup, reading, rules, snapshots, states, values

_PLANS = [snapshots, logs, rules, graph, content, lookup, values, integrity, reading, states]

QUERIES = {name: q for plan in _PLANS for name, q in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
