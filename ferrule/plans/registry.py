"""All registered queries of the engine's own operators, with their SQL twins."""

from __future__ import annotations

from . import analytics, changing, dedup, eav, inventory, lifecycle, listing, maintenance, mining, reports, rules, sources

QUERIES: dict = {}
ORACLES: dict = {}
for module in (analytics, changing, dedup, eav, inventory, lifecycle, listing, maintenance, mining, reports, rules, sources):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
