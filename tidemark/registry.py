"""All queries outside the llm subpackage, by name, with their SQL."""

from __future__ import annotations

from tidemark.plans import actions, assortment, more, pricing, reco, risk, sales, supply, timeseries, vintages

MODULES = (sales, timeseries, assortment, pricing, supply, reco, risk, actions, more, vintages)
QUERIES: dict = {}
ORACLES: dict = {}
for module in MODULES:
    QUERIES |= module.P.queries
    ORACLES |= module.P.oracles
