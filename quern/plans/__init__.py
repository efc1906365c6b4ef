"""Named queries over the tables. load() imports every module that registers some."""

from __future__ import annotations

import importlib

_MODULES = ["retrieval", "graph", "tables", "text", "scoring", "dedup", "evidence", "control", "small", "understanding", "claims", "knowledge", "chunkers", "augmented", "decisions", "sources", "service", "real"]


def load():
    from quern.plans import catalog

    for name in _MODULES:
        importlib.import_module(f"quern.plans.{name}")
    return catalog
