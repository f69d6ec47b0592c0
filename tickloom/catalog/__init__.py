"""Named queries over the order, line-item, event and document tables."""

from __future__ import annotations

import importlib

MODULES = ("cleaning", "technical", "trading", "scoring", "learning")


def load_all() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from tickloom.catalog.base import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
