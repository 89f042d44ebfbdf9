"""Cross-check of the library against SQL on the supplied tables."""
from __future__ import annotations

from importlib import import_module

MODULES = ("time", "source", "feature", "spatial", "onset", "balance", "risk", "rollup", "stream", "plan", "record", "geometry", "calibration")


def load():
    for m in MODULES:
        import_module(f"crosscheck.{m}_queries")
    from crosscheck.registry import ORACLE, QUERIES
    return dict(QUERIES), dict(ORACLE)
