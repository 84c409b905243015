"""All registered queries in one place."""

from __future__ import annotations

from importlib import import_module

MODULES = ["text_queries", "metric_queries", "window_queries", "neighbor_queries", "flood_queries", "verdict_queries", "source_queries", "sample_queries"]


def _merged(attribute: str) -> dict:
    out = {}
    for name in MODULES:
        part = getattr(import_module(f"registry.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
