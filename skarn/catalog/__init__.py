"""Queries over the given tables, one module per area."""

from importlib import import_module

MODULES = (
    "telemetry", "corpus", "joins", "windows", "sources", "features", "hazard", "quality", "streams",
)


def load():
    """Import every query module and return the book they are written in."""
    for name in MODULES:
        import_module(f"skarn.catalog.{name}")
    return import_module("skarn.catalog.book")
