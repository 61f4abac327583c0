"""Registered queries with their checking SQL."""

from fraudloom.registry.core import ORACLES, QUERIES


def load() -> None:
    """Imports every module that registers queries."""
    from fraudloom.registry import (  # noqa: F401
        dashboard, detection, ingest, lifecycle, messaging, model, reads, streams,
    )


__all__ = ["ORACLES", "QUERIES", "load"]
