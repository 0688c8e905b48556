"""The registered queries."""

from __future__ import annotations

import importlib

MODULES = ["q_fields", "q_pairs", "q_sequences", "q_interactions", "q_review", "q_quality", "q_library", "q_tracks", "q_suggested", "q_verify"]


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"snapspan.catalog.{name}")
    return importlib.import_module("snapspan.catalog.registry")
