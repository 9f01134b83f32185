"""Registered queries, one module per section of the operator inventory."""

from __future__ import annotations

from importlib import import_module

MODULES = ("projections", "filters", "reshaping", "aggregates", "ranking", "sources", "decisions", "states", "extraction", "vocabularies", "linking", "models", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"attestry.plans.{name}")
