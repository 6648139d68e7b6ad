"""Queries over the test tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import importlib

MODULES = ["corpus", "relational", "retrieval", "evaluation", "curation"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"textloom.plans.{name}")


def queries() -> dict:
    from textloom.plans import registry

    _load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    from textloom.plans import registry

    _load()
    return dict(registry.ORACLES)
