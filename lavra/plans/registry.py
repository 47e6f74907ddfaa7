"""Queries of the core and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "lavra.operators.csv_rejects",
    "lavra.operators.packed_values",
    "lavra.plans.catalog",
    "lavra.plans.texts",
    "lavra.plans.retrieval",
    "lavra.plans.pipeline",
    "lavra.plans.evaluation",
    "lavra.plans.structure",
    "lavra.plans.dialogue",
    "lavra.plans.upkeep",
    "lavra.plans.scores",
    "lavra.operators.answers",
    "lavra.operators.ingest",
    "lavra.operators.chunker",
    "lavra.streaming.jobs",
]


def _collect(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(m), name).items()}


def queries() -> dict:
    return _collect("QUERIES")


def oracle() -> dict:
    return _collect("ORACLE")
