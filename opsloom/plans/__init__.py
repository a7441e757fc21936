"""Runnable queries over the driver's tables, one module per domain."""

from __future__ import annotations

import importlib

MODULES = (
    "warehouse_queries",
    "trace_queries",
    "detection_queries",
    "incident_queries",
    "claim_queries",
    "text_queries",
    "retrieval_queries",
    "graph_queries",
    "governance_queries",
    "evaluation_queries",
    "storage_queries",
    "stream_queries",
)


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"opsloom.plans.{module}")
