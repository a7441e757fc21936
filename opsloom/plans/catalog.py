"""Registry of runnable queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Build
    oracle: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in _ENTRIES:
            raise ValueError(f"query {name} registered twice")
        _ENTRIES[name] = Entry(name, build, oracle)
        return build

    return register


def entries() -> dict[str, Entry]:
    from opsloom.plans import load_all

    load_all()
    return dict(_ENTRIES)
