"""The catalogue of named queries and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Named:
    name: str
    build: Build
    oracle: str | None


_catalogue: dict[str, Named] = {}
_PARTS = (
    "ingest", "cleaning", "profiling", "features", "aggregates", "geography",
    "timeseries", "segments", "users", "risk", "models", "insights", "streams", "sketches", "bundles", "checked",
)


def named(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Register a query under ``name``; ``oracle`` is the equivalent SQL where there is one."""

    def keep(build: Build) -> Build:
        if name in _catalogue:
            raise ValueError(f"query {name} is registered twice")
        _catalogue[name] = Named(name, build, oracle)
        return build

    return keep


def catalogue() -> dict[str, Named]:
    for part in _PARTS:
        importlib.import_module(f"spendscope.plans.{part}_queries")
    return dict(_catalogue)
