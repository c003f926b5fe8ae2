"""Registries: processing steps, analyses, user functions per frame, and the queries of the driver contract."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .model import FRAME

STEPS: dict[str, Callable[..., DataFrame]] = {}
ANALYSES: dict[str, Callable[..., dict[str, DataFrame]]] = {}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def step(name: str):
    """Register a processing step: ``(pixels, **params) -> pixels``."""

    def add(f):
        STEPS[name] = f
        return f

    return add


def analysis(name: str):
    """Register an analysis: ``(pixels, **params) -> {labels, regions, ...}``."""

    def add(f):
        ANALYSES[name] = f
        return f

    return add


def map_frames(pixels: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user function to each plane; one plane must fit a task."""
    return pixels.groupBy(*FRAME).applyInPandas(fn, schema)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB equivalent, if SQL can express it."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    import importlib
    import pkgutil

    from . import catalogue

    for module in pkgutil.iter_modules(catalogue.__path__):
        importlib.import_module(f"{catalogue.__name__}.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
