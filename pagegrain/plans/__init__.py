"""The catalogue of operators: ``queries()`` over the base tables and ``oracles()`` for checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagegrain.operators import load_all
from pagegrain.plans import bindings as _bindings  # noqa: F401  registers views
from pagegrain.plans.registry import FRAMES, OPS, oracle, run

load_all()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: run(spark, name, sf_dir)) for name in [*OPS, *FRAMES]}


def oracles() -> dict[str, str]:
    return {name: sql for name in [*OPS, *FRAMES] if (sql := oracle(name))}
