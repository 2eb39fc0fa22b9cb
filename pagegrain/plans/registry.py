"""Operators by name: their SQL, the views they read, and how to run them.

An operator is a function of a dialect that returns SQL over views (``regions``,
``blocks``, ``calls`` ...). ``run`` takes the views from the caller's DataFrames; views that
are not given come from ``bindings``, which derive them from the base tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagegrain.plans.dialect import DUCK, SPARK, Spark
from pagegrain.sources.scratch import materialize

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
VIEWS: dict[str, Callable[[Spark], str]] = {}
OPS: dict[str, Callable[[Spark], str]] = {}
KEPT: set[str] = set()


def view(f):
    VIEWS[f.__name__] = f
    return f


def kept(f):
    """A view that a statement uses in several places is written once."""
    KEPT.add(f.__name__)
    return view(f)


DIRECT: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}


def direct(name: str, table: str):
    """How Spark makes a view from a base table at once; its SQL holds where the caller gives views that it is made of, and for checks."""

    def put(f):
        DIRECT[name] = table, f
        return f

    return put


def op(name: str):
    def put(f):
        OPS[name] = f
        return f

    return put


FRAMES: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame], Callable[[Spark], str] | None]] = {}


def frame(name: str, *views: str, check: Callable[[Spark], str] | None = None):
    """An operator over DataFrames: a function of the named views and of parameters by keyword.

    ``a|b`` takes the caller's a or b, and b where neither is given.
    ``check`` gives SQL over the same views for DuckDB, written apart from the function.
    """

    def put(f):
        FRAMES[name] = (views, f, check)
        return f

    return put


def _needs(sql: str, names) -> list[str]:
    found = set(re.findall(r"[a-z_][a-z_0-9]*", sql))
    return [n for n in names if n in found]


def _ordered(sql: str, d: Spark, given: set[str]) -> list[str]:
    out: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text, VIEWS):
            if name not in out and name not in given:
                visit(VIEWS[name](d))
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def text(name: str, d: Spark, given: dict[str, str] | None = None, tables: dict[str, str] | None = None) -> str:
    """The whole statement of an operator: given views and base tables by the names they have, other views defined."""
    return bound(OPS[name](d), d, given, tables)


def bound(sql: str, d: Spark, given: dict[str, str] | None = None, tables: dict[str, str] | None = None) -> str:
    given, tables = given or {}, tables or {}
    if sql.lstrip().startswith("with "):
        sql = f"select * from ({sql}) q"
    views = _ordered(sql, d, set(given))
    parts = [f"{v} as (select * from {at})" for v, at in [*tables.items(), *given.items()]]
    parts += [f"{v} as ({VIEWS[v](d)})" for v in views]
    if not parts:
        return sql
    return f"with {', '.join(parts)} {sql}"


def run(spark: SparkSession, name: str, sf_dir: str | None = None, **given) -> DataFrame:
    """Run an operator over the caller's views, or over those bound to the tables in ``sf_dir``.

    Operators over DataFrames also take their parameters here.
    """
    if name in FRAMES:
        views, f, _ = FRAMES[name]
        names = [next((n for n in v.split("|") if n in given), v.split("|")[-1]) for v in views]
        below = {v: given.pop(v) for v in list(given) if v in VIEWS and v not in names}  # the caller's views that others are made of
        frames = [given.pop(v) if v in given else view_of(spark, v, sf_dir, below) for v in names]
        return f(*frames, **given)
    return _sql(spark, OPS[name](SPARK), sf_dir, given)


def view_of(spark: SparkSession, name: str, sf_dir: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view, or a base table, bound to the tables in ``sf_dir`` and to given views."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _sql(spark, f"select * from {name}", sf_dir, given or {})


def _sql(spark: SparkSession, sql: str, sf_dir: str | None, views: dict[str, DataFrame]) -> DataFrame:
    views = _with_kept(spark, sql, sf_dir, _with_direct(spark, sql, sf_dir, dict(views)))
    tag = uuid.uuid4().hex[:8]
    given = {v: f"{v}_{tag}" for v in views}
    every = _every(sql, set(views))
    tables = {t: f"{t}_{tag}" for t in _needs(every, TABLES) if t not in views} if sf_dir else {}
    frames = {at: views[v] for v, at in given.items()} | {at: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t, at in tables.items()}
    try:
        for at, df in frames.items():
            df.createOrReplaceTempView(at)
        return spark.sql(bound(sql, SPARK, given, tables))
    finally:  # the plan holds what the names stood for
        for at in frames:
            spark.catalog.dropTempView(at)


def _every(sql: str, given: set[str]) -> str:
    """The statement with all views it needs."""
    return " ".join([sql, *(VIEWS[v](SPARK) for v in _ordered(sql, SPARK, given))])


def _with_direct(spark: SparkSession, sql: str, sf_dir: str | None, views: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Views that Spark makes from a base table at once, unless the caller gives something below them."""
    for name in _ordered(sql, SPARK, set(views)) if sf_dir else ():
        if name in DIRECT:
            table, f = DIRECT[name]
            below = {table, *_ordered(VIEWS[name](SPARK), SPARK, set())}
            if not below & set(views):
                views[name] = f(view_of(spark, table, sf_dir))
    return views


def _with_kept(spark: SparkSession, sql: str, sf_dir: str | None, views: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Costly views that a statement names more than once are worked out once, written and read back."""
    for name in _ordered(sql, SPARK, set(views)):
        if name in KEPT and len(re.findall(rf"\b{name}\b", _every(sql, set(views)))) > 1:
            views[name] = materialize(_sql(spark, f"select * from {name}", sf_dir, views), name)
    return views


def oracle(name: str) -> str | None:
    """The SQL for DuckDB; none for an operator over DataFrames that has no check."""
    if name in FRAMES:
        check = FRAMES[name][2]
        return bound(check(DUCK), DUCK) if check else None
    return text(name, DUCK)
