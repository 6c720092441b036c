"""Registered queries: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.plans.oracle import with_ctes
from pitline.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _exact_rounding(sql: str) -> str:
    """Spell ``round(x, n) + 0.0`` as ``floor(x * 10^n + 0.5) / 10^n``.

    Both engines then do the same double arithmetic, also halfway between two digits.
    """
    at = sql.find("round(")
    while at >= 0:
        depth, end = 0, at + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            end += 1
        if sql[end + 1 :].lstrip().startswith("+ 0.0"):
            inner, digits = sql[at + 6 : end].rsplit(",", 1)
            after = sql.index("+ 0.0", end) + 5
            scale = f"1e{int(digits)}"
            sql = f"{sql[:at]}(floor(({inner}) * {scale} + 0.5) / {scale}){sql[after:]}"
        at = sql.find("round(", at + 1)
    return sql


def query(ctes: list[str] | str | None = None, sql: str | None = None):
    """Register a query under its function name, with the SQL that must agree with it."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = _exact_rounding(with_ctes(ctes, sql) if ctes else sql)
        return fn

    return add


_SHARED: dict[tuple[str, str, str], object] = {}


def shared(spark: SparkSession, sf: str, name: str, build: Callable[[], object]):
    """Intermediate tables several queries need, built once per application and input folder.

    They are written to the shared folder, like the tables of any job with more than one report.
    """
    app = spark.sparkContext.applicationId
    folder = shared_dir(spark)
    if "://" not in folder:  # a local folder may have been cleared: then build everything anew
        mark = os.path.join(folder, f"pitline-{app}")
        if not os.path.isdir(mark):
            forget_shared()
            os.makedirs(mark, exist_ok=True)
    key = (app, sf, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def forget_shared() -> None:
    """Build intermediate tables anew; the bench does so to time each query in full."""
    _SHARED.clear()


def r(column, digits: int = 6):
    """Round for output, spelled as the SQL side spells it (see ``_exact_rounding``)."""
    c = F.col(column) if isinstance(column, str) else column
    scale = F.lit(float(10**digits))
    return F.floor(c.cast("double") * scale + 0.5).cast("double") / scale
