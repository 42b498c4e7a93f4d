"""Registry pairing a Spark query with its SQL and one output schema for both."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import Tables
from checks.views_sql import VIEWS

SPARK_TYPES = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
SQL_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Check:
    cols: tuple[tuple[str, str], ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def register(key: str, cols: str, sql: str | None = None):
    """Decorator: ``cols`` is "name:type ..." with l, d, s, b for the types."""

    def add(run: Callable[[Tables], DataFrame]):
        if key in CHECKS:
            raise ValueError(f"duplicate query {key}")
        parsed = tuple(tuple(c.split(":")) for c in cols.split())
        CHECKS[key] = Check(parsed, run, sql)
        return run

    return add


def joined(col: str):
    """Integer or text array as comma text, the same in both engines."""
    return F.concat_ws(",", F.col(col).cast("array<string>"))


def _with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)


def spark_query(key: str) -> Callable[[SparkSession, str], DataFrame]:
    check = CHECKS[key]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = check.run(Tables(spark, sf_dir))
        return out.select(*[F.col(n).cast(SPARK_TYPES[t]).alias(n) for n, t in check.cols])

    return query


def oracle(key: str) -> str | None:
    check = CHECKS[key]
    if check.sql is None:
        return None
    ctes = _with_views(check.sql)
    head = f"WITH RECURSIVE {ctes},\n" if ctes else "WITH RECURSIVE "
    cast = ", ".join(f"CAST({n} AS {SQL_TYPES[t]}) AS {n}" for n, t in check.cols)
    return f"{head}answer AS ({check.sql})\nSELECT {cast} FROM answer"
