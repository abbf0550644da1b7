"""Registered queries and the SQL each is checked against.

``query`` registers a function of ``Inputs``. Its SQL may name the views of
``oracle_views``; those it needs are put in front as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.plans.inputs import Inputs
from corpusmill.plans.oracle_views import VIEWS
from corpusmill.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str, locals_: str = "", instead: dict[str, str] | None = None) -> str:
    """``body`` behind the views it names, each after those it builds on; ``instead`` replaces some of them."""
    done: dict[str, str] = {}
    views = VIEWS | (instead or {})

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in views and name not in done:
                need(views[name])
                done[name] = views[name]

    need(locals_ + body)
    parts = [f"{name} AS ({text.strip()})" for name, text in done.items()]
    if locals_:
        parts.append(locals_.strip())
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def _plain_times(df: DataFrame) -> DataFrame:
    """Instants without a zone, as the given tables have them."""
    return df.select(
        *[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name for f in df.schema]
    )


def query(name: str, sql: str | None = None, locals_: str = "", instead: dict[str, str] | None = None) -> Callable:
    def register(build: Callable[[Inputs], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return _plain_times(build(Inputs(spark, folder)))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql, locals_, instead)
        return build

    return register
