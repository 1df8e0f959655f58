"""Registration of queries and of the inputs they read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborscan.queries.inputs import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        text = text["spark"] if isinstance(text, dict) else text
        used = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{table: self.table(table) for table in used})


def _with_views(sql: str) -> str:
    """Put the definitions of the views a statement uses in front of it."""
    used = sorted(set(re.findall(r"\bv_(\w+)\b", sql)))
    clauses = []
    for name in used:
        text = VIEWS[name]
        text = text["duckdb"] if isinstance(text, dict) else text
        clauses.append(f"v_{name} AS ({re.sub(r'[{}]', '', text)})")
    body = sql.strip()
    recursive = bool(re.match(r"WITH\s+RECURSIVE\b", body, re.I))
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if own:
        body = ("," if clauses else "") + body[own.end():]
    if not clauses and not own:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(clauses) + "\n" + body


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its check statement."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        QUERIES[name].__doc__ = fn.__doc__
        if oracle is not None:
            ORACLES[name] = _with_views(oracle)
        return fn

    return register
