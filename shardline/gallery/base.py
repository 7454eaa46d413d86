"""Registry of queries, and the provided tables recast in the shape an operator expects.

A shape is one SELECT that both engines read alike; the operator under test is the
DataFrame library on one side and separate SQL on the other.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType, TimestampType

from shardline.gallery.shapes import SHAPES
from shardline.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
PERIOD = re.compile(r"(MONTH|YEAR)_START\(([^()]+)\)")
SHAPE = re.compile(r"\bx_\w+")


class Tables:
    """Provided tables and their shapes, each read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif f"x_{name}" in SHAPES:
            frame = self.sql(SHAPES[f"x_{name}"])
        else:
            raise AttributeError(name)
        setattr(self, name, frame)
        return frame

    def sql(self, text: str) -> DataFrame:
        text = PERIOD.sub(r"CAST(DATE_TRUNC('\1', \2) AS TIMESTAMP_NTZ)", text)
        used = {n: getattr(self, n.removeprefix("x_")) for n in re.findall(r"\{(\w+)\}", text)}
        return self.spark.sql(text, **used)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps without zone, so both engines return like types."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        out.append(c)
    return df.select(*out)


def _oracle(body: str) -> str:
    """The SQL with the shapes it uses as leading CTEs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in SHAPE.findall(text):
            if name in SHAPES and name not in order:
                visit(SHAPES[name])
                order.append(name)

    visit(body)
    ctes = []
    for name in order:
        text = PERIOD.sub(r"CAST(DATE_TRUNC('\1', \2) AS TIMESTAMP)", SHAPES[name])
        ctes.append(f"{name} AS ({re.sub(r'[{}]', '', text).strip()})")
    body = body.strip()
    lead = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if lead:
        ctes.append(body[lead.end() :])
        return lead.group(0) + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None):
    """Register a query (and the SQL it must agree with)."""

    def wrap(build: Callable[[Tables], DataFrame]):
        @functools.wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(build(Tables(apply_settings(spark), folder)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = _oracle(sql)
        return build

    return wrap


def div(num: str, den: str, scale: int = 6) -> str:
    """SQL: num / den rounded half up, as an integer count of 10^-scale; 0 for a zero divisor."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return f"(CASE WHEN {d} = 0 THEN CAST(0 AS HUGEINT) ELSE (2 * {n} * {10**scale} + {d}) // (2 * {d}) END)"


def fixed(scaled: str, scale: int, digits: int) -> str:
    """SQL: an integer count of 10^-scale rounded half up to digits, as a double."""
    step = 10 ** (scale - digits)
    return f"(CAST((2 * ({scaled}) + {step}) // {2 * step} AS DOUBLE) / {10**digits})"


def mean(scaled: str, count: str, scale: int, digits: int) -> str:
    """SQL: (sum of 10^-scale counts) / count rounded half up to digits, as a double."""
    step = 10 ** (scale - digits)
    return f"(CAST((2 * ({scaled}) + ({count}) * {step}) // (2 * ({count}) * {step}) AS DOUBLE) / {10**digits})"
