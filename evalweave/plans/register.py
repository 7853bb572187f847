"""Registration of named queries and the SQL pieces that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def union_sql(boxes: str, key: str, x1: str, y1: str, x2: str, y2: str, out: str) -> str:
    """Union area by coordinate compression: cells between neighbouring edges that some box covers."""
    return f"""{out}_x as (select {key}, v, lead(v) over (partition by {key} order by v) as w from (select {key}, {x1} as v from {boxes} union select {key}, {x2} from {boxes})),
{out}_y as (select {key}, v, lead(v) over (partition by {key} order by v) as w from (select {key}, {y1} as v from {boxes} union select {key}, {y2} from {boxes})),
{out} as (select x.{key}, sum((x.w - x.v) * (y.w - y.v)) as area from {out}_x x join {out}_y y on x.{key} = y.{key} where x.w is not null and y.w is not null and exists (select 1 from {boxes} b where b.{key} = x.{key} and b.{x1} <= x.v and b.{x2} >= x.w and b.{y1} <= y.v and b.{y2} >= y.w) group by 1)"""
