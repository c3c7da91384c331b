"""Names, callables and oracle SQL of queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.sources.tables import NOW_US, SINCE_US, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VERSION = "similarity-v1"


def now() -> Column:
    return F.timestamp_micros(F.lit(NOW_US))


def since() -> Column:
    return F.timestamp_micros(F.lit(SINCE_US))


class Tables:
    """The domain views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the folder that driver and executors share, ``spark.checkpoint.dir``; only on one machine, where that is
    unset, in a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-feedloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}"


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds and counts as long, so that both engines' rows compare by value."""
    to = {T.TimestampType: lambda c: F.unix_micros(c), T.IntegerType: lambda c: c.cast("long")}
    return df.select(*(to.get(type(f.dataType), lambda c: c)(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields))


def query(sql: str | None = None):
    """Registers a function of Tables under its name; ``now`` and ``since`` in the SQL stand for the fixed times."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(Tables(spark, sf_dir)))
        if sql:
            ORACLES[f.__name__] = with_views(sql.replace("$now", f"make_timestamp({NOW_US})").replace("$since", f"make_timestamp({SINCE_US})"))
        return f

    return register
