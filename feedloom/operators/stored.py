"""Tables stored in buckets of a key, of which a change rewrites those that it touches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BucketedTable:
    """Rows at ``path`` in a folder for each bucket of their key's hash.

    A change reads and writes the buckets that its keys fall in and no others.  Their new files are staged and put in place of the old
    ones when the whole write succeeds, so a job that fails or loses executors leaves the table as it was.  ``key`` is the column that
    changes refer to; rows of a null key are in one bucket.  Changes come one at a time.
    """

    spark: SparkSession
    path: str
    key: str
    buckets: int = 64

    def placed(self, rows: DataFrame, key: str | None = None) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int"))

    def write(self, rows: DataFrame) -> BucketedTable:
        """The table with these rows and no others."""
        self.put(self.placed(rows).withColumn("__gone", F.lit(False)), "static")
        return self

    def put(self, placed: DataFrame, mode: str) -> None:
        placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(self.path)

    def rows(self, *columns: str) -> DataFrame:
        found = self.spark.read.parquet(self.path).where(~F.col("__gone"))
        return found.select(*columns) if columns else found.drop("bucket", "__gone")

    def touched(self, changes: DataFrame, key: str | None = None) -> list[int]:
        """Buckets that keys of changes fall in: a number for each bucket at most."""
        return sorted(r.bucket for r in self.placed(changes, key).select("bucket").distinct().collect())

    def change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], key: str | None = None) -> list[int]:
        """Replaces the rows of the touched buckets by ``apply`` of them and the changes, whose ``key`` column (the table's own if not given) refers to
        the table's key; gives the buckets rewritten.

        ``apply`` must give rows of the table's columns, and rows of other keys as they are; operators of ``maintenance`` do.
        """
        asked = self.touched(changes, key)
        if not asked:
            return []
        old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(asked) & ~F.col("__gone"))
        columns = [c for c in old.columns if c not in ("bucket", "__gone")]
        new = self.placed(apply(old.select(columns), changes).select(columns)).withColumn("__gone", F.lit(False))
        # a bucket that loses its last row keeps a mark in its place, since only folders with rows are overwritten
        every = self.spark.createDataFrame([(b,) for b in asked], "bucket int")
        empty = every.join(new.select("bucket").distinct(), "bucket", "left_anti")
        marks = empty.select(*(F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns), "bucket", F.lit(True).alias("__gone"))
        self.put(new.select(*columns, "bucket", "__gone").union(marks), "dynamic")
        return asked
