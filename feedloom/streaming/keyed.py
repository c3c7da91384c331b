"""Tables that grow by batches and hold each key once, without reading their history to tell what is new."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of a filter for each key, and bits that a key sets: one of 80,000 absent keys passes.
BITS, PROBES = 24, 14


def places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """(keys, PROBES) bit numbers of keys by two hashes."""
    step = h2.view(np.uint64) | np.uint64(1)
    return (h1.view(np.uint64)[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def bits_of(h1: np.ndarray, h2: np.ndarray) -> bytes:
    bits = np.zeros(1 << max(10, (BITS * len(h1) - 1).bit_length()), np.uint8)  # a power of two, so odd steps reach every place
    bits[places(h1, h2, len(bits)).ravel().astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def any_in(bits: bytes, h1: np.ndarray, h2: np.ndarray) -> bool:
    held = np.unpackbits(np.frombuffer(bits, np.uint8))
    return bool(held[places(h1, h2, len(held)).astype(np.int64)].all(1).any())


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table of files, empty where there are none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class KeyedTable:
    """Rows at ``path``, each batch in a folder of its own and there in one for each bucket of the keys' hash; beside them (``path``-filters) a Bloom
    filter for each batch and bucket.

    A batch first looks its keys up in the filters of their buckets, 3 to 6 bytes for each stored key, and then reads the keys of the
    files alone that may hold one.  A batch counts once its filters are written; one that failed before is written anew under its
    number, and a repeated one looks at the others only, so replays leave neither repeated nor missing rows.
    """

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def hashed(self, rows: DataFrame) -> DataFrame:
        h = lambda n: F.xxhash64(*self.keys, F.lit(n))
        return rows.withColumns({"__h1": h(1), "__h2": h(2), "bucket": F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")})

    def filters(self, spark: SparkSession) -> DataFrame:
        return read(spark, f"{self.path}-filters", "bucket int, bits binary, batch long")

    def rows(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """All rows of batches that count."""
        whole = StructType([*schema.fields]).add("batch", "long").add("bucket", "integer")
        done = self.filters(spark).select("batch").distinct()
        return read(spark, self.path, whole).join(done, "batch", "left_semi").drop("bucket")

    def files_asked(self, keyed: DataFrame, batch: int) -> list[tuple[int, int]]:
        """(batch, bucket) of the files that may hold one of the keys: a number pair for each, at most those of all files."""
        own = keyed.groupBy("bucket").agg(F.collect_list(F.struct("__h1", "__h2")).alias("k"))
        both = self.filters(keyed.sparkSession).where(F.col("batch") != batch).join(own, "bucket")

        def hits(batches):
            for part in batches:
                keep = []
                for k, (bits, ks) in enumerate(zip(part.column("bits").to_pylist(), part.column("k"), strict=True)):
                    s = ks.values
                    if any_in(bits, s.field("__h1").to_numpy(), s.field("__h2").to_numpy()):
                        keep.append(k)
                yield part.select(["batch", "bucket"]).take(pa.array(keep, pa.int64()))

        found = both.select("batch", "bucket", "bits", "k").mapInArrow(hits, "batch long, bucket int").distinct()
        return sorted((r.batch, r.bucket) for r in found.collect())

    def fresh(self, rows: DataFrame, batch: int) -> DataFrame:
        """Of rows those whose keys no other batch has, each key once, with their bucket."""
        keyed = self.hashed(rows.dropDuplicates(list(self.keys)))
        asked = self.files_asked(keyed, batch)
        keyed = keyed.drop("__h1", "__h2")
        if not asked:
            return keyed
        by: dict[int, list[int]] = {}
        for b, bucket in asked:
            by.setdefault(b, []).append(bucket)
        where: Column = F.lit(False)
        for b, buckets in by.items():
            where = where | ((F.col("batch") == b) & F.col("bucket").isin(buckets))
        schema = StructType([rows.schema[k] for k in self.keys]).add("batch", "long").add("bucket", "integer")
        known = rows.sparkSession.read.schema(schema).parquet(self.path).where(where).select(*self.keys)
        return keyed.join(known, list(self.keys), "left_anti")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Writes a batch's new rows and then their filters."""
        spark, out = rows.sparkSession, f"{self.path}/batch={batch}"
        self.fresh(rows, batch).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        written = self.hashed(read(spark, out, StructType([*rows.schema.fields]).add("bucket", "integer")))

        def bits(batches):
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for part in batches:
                b, h1, h2 = (part.column(c).to_numpy() for c in ("bucket", "__h1", "__h2"))
                for k in np.unique(b).tolist():
                    held.setdefault(k, []).append((h1[b == k], h2[b == k]))
            for k, parts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))], pa.binary())], ["bucket", "bits"])

        made = written.select("bucket", "__h1", "__h2").repartition("bucket").mapInArrow(bits, "bucket int, bits binary")
        made.write.mode("overwrite").parquet(f"{self.path}-filters/batch={batch}")
