"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.  ``bytes.split()`` splits at just these.
WORD_SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(df: DataFrame) -> DataFrame:
    """df, its session set for these operators: Arrow batches are bounded by bytes too, since some texts are very long, and
    Spark deletes the shuffle files of each execution at its end, since all that is read again is written as a table."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests on one machine) a local folder is made and set; on a
    cluster that is an error, since executors couldn't see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-feedloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def put(df: DataFrame, name: str, sort: list[str] | None = None, parts: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder, in a subfolder for each value of ``parts`` if given, and read it back: cuts the
    lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd")
    (out.partitionBy(parts) if parts else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame, part: str = "") -> None:
    """Delete a table that ``put`` made and nothing will read again, or its files of one ``part`` ("name=value")."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if part in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def list_of(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Lists values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of numbers of a column as arrays; null as an empty one."""
    at, values = np.asarray(column.offsets), np.asarray(column.values)
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def named_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc, name): each row of docs as a struct, a long in the order of its key (null for a null key), and a 64-bit hash of its
    text (null for a null text).

    doc and name together name a document; only texts of one key have to differ by their hash.  Whole numbers are their own
    order; other keys are numbered once, in a sorted table of the distinct ones.  Docs' columns may have any names.
    """
    kind = docs.schema[key].dataType.typeName()
    row = F.struct("*").alias("row")
    own, value = F.col("row").getField(key), F.col("row").getField(text)
    rows = docs.select(row)
    name = F.when(value.isNotNull(), F.xxhash64(value)).alias("name")
    if kind in ("byte", "short", "integer", "long"):
        return rows.select("row", own.cast("long").alias("doc"), name)
    ranks = rows.select(own.alias("key")).where("key is not null").distinct().orderBy("key").withColumn("doc", F.monotonically_increasing_id())
    return rows.join(put(ranks, "keys"), own == F.col("key"), "left").select("row", "doc", name)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def blocks(batch: pa.RecordBatch, text: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``limit`` bytes of text, so that working memory doesn't follow the batch."""
    if not batch.num_rows:
        return
    col = batch.column(text)
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).cumsum()
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of undirected links between longs: (node, component), component the smallest node.

    Alternates the large-star and small-star steps of the known MapReduce algorithm until no row changes; each
    round is a table in the shared folder.  Groups stay at one row for each link, never one row for each pair.
    Empty links give an empty result; self links and repeated links count once.
    """
    edges = put(
        links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u is not null and u <> v").distinct(), "links"
    )
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u hang on the smallest neighbour of u
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of u, and u itself, hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = put(small.where("u <> v").distinct(), "links")
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop(edges)
        edges = after
        if now == before or not now[0]:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v"), F.col("v")).distinct())
