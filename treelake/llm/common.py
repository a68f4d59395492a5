"""What the training-data operators share: lineage cuts, components, bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.operators.connectivity import stars


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="treelake-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and
    what was written survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table that :func:`cut` wrote for ``df``, once nothing reads it any more."""
    jvm, path = df.sparkSession._jvm, getattr(df, "_cut_path", None)
    if path:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into a reliable checkpoint that keeps its partitioning, so that what is grouped or joined by
    the same key later needs no exchange. (A plan that may still be changed at run time promises no partitioning.)"""
    spark = df.sparkSession
    shared_dir(spark)
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def exact_id(name: str) -> Column:
    """An id as text, the form in which Python tasks pass it on: integers beside nulls would become floats."""
    return F.col(name).cast("string")


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) that depends on ``key`` alone."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): rows (node, root), root the smallest
    node of the component. Only nodes that have an edge to another node appear. Rounds of stars, in which
    a hub's edges stay where they are (:func:`treelake.operators.connectivity.stars`)."""
    e = stars(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), max_rounds)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def crc32_sql(text: str) -> str:
    """DuckDB's lack of crc32, made good: the unsigned crc32 of an ASCII text expression, bit by bit."""
    bit = "list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))), "
            f"lambda a, b: {bit}), CAST(4294967295 AS BIGINT))")
