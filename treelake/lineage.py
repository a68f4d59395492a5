"""Lineage cuts for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's reliable checkpoint folder; a temporary one only where ``spark.checkpoint.dir`` is unset and
    all runs in one process, as in tests."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not configured and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="treelake-"))
    return configured or sc.getCheckpointDir()


def by_predicate(triples: DataFrame) -> DataFrame:
    """``triples`` computed once, in Parquet with a folder for each predicate, so that a pattern reads its predicate alone."""
    path = new_folder(triples.sparkSession, "triples")
    fields = [c for c in triples.columns if c != "p"]
    triples.withColumn("predicate", F.col("p")).write.partitionBy("predicate").option("compression", "zstd").parquet(path)
    read = triples.sparkSession.read.schema(triples.select(*fields).schema.add("predicate", "string")).parquet(path)
    return read.withColumn("p", F.col("predicate")).select(*triples.columns)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settle(df: DataFrame, *by: str) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder, where it survives the loss of any executor; with a folder for each
    value of the columns ``by``."""
    path = new_folder(df.sparkSession, "tables")
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def folder_bytes(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside has its shuffle files deleted as soon as it is written, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(*tables: DataFrame) -> None:
    """Deletes what :func:`settle` wrote for each of ``tables``, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_settled_path", None)
        if path:
            remove(df.sparkSession, path)
