"""A store of triples in hash buckets of subjects: batches read only the buckets that they touch, stars only those of their subjects.

Layout: ``data/batch=<n>/bucket=<k>`` holds what a batch added, sorted by subject; ``measures/batch=<n>`` what it changed in the
measures. A batch's folders are written whole or again, so a batch that failed half-way is repeated without harm. There is one writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.lineage import folder_bytes, forget, freed_shuffles, remove, settle
from treelake.model import LABEL, OWL, TYPE
from treelake.skew import SMALL

KEY = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
SCHEMA = "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
BUCKETS = 256
#: Bytes in files, of a batch and what the store has in its buckets, up to which all buckets are taken at once; the shares in which those of
#: more are taken; and the bytes of one task. Triples take some twenty times as much in memory as in files.
PASS_BYTES, SHARES, TASK_BYTES = 64 << 20, 8, 2 << 20


def bucket_of(s: str = "s", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(s), F.lit(buckets)).cast("int")


class TripleStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _exists(self, part: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _read(self, part: str, schema: str) -> DataFrame:
        """A part of the store; nothing where it does not exist yet."""
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}") if self._exists(part) else self.spark.createDataFrame([], schema)

    def triples(self, touched: list[int] | None = None) -> DataFrame:
        """The triples with their bucket and batch, of the buckets given or of all."""
        rows = self._read("data", f"{SCHEMA}, batch long, bucket int")
        return rows if touched is None else rows.where(F.col("bucket").isin(*touched) if touched else F.lit(False))

    def _write(self, rows: DataFrame, part: str, batch: int, *by: str, mode: str = "overwrite") -> None:
        rows.write.mode(mode).partitionBy(*by).option("compression", "zstd").parquet(f"{self.folder}/{part}/batch={batch}")

    def append(self, batch: DataFrame, number: int) -> DataFrame:
        """Adds the triples of a batch that the store does not hold, as batch ``number``, and returns them. A batch that was
        added wholly is left as it is. A batch is computed once; a large one is taken some of the buckets at a time, so that
        shuffle files hold a share of it and of those buckets. The first batch is compared with nothing."""
        if self._read("measures", "batch long").where(F.col("batch") == number).isEmpty():
            with freed_shuffles(self.spark):
                self._add(batch, number)
                added = self.triples().where(F.col("batch") == number).select("bucket").distinct().collect()  # at most one number a bucket
                self._write(self._changes(number, [r[0] for r in added]), "measures", number)
        return self.triples().where(F.col("batch") == number)

    def _add(self, batch: DataFrame, number: int) -> None:
        fields = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        bucket = bucket_of("s", self.buckets)
        given = settle(batch.select(*fields, bucket.alias("bucket"), (bucket % SHARES).alias("share")), "share")
        touched = [r[0] for r in given.select("bucket").distinct().collect()]  # at most one number a bucket
        remove(self.spark, f"{self.folder}/data/batch={number}")  # what an attempt that failed has left
        stored = folder_bytes(self.spark, f"{self.folder}/data") * len(touched) // self.buckets if self._exists("data") else 0
        size, passes = folder_bytes(self.spark, given._settled_path) + stored, 1
        while passes < SHARES and size > passes * PASS_BYTES:
            passes *= 2
        for turn in range(passes):
            own = given.where(F.col("share") % passes == turn).drop("share").withColumn("new", F.lit(True))
            held = self.triples([b for b in touched if b % passes == turn]).where(F.col("batch") != number)
            # The ranges in which the store keeps its rows hold all that is equal, so one shuffle serves for both.
            both = own.unionByName(held.drop("batch").withColumn("new", F.lit(False)))
            rows = both.repartitionByRange(size // (passes * TASK_BYTES) + 1, "bucket", "s", "p", "o")
            sets = rows.groupBy("bucket", *KEY).agg(F.bool_and("new").alias("new"), F.min(F.struct("graph", "s_kind")).alias("x"))
            new = sets.where("new").select("x.graph", "s", "x.s_kind", *KEY[1:], "bucket")
            self._write(new.sortWithinPartitions("bucket", "s", "p"), "data", number, "bucket", mode="append")
        forget(given)

    def _changes(self, number: int, touched: list[int]) -> DataFrame:
        """(measure, label, n): what batch ``number`` adds to each measure. New subjects are those that the touched buckets, those it added to, lack."""
        rows = self.triples(touched)
        own, lit = F.col("batch") == number, F.col("o_kind") == "lit"
        empty = F.lit("")
        one = lambda test, measure, label=empty: F.when(test, F.struct(F.lit(measure).alias("measure"), label.alias("label")))
        # Few sorts of triples, so it is their counts that are dealt out to the measures.
        sorts = rows.where(own).groupBy("p", "o_kind", "o_dt", "o_lang", F.when(F.col("p") == TYPE, F.col("o")).alias("class"), (F.col("o") == "").alias("blank")).agg(F.count("*").alias("n"))
        found = F.array(one(F.lit(True), "triples"), one(F.lit(True), "predicate", F.col("p")), one(F.col("p") == TYPE, "class", F.col("class")), one(lit, "literals"),
                        one(lit & F.col("o_dt").isNull() & F.col("o_lang").isNull(), "untyped_literals"), one(lit & F.col("blank"), "empty_literals"),
                        one(F.col("p") == OWL + "sameAs", "same_as"), one(lit, "datatype", F.coalesce("o_dt", F.lit("None"))), one(lit, "language", F.coalesce("o_lang", F.lit("None"))))
        counts = sorts.select("n", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).groupBy("x.measure", "x.label").agg(F.sum("n").alias("n"))
        per = rows.groupBy("bucket", "s_kind", "s").agg(F.min("batch").alias("first"), F.bool_or(~own & (F.col("p") == LABEL)).alias("had"), F.bool_or(own & (F.col("p") == LABEL)).alias("has"))
        before = F.col("first") == number
        subjects = per.agg(F.count_if(before).alias("subjects"), F.count_if(F.col("has") & ~F.col("had")).alias("subjects_with_labels"))
        long = subjects.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), empty.alias("label"), F.col(c).alias("n")) for c in subjects.columns])).alias("x")).select("x.*")
        return counts.unionByName(long)

    def measures(self) -> DataFrame:
        """(measure, label, n), kept up to date by what each batch changed: the triples are not read."""
        rows = self._read("measures", "measure string, label string, n long, batch long")
        return rows.groupBy("measure", "label").agg(F.sum("n").alias("n")).where("n <> 0")

    def stars(self, subjects: DataFrame) -> DataFrame:
        """All triples of ``subjects`` (s): of a few, only the buckets and row groups that hold them are read, and no
        triple is shuffled."""
        wanted = subjects.select("s").distinct().withColumn("bucket", bucket_of("s", self.buckets))
        if wanted.limit(SMALL + 1).count() <= SMALL:
            wanted = F.broadcast(wanted)
        return self.triples().join(wanted, ["bucket", "s"], "left_semi").drop("batch", "bucket")

