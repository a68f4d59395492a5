"""Incremental triples: a stream of N-Triples files kept as a set, and its measures, in a bucketed store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treelake.sources.files import parse_ntriples
from treelake.sources.store import KEY, TripleStore


def ingest(store: TripleStore, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes every file that appears in ``folder``, once, and stops when none is left. A batch meets only the buckets of the store
    that its subjects fall into; a batch that is run again changes nothing."""
    lines = store.spark.readStream.option("pathGlobFilter", "*.nt").text(folder)
    triples = parse_ntriples(lines)

    def take(batch: DataFrame, number: int) -> None:
        store.append(batch, number)

    return triples.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()


def distinct_with_watermark(triples: DataFrame, time: str = "at", late: str = "1 hour") -> DataFrame:
    """A stream with an event time, without repeats that arrive within ``late``; state older than that goes."""
    return triples.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(KEY)
