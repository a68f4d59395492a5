"""Best-fit packing of token sequences into rows of a fixed capacity.

A document is its ids and an end id; only documents above the capacity are cut. Which sequence a
piece goes to depends on its length alone, so the packing is worked out on the counts of the
lengths, a table of at most ``capacity`` numbers whatever the corpus holds:

* pieces above a third of the capacity are matched greedily, at most two to a sequence: the
  longest one left with the longest that still fits beside it;
* shorter pieces, longest first, go where they leave the smallest gap.

Both steps treat all pieces of one length and all sequences of one history at once, which gives a
list of runs ("pieces 200 to 900 of length 57 go to sequences 5000 to 5700 at offset 4039"). Each
piece then finds its run by its number among the pieces of its length; the numbers come from a
window over (length, bucket of doc_id) and the buckets' counts, so a length that a third of all
pieces share is no single task's.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelake.llm.common import cut, exact_id, shuffle_partitions
from treelake.llm.tokens import groups, word_encoder

CAPACITY = 4096


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): documents cut into pieces."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = word_encoder(path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        step = 4 * capacity
        for b in batches:
            keys, at = b["doc_id"].tolist(), 0
            for some in groups(b["text"]):
                rows = []
                for key, raw in zip(keys[at : at + len(some)], enc.encode(some), strict=True):
                    raw += end
                    for i, a in enumerate(range(0, len(raw), step)):
                        part = raw[a : a + step]
                        row = (key, i, a // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, "<u4")) if keep_ids else row)
                at += len(some)
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pd.DataFrame(rows, columns=[*names, "ids"] if keep_ids else names)

    own = docs.select(exact_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    return own.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, last, sequence, offset): the pieces numbered first to last - 1 of that
    length go to the sequences from ``sequence`` on, one each, at that offset."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_: list[int] = []
    fresh = 0

    def place(n: int, count: int, sequence: int, offset: int) -> None:
        runs.append((n, used[n], used[n] + count, sequence, offset))
        used[n] += count
        left[n] -= count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap:
            if not gaps.get(gap):
                gaps[gap] = []
                insort(open_, gap)
            heapq.heappush(gaps[gap], (sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large.pop()
        mates = bisect_left(large, capacity - a + 1)
        if 2 * a <= capacity and left[a] > 1:
            pairs = left[a] // 2
            place(a, pairs, fresh, 0)
            place(a, pairs, fresh, a)
            leave(capacity - 2 * a, fresh, pairs)
            fresh += pairs
        while left[a]:
            b = large[mates - 1] if mates else 0
            count = min(left[a], left[b]) if b else left[a]
            place(a, count, fresh, 0)
            if b:
                place(b, count, fresh, a)
                if not left[b]:
                    large.pop(mates - 1)
                    mates -= 1
            leave(capacity - a - b, fresh, count)
            fresh += count
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect_left(open_, n)
            if at == len(open_):
                each = capacity // n
                full = max(1, left[n] // each)
                for k in range(min(each, left[n])):
                    place(n, min(full, left[n]), fresh, k * n)
                leave(capacity - min(each, -(-(runs[-1][4] + n) // n)) * n, fresh, full)
                fresh += full
                continue
            gap = open_[at]
            sequence, count = heapq.heappop(gaps[gap])
            if not gaps[gap]:
                open_.pop(at)
            now = min(count, left[n])
            place(n, now, sequence, capacity - gap)
            leave(gap - n, sequence, now)
            leave(gap, sequence + now, count - now) if count > now else None
    return runs


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece, length, ...) with sequence_id and offset: gapless from 0, no
    sequence above the capacity. An empty table gives an empty result; a null doc_id packs like any
    other; repeated rows are packed one by one; lengths must be 1 to ``capacity``; columns must not begin with ``__``."""
    if clash := [c for c in items.columns if c.startswith("__")]:
        raise ValueError(f"columns that clash with the operator's own: {clash}")
    spark = items.sparkSession
    items = cut(items)
    buckets = shuffle_partitions(spark)
    keyed = items.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sums = keyed.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))

    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity) or [(0, 0, 0, 0, 0)],
                                 "length long, __first long, __last long, __sequence long, __offset long")
    own = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("__at", F.row_number().over(own) - 1).join(bases, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__at"))
    within = (ranked["length"] == runs["length"]) & (ranked["__rank"] >= runs["__first"]) & (ranked["__rank"] < runs["__last"])
    placed = ranked.join(F.broadcast(runs), within)
    return placed.select(*[ranked[c] for c in items.columns],
                         (F.col("__sequence") + F.col("__rank") - F.col("__first")).alias("sequence_id"),
                         F.col("__offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Cut and pack ``docs``: one row per piece. Null text counts as empty: one piece of the end id
    alone; other columns of ``docs`` are ignored. Ids are integers; text that is none fails the job."""
    return pack(pieces(docs, path, end_id, capacity, id_col, text_col, keep_ids), capacity)
