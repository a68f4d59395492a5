"""Ordered work over ranges: positions in a sorted group, and what a range has to know of its neighbours.

A window over a group puts the whole group into one task. Here rows are dealt to sorted ranges of about equal size
instead, whatever their groups, and only a row or so a range, whose number is the number of partitions, passes from a range to those after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.lineage import settle

PART, ROW = "__part", "__row"
_TIE = "__tie"
_BITS = 33


def ranged(df: DataFrame, by: list) -> DataFrame:
    """``df`` sorted by ``by`` over range partitions and written once, with the partition (``__part``) and the row's place in it
    (``__row``, from 0). Ties are dealt to several partitions too, so that rows that all share a key fill no single one."""
    tied = df.withColumn(_TIE, F.monotonically_increasing_id())
    order = [*[_column(c) for c in by], F.col(_TIE)]
    placed = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop(_TIE)
    at = F.monotonically_increasing_id()
    return settle(placed.select("*", F.shiftright(at, _BITS).cast("int").alias(PART), at.bitwiseAND(F.lit((1 << _BITS) - 1)).alias(ROW)))


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ends(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Per partition of a ranged table: rows before it (``start``), its rows (``n``), and how many rows of its first key the
    partitions before it hold (``carried``). One row a partition."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))
    heads = placed.groupBy(PART, *keys).agg(F.min(ROW).alias("first"), F.count("*").alias("n"))
    own = heads.groupBy(PART).agg(F.min_by(key, "first").alias("first_key"), F.max_by(key, "first").alias("last_key"),
                                  F.max("first").alias("last_first"), F.sum("n").alias("n"))
    order = Window.orderBy(PART)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
                     F.coalesce(F.col("first_key").eqNullSafe(F.lag("last_key").over(order)) & F.lag("n").over(order).isNotNull(), F.lit(False)).alias("goes_on"))
    begins = F.when(~F.col("goes_on") | (F.col("last_first") > 0), F.col("start") + F.col("last_first"))
    own = own.withColumn("begins", begins).withColumn("began", F.last("begins", ignorenulls=True).over(before))
    return own.select(PART, "start", "n", "last_first", F.when(F.col("goes_on"), F.col("start") - F.col("began")).otherwise(0).alias("carried"))


def numbered(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """``df`` with ``out``: each row's number, from 0, among the rows of its ``keys`` in the order given. Null keys are a group
    of their own; rows that tie are numbered in any order. No task holds more than a range of rows, however large a group is."""
    placed = ranged(df, [*keys, *order])
    carried = F.broadcast(ends(placed, keys).select(PART, "carried"))  # a row a partition
    first = F.min(ROW).over(Window.partitionBy(PART, *keys))
    rows = placed.withColumn("__first", first).join(carried, PART)
    number = F.col(ROW) - F.col("__first") + F.when(F.col("__first") == 0, F.col("carried")).otherwise(0)
    return rows.withColumn(out, number).select(*df.columns, out)


def rolling(df: DataFrame, keys: list[str], order: list, size: int, **columns) -> DataFrame:
    """``df`` with columns computed over each row and the ``size - 1`` rows before it in its ``keys``: functions of such a window.

    A range takes the last ``size - 1`` rows before it from its neighbours, and gives them up after the window is computed."""
    placed = ranged(df, [*keys, *order])
    own = ends(placed, keys).select(PART, "start", "n").orderBy(PART).collect()  # a row a partition
    pairs = []
    for at, p in enumerate(own):
        for q in own[at + 1 :]:
            if q["start"] - (size - 1) >= p["start"] + p["n"]:
                break
            pairs.append((p[PART], q[PART], q["start"] - p["start"]))
    session = df.sparkSession
    lent = F.broadcast(session.createDataFrame(pairs, f"{PART} int, __to int, __shift long"))
    copies = placed.join(lent, PART).where(F.col(ROW) >= F.col("__shift") - (size - 1)).select(
        *df.columns, F.col("__to").alias(PART), (F.col(ROW) - F.col("__shift")).alias(ROW))
    w = Window.partitionBy(PART, *keys).orderBy(ROW).rowsBetween(1 - size, 0)
    rows = placed.unionByName(copies).withColumns({name: of(w) for name, of in columns.items()})
    return rows.where(F.col(ROW) >= 0).select(*df.columns, *columns)


def around(df: DataFrame, keys: list[str], order: list, value: Column, before: str, after: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null at or before each row (``before``) and the first one at or after it, of
    its ``keys``. Ranges that hold none pass on their neighbours'."""
    placed = ranged(df.withColumn("__value", value), [*keys, *order])
    key = F.struct(*keys)
    has = F.col("__value").isNotNull()
    heads = placed.groupBy(PART, *keys).agg(F.min(ROW).alias("first"), F.min_by("__value", F.when(has, F.col(ROW))).alias("low"),
                                            F.max_by("__value", F.when(has, F.col(ROW))).alias("high"))
    own = heads.groupBy(PART).agg(F.min_by(F.struct(key.alias("key"), F.col("low").alias("value")), "first").alias("head"),
                                  F.max_by(F.struct(key.alias("key"), F.col("high").alias("value")), "first").alias("tail"), F.max("first").alias("last_first"))
    line = Window.orderBy(PART)  # a row a partition
    past, future = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    held = lambda end: F.when(F.col(end)["value"].isNotNull(), F.col(end))
    own = own.withColumns({"past": F.last(held("tail"), ignorenulls=True).over(past), "future": F.first(held("head"), ignorenulls=True).over(future)})
    carried = own.select(PART, "last_first", F.when(F.col("past.key").eqNullSafe(F.col("head.key")), F.col("past.value")).alias("__past"),
                         F.when(F.col("future.key").eqNullSafe(F.col("tail.key")), F.col("future.value")).alias("__future"))
    run = Window.partitionBy(PART, *keys)
    rows = placed.withColumns({
        "__first": F.min(ROW).over(run),
        before: F.last("__value", ignorenulls=True).over(run.orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)),
        after: F.last("__value", ignorenulls=True).over(run.orderBy(F.col(ROW).desc()).rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.join(F.broadcast(carried), PART)
    return rows.select(*df.columns, F.coalesce(before, F.when(F.col("__first") == 0, F.col("__past"))).alias(before),
                       F.coalesce(after, F.when(F.col("__first") == F.col("last_first"), F.col("__future"))).alias(after))
