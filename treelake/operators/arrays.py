"""Array data in long form: selection, coordinates, decoding, alignment, statistics.

A dataset's cells are rows with index columns; a selection is a predicate on those, which reaches the
scan. Nothing here gathers a dataset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake import ranges


def isel(values: DataFrame, sizes: dict[str, int] | None = None, **at: int | slice | list[int]) -> DataFrame:
    """Cells by index: an int, a slice, or a list (made unique). Negative bounds count from ``sizes``."""
    def place(c: str, k: int) -> int:
        if k < 0:
            if not sizes or c not in sizes:
                raise ValueError(f"the size of {c} is needed for a negative index")
            k += sizes[c]
        return k

    out = values
    for c, x in at.items():
        if isinstance(x, slice):
            step = 1 if x.step is None else x.step
            if step < 1:
                raise ValueError("steps must be positive")
            start = place(c, x.start or 0)
            test = (F.col(c) >= start) & ((F.col(c) - start) % step == 0)
            out = out.where(test if x.stop is None else test & (F.col(c) < place(c, x.stop)))
        elif isinstance(x, (list, tuple)):
            out = out.where(F.col(c).isin(*sorted({place(c, k) for k in x})))
        else:
            out = out.where(F.col(c) == place(c, x))
    return out


def sel_exact(values: DataFrame, requests: DataFrame, coord: str = "coord") -> tuple[DataFrame, DataFrame]:
    """(cells at the requested coordinates, requests that no coordinate equals)."""
    return values.join(requests.select(coord).distinct(), coord, "left_semi"), requests.join(values.select(coord), coord, "left_anti")


def sel_nearest(coords: DataFrame, requests: list[float], keys: list[str]) -> DataFrame:
    """``coords`` (keys, i, coord) to (keys, request, i, coord): of each key the coordinate nearest to each of a few
    requests, the first index on ties. One pass: a minimum per key and request, taken before the shuffle."""
    wanted = F.explode(F.array(*[F.lit(float(r)) for r in requests])).alias("request")
    far = F.abs(F.col("coord") - F.col("request"))
    near = coords.select(*keys, "i", "coord", wanted)
    return near.groupBy(*keys, "request").agg(F.min(F.struct(far.alias("far"), F.col("i").alias("i"), F.col("coord").alias("coord"))).alias("x")).select(
        *keys, "request", F.col("x.i").alias("i"), F.col("x.coord").alias("coord"))


def nearest_join(requests: DataFrame, coords: DataFrame, keys: list[str]) -> DataFrame:
    """``requests`` (keys, request) with (i, coord) of the nearest of ``coords`` (keys, i, coord), for many requests: the last
    coordinate before and the first one after, the closer wins, the first index on ties. Both sides are merged in sorted ranges, so no
    task holds a key. Null coordinates are near to nothing; requests of a key without coordinates get null."""
    none = F.lit(None)
    known = coords.where("coord is not null").groupBy(*keys, F.col("coord").cast("double").alias("at")).agg(F.min("i").cast("long").alias("i"))
    both = known.select(*keys, "at", "i", none.cast("double").alias("request"), F.lit(0).alias("side"))
    both = both.unionByName(requests.select(*keys, F.col("request").cast("double").alias("at"), none.cast("long").alias("i"),
                                            F.col("request").cast("double").alias("request"), F.lit(1).alias("side")))
    cell = F.when(F.col("side") == 0, F.struct(F.col("at").alias("coord"), F.col("i").alias("i")))
    seen = ranges.around(both, keys, ["at", "side"], cell, "lo", "hi").where("side = 1")
    far = lambda s: F.abs(F.col(s)["coord"] - F.col("request"))
    lower = F.col("hi").isNull() | (F.col("lo").isNotNull() & ((far("lo") < far("hi")) | ((far("lo") == far("hi")) & (F.col("lo.i") <= F.col("hi.i")))))
    pick = F.when(F.col("request").isNotNull(), F.when(lower, F.col("lo")).otherwise(F.col("hi")))
    return seen.select(*keys, "request", pick["i"].alias("i"), pick["coord"].alias("coord"))


def attach_coords(values: DataFrame, scales: DataFrame, axis: str, name: str) -> DataFrame:
    """``values`` with a column ``name``: the value of a scale (keys, i, coord) at the cell's index on ``axis``; null
    where the scale has none."""
    return values.join(scales.select("file_id", F.col("i").alias(axis), F.col("coord").alias(name)), ["file_id", axis], "left")


def decode(values: DataFrame, scale: DataFrame | None, offset: DataFrame | None, keys: list[str]) -> DataFrame:
    """``values`` (keys, v) times its scale plus its offset (keys, factor): each found by reference; one or none."""
    out = values
    for side, name in ((scale, "scale"), (offset, "offset")):
        if side is not None:
            out = out.join(side.select(*keys, F.col("factor").alias(f"__{name}")), keys, "left")
    v = F.col("v")
    v = v * F.coalesce("__scale", F.lit(1.0)) if scale is not None else v
    v = v + F.coalesce("__offset", F.lit(0.0)) if offset is not None else v
    return out.withColumn("decoded", v).drop("__scale", "__offset")


def attach_flags(values: DataFrame, flags: DataFrame, index: list[str]) -> DataFrame:
    """An ancillary dataset of the same shape, joined on the whole index; cells without a flag are null."""
    return values.join(flags, index, "left")


def align(series: DataFrame, coords: list[str], names: list[str], value: str = "v") -> DataFrame:
    """Several datasets (name, coords, v) as columns of one table over the coordinates of any of them, in one
    grouping instead of a chain of outer joins."""
    cols = [F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in names]
    return series.where(F.col("name").isin(*names)).groupBy(*coords).agg(*cols)


def to_datasets(grid: DataFrame, coords: list[str], names: list[str], existing: DataFrame | None = None) -> DataFrame:
    """(coords, name, v): each variable of a wide table as a dataset over its coordinates. ``existing`` (name, index long, v)
    holds coordinates that are there already: the distinct values of a coordinate, in order, must equal them, else
    the job fails and names the coordinate."""
    cells = grid.unpivot(coords, names, "name", "v")
    if existing is None:
        return cells
    values = grid.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in coords])).alias("x")).select("x.*")
    placed = ranges.numbered(values.distinct(), ["name"], ["v"], "index")
    known = existing.join(placed.select("name").distinct(), "name", "left_semi").select("name", "index", F.col("v").alias("known"))
    checked = known.select("name").distinct()
    wrong = placed.join(checked, "name", "left_semi").join(known, ["name", "index"], "full_outer").where(~F.col("v").eqNullSafe(F.col("known")))
    found = wrong.agg(F.min("name").alias("__wrong"))
    guard = F.when(F.col("__wrong").isNotNull(), F.raise_error(F.concat(F.lit("a coordinate exists with other values: "), F.col("__wrong")))).otherwise(F.lit(True))
    return cells.crossJoin(F.broadcast(found)).where(guard).drop("__wrong")


def decode_all(values: DataFrame, decoders: list) -> DataFrame:
    """``values`` through functions of a DataFrame, in the order of registration."""
    for d in decoders:
        values = values.transform(d)
    return values


def magnitude(table: DataFrame, names: list[str]) -> DataFrame:
    """Root of the sum of squares of two columns or more, named after them; null where one is."""
    if len(names) < 2:
        raise ValueError("a magnitude needs two components")
    total = reduce(lambda a, b: a + b, [F.col(n) * F.col(n) for n in names])
    return table.withColumn("magnitude_of_" + "_and_".join(names), F.sqrt(total))


def dataset_stats(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("n"))


def rolling_mean(series: DataFrame, keys: list[str], coord: str, size: int, value: str = "v") -> DataFrame:
    """The mean of the last ``size`` rows along a coordinate; null until there are so many. Long series are windowed in ranges
    that borrow the rows before them."""
    return ranges.rolling(series, keys, [coord], size, rolling=lambda w: F.when(F.count(value).over(w) == size, F.avg(value).over(w)))


def where_index(values: DataFrame, condition: Column, index: list[str], other: DataFrame | None = None) -> DataFrame:
    """The positions where a condition holds; with ``other``, its cells there."""
    hits = values.where(condition).select(*index).distinct()
    return hits if other is None else other.join(hits, index, "left_semi")


def normalize(series: DataFrame, reference: float, unit_factor: float = 1.0, value: str = "v", coord: str | None = None) -> DataFrame:
    """Values, and a coordinate, over a reference; the reference's unit enters as its factor."""
    ref = reference * unit_factor
    if not ref:
        raise ValueError("the reference is zero")
    out = series.withColumn(f"{value}_norm", F.col(value) / ref)
    return out.withColumn(f"{coord}_norm", F.col(coord) / ref) if coord else out


def normalized_name(name: str, reference: str) -> str:
    return f"{name}/{reference}"


def stack(arrays: DataFrame, file: str, column: str, axis: int = 0, shape: list[int] | None = None) -> DataFrame:
    """``arrays`` (file ordinal, array column) to cells: the file index comes first (axis 0) or last (-1); ``shape``
    splits the position into row-major indexes first."""
    if axis not in (0, -1):
        raise ValueError("axis is 0 or -1")
    cells = arrays.select(F.col(file).cast("int").alias("__file"), F.posexplode(column).alias("__at", "v"))
    inner: list[Column] = []
    if shape:
        rest = 1
        for n in reversed(shape):
            inner.insert(0, (F.floor(F.col("__at") / rest) % n).cast("int"))
            rest *= n
    else:
        inner = [F.col("__at")]
    index = [F.col("__file"), *inner] if axis == 0 else [*inner, F.col("__file")]
    return cells.select(*[c.alias(f"i{k}") for k, c in enumerate(index)], "v")
