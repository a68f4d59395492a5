"""Queries of array selection, alignment and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake import ranges
from treelake.jobs.registry import query
from treelake.jobs.views_sql import views
from treelake.model import component_series, embedding_values, table, user_series
from treelake.operators import arrays

_R6 = "round({0}, 6)"


@query(views("emb") + "SELECT i0, i1, round(v, 6) AS v FROM emb WHERE i0 >= 10 AND (i0 - 10) % 3 = 0 AND i0 < 200 AND i1 IN (0, 5, 63)")
def isel(spark, sf_dir):
    return arrays.isel(embedding_values(spark, sf_dir), {"i1": 64}, i0=slice(10, 200, 3), i1=[5, 0, 5, -1]).select("i0", "i1", F.round("v", 6).alias("v"))


@query("""SELECT 'hit' AS which, vec_id AS at, CAST(label AS DOUBLE) AS coord FROM embeddings WHERE label IN (1, 4)
  UNION ALL SELECT 'missing', NULL, 99.0""")
def sel_exact(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("at"), F.col("label").cast("double").alias("coord"))
    hit, missing = arrays.sel_exact(e, spark.createDataFrame([(1.0,), (4.0,), (99.0,)], "coord double"))
    return hit.select(F.lit("hit").alias("which"), "at", "coord").union(missing.select(F.lit("missing"), F.lit(None).cast("long"), "coord"))


_ORIGIN = 1704067200  # 2024-01-01
_REQUESTS = [_ORIGIN + 3600 * k for k in (0, 5, 100, 2000)]


@query(views("series") + f""", s AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY coord) - 1 AS i, coord FROM series),
  r AS (SELECT unnest({[float(x) for x in _REQUESTS]}) AS request)
  SELECT dataset, request, i, coord FROM (SELECT *, row_number() OVER (PARTITION BY dataset, request ORDER BY abs(coord - request), i) AS n FROM s, r) WHERE n = 1""")
def sel_nearest(spark, sf_dir):
    return arrays.sel_nearest(_indexed(spark, sf_dir), [float(x) for x in _REQUESTS], ["dataset"])


def _indexed(spark, sf_dir):
    return ranges.numbered(user_series(spark, sf_dir).select("dataset", "coord"), ["dataset"], ["coord"], "i").select("dataset", "i", "coord")


@query(views("series") + """, s AS (SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY coord) - 1 AS BIGINT) AS i, CAST(coord AS DOUBLE) AS coord FROM series),
  q AS (SELECT DISTINCT dataset, CAST(coord + 1800 AS DOUBLE) AS request FROM series)
  SELECT dataset, request, i, coord FROM (SELECT q.dataset, request, i, coord, row_number() OVER (PARTITION BY q.dataset, request ORDER BY abs(coord - request), i) AS n
    FROM q JOIN s ON s.dataset = q.dataset) WHERE n = 1""")
def nearest_join(spark, sf_dir):
    requests = user_series(spark, sf_dir).select("dataset", (F.col("coord") + 1800).cast("double").alias("request")).distinct()
    return arrays.nearest_join(requests, _indexed(spark, sf_dir), ["dataset"])


@query(views("emb") + "SELECT i0, i1, round(v, 6) AS v, label FROM emb")
def attach_coords(spark, sf_dir):
    values = embedding_values(spark, sf_dir)
    scale = table(spark, sf_dir, "embeddings").select(F.lit("emb").alias("file_id"), F.col("vec_id").cast("int").alias("i"), F.col("label").alias("coord"))
    return arrays.attach_coords(values, scale, "i0", "label").select("i0", "i1", F.round("v", 6).alias("v"), "label")


@query(views("emb") + "SELECT i0, i1, round(v, 6) AS v, CASE WHEN (i0 + i1) % 2 = 0 THEN i0 % 7 END AS flag FROM emb")
def attach_flags(spark, sf_dir):
    values = embedding_values(spark, sf_dir)
    flags = values.where("(i0 + i1) % 2 = 0").select("file_id", "i0", "i1", (F.col("i0") % 7).alias("flag"))
    return arrays.attach_flags(values, flags, ["file_id", "i0", "i1"]).select("i0", "i1", F.round("v", 6).alias("v"), "flag")


@query("""WITH d AS (SELECT l_suppkey, avg(l_discount) AS scale, avg(l_tax) AS shift FROM lineitem GROUP BY l_suppkey)
  SELECT l.l_suppkey, count(*) AS n, round(sum(round(l_extendedprice * scale + shift, 4)), 2) AS total FROM lineitem l JOIN d USING (l_suppkey) GROUP BY 1""")
def scale_offset(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_discount", "l_tax", F.col("l_extendedprice").alias("v"))
    one = lambda c: line.groupBy("l_suppkey").agg(F.avg(c).alias("factor"))
    out = arrays.decode(line, one("l_discount"), one("l_tax"), ["l_suppkey"])
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum(F.round("decoded", 4)), 2).alias("total"))


@query("""WITH d AS (SELECT l_suppkey, avg(l_discount) AS scale, avg(l_tax) AS shift FROM lineitem GROUP BY l_suppkey)
  SELECT l_suppkey, l_returnflag, count(*) AS n, round(sum(round((l_extendedprice * scale + shift) / 1000, 6)), 2) AS total, count(*) FILTER (l_quantity > 25) AS flagged
  FROM lineitem JOIN d USING (l_suppkey) GROUP BY ALL""")
def decoder_chain(spark, sf_dir):
    """Three decoders in the order of registration: scale and offset, a unit, a flag."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("v"))
    one = lambda c: line.groupBy("l_suppkey").agg(F.avg(c).alias("factor"))
    out = arrays.decode_all(line, [
        lambda df: arrays.decode(df, one("l_discount"), one("l_tax"), ["l_suppkey"]),
        lambda df: df.withColumn("decoded", F.round(F.col("decoded") / 1000, 6)), lambda df: df.withColumn("flag", F.col("l_quantity") > 25)])
    return out.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("decoded"), 2).alias("total"), F.count_if("flag").alias("flagged"))


_AXES = "max(CASE WHEN name = 'click' THEN v END) AS click, max(CASE WHEN name = 'view' THEN v END) AS view"


@query(views("component") + f"SELECT user_id, day, round(click, 6) AS click, round(view, 6) AS view FROM (SELECT user_id, day, {_AXES} FROM component WHERE name IN ('click', 'view') GROUP BY ALL)")
def vector_merge(spark, sf_dir):
    out = arrays.align(component_series(spark, sf_dir), ["user_id", "day"], ["click", "view"])
    return out.select("user_id", "day", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@query(views("component") + f"SELECT user_id, day, round(sqrt(click * click + view * view), 6) AS magnitude_of_click_and_view FROM (SELECT user_id, day, {_AXES} FROM component WHERE name IN ('click', 'view') GROUP BY ALL)")
def magnitude(spark, sf_dir):
    out = arrays.magnitude(arrays.align(component_series(spark, sf_dir), ["user_id", "day"], ["click", "view"]), ["click", "view"])
    return out.select("user_id", "day", F.round("magnitude_of_click_and_view", 6).alias("magnitude_of_click_and_view"))


@query(views("series") + "SELECT dataset, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n FROM series GROUP BY dataset")
def dataset_stats(spark, sf_dir):
    return arrays.dataset_stats(user_series(spark, sf_dir), ["dataset"]).select("dataset", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(views("series") + """SELECT dataset, coord, CASE WHEN count(v) OVER w = 10 THEN round(avg(v) OVER w, 6) END AS rolling FROM series
  WINDOW w AS (PARTITION BY dataset ORDER BY coord ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def rolling_mean(spark, sf_dir):
    return arrays.rolling_mean(user_series(spark, sf_dir), ["dataset"], "coord", 10).select("dataset", "coord", F.round("rolling", 6).alias("rolling"))


@query(views("emb") + "SELECT i0, i1, round(v, 6) AS v FROM emb e WHERE EXISTS (SELECT 1 FROM emb x WHERE x.i0 = e.i0 AND x.i1 = 0 AND x.v > 0.1)")
def where_index(spark, sf_dir):
    v = embedding_values(spark, sf_dir)
    return arrays.where_index(v.where("i1 = 0"), F.col("v") > 0.1, ["i0"], v).select("i0", "i1", F.round("v", 6).alias("v"))


@query("""WITH s AS (SELECT vec_id, unnest(range(0, 64)) AS pos, embedding FROM embeddings)
  SELECT CAST(vec_id AS INTEGER) AS i2, CAST(pos // 8 AS INTEGER) AS i0, CAST(pos % 8 AS INTEGER) AS i1, round(CAST(embedding[pos + 1] AS DOUBLE), 6) AS v FROM s""")
def stack_arrays(spark, sf_dir):
    """Embeddings as 8 x 8 images, stacked along a last axis."""
    e = table(spark, sf_dir, "embeddings")
    return arrays.stack(e, "vec_id", "embedding", axis=-1, shape=[8, 8]).select("i0", "i1", "i2", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("SELECT s_suppkey AS key, 'balance' AS name, round(s_acctbal, 6) AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def unpivot_grid(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.round("s_acctbal", 6).alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    scale = table(spark, sf_dir, "supplier").select(F.lit("key").alias("name"), F.col("s_suppkey").alias("index"), F.col("s_suppkey").cast("double").alias("v"))
    return arrays.to_datasets(s, ["key"], ["balance", "nation"], existing=scale)
