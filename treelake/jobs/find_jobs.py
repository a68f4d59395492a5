"""Queries of the find language over the event tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake.jobs.registry import query
from treelake.jobs.views_sql import views
from treelake.model import EX, Catalogue, embedding_values, event_catalogue, event_objects
from treelake.operators import filters

_KEY = ["file_id", "name"]
_ATTR = views("attributes") + "SELECT file_id, name FROM attributes WHERE "
_OBJ = views("objects") + "SELECT file_id, name FROM objects WHERE "


@query(_ATTR + "attr = 'units' AND s = 'V'")
def find_attr_eq(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"units": "V"}).select(*_KEY)


@query(_ATTR + "attr = 'value' AND d > 10 AND d <= 50")
def find_attr_cmp(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"value": {"$gt": 10, "$lte": 50}}, match="all").select(*_KEY)


@query(_ATTR + "attr = 'value' AND (d < 1 OR d >= 90)")
def find_attr_any(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"value": {"$lt": 1, "$gte": 90}}).select(*_KEY)


@query(_ATTR + "attr = 'event_type' AND s IN ('error', 'signup')")
def find_in(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"event_type": {"$in": ["error", "signup"]}}).select(*_KEY)


@query(_ATTR + "attr = 'ts' AND regexp_matches(s, 'T0[0-5]:.*[05]$')")
def find_regex(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"ts": {"$regex": "T0[0-5]:.*[05]$"}}).select(*_KEY)


@query(_OBJ + "regexp_matches(name, '^.*/e1[0-9]*7$')")
def find_basename(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"$basename": "e1[0-9]*7"}).select(*_KEY)


@query(_ATTR + "attr = 'units'")
def find_exists(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"units": {"$exists": True}}).select(*_KEY)


@query(views("objects", "attributes") + """SELECT file_id, name FROM objects o WHERE obj_type = 'dataset'
  AND NOT EXISTS (SELECT 1 FROM attributes a WHERE a.file_id = o.file_id AND a.name = o.name AND a.attr = 'units')""")
def find_not_exists(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"units": {"$exists": False}}, "dataset").select(*_KEY)


@query(_ATTR + "attr = 'ts' AND length(s) = 19 AND CAST(substr(s, 18, 2) AS INTEGER) % 7 = 0")
def find_userdefined(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir),
                        {"ts": lambda c: (F.length(c) == 19) & (F.substring(c, 18, 2).cast("int") % 7 == 0)}).select(*_KEY)


@query(_ATTR + "attr = 'props' AND CAST(json_extract_string(json, '$.k') AS DOUBLE) >= 90")
def find_json_path(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"props.k": {"$gte": 90}}).select(*_KEY)


@query(_OBJ + "ndim = 0 AND dtype = 'float64' AND regexp_matches(name, '/e[5-9][0-9]+$')")
def find_property(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"$ndim": 0, "$dtype": "float64", "$shape": [],
                                                         "$name": {"$regex": "/e[5-9][0-9]+$"}}).select(*_KEY)


@query("SELECT 'user_' || user_id AS file_id, '/' || event_type || '/e' || event_id AS name FROM events WHERE value >= 40 AND value < 60")
def find_value(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"$gte": 40, "$lt": 60}).select(*_KEY)


def _vectors(spark, sf_dir) -> Catalogue:
    """One dataset per embedding."""
    v = embedding_values(spark, sf_dir).select("file_id", F.concat(F.lit("/v"), F.col("i0").cast("string")).alias("name"),
                                               F.col("i1").alias("i0"), F.lit(None).cast("int").alias("i1"), "i2", "v", "sv")
    objects = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.lit("emb").alias("file_id"), F.concat(F.lit("/v"), F.col("vec_id").cast("string")).alias("name"), F.lit("/").alias("parent"),
        F.lit("dataset").alias("obj_type"))
    return Catalogue(objects, values=v)


@query("""SELECT 'emb' AS file_id, '/v' || vec_id AS name FROM embeddings
  WHERE list_sum([CAST(x AS DOUBLE) for x in embedding]) / len(embedding) > 0.01""")
def find_value_mean(spark, sf_dir):
    return filters.find(_vectors(spark, sf_dir), {"$mean": {"$gt": 0.01}}).select(*_KEY)


@query(_OBJ + "obj_type = 'group'")
def find_objfilter(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {}, "groups").select(*_KEY)


@query(views("objects") + """SELECT 'below' AS scope, file_id, name FROM objects WHERE name = '/error' OR name LIKE '/error/%'
  UNION ALL SELECT 'direct', file_id, name FROM objects WHERE parent = '/'""")
def find_scope(spark, sf_dir):
    cat = event_catalogue(spark, sf_dir)
    below = filters.find(cat, {}, base="/error").select(F.lit("below").alias("scope"), *_KEY)
    return below.union(filters.find(cat, {}, recursive=False).select(F.lit("direct").alias("scope"), *_KEY))


@query(views("attributes") + """SELECT file_id, name FROM attributes WHERE attr IN ('units', 'props')
  GROUP BY file_id, name HAVING count(DISTINCT attr) = 2""")
def find_has_all(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), ["units", "props"]).select(*_KEY)


@query(views("attributes") + """SELECT file_id, name FROM attributes GROUP BY file_id, name
  HAVING bool_or(attr = 'event_type' AND s = 'error') AND bool_or(attr = 'value' AND d > 10)""")
def find_and(spark, sf_dir):
    return filters.find(event_catalogue(spark, sf_dir), {"event_type": "error", "value": {"$gt": 10}}, "dataset").select(*_KEY)


@query(views("attributes") + """, hits AS (SELECT file_id, name FROM attributes WHERE attr = 'units' AND s = 'V')
  SELECT 'each' AS which, file_id, min(name) AS name FROM hits GROUP BY file_id
  UNION ALL (SELECT 'first', file_id, name FROM hits ORDER BY file_id, name LIMIT 1)""")
def find_one(spark, sf_dir):
    cat = event_catalogue(spark, sf_dir)
    each = filters.find_one(cat, {"units": "V"}, per_file=True).select(F.lit("each").alias("which"), *_KEY)
    return each.union(filters.find_one(cat, {"units": "V"}).select(F.lit("first").alias("which"), *_KEY))


@query(views("objects") + """SELECT file_id, name, obj_type FROM objects WHERE (obj_type = 'dataset' AND parent = '/view'
  AND regexp_matches(basename, '[02468]$')) OR (obj_type = 'group' AND parent = '/' AND regexp_matches(basename, '^[c-p]'))""")
def list_datasets(spark, sf_dir):
    o = event_objects(spark, sf_dir)
    return filters.list_children(o, "dataset", "[02468]$", "/view").union(filters.list_children(o, "group", "^[c-p]")).select(
        *_KEY, "obj_type")


@query(views("objects") + """SELECT file_id, bool_or(coalesce(parent = '/signup' AND obj_type = 'dataset', false)) AS has_datasets,
  bool_or(coalesce(parent = '/signup' AND obj_type = 'group', false)) AS has_groups FROM objects GROUP BY file_id""")
def has_datasets(spark, sf_dir):
    return filters.has_children(event_objects(spark, sf_dir), "/signup")


@query(views("annotations") + f"""SELECT file_id, name FROM annotations
  WHERE type = '{EX}class/error' AND predicate = '{EX}hasValue' AND object = '{EX}High'""")
def rdf_find(spark, sf_dir):
    return filters.rdf_find(event_catalogue(spark, sf_dir), type=EX + "class/error", predicate=EX + "hasValue",
                            object=EX + "High").select(*_KEY)


@query(views("attributes") + "SELECT DISTINCT s AS value FROM attributes WHERE attr = 'units'")
def distinct_attr(spark, sf_dir):
    return filters.distinct_values(event_catalogue(spark, sf_dir), "units", "dataset")


@query(views("objects") + "SELECT DISTINCT basename AS value FROM objects WHERE obj_type = 'group'")
def distinct_prop(spark, sf_dir):
    return filters.distinct_values(event_catalogue(spark, sf_dir), "$basename", "group")


@query(views("attributes") + """, hits AS (SELECT file_id, name FROM attributes GROUP BY file_id, name
  HAVING bool_or(attr = 'event_type' AND s = 'error') AND bool_or(attr = 'value' AND d > 10))
  SELECT file_id, count(*) AS n_hits FROM hits GROUP BY file_id""")
def search_hits_per_file(spark, sf_dir):
    hits = filters.find(event_catalogue(spark, sf_dir), {"event_type": "error", "value": {"$gt": 10}}, "dataset")
    return hits.groupBy("file_id").agg(F.count("*").alias("n_hits"))
