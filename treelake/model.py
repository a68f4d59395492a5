"""The catalogue tables, and builders of them over the given tables.

The library works on a few wide tables that hold every object of every file (SCHEMAS). The builders
present the given star schema in those tables: events as trees of scalar datasets, the business
tables as an entity graph, embeddings as an array, prices as scaled data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "objects": "file_id string, name string, parent string, basename string, depth int, obj_type string, dtype string, "
               "ndim int, shape array<long>, maxshape array<long>, size long, chunks array<long>, compression string, "
               "compression_opts int, layout string",
    "attributes": "file_id string, name string, attr string, vtype string, s string, i long, d double, a array<string>, json string",
    "values": "file_id string, name string, i0 int, i1 int, i2 int, v double, sv string",
    "dim_scales": "file_id string, dataset string, axis int, iscale int, scale_name string",
    "links": "file_id string, name string, role string, target string",
    "rdf_annot": "file_id string, name string, scope string, attr string, subject string, types array<string>, "
                 "predicate string, object string, object_kind string",
    "triples": "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string",
}

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
HDF = "http://purl.allotrope.org/ontologies/hdf5/1.8#"
EX = "http://ex.org/"
TYPE, LABEL = RDF + "type", RDFS + "label"


@dataclass
class Catalogue:
    """The tables a search works on; those not needed may be left out."""

    objects: DataFrame
    attributes: DataFrame | None = None
    values: DataFrame | None = None
    annotations: DataFrame | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table up to which one task takes the rows of it that are grouped by long names.
TASK_BYTES = 8 << 20


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table for work that holds its rows' names in memory: a large one is dealt by ``key`` to as many tasks as its bytes
    ask for, so that a task holds no more of a larger table. All rows of a key are one task's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    rows, parts = table(spark, sf_dir, name), -(-size // TASK_BYTES)
    return rows if parts <= spark.sparkContext.defaultParallelism else rows.repartition(parts, key)


# --- events as files of groups and scalar datasets ------------------------------------------------

_UNITS = {"click": "", "view": "s", "purchase": "V", "error": "invalid"}


def _object(file_id: Column, name: Column, parent: Column, base: Column, depth: int, kind: str) -> Column:
    data = kind == "dataset"
    dims = F.array().cast("array<bigint>") if data else F.lit(None).cast("array<bigint>")
    return F.struct(
        file_id.alias("file_id"), name.alias("name"), parent.alias("parent"), base.alias("basename"),
        F.lit(depth).alias("depth"), F.lit(kind).alias("obj_type"), F.lit("float64" if data else None).cast("string").alias("dtype"),
        F.lit(0 if data else None).cast("int").alias("ndim"), dims.alias("shape"), dims.alias("maxshape"),
        F.lit(1 if data else None).cast("long").alias("size"), F.lit(None).cast("array<bigint>").alias("chunks"),
        F.lit(None).cast("string").alias("compression"), F.lit(None).cast("int").alias("compression_opts"),
        F.lit("contiguous" if data else None).cast("string").alias("layout"))


def _event_file() -> Column:
    return F.concat(F.lit("user_"), F.col("user_id").cast("string"))


def _event_name() -> Column:
    return F.concat(F.lit("/"), F.col("event_type"), F.lit("/e"), F.col("event_id").cast("string"))


def event_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root and one group per event type for each user, one scalar dataset per event."""
    e = table(spark, sf_dir, "events")
    f, group = _event_file(), F.concat(F.lit("/"), F.col("event_type"))
    data = e.select(_object(f, _event_name(), group, F.concat(F.lit("e"), F.col("event_id").cast("string")), 2, "dataset").alias("o"))
    groups = e.select("user_id", "event_type").distinct().select(_object(f, group, F.lit("/"), F.col("event_type"), 1, "group").alias("o"))
    roots = e.select("user_id").distinct().select(_object(f, F.lit("/"), F.lit(None).cast("string"), F.lit(""), 0, "group").alias("o"))
    return data.union(groups).union(roots).select("o.*")


def event_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five attributes per event; signups have no units."""
    e = table(spark, sf_dir, "events")
    none = {"s": "string", "i": "long", "d": "double", "json": "string"}

    def attr(name: str, kind: str, **value: Column) -> Column:
        cols = [value[k].alias(k) if k in value else F.lit(None).cast(t).alias(k) for k, t in none.items()]
        cols.insert(3, F.lit(None).cast("array<string>").alias("a"))
        return F.struct(F.lit(name).alias("attr"), F.lit(kind).alias("vtype"), *cols)

    units = F.when(F.lit(False), "")
    for k, v in _UNITS.items():
        units = units.when(F.col("event_type") == k, v)
    rows = F.array(attr("event_type", "str", s=F.col("event_type")), attr("value", "float", d=F.col("value")),
                   attr("props", "json", json=F.col("props")),
                   attr("ts", "str", s=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), attr("units", "str", s=units))
    out = e.select(_event_file().alias("file_id"), _event_name().alias("name"), F.explode(rows).alias("x")).select("file_id", "name", "x.*")
    return out.where("attr <> 'units' or s is not null")


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = [F.lit(None).cast("int").alias(k) for k in ("i0", "i1", "i2")]
    return table(spark, sf_dir, "events").select(_event_file().alias("file_id"), _event_name().alias("name"), *none,
                                                 F.col("value").alias("v"), F.lit(None).cast("string").alias("sv"))


def event_catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    return Catalogue(event_objects(spark, sf_dir), event_attributes(spark, sf_dir), event_values(spark, sf_dir),
                     event_annotations(spark, sf_dir))


def event_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases are annotated: a subject and type for each, a predicate for their value."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    return e.select(
        _event_file().alias("file_id"), _event_name().alias("name"), F.lit("obj").alias("scope"), F.lit("value").alias("attr"),
        F.concat(F.lit(EX + "event/"), F.col("event_id").cast("string")).alias("subject"),
        F.array(F.concat(F.lit(EX + "class/"), F.col("event_type"))).alias("types"), F.lit(EX + "hasValue").alias("predicate"),
        F.when(F.col("value") > 50, EX + "High").alias("object"), F.when(F.col("value") > 50, "iri").alias("object_kind"))


# --- the business tables as an entity graph -------------------------------------------------------

def _iri(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{EX}{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _triples(df: DataFrame, graph: str, s: Column, p: str, o: Column, kind: str, datatype: str | None = None,
             lang: Column | None = None, s_kind: str = "iri") -> DataFrame:
    """One triple a row. Graph, predicate and kinds are literals, so a pattern drops all branches of a union but its own."""
    return df.select(F.lit(graph).alias("graph"), s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(p).alias("p"), o.alias("o"),
                     F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_dt"),
                     (F.lit(None) if lang is None else lang).cast("string").alias("o_lang"))


def entity_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, labels, references, prices and dates of all business tables; a narrow pass for each predicate of a table, with the
    columns it needs; only the references of order lines are made distinct."""
    t = lambda name: table(spark, sf_dir, name) if name not in of else dealt(spark, sf_dir, name, of[name])
    of = {"customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    rows: list[DataFrame] = []

    def add(name: str, graph: str, s: Column, p: str, o: Column, kind: str = "iri", datatype: str | None = None) -> None:
        rows.append(_triples(t(name), graph, s, p, o, kind, datatype))

    keys = (("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"),
            ("supplier", "supplier", "s_suppkey"), ("part", "part", "p_partkey"), ("orders", "order", "o_orderkey"))
    for name, kind, key in keys:
        add(name, kind, _iri(kind, key), TYPE, F.lit(f"{EX}class/{kind}"))
    r, n, c, s, p, o = (_iri(kind, key) for _, kind, key in keys)
    money = lambda name: F.col(name).cast("decimal(18,2)").cast("string")
    add("region", "region", r, LABEL, F.col("r_name"), "lit")
    add("nation", "nation", n, LABEL, F.col("n_name"), "lit")
    add("nation", "nation", n, EX + "inRegion", _iri("region", "n_regionkey"))
    add("customer", "customer", c, EX + "inNation", _iri("nation", "c_nationkey"))
    add("customer", "customer", c, EX + "balance", money("c_acctbal"), "lit", XSD + "double")
    add("supplier", "supplier", s, EX + "inNation", _iri("nation", "s_nationkey"))
    add("part", "part", p, EX + "name", F.col("p_name"), "lit")
    add("orders", "order", o, EX + "by", _iri("customer", "o_custkey"))
    add("orders", "order", o, EX + "total", money("o_totalprice"), "lit", XSD + "double")
    add("orders", "order", o, EX + "date", F.date_format("o_orderdate", "yyyy-MM-dd"), "lit", XSD + "date")
    for p, kind, key in ((EX + "hasPart", "part", "l_partkey"), (EX + "fromSupplier", "supplier", "l_suppkey")):
        line = t("lineitem").select("l_orderkey", key).distinct()
        rows.append(_triples(line, "order", _iri("order", "l_orderkey"), p, _iri(kind, key), "iri"))
    return reduce(DataFrame.unionByName, rows)


def contact_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What other sources say of suppliers: a blank contact node with a name and a telephone number that may be empty, and
    the same supplier in a register of the solvent ones."""
    t = table(spark, sf_dir, "supplier")
    s = _iri("supplier", "s_suppkey")
    node = F.concat(F.lit("c"), F.col("s_suppkey").cast("string"))
    phone = F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey").cast("string")).otherwise("")
    return reduce(DataFrame.unionByName, [
        _triples(t, "contacts", s, EX + "contact", node, "bnode"), _triples(t, "contacts", node, EX + "name", F.col("s_name"), "lit", s_kind="bnode"),
        _triples(t, "contacts", node, EX + "phone", phone, "lit", s_kind="bnode"),
        _triples(t.where("s_acctbal >= 0"), "contacts", s, OWL + "sameAs", F.concat(F.lit("https://register.example.net/s#"), F.col("s_suppkey").cast("string")), "iri")])


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region over nation over customer over order, as (s, o) of the member predicate."""
    t = lambda name: table(spark, sf_dir, name)
    rows = [t("nation").select(_iri("region", "n_regionkey").alias("s"), _iri("nation", "n_nationkey").alias("o")),
            t("customer").select(_iri("nation", "c_nationkey").alias("s"), _iri("customer", "c_custkey").alias("o")),
            t("orders").select(_iri("customer", "o_custkey").alias("s"), _iri("order", "o_orderkey").alias("o"))]
    return rows[0].union(rows[1]).union(rows[2])


def text_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as described resources, the text tagged with its language."""
    d = table(spark, sf_dir, "documents")
    return _triples(d, "documents", _iri("document", "doc_id"), "http://purl.org/dc/terms/description", F.coalesce("text", F.lit("")), "lit",
                    None, F.col("lang"))


# --- arrays -----------------------------------------------------------------------------------------

def embedding_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as one two-dimensional dataset."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select(F.lit("emb").alias("file_id"), F.lit("/embeddings").alias("name"), F.col("vec_id").cast("int").alias("i0"),
                    F.col("pos").alias("i1"), F.lit(None).cast("int").alias("i2"), F.col("x").cast("double").alias("v"),
                    F.lit(None).cast("string").alias("sv"))


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, coord, v): a dataset per user over the seconds of its events; one value a second."""
    e = table(spark, sf_dir, "events").select(_event_file().alias("dataset"), F.unix_timestamp("ts").alias("coord"), "event_id", "value")
    return e.groupBy("dataset", "coord").agg(F.min_by("value", "event_id").alias("v"))


def component_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, user_id, day, v): per event type a dataset over (user, day)."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"),
                                              F.col("value").cast("decimal(18,4)").alias("value"))
    return e.groupBy(F.col("event_type").alias("name"), "user_id", "day").agg((F.sum("value").cast("double") / F.count("*")).alias("v"))
