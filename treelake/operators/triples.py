"""Triples from the catalogue tables: structure, annotations, attribute mappings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.functions.literals import date_literal, literal_type
from treelake.functions.paths import attribute_iri, object_iri
from treelake.model import HDF, TYPE, XSD
from treelake.skew import distinct_rows

SCHEMA_ABOUT = "https://schema.org/about"
RDF_VALUE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#value"
RELATION = "http://purl.org/dc/terms/relation"


def _t(s: Column, p: str | Column, o: Column, kind: str | Column = "lit", dt: str | Column | None = None) -> Column:
    as_c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(s.alias("s"), as_c(p).alias("p"), o.cast("string").alias("o"), as_c(kind).alias("o_kind"),
                    (F.lit(None).cast("string") if dt is None else as_c(dt)).alias("o_dt"))


def _base(base: str) -> Column:
    if not base.endswith(("#", "/")):
        raise ValueError("the base IRI must end in # or /")
    return F.concat(F.lit(base), F.col("file_id"), F.lit("/"))


def _native(dtype: Column) -> Column:
    """The native type's name of an integer or float type; big-endian types are marked by >."""
    m = lambda k: F.regexp_extract(dtype, r"^([<>|=]?)([a-zA-Z]+)(\d*)$", k)
    bits = F.when(m(2).isin("int", "uint", "float"), m(3)).otherwise((m(3).try_cast("int") * 8).cast("string"))
    sign = F.when(m(2).isin("i", "int"), "I").when(m(2).isin("u", "uint"), "U").when(m(2).isin("f", "float"), "F")
    return F.when(sign.isNotNull(), F.concat(F.lit(HDF + "H5T_"), F.when(sign == "F", "IEEE_F").when(sign == "I", "INTEL_I").otherwise("INTEL_U"),
                                             bits, F.when(m(1) == ">", "BE").otherwise("LE")))


def structural(objects: DataFrame, attributes: DataFrame | None = None, values: DataFrame | None = None,
               base: str = "https://example.org/") -> DataFrame:
    """(s, p, o, o_kind, o_dt) of every file's structure. Objects and attributes are each exploded in one narrow
    pass; only the shared datatype and file nodes are made distinct."""
    iri = lambda name: object_iri(_base(base), name)
    me, root = iri(F.col("name")), F.col("name") == "/"
    file = F.concat(F.lit(base), F.col("file_id"))
    group, data = F.col("obj_type") == "group", F.col("obj_type") == "dataset"
    size = F.aggregate("maxshape", F.lit(1).cast("long"), lambda a, x: F.when(x.isNull() | (a < 0), -1).otherwise(a * x))
    kind = F.when(F.col("dtype").rlike("^[|<>=]?[SUO]|^str|^object"), "H5T_STRING").when(F.col("dtype").rlike("^[<>=|]?[iu]"), "H5T_INTEGER").otherwise("H5T_FLOAT")
    dims = F.transform(F.when(data, F.col("shape")), lambda x, i: _t(
        F.concat(me, F.lit("_dim_"), i.cast("string")), HDF + "size", x, dt=XSD + "integer"))
    chunks = F.transform(F.when(data, F.col("chunks")), lambda x, i: _t(
        F.concat(me, F.lit("_chunk_"), i.cast("string")), HDF + "size", x, dt=XSD + "integer"))
    parent = iri(F.col("parent"))
    rows = F.array(
        F.when(root, _t(file, TYPE, F.lit(HDF + "File"), "iri")), F.when(root, _t(file, HDF + "rootGroup", me, "iri")),
        F.when(group, _t(me, TYPE, F.lit(HDF + "Group"), "iri")), F.when(data, _t(me, TYPE, F.lit(HDF + "Dataset"), "iri")),
        _t(me, HDF + "name", F.col("name")), F.when(F.col("parent").isNotNull(), _t(parent, HDF + "member", me, "iri")),
        F.when(data, _t(me, HDF + "rank", F.col("ndim"), dt=XSD + "integer")), F.when(data, _t(me, HDF + "size", F.col("size"), dt=XSD + "integer")),
        F.when(data & (F.size("maxshape") > 0), _t(me, HDF + "maximumSize", size, dt=XSD + "integer")),
        F.when(data, _t(me, HDF + "datatype", kind)), F.when(data, _t(me, HDF + "datatype", _native(F.col("dtype")), "iri")),
        F.when(data & F.col("layout").isNotNull(), _t(me, HDF + "layout", F.concat(F.lit(HDF + "H5D_"), F.upper("layout")), "iri")),
        F.when(data & F.col("compression").isNotNull(), _t(me, HDF + "filter", F.col("compression"))),
        F.when(data & F.col("compression_opts").isNotNull(), _t(me, HDF + "deflateLevel", F.col("compression_opts"), dt=XSD + "integer")))
    empty = F.array().cast(f"array<struct<s:string,p:string,o:string,o_kind:string,o_dt:string>>")
    every = F.concat(rows, F.coalesce(dims, empty), F.coalesce(chunks, empty))
    out = objects.select(F.explode(every).alias("t")).where("t is not null and t.o is not null").select("t.*")
    if attributes is not None:
        own = attributes.where(~F.col("attr").rlike("^[A-Z@]"))
        it = attribute_iri(_base(base), F.col("name"), F.col("attr"))
        text = F.coalesce("s", F.col("i").cast("string"), F.col("d").cast("string"), "json")
        kinds = F.when(F.col("vtype") == "int", HDF + "IntegerAttribute").when(F.col("vtype") == "float", HDF + "FloatAttribute").otherwise(
            HDF + "StringAttribute")
        several = F.transform("a", lambda x: _t(it, HDF + "data", x))
        triples = F.concat(F.array(_t(iri(F.col("name")), HDF + "attribute", it, "iri"), _t(it, TYPE, kinds, "iri"), _t(it, HDF + "name", F.col("attr")),
                                   F.when(text.isNotNull(), _t(it, HDF + "data", text, dt=literal_type(F.col("vtype"))))), F.coalesce(several, empty))
        out = out.unionByName(own.select(F.explode(triples).alias("t")).where("t is not null").select("t.*"))
    if values is not None:
        scalar = values.where("i0 is null")
        number = F.col("v").isNotNull()
        out = out.unionByName(scalar.select(_t(iri(F.col("name")), HDF + "value", F.coalesce(F.col("v").cast("string"), "sv"),
                                               dt=F.when(number, XSD + "double")).alias("t")).where("t.o is not null").select("t.*"))
    return out


def contextual(objects: DataFrame, attributes: DataFrame, annotations: DataFrame, base: str = "https://example.org/") -> DataFrame:
    """(s, p, o, o_kind, o_dt) of the annotations: types, the annotated attribute's value under its predicate (a given
    object instead of the value), fallback predicates without one, and what each object is about."""
    me = object_iri(_base(base), F.col("name"))
    text = F.coalesce("s", F.col("i").cast("string"), F.col("d").cast("string"), "json")
    held = attributes.select("file_id", "name", "attr", text.alias("text"), "vtype")
    rows = annotations.join(held, ["file_id", "name", "attr"], "left").join(objects.select("file_id", "name"), ["file_id", "name"], "left_semi")
    subject = F.coalesce("subject", me)
    date = date_literal(F.col("text"))
    is_iri = F.when(F.col("object").isNotNull(), F.col("object_kind") == "iri").otherwise(F.col("text").rlike("^https?://"))
    o = F.coalesce("object", "text")
    kind = F.when(is_iri, "iri").otherwise("lit")
    dt = F.when(~is_iri & F.col("object").isNull(), F.coalesce(date, literal_type(F.col("vtype"))))
    p = F.coalesce("predicate", F.when(is_iri, RELATION).otherwise(RDF_VALUE))
    empty = F.array().cast("array<struct<s:string,p:string,o:string,o_kind:string,o_dt:string>>")
    types = F.transform("types", lambda t: _t(subject, TYPE, t, "iri"))
    every = F.concat(F.coalesce(types, empty), F.array(
        F.when(o.isNotNull(), _t(subject, p, o, kind, dt)), F.when(F.col("subject").isNotNull() & (F.col("subject") != me), _t(me, SCHEMA_ABOUT, F.col("subject"), "iri"))))
    return rows.select(F.explode(every).alias("t")).where("t is not null").select("t.*").distinct()


def select_graph(structural_rows: DataFrame | None, contextual_rows: DataFrame | None) -> DataFrame:
    """Either graph or their union as a set; neither is an error."""
    given = [g for g in (structural_rows, contextual_rows) if g is not None]
    if not given:
        raise ValueError("structural, contextual or both must be given")
    return given[0] if len(given) == 1 else distinct_rows(given[0].unionByName(given[1]))


def map_attributes(attributes: DataFrame, mapping: dict[str, str], objects: dict[str, Callable[[Column], Column]] | None = None,
                   base: str = "https://example.org/") -> DataFrame:
    """(s, p, o): attributes named in ``mapping`` under its predicates; a function may change the value, or drop
    the triple by giving null."""
    text = F.coalesce("s", F.col("i").cast("string"), F.col("d").cast("string"), "json")
    p, o = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, predicate in mapping.items():
        p = p.when(F.col("attr") == name, predicate)
        o = o.when(F.col("attr") == name, (objects or {}).get(name, lambda c: c)(text))
    rows = attributes.where(F.col("attr").isin(*mapping)).select(object_iri(_base(base), F.col("name")).alias("s"), p.alias("p"), o.alias("o"))
    return rows.where("o is not null").distinct()
