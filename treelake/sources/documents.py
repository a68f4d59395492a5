"""Metadata documents: one per object or per slice, upserts, registries, trees, nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake import ranges
from treelake.model import Catalogue

#: Attributes that are bookkeeping of the container; they never enter documents.
PROTECTED = ("CLASS", "NAME", "DIMENSION_LIST", "REFERENCE_LIST", "COORDINATES", "PROVENANCE")
KEY = ["file_id", "name"]


def attribute_maps(attributes: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """(file_id, name, attrs): a map of each object's attributes as text, protected and ignored ones left out."""
    own = attributes.where(~F.col("attr").isin(*PROTECTED, *(ignore or [])) & ~F.col("attr").startswith("RDF_"))
    text = F.coalesce("s", F.col("i").cast("string"), F.col("d").cast("string"), "json", F.concat_ws(",", "a"))
    return own.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", text.alias("value"))))).alias("attrs"))


def object_documents(cat: Catalogue, ignore: list[str] | None = None, recursive: bool = True, base: str = "/",
                     **additional: str) -> DataFrame:
    """One document per object: place, kind, shape, scalar value, attributes and additional fields."""
    objects = cat.objects if recursive else cat.objects.where((F.col("name") == base) | (F.col("parent") == base))
    out = objects.join(attribute_maps(cat.attributes, ignore), KEY, "left")
    if cat.values is not None:
        out = out.join(cat.values.where("i0 is null").select(*KEY, "v"), KEY, "left")
    extra = [F.lit(v).alias(k) for k, v in additional.items()]
    data = F.col("v") if cat.values is not None else F.lit(None).cast("double")
    return out.select(F.col("file_id").alias("filename"), "name", "basename", "obj_type", "shape", "ndim", data.alias("data"), "attrs", *extra)


def slice_documents(datasets: DataFrame, scales: DataFrame, size: str = "n0") -> DataFrame:
    """``datasets`` (file_id, name, n0) and ``scales`` (file_id, dataset, scale_name, i, value) to one document for each
    index of the first axis: the slice, and every attached scale's value there. Attributes stay in the
    object's document, which the pair (filename, name) names."""
    rows = datasets.where(F.col(size) > 0).select(*KEY, F.explode(F.sequence(F.lit(0), (F.col(size) - 1).cast("int"))).alias("i"))
    held = scales.groupBy("file_id", F.col("dataset").alias("name"), "i").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("scale_name", "value")))).alias("scales"))
    one = F.array(F.struct(F.col("i").alias("start"), (F.col("i") + 1).alias("stop"), F.lit(1).alias("step")))
    return rows.join(held, [*KEY, "i"], "left").select(F.col("file_id").alias("filename"), "name", one.alias("slice"), "scales")


def apply_slices(documents: DataFrame, values: DataFrame) -> DataFrame:
    """The cells that the documents' slices name."""
    first = F.element_at("slice", 1)
    own = documents.select(F.col("filename").alias("file_id"), "name", F.explode(F.sequence(
        first["start"], first["stop"] - 1, first["step"])).alias("i0"))
    return values.join(own, [*KEY, "i0"], "left_semi")


def upsert(existing: DataFrame, incoming: DataFrame, update: bool = True) -> DataFrame:
    """``existing`` with ``incoming``. The match is on the whole document, so an update adds those documents that no
    identical one precedes; a plain insert adds all. Maps compare by their sorted entries."""
    if not update:
        return existing.unionByName(incoming, allowMissingColumns=True)
    digest = lambda df: df.withColumn("__d", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))
    new = digest(incoming).dropDuplicates(["__d"]).join(digest(existing).select("__d"), "__d", "left_anti").drop("__d")
    return existing.unionByName(new)


def find_documents(documents: DataFrame, condition, listing: DataFrame) -> DataFrame:
    """Documents that match and whose file is still listed (path); documents without a file name are an error."""
    checked = documents.where(condition).withColumn("filename", F.coalesce("filename", F.raise_error(F.lit("a document has no filename")).cast("string")))
    return checked.join(listing.select(F.col("path").alias("filename")).distinct(), "filename", "left_semi")


def register_files(registry: DataFrame, files: DataFrame) -> DataFrame:
    """``registry`` (id, path, created, metadata) with those ``files`` (path, metadata) whose path is new; the id is the
    hash of the path, so registering again or elsewhere gives the same one."""
    new = files.dropDuplicates(["path"]).join(registry.select("path"), "path", "left_anti")
    return registry.unionByName(new.select(F.sha2("path", 256).alias("id"), "path", F.current_timestamp().alias("created"), "metadata"))


def tree_rows(cat: Catalogue, ignore: list[str] | None = None) -> DataFrame:
    """(file_id, name, parent, depth, node): every object of a file as a JSON node of its kind and its attributes under ``/``;
    sorted by name within a file, the rows are the tree, for files too large for one string."""
    nodes = cat.objects.join(attribute_maps(cat.attributes, ignore), KEY, "left")
    return nodes.select(*KEY, "parent", "depth", F.to_json(F.struct(
        F.col("basename").alias("name"), F.col("obj_type").alias("kind"), "ndim", F.col("attrs").alias("/"))).alias("node"))


def trees(cat: Catalogue, depth: int | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(file_id, tree): a JSON tree per file, down to its deepest object or to ``depth``, folded from the deepest level up: a
    node is its kind, its attributes under ``/`` and its children, in the order of their names. A tree is one string; see
    :func:`tree_rows` for files of any size."""
    if depth is None:
        depth = cat.objects.agg(F.max("depth")).first()[0] or 0
    nodes = cat.objects.where(F.col("depth") <= depth).join(attribute_maps(cat.attributes, ignore), KEY, "left")
    below = None
    for level in range(depth, -1, -1):
        own = nodes.where(F.col("depth") == level)
        if below is not None:
            own = own.join(below, (own["file_id"] == below["__f"]) & (own["name"] == below["__p"]), "left").drop("__f", "__p")
        children = F.coalesce("children", F.array()) if below is not None else F.array().cast("array<string>")
        own_json = F.to_json(F.struct(F.col("basename").alias("name"), F.col("obj_type").alias("kind"), "ndim", F.col("attrs").alias("/")))
        node = F.concat(F.substring(own_json, F.lit(1), F.length(own_json) - 1), F.lit(',"children":['), F.array_join(children, ","), F.lit("]}"))
        if level == 0:
            return own.select("file_id", node.alias("tree"))
        below = own.select(F.col("file_id").alias("__f"), F.col("parent").alias("__p"), F.struct("basename", node.alias("node")).alias("n"))
        below = below.groupBy("__f", "__p").agg(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["node"]).alias("children"))
    raise AssertionError


def tree_texts(cat: Catalogue, ignore: list[str] | None = None) -> DataFrame:
    """(file_id, at, text): each file's JSON tree in pieces; joined in the order of ``at`` they are the text that :func:`trees` gives.

    Objects are sorted by path in ranges. What a piece closes before it opens its own node follows from its depth and that of the
    row before, which the range borrows from its neighbour where it has to, so a file of any size is many tasks'. Every object's parents
    must be objects too."""
    nodes = tree_rows(cat, ignore).select("file_id", F.replace("name", F.lit("/"), F.lit("\x01")).alias("key"), "depth", "node")
    # A last row closes what is open; no name comes after it.
    last = cat.objects.where("name = '/'").select("file_id", F.lit("\U0010ffff").alias("key"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("node"))
    rows = ranges.rolling(nodes.unionByName(last), ["file_id"], ["key"], 2, before=lambda w: F.when(F.count(F.lit(1)).over(w) == 2, F.first("depth").over(w)))
    closed = F.when(F.col("before") >= F.col("depth"), F.repeat(F.lit("]}"), F.col("before") - F.col("depth") + 1))
    comma = F.when(F.col("before").isNotNull() & (F.col("before") >= F.col("depth")) & F.col("node").isNotNull(), ",")
    opened = F.concat(F.left("node", F.char_length("node") - 1), F.lit(',"children":['))
    pieces = rows.select("file_id", "key", F.concat(*[F.coalesce(c, F.lit("")) for c in (closed, comma, opened)]).alias("text"))
    return ranges.numbered(pieces, ["file_id"], ["key"], "at").select("file_id", "at", "text")


def cast_bindings(results: DataFrame) -> DataFrame:
    """Result cells (row, variable, value, datatype) with typed columns beside the text: integers, decimals, floats,
    booleans, times and dates; what does not parse keeps its text alone."""
    local = F.substring_index("datatype", "#", -1)
    text = F.col("value")
    whole = local.isin("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")
    return results.withColumns({
        "as_long": F.when(whole, text.try_cast("long")), "as_double": F.when(local.isin("double", "float", "decimal"), text.try_cast("double")),
        "as_boolean": F.when(local == "boolean", F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)),
        "as_time": F.when(local == "dateTime", text.try_cast("timestamp")), "as_date": F.when(local == "date", text.try_cast("date"))})


def parse_bindings(json_rows: DataFrame, column: str = "json") -> DataFrame:
    """Query results in their JSON form, one result per row, to (row, variable, value, datatype)."""
    schema = "struct<results:struct<bindings:array<map<string,struct<value:string,datatype:string,type:string>>>>>"
    rows = json_rows.select(F.posexplode(F.from_json(column, schema)["results"]["bindings"]).alias("row", "b"))
    return rows.select("row", F.explode("b").alias("variable", "cell")).select("row", "variable", "cell.value", "cell.datatype")


def provenance(objects: DataFrame, attributes: DataFrame) -> DataFrame:
    """(file_id, name, file_attrs, parent_attrs): of each dataset the attributes of its root and its group."""
    maps = attribute_maps(attributes)
    root = maps.where("name = '/'").select("file_id", F.col("attrs").alias("file_attrs"))
    up = maps.select("file_id", F.col("name").alias("parent"), F.col("attrs").alias("parent_attrs"))
    data = objects.where("obj_type = 'dataset'").select(*KEY, "parent")
    return data.join(root, "file_id", "left").join(up, ["file_id", "parent"], "left").select(*KEY, "file_attrs", "parent_attrs")
