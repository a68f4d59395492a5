"""Queries of documents, registries, files and N-Triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake.jobs.registry import query
from treelake.jobs.views_sql import views
from treelake.lineage import new_folder, remove
from treelake.model import EX, Catalogue, embedding_values, entity_triples, event_attributes, event_catalogue, event_objects, event_values, table, text_triples
from treelake.operators import triples as T
from treelake.skew import distinct_rows
from treelake.sources import documents, files

_V = "coalesce(s, CAST(d AS VARCHAR), json)"
_MAPS = f""", m AS (SELECT file_id, name, string_agg(CASE WHEN attr = 'value' THEN 'value' ELSE attr || '=' || {_V} END, ';' ORDER BY attr) AS attrs
  FROM attributes GROUP BY file_id, name)"""


def _entries(c: str):
    """A map's entries as text; the number keeps its name alone, as engines write doubles differently."""
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.when(e["key"] == "value", "value").otherwise(
        F.concat(e["key"], F.lit("="), e["value"]))), ";")


@query(views("objects", "attributes").rstrip() + _MAPS + """ SELECT o.file_id AS filename, o.name, o.basename, o.obj_type, o.ndim, e.value AS data, attrs, 'run' AS project
  FROM objects o LEFT JOIN m ON m.file_id = o.file_id AND m.name = o.name LEFT JOIN events e ON o.obj_type = 'dataset' AND 'e' || e.event_id = o.basename""")
def object_documents(spark, sf_dir):
    out = documents.object_documents(event_catalogue(spark, sf_dir), project="run")
    return out.select("filename", "name", "basename", "obj_type", "ndim", "data", _entries("attrs").alias("attrs"), "project")


@query("""SELECT 'emb' AS filename, '/embeddings' AS name, CAST(vec_id AS INTEGER) AS start, CAST(vec_id + 1 AS INTEGER) AS stop,
  'half=' || (vec_id // 2) || ';label=' || label AS scales FROM embeddings""")
def slice_documents(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    data = e.agg((F.max("vec_id") + 1).cast("int").alias("n0")).select(F.lit("emb").alias("file_id"), F.lit("/embeddings").alias("name"), "n0")
    scale = lambda n, c: F.struct(F.lit(n).alias("scale_name"), c.cast("string").alias("value"))
    scales = e.select(F.lit("emb").alias("file_id"), F.lit("/embeddings").alias("dataset"), F.col("vec_id").cast("int").alias("i"),
                      F.explode(F.array(scale("label", F.col("label")), scale("half", F.floor(F.col("vec_id") / 2)))).alias("x")).select("file_id", "dataset", "i", "x.*")
    out = documents.slice_documents(data, scales)
    first = F.element_at("slice", 1)
    return out.select("filename", "name", first["start"].alias("start"), first["stop"].alias("stop"), _entries("scales").alias("scales"))


@query("""SELECT DISTINCT lang, source, md5(coalesce(text, '')) AS digest FROM documents""")
def document_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return documents.upsert(documents.upsert(d.limit(0), d.where("source < 'src2'")), d)


@query("""SELECT doc_id, lang, source AS filename FROM documents WHERE lang = 'de' AND source IN (SELECT source FROM documents WHERE lang = 'fr' AND n_chars > 9000)""")
def document_find(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("filename"), "n_chars")
    listing = d.where("lang = 'fr' and n_chars > 9000").select(F.col("filename").alias("path"))
    return documents.find_documents(d.drop("n_chars"), F.col("lang") == "de", listing)


@query("""SELECT DISTINCT sha256(url) AS id, url AS path FROM pages""")
def registry_insert(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.lit("{}").alias("metadata"), "page_id")
    empty = spark.createDataFrame([], "id string, path string, created timestamp, metadata string")
    first = documents.register_files(empty, p.where("page_id % 2 = 0").drop("page_id"))
    return documents.register_files(first, p.drop("page_id")).select("id", "path")


_TREE = views("objects", "attributes").rstrip() + """, m AS (SELECT file_id, name, '{' || string_agg('"' || attr || '":"' || replace(coalesce(s, json), '"', '\\"') || '"', ',' ORDER BY attr) || '}' AS attrs
    FROM attributes WHERE attr <> 'value' GROUP BY ALL),
  n AS (SELECT o.file_id, replace(o.name, '/', chr(1)) AS key, depth, '{"name":"' || basename || '","kind":"' || obj_type || '"' || coalesce(',"ndim":' || ndim, '')
      || coalesce(',"/":' || attrs, '') || ',"children":[' AS node FROM objects o LEFT JOIN m ON m.file_id = o.file_id AND m.name = o.name
    UNION ALL SELECT file_id, chr(1114111), 0, NULL FROM objects WHERE name = '/'),
  p AS (SELECT file_id, key, row_number() OVER w - 1 AS pos, coalesce(repeat(']}', CAST(greatest(lag(depth) OVER w - depth + 1, 0) AS BIGINT)), '')
      || CASE WHEN lag(depth) OVER w >= depth AND node IS NOT NULL THEN ',' ELSE '' END || coalesce(node, '') AS text
    FROM n WINDOW w AS (PARTITION BY file_id ORDER BY key))
"""


@query(_TREE + "SELECT file_id, pos, text FROM p")
def tree_pieces(spark, sf_dir):
    """Each file's tree as pieces of JSON text, in order."""
    cat = Catalogue(event_objects(spark, sf_dir), event_attributes(spark, sf_dir))
    return documents.tree_texts(cat, ignore=["value"]).select("file_id", F.col("at").alias("pos"), "text")


@query(_TREE + "SELECT file_id, string_agg(text, '' ORDER BY pos) AS tree FROM p GROUP BY file_id")
def tree_structure(spark, sf_dir):
    """Each file's tree as one text, folded level by level."""
    cat = Catalogue(event_objects(spark, sf_dir), event_attributes(spark, sf_dir))
    return documents.trees(cat, ignore=["value"])


@query("""SELECT event_id, kind, CASE WHEN kind = 'integer' THEN user_id END AS as_long, CASE WHEN kind = 'double' THEN value END AS as_double,
  CASE WHEN kind = 'boolean' THEN user_id % 2 = 0 END AS as_boolean FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'double' WHEN 2 THEN 'boolean' ELSE 'string' END AS kind FROM events)""")
def bindings_cast(spark, sf_dir):
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "integer").when(k == 1, "double").when(k == 2, "boolean").otherwise("string")
    text = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.col("value").cast("string")).when(
        k == 2, F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")).otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), text.alias("value"), F.concat(F.lit("http://www.w3.org/2001/XMLSchema#"), kind).alias("datatype"))
    return documents.cast_bindings(e).select("event_id", "kind", "as_long", "as_double", "as_boolean")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'exists' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'no checksum' ELSE 'unsupported algorithm' END AS status FROM documents""")
def verify_checksums(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filename"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    k = F.col("filename") % 4
    manifest = d.select("filename", F.when(k == 0, F.concat(F.lit("md5:"), F.upper("md5"))).when(k == 1, "md5:0").when(k == 3, F.concat(F.lit("sha1:"), "md5")).alias("checksum"))
    return files.verify_checksums(manifest, d).select(F.col("filename").alias("doc_id"), "status")


@query("""SELECT doc_id, md5(coalesce(text, '')) AS md5, octet_length(encode(coalesce(text, ''))) AS length FROM documents""")
def checksum(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    return files.with_checksums(d).select("doc_id", "md5", "length")


_TYPES = ("click", "error", "purchase", "signup", "view")
_ROWS = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos,
  dense_rank() OVER (ORDER BY event_type) - 1 AS file, row_number() OVER (ORDER BY event_type, event_id) - 1 AS run FROM events)
"""


def _csv_rows(spark, sf_dir):
    """The events written as one CSV folder per type, each in as many parts as it fills, and read back."""
    out = new_folder(spark, "csv")
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value", F.col("user_id").cast("double").alias("user"))
    (e.repartitionByRange("event_type", "event_id").sortWithinPartitions("event_type", "event_id").drop("event_id")
     .write.partitionBy("event_type").option("header", "true").csv(out))
    rows = files.read_csvs(spark, [f"{out}/event_type={t}" for t in _TYPES], "value double, user double")
    remove(spark, out)
    return rows


@query(_ROWS + """SELECT 'value' AS name, run AS i, value AS v FROM e
  UNION ALL SELECT 'user', run, CAST(user_id AS DOUBLE) FROM e""")
def csv_concat(spark, sf_dir):
    return files.concatenate(_csv_rows(spark, sf_dir), ["value", "user"]).select("name", "i", "v")


@query(_ROWS + """SELECT 'value' AS name, pos AS i0, CAST(file AS INTEGER) AS i1, value AS v FROM e""")
def csv_stack(spark, sf_dir):
    return files.stacked(_csv_rows(spark, sf_dir), ["value"], axis=-1).select("name", "i0", "i1", "v")


@query()
def discover_files(spark, sf_dir):
    """The tables' own files."""
    return files.discover(spark, sf_dir, (".parquet",)).select(F.substring_index("path", "/", -1).alias("file"), "length")


@query(views("triples", "texts") + """SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang FROM (SELECT * FROM triples UNION ALL SELECT * FROM texts)""")
def ntriples_parse(spark, sf_dir):
    """Written as lines and read back: every escape, datatype and language survives."""
    t = entity_triples(spark, sf_dir).unionByName(text_triples(spark, sf_dir))
    back = files.parse_ntriples(files.format_ntriples(t))
    return distinct_rows(back.select("s", "p", "o", "o_kind", "o_dt", "o_lang"))


@query(views("triples") + """SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'lit' THEN '"' || o || '"' || CASE WHEN o_dt IS NOT NULL THEN '^^<' || o_dt || '>' ELSE '' END
  ELSE '<' || o || '>' END || ' .' AS value FROM triples""")
def ntriples_format(spark, sf_dir):
    return files.format_ntriples(entity_triples(spark, sf_dir))


_HDF = "http://purl.allotrope.org/ontologies/hdf5/1.8#"
_IRI = "'https://example.org/' || file_id || '/' || substr(name, 2)"


_RDF, _XS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
#: Every triple of the events' structure and attributes; numbers as decimals, as engines write doubles differently.
_STRUCTURE = f""", me AS (SELECT *, {_IRI} AS iri, 'https://example.org/' || file_id AS file, 'https://example.org/' || file_id || '/' || substr(parent, 2) AS up FROM objects),
  ats AS (SELECT *, {_IRI} AS iri, {_IRI} || '@' || attr AS it FROM attributes),
  st AS (SELECT file AS s, '{_RDF}type' AS p, '{_HDF}File' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_dt FROM me WHERE name = '/'
    UNION ALL SELECT file, '{_HDF}rootGroup', iri, 'iri', NULL FROM me WHERE name = '/'
    UNION ALL SELECT iri, '{_RDF}type', CASE obj_type WHEN 'group' THEN '{_HDF}Group' ELSE '{_HDF}Dataset' END, 'iri', NULL FROM me
    UNION ALL SELECT iri, '{_HDF}name', name, 'lit', NULL FROM me UNION ALL SELECT up, '{_HDF}member', iri, 'iri', NULL FROM me WHERE parent IS NOT NULL
    UNION ALL SELECT iri, '{_HDF}rank', '0', 'lit', '{_XS}integer' FROM me WHERE obj_type = 'dataset'
    UNION ALL SELECT iri, '{_HDF}size', '1', 'lit', '{_XS}integer' FROM me WHERE obj_type = 'dataset'
    UNION ALL SELECT iri, '{_HDF}datatype', 'H5T_FLOAT', 'lit', NULL FROM me WHERE obj_type = 'dataset'
    UNION ALL SELECT iri, '{_HDF}datatype', '{_HDF}H5T_IEEE_F64LE', 'iri', NULL FROM me WHERE obj_type = 'dataset'
    UNION ALL SELECT iri, '{_HDF}layout', '{_HDF}H5D_CONTIGUOUS', 'iri', NULL FROM me WHERE obj_type = 'dataset'
    UNION ALL SELECT iri, '{_HDF}value', CAST(CAST(d AS DECIMAL(18,4)) AS VARCHAR), 'lit', '{_XS}double' FROM ats WHERE attr = 'value'
    UNION ALL SELECT iri, '{_HDF}attribute', it, 'iri', NULL FROM ats UNION ALL SELECT it, '{_HDF}name', attr, 'lit', NULL FROM ats
    UNION ALL SELECT it, '{_RDF}type', '{_HDF}' || CASE vtype WHEN 'float' THEN 'FloatAttribute' ELSE 'StringAttribute' END, 'iri', NULL FROM ats
    UNION ALL SELECT it, '{_HDF}data', coalesce(s, CAST(CAST(d AS DECIMAL(18,4)) AS VARCHAR), json), 'lit', CASE vtype WHEN 'float' THEN '{_XS}float' END FROM ats)"""
_CONTEXT = f""", co AS (SELECT subject AS s, '{_RDF}type' AS p, type AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_dt FROM annotations
    UNION ALL SELECT subject, predicate, coalesce(object, CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR)), CASE WHEN object IS NULL THEN 'lit' ELSE 'iri' END,
      CASE WHEN object IS NULL THEN '{_XS}float' END FROM annotations
    UNION ALL SELECT {_IRI}, 'https://schema.org/about', subject, 'iri', NULL FROM annotations)"""


def _decimals(t):
    number = F.col("o_dt").isin(_XS + "float", _XS + "double")
    return t.withColumn("o", F.when(number, F.col("o").cast("decimal(18,4)").cast("string")).otherwise(F.col("o"))).select("s", "p", "o", "o_kind", "o_dt")


@query(views("objects", "attributes").rstrip() + _STRUCTURE + " SELECT s, p, o, o_kind, o_dt FROM st")
def structural_triples(spark, sf_dir):
    return _decimals(T.structural(event_objects(spark, sf_dir), event_attributes(spark, sf_dir), event_values(spark, sf_dir)))


@query(views("annotations").rstrip() + _CONTEXT + " SELECT s, p, o, o_kind, o_dt FROM co")
def contextual_triples(spark, sf_dir):
    cat = event_catalogue(spark, sf_dir)
    return _decimals(T.contextual(cat.objects, cat.attributes, cat.annotations))


@query(views("objects", "attributes", "annotations").rstrip() + _STRUCTURE + _CONTEXT + " SELECT * FROM st UNION SELECT * FROM co")
def graph_selection(spark, sf_dir):
    """Structure and context as one set."""
    cat = event_catalogue(spark, sf_dir)
    return _decimals(T.select_graph(T.structural(cat.objects, cat.attributes, cat.values), T.contextual(cat.objects, cat.attributes, cat.annotations)))


@query(views("attributes") + f"""SELECT {_IRI} AS s, CASE attr WHEN 'units' THEN '{EX}unit' ELSE '{EX}at' END AS p, CASE WHEN attr = 'units' THEN '{EX}u/' || s ELSE s END AS o
  FROM attributes WHERE attr = 'ts' OR (attr = 'units' AND s <> '')""")
def rdf_mapping(spark, sf_dir):
    return T.map_attributes(event_attributes(spark, sf_dir), {"units": EX + "unit", "ts": EX + "at"},
                            {"units": lambda c: F.when(c != "", F.concat(F.lit(EX + "u/"), c))})


@query("""WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT 'user_' || e.user_id AS file_id, '/' || e.event_type || '/e' || event_id AS name, 'n=' || f.n || ';owner=' || e.user_id AS file_attrs,
    CASE WHEN e.event_type <> 'signup' THEN 'kind=' || e.event_type || ';n=' || g.n END AS parent_attrs
  FROM events e JOIN f USING (user_id) JOIN g ON g.user_id = e.user_id AND g.event_type = e.event_type""")
def provenance(spark, sf_dir):
    """Each dataset with the attributes of its file and of its group; groups of signups have none."""
    e = table(spark, sf_dir, "events").withColumn("file_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")))
    attr = lambda name, value: F.struct(F.lit(name).alias("attr"), value.cast("string").alias("s"))
    root = e.groupBy("file_id", "user_id").agg(F.count("*").alias("n")).select("file_id", F.lit("/").alias("name"), F.explode(F.array(
        attr("owner", F.col("user_id")), attr("n", F.col("n")))).alias("x"))
    group = e.where("event_type <> 'signup'").groupBy("file_id", "event_type").agg(F.count("*").alias("n")).select(
        "file_id", F.concat(F.lit("/"), "event_type").alias("name"), F.explode(F.array(attr("kind", F.col("event_type")), attr("n", F.col("n")))).alias("x"))
    more = root.union(group).select("file_id", "name", "x.attr", F.lit("str").alias("vtype"), "x.s")
    attributes = event_attributes(spark, sf_dir).unionByName(more, allowMissingColumns=True)
    out = documents.provenance(event_objects(spark, sf_dir), attributes)
    return out.select("file_id", "name", _entries("file_attrs").alias("file_attrs"), _entries("parent_attrs").alias("parent_attrs"))


@query("""SELECT vec_id AS i0, pos - 1 AS i1, round(CAST(embedding[pos] AS DOUBLE), 6) AS v FROM (SELECT *, unnest(range(1, 65)) AS pos FROM embeddings) WHERE label % 2 = 1""")
def slices_reapplied(spark, sf_dir):
    """The cells of the slice documents whose label is odd."""
    e = table(spark, sf_dir, "embeddings")
    data = e.agg((F.max("vec_id") + 1).cast("int").alias("n0")).select(F.lit("emb").alias("file_id"), F.lit("/embeddings").alias("name"), "n0")
    scales = e.select(F.lit("emb").alias("file_id"), F.lit("/embeddings").alias("dataset"), F.col("vec_id").cast("int").alias("i"),
                      F.lit("label").alias("scale_name"), F.col("label").cast("string").alias("value"))
    found = documents.slice_documents(data, scales).where(F.element_at("scales", F.lit("label")).cast("int") % 2 == 1)
    cells = documents.apply_slices(found, embedding_values(spark, sf_dir))
    return cells.select(F.col("i0").cast("long").alias("i0"), F.col("i1").cast("long").alias("i1"), F.round("v", 6).alias("v"))
