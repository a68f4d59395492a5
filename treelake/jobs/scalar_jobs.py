"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake.functions import identifiers, literals, paths, units
from treelake.jobs.registry import query
from treelake.jobs.views_sql import views
from treelake.model import EX, XSD, event_objects, table, user_series
from treelake.operators import arrays


@query(views("objects") + """SELECT file_id, name, regexp_extract(name, '([^/]*)$', 1) AS base,
  CASE WHEN name = '/' THEN NULL WHEN regexp_replace(name, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(name, '/[^/]*$', '') END AS above,
  CASE WHEN depth = 2 THEN split_part(name, '/', 2) ELSE '' END AS parents FROM objects""")
def path_parts(spark, sf_dir):
    n = F.col("name")
    return event_objects(spark, sf_dir).select("file_id", "name", paths.basename(n).alias("base"), paths.parent(n).alias("above"),
                                               F.array_join(paths.parent_names(n), ",").alias("parents"))


@query("""SELECT url, CASE WHEN starts_with(url, 'https://www.') THEN 'w:' || substr(url, 13)
    WHEN regexp_extract(regexp_extract(url, '([^#]*)$', 1), '([^/]*)$', 1) = '' THEN url
    ELSE regexp_extract(regexp_extract(url, '([^#]*)$', 1), '([^/]*)$', 1) END AS label,
  CASE WHEN length(url) > 48 THEN substr(url, 1, 45) || '...' ELSE url END AS as_literal FROM pages""")
def term_label(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("url", paths.term_label(u, F.lit("iri"), {"w": "https://www."}).alias("label"),
                                                paths.term_label(u, F.lit("lit")).alias("as_literal"))


@query("""SELECT url, CASE WHEN contains(url, '#') THEN regexp_extract(url, '^(.*#)', 1) ELSE regexp_extract(url, '^(.*/)', 1) END AS ns FROM pages""")
def namespace_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", paths.namespace(F.col("url")).alias("ns"))


@query("""SELECT p_partkey, 'http://ex.org/' || replace(replace('My !&9]231,.0Group/' || p_name || ' ' || p_type, ' ', '%20'), '!&9]231,', '%21%269%5D231%2C') AS iri,
  'http://ex.org/parts@' || replace(p_name, ' ', '%20') AS attr_iri FROM part""")
def object_iri(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("/My !&9]231,.0Group/"), F.col("p_name"), F.lit(" "), F.col("p_type"))
    return p.select("p_partkey", paths.object_iri(F.lit(EX), name).alias("iri"),
                    paths.attribute_iri(F.lit(EX), F.lit("/parts"), F.col("p_name")).alias("attr_iri"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'http://ex.org/b' || page_id WHEN 2 THEN 'urn:page:' || page_id END AS iri FROM pages""")
def to_iri(spark, sf_dir):
    k, key = F.col("page_id") % 4, F.col("page_id").cast("string")
    raw = (F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("_:b"), key)).when(k == 2, F.concat(F.lit("urn:page:"), key))
           .otherwise(F.concat(F.lit("page "), key)))
    return table(spark, sf_dir, "pages").select("page_id", paths.to_iri(raw, F.lit(EX)).alias("iri"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '{XSD}date' WHEN 1 THEN '{XSD}dateTime' END AS kind FROM orders""")
def date_literal(spark, sf_dir):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(d, "yyyy.MM.dd"))
            .when(k == 3, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"))).otherwise(F.date_format(d, "'0'MMdd-MM-dd")))
    return table(spark, sf_dir, "orders").select("o_orderkey", literals.date_literal(text).alias("kind"))


@query("""SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M:%S') AS text, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS back FROM events""")
def time_codec(spark, sf_dir):
    text = literals.encode_time(F.col("ts"), "%d.%m.%Y %H:%M:%S")
    e = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return e.withColumn("back", F.date_format(literals.decode_time(F.col("text"), "%d.%m.%Y %H:%M:%S"), "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g'), '_') AS clean,
  regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file,
  nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([0-9]+)/?$', 1), '') AS record,
  CASE page_id % 3 WHEN 0 THEN 'turtle' WHEN 1 THEN 'json-ld' END AS format FROM pages""")
def clean_names(spark, sf_dir):
    u, key = F.col("url"), F.col("page_id").cast("string")
    name = F.concat(F.lit("p"), key, F.when(F.col("page_id") % 3 == 0, ".ttl").when(F.col("page_id") % 3 == 1, ".JSONLD").otherwise(".csv"))
    return table(spark, sf_dir, "pages").select("page_id", paths.clean_name(u).alias("clean"), paths.file_name(u).alias("file"),
                                                paths.record_id(u).alias("record"), paths.rdf_format(name).alias("format"))


@query("""SELECT p_partkey, p_name AS label, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS unit FROM part""")
def label_units(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" ["), "p_brand", F.lit("]"))).otherwise(F.col("p_name"))
    label, unit = paths.label_and_unit(text)
    return p.select("p_partkey", label.alias("label"), unit.alias("unit"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'array' ELSE 'str' END AS vtype,
  CASE event_id % 3 WHEN 0 THEN json_extract_string(props, '$.k') END AS k, CASE event_id % 3 WHEN 1 THEN event_type || '|' || user_id END AS items FROM events""")
def attr_parse(spark, sf_dir):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("('"), "event_type", F.lit("', "), F.col("user_id").cast("string"), F.lit(")"))).otherwise(
        F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", literals.parse_value(text).alias("x"))
    return e.select("event_id", "x.vtype", F.get_json_object("x.json", "$.k").alias("k"), F.array_join("x.items", "|").alias("items"))


_ORCID_TOTAL = "list_reduce([CAST(substr(d, i, 1) AS BIGINT) for i in range(1, 16)], lambda a, x: (a + x) * 2 % 11, CAST(0 AS BIGINT))"


@query(f"""WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 15, '0') AS d FROM customer)
  SELECT c_custkey, (12 - {_ORCID_TOTAL} % 11) % 11 = 7 AS valid FROM c""")
def orcid_valid(spark, sf_dir):
    d = F.lpad(F.col("c_custkey").cast("string"), 15, "0")
    text = F.concat(F.lit("https://orcid.org/"), F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 4), F.lit("-"), F.substring(d, 9, 4), F.lit("-"),
                    F.substring(d, 13, 3), F.lit("7"))
    return table(spark, sf_dir, "customer").select("c_custkey", identifiers.orcid_valid(text).alias("valid"))


@query("""WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS d FROM customer)
  SELECT c_custkey, (list_sum([CAST(substr(d, i, 1) AS BIGINT) * (11 - i) for i in range(1, 10)]) + 3) % 11 = 0 AS ten,
  (9 + 7 * 3 + 8 + list_sum([CAST(substr(d, i, 1) AS BIGINT) * (CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) for i in range(1, 10)]) + 5) % 10 = 0 AS thirteen FROM c""")
def isbn_valid(spark, sf_dir):
    d = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", identifiers.isbn10_valid(F.concat(d, F.lit("3"))).alias("ten"),
                                                   identifiers.isbn13_valid(F.concat(F.lit("978-"), d, F.lit("5"))).alias("thirteen"))


@query("""SELECT page_id, page_id % 4 = 0 AS urn, page_id % 4 = 1 AS email, page_id % 4 = 2 AS semver FROM pages""")
def identifier_valid(spark, sf_dir):
    k, key = F.col("page_id") % 4, F.col("page_id").cast("string")
    text = (F.when(k == 0, F.concat(F.lit("urn:page:"), key)).when(k == 1, F.concat(F.lit("p"), key, F.lit("@mail.example.com")))
            .when(k == 2, F.concat(F.lit("1.0."), key)).otherwise(F.concat(F.lit("x "), key)))
    return table(spark, sf_dir, "pages").select("page_id", *[identifiers.identifier_valid(text, n).alias(n) for n in ("urn", "email", "semver")])


@query("""SELECT event_id, event_type IN ('view', 'signup') AS same_dimension, event_type = 'view' AS same_unit FROM events""")
def unit_equal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "view", "s").when(F.col("event_type") == "signup", "min").when(F.col("event_type") == "click", "m/s").when(
        F.col("event_type") == "error", "invalid")
    parsed = e.select("event_id", units.parse(text).alias("u"), units.parse(F.lit("m*s/m")).alias("w"))
    return parsed.select("event_id", units.same_dimension(F.col("u"), F.col("w")).alias("same_dimension"), units.same_unit(F.col("u"), F.col("w")).alias("same_unit"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN round(value * 1000, 6) WHEN 'click' THEN round(value * 60000, 6) END AS ms,
  round(value + 273.15, 6) AS kelvin FROM events""")
def to_units(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "view", "s").when(F.col("event_type") == "click", "min").otherwise("V")
    parsed = e.select("event_id", "value", units.parse(text).alias("u"), units.parse(F.lit("degC")).alias("c"))
    return parsed.select("event_id", F.round(units.convert_to(F.col("value"), F.col("u"), "ms"), 6).alias("ms"),
                         F.round(units.convert_to(F.col("value"), F.col("c"), "K"), 6).alias("kelvin"))


@query(views("series") + """SELECT dataset, coord, round(v / 2500.0, 9) AS v_norm, round(coord / 2500.0, 6) AS coord_norm, 'v/L' AS name FROM series""")
def normalize(spark, sf_dir):
    factor = units.parse_unit("m")[0] / units.parse_unit("mm")[0]
    out = arrays.normalize(user_series(spark, sf_dir), 2.5, factor, coord="coord")
    return out.select("dataset", "coord", F.round("v_norm", 9).alias("v_norm"), F.round("coord_norm", 6).alias("coord_norm"),
                      F.lit(arrays.normalized_name("v", "L")).alias("name"))
