"""Queries of layouts, conventions and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake.jobs.registry import query
from treelake.jobs.views_sql import views
from treelake.model import EX, LABEL, RDFS, TYPE, XSD, entity_triples, event_catalogue
from treelake.operators import convention, layout, shapes
from treelake.operators.convention import Rule
from treelake.operators.layout import Spec
from treelake.operators.shapes import Property, Shape

_SPECS = [
    Spec("groups", {}, "group", n={"$gte": 6}, recursive=False, description="all event types"),
    Spec("errors", {"$basename": "error"}, "group", n=1, then=[
        Spec("values", {"value": {"$gt": 10}}, "dataset", n={"$gte": 2}, recursive=False), Spec("units", {"units": "invalid"}, "dataset"),
        Spec("views", {"event_type": "view"}, "dataset", n={"$gte": 1}, rebase=True)]),
    Spec("rare", {"value": {"$gt": 95}}, "dataset", n={"$gte": 1}, alternatives=[Spec("high", {"value": {"$gt": 60}}, "dataset")]),
]
_LAYOUT = """WITH u AS (SELECT DISTINCT user_id FROM events), f AS (SELECT 'user_' || user_id AS file_id, user_id FROM u),
  e AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 10) AS n10 FROM events WHERE event_type = 'error' GROUP BY 1),
  v AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (value > 95) AS n95, count(*) FILTER (value > 60) AS n60,
        count(DISTINCT event_type) AS kinds FROM events GROUP BY 1),
  r AS (SELECT file_id, 'groups' AS spec, '/' AS target, kinds AS n_hits, CASE WHEN kinds >= 6 THEN 1 ELSE 10 END AS flag FROM f JOIN v USING (user_id)
    UNION ALL SELECT file_id, 'errors', '/', CASE WHEN e.n IS NULL THEN 0 ELSE 1 END, CASE WHEN e.n IS NULL THEN 10 ELSE 1 END FROM f LEFT JOIN e USING (user_id)
    UNION ALL SELECT file_id, 'values', '/error', n10, CASE WHEN n10 >= 2 THEN 1 ELSE 10 END FROM f JOIN e USING (user_id)
    UNION ALL SELECT file_id, 'units', '/error', n, 17 FROM f JOIN e USING (user_id)
    UNION ALL SELECT file_id, 'views', '/', views, CASE WHEN views >= 1 THEN 1 ELSE 10 END FROM f JOIN e USING (user_id) JOIN v USING (user_id)
    UNION ALL SELECT file_id, 'rare', '/', CASE WHEN n95 > 0 THEN n95 ELSE n60 END,
      CASE WHEN n95 > 0 THEN 1 WHEN n60 > 0 THEN 5 ELSE 10 END FROM f JOIN v USING (user_id))
"""


#: A convention as its configuration is read.
_CONFIG = {
    "__name__": "events", "$kinds": ["view", "click"],
    "units": {"target_method": "create_dataset", "validator": "$units"},
    "event_type": {"target_method": "create_dataset", "validator": "$kinds", "default_value": "$NONE", "requirements": "units"},
    "ts": {"target_method": "create_dataset", "validator": "$regex(^2024-01)", "default_value": "$NONE"},
    "value": {"target_method": "create_dataset", "validator": "$small(50)", "default_value": "$NONE"},
    "comment-group": {"target_method": "create_group", "validator": "str", "default_value": "$NONE"}}


@query(views("objects", "attributes") + """, a AS (SELECT file_id, name, max(CASE WHEN attr = 'units' THEN s END) AS u, max(CASE WHEN attr = 'event_type' THEN s END) AS t,
    max(CASE WHEN attr = 'ts' THEN s END) AS ts, max(CASE WHEN attr = 'value' THEN d END) AS v FROM attributes GROUP BY 1, 2)
  SELECT file_id, name, 'units' AS attr, CASE WHEN u IS NULL THEN 'missing' ELSE 'invalid' END AS problem FROM a WHERE u IS NULL OR u = 'invalid'
  UNION ALL SELECT file_id, name, 'event_type', CASE WHEN t NOT IN ('view', 'click') THEN 'invalid' ELSE 'requires units' END FROM a WHERE t NOT IN ('view', 'click') OR u IS NULL
  UNION ALL SELECT file_id, name, 'ts', 'invalid' FROM a WHERE ts NOT LIKE '2024-01%' UNION ALL SELECT file_id, name, 'value', 'invalid' FROM a WHERE v >= 50""")
def convention_from_config(spark, sf_dir):
    """A convention read from a configuration, with a validator of the caller's own."""
    convention.register("small", lambda c, arg: c.try_cast("double") < float(arg))
    return convention.validate(event_catalogue(spark, sf_dir), convention.from_config(_CONFIG))


@query(_LAYOUT + "SELECT file_id, spec, target, CAST(n_hits AS BIGINT) AS n_hits, CAST(flag AS INTEGER) AS flag FROM r")
def layout_validate(spark, sf_dir):
    return layout.validate(event_catalogue(spark, sf_dir), _SPECS).select("file_id", "spec", "target", "n_hits", "flag")


@query(_LAYOUT + """SELECT file_id, bool_and(flag & 2 = 0) AS valid, count(*) FILTER (flag & 2 > 0) AS n_failed,
  string_agg(CASE flag WHEN 1 THEN 'SUCCESSFUL' WHEN 5 THEN 'SUCCESSFUL|ALTERNATIVE' WHEN 10 THEN 'FAILED|INVALID_NUMBER' WHEN 17 THEN 'SUCCESSFUL|OPTIONAL' END, ','
    ORDER BY spec) AS texts FROM r GROUP BY file_id""")
def layout_summary(spark, sf_dir):
    rows = layout.summary(layout.validate(event_catalogue(spark, sf_dir), _SPECS))
    texts = rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("spec", "text"))), lambda x: x["text"]), ",").alias("texts"))
    return layout.is_valid(rows).join(texts, "file_id")


@query(_LAYOUT + "SELECT spec, flag, count(*) AS n FROM r GROUP BY 1, 2")
def layout_counts(spark, sf_dir):
    return layout.validate(event_catalogue(spark, sf_dir), _SPECS).groupBy("spec", "flag").agg(F.count("*").alias("n"))


@query(views("objects", "attributes") + """, a AS (SELECT file_id, name, max(CASE WHEN attr = 'units' THEN s END) AS u, max(CASE WHEN attr = 'event_type' THEN s END) AS t
    FROM attributes GROUP BY 1, 2)
  SELECT o.file_id, o.name, 'units' AS attr, CASE WHEN u IS NULL THEN 'missing' ELSE 'invalid' END AS problem FROM objects o LEFT JOIN a ON a.file_id = o.file_id AND a.name = o.name
    WHERE obj_type = 'dataset' AND (u IS NULL OR u = 'invalid')
  UNION ALL SELECT o.file_id, o.name, 'event_type', 'invalid' FROM objects o JOIN a ON a.file_id = o.file_id AND a.name = o.name WHERE t NOT IN ('view', 'click', 'error', 'purchase')
  UNION ALL SELECT file_id, name, 'title', 'missing' FROM objects WHERE name = '/'""")
def convention_validate(spark, sf_dir):
    rules = [Rule("units", "dataset", "units", numeric_only=True), Rule("event_type", "dataset", "regex", "view$|click$|error$|purchase$", obligatory=False),
             Rule("title", "file"), Rule("comment", "group", obligatory=False)]
    return convention.validate(event_catalogue(spark, sf_dir), rules)


@query(views("attributes") + """, a AS (SELECT file_id, name, max(CASE WHEN attr = 'ts' THEN s END) AS ts, max(CASE WHEN attr = 'props' THEN json END) AS props,
    max(CASE WHEN attr = 'value' THEN d END) AS v, max(CASE WHEN attr = 'units' THEN s END) AS u FROM attributes GROUP BY 1, 2)
  SELECT file_id, name, 'props' AS attr, 'invalid' AS problem FROM a WHERE NOT regexp_matches(json_extract_string(props, '$.k'), '^[1-4]')
  UNION ALL SELECT file_id, name, 'value', 'requires units' FROM a WHERE u IS NULL
  UNION ALL SELECT file_id, name, 'event_type', 'invalid' FROM a JOIN (SELECT 'user_' || user_id AS file_id, '/' || event_type || '/e' || event_id AS name, event_type AS t FROM events) USING (file_id, name)
    WHERE t NOT IN ('view', 'error')""")
def convention_rules(spark, sf_dir):
    rules = [Rule("ts", "dataset", "date"), Rule("props", "dataset", "fields", {"k": ("regex", "[1-4]")}), Rule("value", "dataset", "number", requires=["units"]),
             Rule("long_name", "dataset", alternative="event_type"), Rule("event_type", "dataset", "in", ["view", "error"])]
    return convention.validate(event_catalogue(spark, sf_dir), rules)


_VIOLATIONS = views("triples").rstrip() + f""", typed AS (SELECT s FROM triples WHERE p = '{TYPE}' AND o = '{EX}class/order'),
  v AS (SELECT 'customer' AS shape, s AS focus, '{LABEL}' AS path, '0' AS value, 'minCount' AS component, 'a customer needs a name' AS message FROM triples WHERE p = '{TYPE}' AND o = '{EX}class/customer'
  UNION ALL SELECT 'order', s, '{EX}hasPart', CAST(count(*) AS VARCHAR), 'maxCount', 'violates maxCount of {EX}hasPart' FROM triples WHERE p = '{EX}hasPart' AND s IN (SELECT s FROM typed) GROUP BY s HAVING count(*) > 5
  UNION ALL SELECT 'order', s, '{EX}by', o, 'node', 'violates node of {EX}by' FROM triples WHERE p = '{EX}by' AND s IN (SELECT s FROM typed)
    AND o IN (SELECT s FROM triples WHERE p = '{EX}inNation' AND o NOT IN (SELECT s FROM triples WHERE p = '{TYPE}' AND o = '{EX}class/nation'))
  UNION ALL SELECT 'order', s, '{EX}total', o, 'datatype', 'violates datatype of {EX}total' FROM triples WHERE p = '{EX}total' AND o_dt <> '{XSD}decimal'
  UNION ALL SELECT 'nation', s, '{EX}inRegion', NULL, 'notExists', 'violates notExists of {EX}inRegion' FROM triples WHERE p = '{EX}inRegion')
"""


def _violations(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    located = Shape("located", properties=[Property(EX + "inNation", of_class=EX + "class/nation", node_kind="iri")])
    return shapes.validate(t, [
        Shape("customer", target_class=EX + "class/customer", properties=[Property(LABEL, min_count=1, message="a customer needs a name")]),
        Shape("order", target_class=EX + "class/order", properties=[
            Property(EX + "hasPart", max_count=5), Property(EX + "total", min_count=1, max_count=1, datatype=XSD + "decimal"), Property(EX + "by", node=located)]),
        Shape("nation", subjects_of=EX + "inRegion", not_exists=EX + "inRegion")])


@query(_VIOLATIONS + "SELECT shape, focus, path, value, component, message FROM v")
def shacl_validate(spark, sf_dir):
    return _violations(spark, sf_dir)


_SH, _NAME = shapes.SH, "'urn:report:' || sha256(shape || chr(1) || focus || chr(1) || path || chr(1) || coalesce(value, chr(2)) || chr(1) || component)"


@query(_VIOLATIONS.rstrip() + f""", n AS (SELECT *, {_NAME} AS name FROM v)
  SELECT 'urn:report:all' AS s, '{TYPE}' AS p, '{_SH}ValidationReport' AS o, 'iri' AS o_kind UNION ALL SELECT 'urn:report:all', '{_SH}conforms', 'false', 'lit'
  UNION ALL SELECT 'urn:report:all', '{_SH}result', name, 'iri' FROM n UNION ALL SELECT name, '{TYPE}', '{_SH}ValidationResult', 'iri' FROM n
  UNION ALL SELECT name, '{_SH}focusNode', focus, 'iri' FROM n UNION ALL SELECT name, '{_SH}resultPath', path, 'iri' FROM n
  UNION ALL SELECT name, '{_SH}sourceShape', shape, 'lit' FROM n UNION ALL SELECT name, '{_SH}resultMessage', message, 'lit' FROM n
  UNION ALL SELECT name, '{_SH}resultSeverity', '{_SH}Violation', 'iri' FROM n
  UNION ALL SELECT name, '{_SH}sourceConstraintComponent', '{_SH}' || CASE component WHEN 'notExists' THEN 'SPARQL' ELSE upper(component[1]) || component[2:] END || 'ConstraintComponent', 'iri' FROM n
  UNION ALL SELECT name, '{_SH}value', value, CASE WHEN value LIKE 'http%' THEN 'iri' ELSE 'lit' END FROM n WHERE value IS NOT NULL""")
def shacl_report(spark, sf_dir):
    """The violations as triples."""
    return shapes.report(_violations(spark, sf_dir)).select("s", "p", "o", "o_kind")


@query(views("triples") + f"""SELECT 'priced' AS shapes, NOT EXISTS (SELECT 1 FROM (SELECT s FROM triples WHERE p = '{TYPE}' AND o = '{EX}class/order') WHERE s NOT IN (SELECT s FROM triples WHERE p = '{EX}total')) AS conforms
  UNION ALL SELECT 'labelled', NOT EXISTS (SELECT 1 FROM (SELECT s FROM triples WHERE p = '{TYPE}' AND o = '{EX}class/part') WHERE s NOT IN (SELECT s FROM triples WHERE p = '{LABEL}'))""")
def shacl_conforms(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    of = lambda kind, path: [Shape(kind, target_class=f"{EX}class/{kind}", properties=[Property(path, min_count=1)])]
    one = lambda name, own: shapes.conforms(shapes.validate(t, own)).select(F.lit(name).alias("shapes"), "conforms")
    return one("priced", of("order", EX + "total")).unionByName(one("labelled", of("part", LABEL)))


@query(views("triples") + f""", t AS (SELECT DISTINCT s, p, o, o_kind FROM triples)
  SELECT s, p, o, o_kind FROM t UNION SELECT s, '{EX}within', o, o_kind FROM t WHERE p IN ('{EX}inNation', '{EX}inRegion')
  UNION SELECT s, '{TYPE}', x, 'iri' FROM t, (SELECT unnest(['{EX}class/party', '{EX}class/thing']) AS x) WHERE p = '{TYPE}' AND o = '{EX}class/customer'
  UNION SELECT o, '{TYPE}', x, 'iri' FROM t, (SELECT unnest(['{EX}class/area', '{EX}class/thing']) AS x) WHERE p IN ('{EX}inNation', '{EX}inRegion')""")
def rdfs_closure(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    rows = [(f"{EX}class/customer", RDFS + "subClassOf", f"{EX}class/party"), (f"{EX}class/party", RDFS + "subClassOf", f"{EX}class/thing"),
            (f"{EX}class/area", RDFS + "subClassOf", f"{EX}class/thing"), (EX + "inNation", RDFS + "subPropertyOf", EX + "within"),
            (EX + "inRegion", RDFS + "subPropertyOf", EX + "within"), (EX + "within", RDFS + "range", f"{EX}class/area")]
    return shapes.rdfs_closure(t, spark.createDataFrame(rows, "s string, p string, o string"))


@query(views("triples") + f"""SELECT graph, count(*) AS n FROM triples WHERE graph IN ('region', 'nation') GROUP BY graph""")
def validated_load(spark, sf_dir):
    """Graphs in which every typed thing has a label; others are rejected whole."""
    named = [Property(LABEL, min_count=1)]
    t = shapes.validated_load(entity_triples(spark, sf_dir), [Shape("named", subjects_of=TYPE, properties=named)])
    return t.groupBy("graph").agg(F.count("*").alias("n"))
