"""Queries of graph patterns and measures over the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake.functions import paths
from treelake.jobs.registry import query
from treelake.jobs.views_sql import views
from treelake.lineage import new_folder
from treelake.model import EX, LABEL, OWL, TYPE, XSD, contact_triples, containment, entity_triples, table, text_triples
from treelake.operators import metrics, neighborhood
from treelake.operators import patterns as P
from treelake.operators.filters import first_per
from treelake.sources.store import TripleStore

_T = views("triples")
_LINKED = views("triples", "contacts", "linked")
#: The label of an IRI of the entity graph, in DuckDB.
_LABEL = (f"CASE WHEN {{0}} = '{TYPE}' THEN 'rdf:type' WHEN {{0}} = '{LABEL}' THEN 'rdfs:label' "
          f"WHEN starts_with({{0}}, '{XSD}') THEN 'xsd:' || substr({{0}}, {len(XSD) + 1}) WHEN {{0}} = '{OWL}sameAs' THEN 'owl:sameAs' "
          "WHEN regexp_extract(regexp_extract({0}, '([^#]*)$', 1), '([^/]*)$', 1) = '' THEN {0} "
          "ELSE regexp_extract(regexp_extract({0}, '([^#]*)$', 1), '([^/]*)$', 1) END")


def _linked(spark, sf_dir):
    """The entity graph and what other sources add to it: blank nodes, sameAs statements, empty literals."""
    return entity_triples(spark, sf_dir).unionByName(contact_triples(spark, sf_dir))


def _label(c: str) -> str:
    return _LABEL.format(c)


# --- patterns ---------------------------------------------------------------------------------------

@query(_T + f"""SELECT a.s AS order, b.o AS customer, c.o AS nation, d.o AS name FROM triples a
  JOIN triples b ON b.s = a.s AND b.p = '{EX}by' JOIN triples c ON c.s = b.o AND c.p = '{EX}inNation'
  JOIN triples d ON d.s = c.o AND d.p = '{LABEL}' WHERE a.p = '{TYPE}' AND a.o = '{EX}class/order'""")
def bgp_join(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    return P.bgp(t, [("?order", TYPE, EX + "class/order"), ("?order", EX + "by", "?customer"), ("?customer", EX + "inNation", "?nation"),
                     ("?nation", LABEL, "?name")])


@query(_T + f"""SELECT s AS order, max(CASE WHEN p = '{EX}total' THEN o END) AS total, max(CASE WHEN p = '{EX}date' THEN o END) AS day
  FROM triples WHERE p IN ('{EX}total', '{EX}date') GROUP BY s HAVING count(DISTINCT p) = 2""")
def bgp_star(spark, sf_dir):
    return P.star(entity_triples(spark, sf_dir), "order", {"total": EX + "total", "day": EX + "date"})


@query(_T + f"""SELECT a.s AS customer, b.o AS balance FROM triples a LEFT JOIN triples b ON b.s = a.s AND b.p = '{EX}balance'
  AND CAST(b.o AS DOUBLE) < 0 WHERE a.p = '{TYPE}' AND a.o = '{EX}class/customer'""")
def bgp_optional(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    poor = P.match(t, ("?customer", EX + "balance", "?balance")).where(F.col("balance").try_cast("double") < 0)
    return P.optional(P.match(t, ("?customer", TYPE, EX + "class/customer")), poor)


@query(_T + f"""SELECT s AS customer FROM triples a WHERE p = '{TYPE}' AND o = '{EX}class/customer'
  AND NOT EXISTS (SELECT 1 FROM triples b JOIN triples c ON c.s = b.s AND c.p = '{EX}total' AND CAST(c.o AS DOUBLE) > 400000
    WHERE b.p = '{EX}by' AND b.o = a.s)""")
def bgp_not_exists(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    large = P.match(t, ("?order", EX + "total", "?total")).where(F.col("total").try_cast("double") > 400000)
    orders = P.join(P.match(t, ("?order", EX + "by", "?customer")), large)
    return P.without(P.match(t, ("?customer", TYPE, EX + "class/customer")), orders.select("customer"))


@query(_T + f"""SELECT s AS part, o AS name, EXISTS (SELECT 1 FROM triples WHERE p = '{EX}name' AND o = 'small ring') AS asked FROM triples a
  WHERE p = '{EX}name' AND EXISTS (SELECT 1 FROM triples b WHERE b.p = '{EX}hasPart' AND b.o = a.s)""")
def bgp_exists(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    named = P.match(t, ("?part", EX + "name", "?name"))
    asked = P.ask(named.where("name = 'small ring'")).withColumnRenamed("answer", "asked")
    return P.having(named, P.match(t, ("?order", EX + "hasPart", "?part"))).join(F.broadcast(asked))


@query(_T + f"""SELECT s AS node, o AS text FROM triples WHERE p = '{LABEL}' AND contains(lower(o), 'nation_1') AND starts_with(s, '{EX}nation/')
  AND o_lang IS NULL AND p NOT IN ('{TYPE}')""")
def bgp_filters(spark, sf_dir):
    t = entity_triples(spark, sf_dir).where(F.col("o_lang").isNull() & ~F.col("p").isin(TYPE))
    return P.match(t, ("?node", LABEL, "?text")).where(F.lower("text").contains("nation_1") & F.col("node").startswith(EX + "nation/"))


@query(_T + f"""SELECT s AS purchase, CAST(o AS DOUBLE) AS total FROM triples WHERE p = '{EX}total' AND CAST(o AS DOUBLE) > 1000
  ORDER BY total DESC, purchase LIMIT 25""")
def bgp_order_limit(spark, sf_dir):
    t = P.match(entity_triples(spark, sf_dir), ("?purchase", EX + "total", "?total"))
    t = t.withColumn("total", F.col("total").try_cast("double")).where("total > 1000")
    return t.orderBy(F.col("total").desc(), "purchase").limit(25)


@query(_T + f"""SELECT DISTINCT s AS entity FROM triples WHERE starts_with(s, '{EX}nation/')
  UNION SELECT DISTINCT o FROM triples WHERE o_kind = 'iri' AND starts_with(o, '{EX}nation/')""")
def bgp_union(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    both = t.select(F.explode(F.array(F.col("s"), F.when(F.col("o_kind") == "iri", F.col("o")))).alias("entity"))
    return both.where(F.col("entity").startswith(EX + "nation/")).distinct()


@query("WITH RECURSIVE " + views("member").removeprefix("WITH ") + f""", reach AS (
  SELECT s AS start, s AS node FROM (SELECT DISTINCT s FROM member WHERE starts_with(s, '{EX}region/'))
  UNION SELECT r.start, m.o FROM reach r JOIN member m ON m.s = r.node)
  SELECT start, node FROM reach""")
def path_closure(spark, sf_dir):
    edges = containment(spark, sf_dir)
    return P.closure(edges, edges.where(F.col("s").startswith(EX + "region/")).select(F.col("s").alias("start")))


@query(_T + f""", ext AS (SELECT '{EX}nation/' || n_nationkey AS entity, '{EX}homepage' AS p, 'https://n.example.org/' || n_nationkey AS value FROM nation
    UNION ALL SELECT '{EX}nation/' || n_nationkey, '{EX}internal', 'x' FROM nation
    UNION ALL SELECT '{EX}part/' || p_partkey, '{EX}size', CAST(p_size AS VARCHAR) FROM part),
  ent AS (SELECT DISTINCT o AS entity FROM triples WHERE p IN ('{EX}inNation', '{EX}hasPart')),
  new AS (SELECT DISTINCT entity AS s, p, value AS o, CASE WHEN regexp_matches(value, '^https?://') THEN 'iri' ELSE 'lit' END AS o_kind
    FROM ext WHERE p <> '{EX}internal' AND entity IN (SELECT entity FROM ent))
  SELECT s, p, o, o_kind FROM (SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang FROM triples) UNION ALL SELECT s, p, o, o_kind FROM new""")
def augment_entities(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    nation, part = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    key = lambda kind, c: F.concat(F.lit(f"{EX}{kind}/"), F.col(c).cast("string"))
    external = nation.select(key("nation", "n_nationkey").alias("entity"), F.explode(F.array(
        F.struct(F.lit(EX + "homepage").alias("p"), F.concat(F.lit("https://n.example.org/"), F.col("n_nationkey").cast("string")).alias("value")),
        F.struct(F.lit(EX + "internal").alias("p"), F.lit("x").alias("value")))).alias("x")).select("entity", "x.*")
    external = external.union(part.select(key("part", "p_partkey"), F.lit(EX + "size"), F.col("p_size").cast("string")))
    entities = t.where(F.col("p").isin(EX + "inNation", EX + "hasPart")).select(F.col("o").alias("entity"))
    return P.augment(t, entities, external, [EX + "internal"]).select("s", "p", "o", "o_kind")


@query(_T + """SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang FROM triples""")
def graph_union(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    return P.union_graphs(t, t.where("graph = 'order'")).select("s", "p", "o", "o_kind", "o_dt", "o_lang")


@query(_T + f"""SELECT 'a' AS store, s, o, CAST(NULL AS VARCHAR) AS p FROM triples WHERE p = '{EX}inNation'
  UNION ALL SELECT 'b', s, o, p FROM triples WHERE graph = 'nation'""")
def multi_store(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    a = t.where(F.col("p") == EX + "inNation").select(F.lit("a").alias("store"), "s", "o")
    return a.unionByName(t.where("graph = 'nation'").select(F.lit("b").alias("store"), "s", "o", "p"), allowMissingColumns=True)


@query(_T + f""", a AS (SELECT s FROM triples WHERE p = '{EX}hasPart'), b AS (SELECT s FROM triples WHERE p = '{EX}total' AND CAST(o AS DOUBLE) > 250000)
  SELECT 'both' AS which, s FROM (SELECT s FROM a INTERSECT SELECT s FROM b) UNION ALL SELECT 'only_a', s FROM (SELECT s FROM a EXCEPT SELECT s FROM b)""")
def set_ops(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    part = F.col("p") == EX + "hasPart"
    rows = t.where(part | ((F.col("p") == EX + "total") & (F.col("o").try_cast("double") > 250000))).select("s", part.alias("part"))
    per = rows.groupBy("s").agg(F.bool_or("part").alias("a"), F.bool_or(~F.col("part")).alias("b")).where("a")
    return per.select(F.when(F.col("b"), "both").otherwise("only_a").alias("which"), "s")


@query(_T + f"""SELECT s, p, o FROM triples WHERE s IN (SELECT s FROM triples WHERE p = '{EX}inRegion' AND o = '{EX}region/1')
  AND s IN (SELECT s FROM triples WHERE p = '{TYPE}' AND o = '{EX}class/nation')""")
def describe(spark, sf_dir):
    """From a store in buckets of subjects, which reads what holds the subjects."""
    store = TripleStore(spark, new_folder(spark, "store"), buckets=64)
    t = store.append(entity_triples(spark, sf_dir), 0)
    subjects = P.match(t, ("?s", EX + "inRegion", EX + "region/1"))
    return store.stars(P.having(subjects, P.match(t, ("?s", TYPE, EX + "class/nation")))).select("s", "p", "o")


@query(_T + f""", t AS (SELECT DISTINCT * EXCLUDE (graph) FROM triples), m AS (
  SELECT 'triples' AS measure, '' AS label, count(*) AS n FROM t UNION ALL SELECT 'predicate', p, count(*) FROM t GROUP BY p
  UNION ALL SELECT 'class', o, count(*) FROM t WHERE p = '{TYPE}' GROUP BY o UNION ALL SELECT 'literals', '', count(*) FROM t WHERE o_kind = 'lit'
  UNION ALL SELECT 'untyped_literals', '', count(*) FROM t WHERE o_kind = 'lit' AND o_dt IS NULL AND o_lang IS NULL
  UNION ALL SELECT 'datatype', coalesce(o_dt, 'None'), count(*) FROM t WHERE o_kind = 'lit' GROUP BY ALL UNION ALL SELECT 'language', 'None', count(*) FROM t WHERE o_kind = 'lit'
  UNION ALL SELECT 'subjects', '', count(DISTINCT s) FROM t UNION ALL SELECT 'subjects_with_labels', '', count(DISTINCT s) FROM t WHERE p = '{LABEL}')
  SELECT measure, label, n FROM m WHERE n > 0""")
def ingest_measures(spark, sf_dir):
    """Three batches that overlap: the measures that their changes add up to."""
    store = TripleStore(spark, new_folder(spark, "store"), buckets=64)
    t = entity_triples(spark, sf_dir)
    for number, batch in enumerate((t.where("graph in ('region', 'nation', 'part')"), t.where(f"graph <> 'part' and p <> '{LABEL}'"), t)):
        store.append(batch, number)
    return store.measures()


@query("WITH RECURSIVE " + views("member").removeprefix("WITH ") + f""", reach AS (
  SELECT s AS start, s AS node FROM (SELECT DISTINCT s FROM member WHERE starts_with(s, '{EX}region/') OR starts_with(s, '{EX}nation/1'))
  UNION SELECT r.start, m.o FROM reach r JOIN member m ON m.s = r.node)
  SELECT start, node FROM reach""")
def path_below(spark, sf_dir):
    """All that regions, and some of their nations, contain: by the names of the containment tree, in one join."""
    t = lambda name: table(spark, sf_dir, name)
    part = lambda kind, c: F.concat(F.lit(f"/{kind}-"), F.col(c).cast("string"))
    nation = t("nation").select("n_nationkey", F.concat(part("region", "n_regionkey"), part("nation", "n_nationkey")).alias("name"))
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("name", part("customer", "c_custkey")).alias("name"))
    order = t("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.concat("name", part("order", "o_orderkey")).alias("name"))
    region = t("nation").select(part("region", "n_regionkey").alias("name")).distinct()
    objects = region.union(nation.select("name")).union(customer.select("name")).union(order).withColumn("file_id", F.lit("world"))
    last = F.substring_index("name", "/", -1)
    starts = region.union(nation.where(last.startswith("nation-1")).select("name")).select(F.lit("world").alias("file_id"), F.col("name").alias("start"))
    iri = lambda c: F.concat(F.lit(EX), F.replace(F.substring_index(c, "/", -1), F.lit("-"), F.lit("/")))
    return P.below(objects, starts).select(iri("start").alias("start"), iri("name").alias("node"))


@query(_T + f""", b AS (SELECT a.s AS c, b.o AS n, x.o AS bal FROM triples a JOIN triples b ON b.s = a.s AND b.p = '{EX}inNation'
    LEFT JOIN triples x ON x.s = a.s AND x.p = '{EX}balance' AND CAST(x.o AS DOUBLE) > 9000 WHERE a.p = '{TYPE}' AND a.o = '{EX}class/customer')
  SELECT DISTINCT c AS s, '{EX}livesIn' AS p, n AS o, 'iri' AS o_kind FROM b
  UNION SELECT DISTINCT c, '{EX}rich', bal, 'lit' FROM b WHERE bal IS NOT NULL""")
def construct(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    rich = P.match(t, ("?c", EX + "balance", "?bal")).where(F.col("bal").try_cast("double") > 9000)
    rows = P.optional(P.bgp(t, [("?c", TYPE, EX + "class/customer"), ("?c", EX + "inNation", "?n")]), rich)
    return P.construct(rows, [("?c", EX + "livesIn", "?n", "iri"), ("?c", EX + "rich", "?bal", "lit")])


@query(_T + f""", d AS (SELECT a.s AS n, b.o AS label FROM triples a JOIN triples b ON b.s = a.s AND b.p = '{LABEL}' WHERE a.p = '{EX}inRegion' AND a.o = '{EX}region/2')
  SELECT d.label AS nation, c.c_custkey AS custkey, c.c_acctbal AS balance FROM d JOIN customer c ON '{EX}nation/' || c.c_nationkey = d.n WHERE c.c_acctbal > 5000""")
def federated(spark, sf_dir):
    """Metadata first (nations of a region), then the payload by the key found."""
    t = entity_triples(spark, sf_dir)
    found = P.bgp(t, [("?n", EX + "inRegion", EX + "region/2"), ("?n", LABEL, "?nation")])
    payload = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(
        F.concat(F.lit(EX + "nation/"), F.col("c_nationkey").cast("string")).alias("n"), F.col("c_custkey").alias("custkey"),
        F.col("c_acctbal").alias("balance"))
    return payload.join(found, "n").select("nation", "custkey", "balance")


# --- measures ---------------------------------------------------------------------------------------

@query(_T + """SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates,
  (SELECT count(*) FROM (SELECT DISTINCT o, o_kind, o_dt, o_lang FROM triples)) AS objects FROM triples""")
def graph_counts(spark, sf_dir):
    return metrics.graph_counts(entity_triples(spark, sf_dir))


@query(_LINKED + """SELECT count(DISTINCT t) FILTER (k = 'iri') AS iri_count, count(DISTINCT t) FILTER (k = 'bnode') AS blank_nodes FROM (
  SELECT s AS t, s_kind AS k FROM linked UNION ALL SELECT p, 'iri' FROM linked UNION ALL SELECT o, o_kind FROM linked)""")
def graph_terms(spark, sf_dir):
    return metrics.graph_terms(_linked(spark, sf_dir))


def _metrics_sql(graph: str, extra: str = "") -> str:
    """Every measure of the linked graph in DuckDB, grouped by an expression for the graph. Components by least labels that spread
    along edges; distances by a search from every node of a graph within the limit."""
    return "WITH RECURSIVE " + _LINKED.rstrip().removeprefix("WITH ") + f""", x AS MATERIALIZED (SELECT {graph} AS g, s, s_kind, p, o, o_kind, o_dt, o_lang FROM linked),
  t AS (SELECT g, s AS term, s_kind AS kind, CAST(NULL AS VARCHAR) AS dt, CAST(NULL AS VARCHAR) AS lang, 1 AS su, 0 AS pr, 0 AS ob, CAST(o_kind <> 'lit' AS INT) AS e_out, 0 AS e_in,
    CAST(p = '{TYPE}' AS INT) AS ty, CAST(p = '{LABEL}' AS INT) AS la FROM x
  UNION ALL SELECT g, p, 'iri', NULL, NULL, 0, 1, 0, 0, 0, 0, 0 FROM x
  UNION ALL SELECT g, o, o_kind, o_dt, o_lang, 0, 0, 1, 0, CAST(o_kind <> 'lit' AS INT), 0, 0 FROM x),
  terms AS MATERIALIZED (SELECT g, term, kind, dt, lang, sum(su) AS su, sum(pr) AS pr, sum(ob) AS ob, sum(e_out) AS e_out, sum(e_in) AS e_in, sum(ty) AS ty, sum(la) AS la
    FROM t GROUP BY ALL),
  n AS MATERIALIZED (SELECT g, count(*) FILTER (su > 0) AS subjects, count(*) FILTER (su > 0 OR (ob > 0 AND kind <> 'lit')) AS nodes FROM terms GROUP BY g),
  nodes AS MATERIALIZED (SELECT g, CASE kind WHEN 'bnode' THEN '_:' || term ELSE term END AS node, row_number() OVER (ORDER BY g, CASE kind WHEN 'bnode' THEN '_:' || term ELSE term END) AS id
    FROM terms WHERE su > 0 OR (ob > 0 AND kind <> 'lit')),
  m AS (SELECT DISTINCT g, CASE s_kind WHEN 'bnode' THEN '_:' || s ELSE s END AS a, CASE o_kind WHEN 'bnode' THEN '_:' || o ELSE o END AS b FROM x WHERE o_kind <> 'lit'),
  ids AS MATERIALIZED (SELECT u.id AS a, v.id AS b FROM m JOIN nodes AS u ON u.g = m.g AND u.node = m.a JOIN nodes AS v ON v.g = m.g AND v.node = m.b),
  e AS MATERIALIZED (SELECT a, b FROM ids UNION SELECT b, a FROM ids),
  cc(id, root) USING KEY (id) AS (
    SELECT id, id FROM nodes
    UNION (SELECT e.a, min(v.root) FROM cc AS v JOIN e ON e.b = v.id JOIN recurring.cc AS u ON u.id = e.a WHERE v.root < u.root GROUP BY e.a)),
  comp AS MATERIALIZED (SELECT nodes.g, nodes.node, r.node AS root FROM cc JOIN nodes USING (id) JOIN nodes AS r ON r.id = cc.root),
  dist(start, node, d) USING KEY (start, node) AS (
    SELECT id, id, 0 FROM nodes JOIN n ON n.g = nodes.g AND n.nodes <= 2000
    UNION (SELECT dist.start, e.b, min(dist.d) + 1 FROM dist JOIN e ON e.a = dist.node LEFT JOIN recurring.dist AS u ON u.start = dist.start AND u.node = e.b
           WHERE u.node IS NULL GROUP BY dist.start, e.b)),
  far AS MATERIALIZED (SELECT g, CAST(max(d) AS BIGINT) AS d FROM dist JOIN nodes ON nodes.id = dist.start GROUP BY g),
  cls AS MATERIALIZED (SELECT g, count(DISTINCT {_label('o')}) AS k FROM x WHERE p = '{TYPE}' GROUP BY g),
  dup AS MATERIALIZED (SELECT g, CAST(sum(k - 1) AS BIGINT) AS k FROM (SELECT g, count(*) AS k FROM x GROUP BY g, s, p, o, s_kind, o_kind, o_dt, o_lang) GROUP BY g),
  parts AS MATERIALIZED (SELECT g, count(*) AS k, max(k) AS most FROM (SELECT g, root, count(*) AS k FROM comp GROUP BY ALL) GROUP BY g){extra}"""


_NUMBERS = f"""CAST(sum(su) AS BIGINT) AS triples, any_value(n.subjects) AS subjects, count(*) FILTER (pr > 0) AS predicates, count(*) FILTER (ob > 0) AS objects,
  count(*) FILTER (kind = 'iri') AS iri_count, count(*) FILTER (kind = 'bnode') AS blank_nodes, CAST(coalesce(sum(ob) FILTER (kind = 'lit'), 0) AS BIGINT) AS literals,
  CAST(coalesce(sum(ob) FILTER (kind = 'lit' AND dt IS NULL AND lang IS NULL), 0) AS BIGINT) AS untyped_literals,
  CAST(coalesce(sum(ob) FILTER (kind = 'lit' AND term = ''), 0) AS BIGINT) AS empty_literals, round(CAST(sum(su) AS DOUBLE) / any_value(n.subjects), 6) AS avg_triples_per_subject,
  coalesce(any_value(cls.k), 0) AS classes, count(*) FILTER (su > 0 AND ty = 0) AS subjects_without_type,
  count(*) FILTER (su > 0 AND la > 0) AS subjects_with_labels, count(*) FILTER (su > 0 AND la = 0) AS subjects_missing_labels,
  round(100.0 * count(*) FILTER (su > 0 AND la > 0) / any_value(n.subjects), 6) AS label_coverage, count(*) FILTER (su = 1) AS subjects_with_one_triple,
  any_value(n.nodes) AS resource_nodes, round(CAST(sum(e_out) AS DOUBLE) / any_value(n.nodes), 6) AS avg_out_degree,
  round(CAST(sum(e_in) AS DOUBLE) / any_value(n.nodes), 6) AS avg_in_degree,
  count(*) FILTER ((su > 0 OR (ob > 0 AND kind <> 'lit')) AND e_in + e_out <= 1) AS weakly_connected_nodes,
  round(100.0 * count(*) FILTER (kind = 'bnode') / any_value(n.nodes), 6) AS blank_node_percentage,
  CAST(coalesce(sum(pr) FILTER (term = '{OWL}sameAs'), 0) AS BIGINT) AS same_as_count,
  CAST(coalesce(sum(su + pr + ob) FILTER (kind = 'iri' AND NOT starts_with(term, '{EX}')), 0) AS BIGINT) AS external_iri_count,
  any_value(dup.k) AS duplicate_triples, any_value(parts.k) AS components, any_value(parts.most) AS largest_component, any_value(far.d) AS largest_distance,
  any_value(n.nodes) <= 2000 AS largest_distance_computed"""

_LISTS = f""", pl AS (SELECT g, {_label('term')} AS label, CAST(sum(pr) AS BIGINT) AS n FROM terms WHERE pr > 0 GROUP BY ALL),
  dl AS (SELECT g, coalesce({_label('dt')}, 'None') AS label, CAST(sum(ob) AS BIGINT) AS n FROM terms WHERE kind = 'lit' AND ob > 0 GROUP BY ALL),
  ll AS (SELECT g, coalesce(lang, 'None') AS label, CAST(sum(ob) AS BIGINT) AS n FROM terms WHERE kind = 'lit' AND ob > 0 GROUP BY ALL),
  cl AS (SELECT g, label, count(*) AS n FROM (SELECT DISTINCT g, s_kind, s, {_label('o')} AS label FROM x WHERE p = '{TYPE}') GROUP BY ALL),
  nl AS (SELECT g, CASE WHEN contains(term, '#') THEN regexp_extract(term, '^(.*#)', 1) ELSE regexp_extract(term, '^(.*/)', 1) END AS label, CAST(sum(su + pr + ob) AS BIGINT) AS n
    FROM terms WHERE kind = 'iri' AND NOT starts_with(term, '{EX}') GROUP BY ALL),
  ol AS (SELECT g, {_label('term')} AS label, term, CAST(e_out AS BIGINT) AS n FROM terms WHERE e_out > 0),
  il AS (SELECT g, {_label('term')} AS label, term, CAST(e_in AS BIGINT) AS n FROM terms WHERE e_in > 0),
  lists AS (SELECT g AS graph, 'predicates' AS list, row_number() OVER (PARTITION BY g ORDER BY n DESC, label) AS place, label, n FROM pl
    UNION ALL SELECT g, 'datatypes', row_number() OVER (PARTITION BY g ORDER BY n DESC, label), label, n FROM dl
    UNION ALL SELECT g, 'languages', row_number() OVER (PARTITION BY g ORDER BY n DESC, label), label, n FROM ll
    UNION ALL SELECT g, 'top_predicates', row_number() OVER (PARTITION BY g ORDER BY n DESC, label) AS r, label, n FROM pl QUALIFY r <= 10
    UNION ALL SELECT g, 'rare_predicates', row_number() OVER (PARTITION BY g ORDER BY n, label) AS r, label, n FROM pl QUALIFY r <= 10
    UNION ALL SELECT g, 'top_classes', row_number() OVER (PARTITION BY g ORDER BY n DESC, label) AS r, label, n FROM cl QUALIFY r <= 10
    UNION ALL SELECT g, 'top_external_namespaces', row_number() OVER (PARTITION BY g ORDER BY n DESC, label) AS r, label, n FROM nl QUALIFY r <= 10
    UNION ALL SELECT g, 'top_out_degree', row_number() OVER (PARTITION BY g ORDER BY n DESC, label, term) AS r, label, n FROM ol QUALIFY r <= 10
    UNION ALL SELECT g, 'top_in_degree', row_number() OVER (PARTITION BY g ORDER BY n DESC, label, term) AS r, label, n FROM il QUALIFY r <= 10)"""
_TEXTS = ", ".join(f"any_value(texts.{t}) AS {t}" for t in metrics.TOPS)
_LISTS += ", texts AS MATERIALIZED (SELECT graph AS g, " + ", ".join(
    f"string_agg(label || '=' || n, ';' ORDER BY place) FILTER (list = '{t}') AS {t}" for t in metrics.TOPS) + " FROM lists GROUP BY graph)"
_FROM = "FROM terms JOIN n USING (g) JOIN dup USING (g) JOIN parts USING (g) LEFT JOIN cls USING (g) LEFT JOIN far USING (g) JOIN texts USING (g) GROUP BY terms.g"


def _flat(rows):
    """Lists as text."""
    one = lambda t: F.when(F.size(t) > 0, F.array_join(F.transform(t, lambda x: F.concat(x["label"], F.lit("="), x["n"].cast("string"))), ";"))
    return rows.withColumns({t: one(t) for t in metrics.TOPS})


@query(_metrics_sql("'*'", _LISTS) + f"SELECT {_NUMBERS}, {_TEXTS} {_FROM}")
def graph_metrics(spark, sf_dir):
    """Every measure of all graphs taken together, in one row."""
    return _flat(metrics.graph_metrics(_linked(spark, sf_dir), EX))


@query(_metrics_sql("graph", _LISTS) + f"SELECT terms.g AS graph, {_NUMBERS}, {_TEXTS} {_FROM}")
def graph_metrics_per_graph(spark, sf_dir):
    """Every measure of each graph: several components, and distances of those within the limit."""
    return _flat(metrics.graph_metrics(_linked(spark, sf_dir), EX, per_graph=True))


@query(_metrics_sql("graph", _LISTS) + "SELECT graph, list, place, label, n FROM lists")
def graph_lists(spark, sf_dir):
    """Whole distributions and heads of lists, of each graph."""
    return metrics.graph_lists(_linked(spark, sf_dir), EX).select("graph", "list", F.col("place").cast("long").alias("place"), "label", "n")


@query(views("triples", "texts", "contacts") + f""", x AS (SELECT graph, s, p, o, o_kind, o_dt, o_lang FROM triples UNION ALL SELECT * FROM texts
    UNION ALL SELECT graph, s, p, o, o_kind, o_dt, o_lang FROM contacts)
  SELECT count(*) FILTER (o_kind = 'lit') AS literals, count(*) FILTER (o_kind = 'lit' AND o_dt IS NULL AND o_lang IS NULL) AS untyped,
  count(*) FILTER (o_kind = 'lit' AND o = '') AS empty, count(*) FILTER (p = '{OWL}sameAs') AS same_as,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang FROM x)) AS duplicates FROM x""")
def literal_quality(spark, sf_dir):
    return metrics.literal_quality(_linked(spark, sf_dir).unionByName(text_triples(spark, sf_dir)))


@query(_T + """, c AS (SELECT s, count(*) AS n FROM triples GROUP BY s)
  SELECT round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS avg_triples_per_subject, count(*) FILTER (n = 1) AS single_triple_subjects FROM c""")
def subject_stats(spark, sf_dir):
    return metrics.subject_stats(entity_triples(spark, sf_dir))


@query(_T + f""", c AS (SELECT {_label('p')} AS label, count(*) AS n FROM triples GROUP BY 1)
  SELECT 'all' AS which, label, n FROM c UNION ALL (SELECT 'rare', label, n FROM c ORDER BY n, label LIMIT 10)
  UNION ALL (SELECT 'top', label, n FROM c ORDER BY n DESC, label LIMIT 10)""")
def predicate_distribution(spark, sf_dir):
    c = metrics.predicate_distribution(entity_triples(spark, sf_dir))
    part = lambda name, df: df.select(F.lit(name).alias("which"), "label", "n")
    return part("all", c).union(part("rare", metrics.top(c, rare=True))).union(part("top", metrics.top(c)))


@query(_T + f"SELECT {_label('o')} AS label, count(DISTINCT s) AS n FROM triples WHERE p = '{TYPE}' GROUP BY 1")
def class_counts(spark, sf_dir):
    return metrics.class_counts(entity_triples(spark, sf_dir))


@query(_T + f""", c AS (SELECT s, bool_or(p = '{TYPE}') AS t, bool_or(p = '{LABEL}') AS l FROM triples GROUP BY s)
  SELECT count(*) FILTER (NOT t) AS without_type, count(*) FILTER (l) AS with_label, count(*) FILTER (NOT l) AS without_label,
  round(100.0 * count(*) FILTER (t) / count(*), 6) AS type_coverage, round(100.0 * count(*) FILTER (l) / count(*), 6) AS label_coverage FROM c""")
def coverage(spark, sf_dir):
    return metrics.coverage(entity_triples(spark, sf_dir))


@query(_T + f"SELECT coalesce({_label('o_dt')}, 'None') AS label, count(*) AS n FROM triples WHERE o_kind = 'lit' GROUP BY 1")
def datatype_distribution(spark, sf_dir):
    return metrics.literal_distribution(entity_triples(spark, sf_dir), "o_dt")


@query(views("texts") + "SELECT coalesce(o_lang, 'None') AS label, count(*) AS n FROM texts GROUP BY 1")
def language_distribution(spark, sf_dir):
    return metrics.literal_distribution(text_triples(spark, sf_dir), "o_lang")


@query(_T + f""", x AS (SELECT s AS t FROM triples UNION ALL SELECT p FROM triples UNION ALL SELECT o FROM triples WHERE o_kind = 'iri')
  SELECT CASE WHEN contains(t, '#') THEN regexp_extract(t, '^(.*#)', 1) ELSE regexp_extract(t, '^(.*/)', 1) END AS label, count(*) AS n
  FROM x WHERE NOT starts_with(t, '{EX}order/') GROUP BY 1""")
def external_namespaces(spark, sf_dir):
    return metrics.external_namespaces(entity_triples(spark, sf_dir), EX + "order/")


_DEGREES = """, m AS (SELECT CASE s_kind WHEN 'bnode' THEN '_:' || s ELSE s END AS s, CASE o_kind WHEN 'bnode' THEN '_:' || o ELSE o END AS o, o_kind FROM linked),
  e AS (SELECT s, o FROM m WHERE o_kind <> 'lit'), nodes AS (SELECT s AS node FROM m UNION SELECT o FROM e),
  d AS (SELECT node, coalesce(b.n, 0) AS out_degree, coalesce(a.n, 0) AS in_degree FROM nodes
    LEFT JOIN (SELECT s, count(*) AS n FROM e GROUP BY s) b ON b.s = node LEFT JOIN (SELECT o, count(*) AS n FROM e GROUP BY o) a ON a.o = node)"""


@query(_LINKED.rstrip() + _DEGREES + "SELECT node, out_degree, in_degree FROM d")
def degrees(spark, sf_dir):
    return metrics.degrees(_linked(spark, sf_dir))


@query(_LINKED.rstrip() + _DEGREES + """SELECT count(*) AS resource_nodes, count(*) FILTER (starts_with(node, '_:')) AS blank_nodes,
  round(100.0 * count(*) FILTER (starts_with(node, '_:')) / count(*), 6) AS blank_percent,
  round(CAST(sum(out_degree) AS DOUBLE) / count(*), 6) AS avg_out, round(CAST(sum(in_degree) AS DOUBLE) / count(*), 6) AS avg_in,
  count(*) FILTER (out_degree + in_degree <= 1) AS weakly_connected FROM d""")
def degree_summary(spark, sf_dir):
    return metrics.degree_summary(_linked(spark, sf_dir))


@query(_metrics_sql("'*'") + "SELECT node, root FROM comp WHERE node IN (SELECT a FROM m UNION SELECT b FROM m)")
def components(spark, sf_dir):
    """All resources of the graph and what it is linked to."""
    return metrics.components(metrics.resource_edges(_linked(spark, sf_dir)))


@query(_metrics_sql("graph") + "SELECT g AS graph, node, root FROM comp WHERE (g, node) IN (SELECT (g, a) FROM m UNION SELECT (g, b) FROM m)")
def components_per_graph(spark, sf_dir):
    """Components inside each graph: one per supplier in the graph of contacts."""
    rows = metrics.components(metrics.resource_edges(_linked(spark, sf_dir), "graph"), "graph")
    return rows.select("graph", "node", "root")


@query(_metrics_sql("graph") + "SELECT g AS graph, nodes AS resource_nodes, d AS largest_distance, nodes <= 2000 AS computed FROM n LEFT JOIN far USING (g)")
def largest_distance(spark, sf_dir):
    """Of each graph: those above the limit of nodes are counted and not computed."""
    return metrics.largest_distance(_linked(spark, sf_dir), per_graph=True)


@query(_T + "SELECT graph, count(*) AS n FROM triples GROUP BY graph")
def count_triples(spark, sf_dir):
    return metrics.triple_counts(entity_triples(spark, sf_dir))


@query(_T + f""", c AS (SELECT graph, {_label('p')} AS label, count(*) AS n FROM triples GROUP BY 1, 2)
  SELECT graph, label, n, place FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY n DESC, label) AS place FROM c) WHERE place <= 3""")
def topn_per_graph(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    counts = t.groupBy("graph", paths.term_label(F.col("p"), F.lit("iri")).alias("label")).agg(F.count("*").alias("n"))
    return metrics.top_per_graph(counts)


@query("""SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id""")
def first_subject(spark, sf_dir):
    """The first graph, in load order, that defines a subject."""
    return first_per(table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("user_id", "event_type", "event_id")


# --- neighbourhoods ---------------------------------------------------------------------------------

_HOOD = f""", e AS (SELECT DISTINCT s, o FROM triples WHERE o_kind = 'iri' AND p <> '{TYPE}'),
  h1 AS (SELECT '{EX}nation/3' AS node, 0 AS hops UNION SELECT CASE WHEN s = '{EX}nation/3' THEN o ELSE s END, 1 FROM e
         WHERE s = '{EX}nation/3' OR o = '{EX}nation/3'),
  h AS (SELECT node, min(hops) AS hops FROM (SELECT * FROM h1 UNION ALL SELECT o, h1.hops + 1 FROM e JOIN h1 ON h1.node = e.s
        UNION ALL SELECT s, h1.hops + 1 FROM e JOIN h1 ON h1.node = e.o) WHERE hops <= 2 GROUP BY node)"""


@query(_T.rstrip() + _HOOD + " SELECT e.s, e.o FROM e WHERE e.s IN (SELECT node FROM h) AND e.o IN (SELECT node FROM h)", name="neighborhood")
def neighborhood_of(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    return neighborhood.around(t, EX + "nation/3", depth=2, direction="both").select("s", "o")


@query(_T + f""", e AS (SELECT DISTINCT s, p, o FROM triples WHERE o_kind = 'iri'), hit AS (SELECT s AS node FROM triples
    WHERE contains(lower(s), 'nation_7') OR (p = '{LABEL}' AND contains(lower(o), 'nation_7')) UNION SELECT o FROM e WHERE contains(lower(o), 'nation_7')),
  near AS (SELECT node FROM hit UNION SELECT o FROM e JOIN hit ON hit.node = e.s UNION SELECT s FROM e JOIN hit ON hit.node = e.o)
  SELECT s, p, o FROM e WHERE s IN (SELECT node FROM near) AND o IN (SELECT node FROM near)""")
def neighborhood_search(spark, sf_dir):
    return neighborhood.search(entity_triples(spark, sf_dir), "Nation_7").select("s", "p", "o")


_TOP = f""", e AS (SELECT DISTINCT s, o FROM triples WHERE o_kind = 'iri' AND p <> '{TYPE}'),
  d AS (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM e UNION ALL SELECT o FROM e) GROUP BY node),
  top AS (SELECT node FROM d ORDER BY degree DESC, {_label('node')}, node LIMIT 200),
  kept AS (SELECT s, o FROM e WHERE s IN (SELECT node FROM top) AND o IN (SELECT node FROM top)),
  c AS (SELECT s AS node, min({_label('o')}) AS class FROM triples WHERE p = '{TYPE}' GROUP BY s),
  w AS (SELECT node, count(*) AS shown FROM (SELECT s AS node FROM kept UNION ALL SELECT o FROM kept) GROUP BY node),
  nt AS (SELECT d.node, coalesce(class, 'Resource') AS class, degree, coalesce(shown, 0) AS shown, degree - coalesce(shown, 0) AS hidden FROM d LEFT JOIN c USING (node) LEFT JOIN w USING (node))
"""


def _nodes(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    e = neighborhood.edges(t, with_terms=False)
    shown = neighborhood.most_connected(e, nodes=200, edges=100_000).where("s is not null")
    return neighborhood.node_table(t, e, shown)


@query(_T.rstrip() + _TOP + "SELECT node, class, degree, shown, hidden FROM nt")
def node_table(spark, sf_dir):
    """All nodes, with the neighbours inside and outside of the part that is shown."""
    return _nodes(spark, sf_dir)


@query(_T.rstrip() + _TOP + "SELECT class, count(*) AS nodes, CAST(sum(degree) AS BIGINT) AS links, CAST(sum(hidden) AS BIGINT) AS hidden FROM nt GROUP BY class")
def class_index(spark, sf_dir):
    return neighborhood.class_index(_nodes(spark, sf_dir))


@query(_T.rstrip() + _TOP + """SELECT s, o, (SELECT count(*) FROM d) AS total_nodes, (SELECT count(*) FROM e) AS total_edges,
  (SELECT count(*) FROM d) > 200 OR (SELECT count(*) FROM kept) > 100000 AS truncated FROM kept""")
def subgraph_top(spark, sf_dir):
    t = entity_triples(spark, sf_dir)
    return neighborhood.most_connected(neighborhood.edges(t, with_terms=False), nodes=200, edges=100_000)


@query(_LINKED + """, n AS (SELECT s_kind AS kind, s AS node FROM linked UNION SELECT o_kind, o FROM linked WHERE o_kind <> 'lit'),
  g AS (SELECT CASE WHEN kind = 'bnode' THEN 'blank' WHEN contains(node, '#') THEN regexp_extract(node, '^(.*#)', 1) ELSE regexp_extract(node, '^(.*/)', 1) END AS namespace FROM n)
  SELECT CASE namespace WHEN 'http://ex.org/class/' THEN 'cls' ELSE namespace END AS "group", namespace, count(*) AS nodes FROM g GROUP BY namespace""")
def namespace_groups(spark, sf_dir):
    return neighborhood.namespace_groups(_linked(spark, sf_dir), {"cls": EX + "class/"})


_VIEW = f""", r AS (SELECT DISTINCT s, p, o FROM linked WHERE o_kind <> 'lit'), nodes AS (SELECT s AS node FROM linked UNION SELECT o FROM r),
  d AS (SELECT node, count(x.node) AS degree FROM nodes LEFT JOIN (SELECT s AS node FROM r UNION ALL SELECT o FROM r) AS x USING (node) GROUP BY node),
  top AS (SELECT node FROM d WHERE degree > 0 ORDER BY degree DESC, {_label('node')}, node LIMIT 250),
  inside AS (SELECT * FROM r WHERE s IN (SELECT node FROM top) AND o IN (SELECT node FROM top)), shown AS (SELECT * FROM inside ORDER BY s, p, o LIMIT 750),
  w AS (SELECT node, count(*) AS shown FROM (SELECT s AS node FROM shown UNION ALL SELECT o FROM shown) GROUP BY node),
  c AS (SELECT s AS node, min({_label('o')}) AS class FROM linked WHERE p = '{TYPE}' GROUP BY s)
"""


@query(_LINKED.rstrip() + _VIEW + f"""SELECT node, {_label('node')} AS label, coalesce(class, 'Resource') AS class, degree, shown, degree - shown AS hidden
  FROM w JOIN d USING (node) LEFT JOIN c USING (node)""")
def graph_view(spark, sf_dir):
    """Nodes of the compact view of the whole graph."""
    return neighborhood.view(_linked(spark, sf_dir), "compact").nodes


@query(_LINKED.rstrip() + _VIEW + """SELECT (SELECT count(*) FROM d WHERE degree > 0) AS total_nodes, (SELECT count(*) FROM w) AS shown_nodes, (SELECT count(*) FROM inside) AS total_edges,
  (SELECT count(*) FROM shown) AS shown_edges, (SELECT count(*) FROM top) - (SELECT count(*) FROM w) AS dropped_isolated,
  (SELECT count(*) FROM d WHERE degree > 0) > 250 OR (SELECT count(*) FROM inside) > 750 AS truncated""")
def graph_view_summary(spark, sf_dir):
    return neighborhood.view(_linked(spark, sf_dir), "compact").summary
