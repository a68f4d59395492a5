"""The views of :mod:`treelake.model` as DuckDB common table expressions."""

from __future__ import annotations

from treelake.model import EX, LABEL, OWL, TYPE, XSD

_FILE = "'user_' || CAST(user_id AS VARCHAR)"
_NAME = "'/' || event_type || '/e' || CAST(event_id AS VARCHAR)"

CTES = {
    "objects": f"""objects AS (
  SELECT {_FILE} AS file_id, {_NAME} AS name, '/' || event_type AS parent, 'e' || CAST(event_id AS VARCHAR) AS basename,
         2 AS depth, 'dataset' AS obj_type, 'float64' AS dtype, 0 AS ndim FROM events
  UNION ALL SELECT DISTINCT {_FILE}, '/' || event_type, '/', event_type, 1, 'group', NULL, NULL FROM events
  UNION ALL SELECT DISTINCT {_FILE}, '/', NULL, '', 0, 'group', NULL, NULL FROM events)""",
    "attributes": f"""attributes AS (
  SELECT {_FILE} AS file_id, {_NAME} AS name, 'event_type' AS attr, 'str' AS vtype, event_type AS s, CAST(NULL AS DOUBLE) AS d,
         CAST(NULL AS VARCHAR) AS json FROM events
  UNION ALL SELECT {_FILE}, {_NAME}, 'value', 'float', NULL, value, NULL FROM events
  UNION ALL SELECT {_FILE}, {_NAME}, 'props', 'json', NULL, NULL, props FROM events
  UNION ALL SELECT {_FILE}, {_NAME}, 'ts', 'str', strftime(ts, '%Y-%m-%dT%H:%M:%S'), NULL, NULL FROM events
  UNION ALL SELECT {_FILE}, {_NAME}, 'units', 'str',
    CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 's' WHEN 'purchase' THEN 'V' WHEN 'error' THEN 'invalid' END, NULL, NULL
    FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error'))""",
    "annotations": f"""annotations AS (
  SELECT {_FILE} AS file_id, {_NAME} AS name, '{EX}event/' || CAST(event_id AS VARCHAR) AS subject,
         '{EX}class/' || event_type AS type, '{EX}hasValue' AS predicate,
         CASE WHEN value > 50 THEN '{EX}High' END AS object, value
  FROM events WHERE event_type IN ('error', 'purchase'))""",
    "triples": f"""triples AS (
  SELECT 'region' AS graph, '{EX}region/' || r_regionkey AS s, '{TYPE}' AS p, '{EX}class/region' AS o, 'iri' AS o_kind,
         CAST(NULL AS VARCHAR) AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM region
  UNION ALL SELECT 'region', '{EX}region/' || r_regionkey, '{LABEL}', r_name, 'lit', NULL, NULL FROM region
  UNION ALL SELECT 'nation', '{EX}nation/' || n_nationkey, '{TYPE}', '{EX}class/nation', 'iri', NULL, NULL FROM nation
  UNION ALL SELECT 'nation', '{EX}nation/' || n_nationkey, '{LABEL}', n_name, 'lit', NULL, NULL FROM nation
  UNION ALL SELECT 'nation', '{EX}nation/' || n_nationkey, '{EX}inRegion', '{EX}region/' || n_regionkey, 'iri', NULL, NULL FROM nation
  UNION ALL SELECT 'customer', '{EX}customer/' || c_custkey, '{TYPE}', '{EX}class/customer', 'iri', NULL, NULL FROM customer
  UNION ALL SELECT 'customer', '{EX}customer/' || c_custkey, '{EX}inNation', '{EX}nation/' || c_nationkey, 'iri', NULL, NULL FROM customer
  UNION ALL SELECT 'customer', '{EX}customer/' || c_custkey, '{EX}balance', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), 'lit', '{XSD}double', NULL FROM customer
  UNION ALL SELECT 'supplier', '{EX}supplier/' || s_suppkey, '{TYPE}', '{EX}class/supplier', 'iri', NULL, NULL FROM supplier
  UNION ALL SELECT 'supplier', '{EX}supplier/' || s_suppkey, '{EX}inNation', '{EX}nation/' || s_nationkey, 'iri', NULL, NULL FROM supplier
  UNION ALL SELECT 'part', '{EX}part/' || p_partkey, '{TYPE}', '{EX}class/part', 'iri', NULL, NULL FROM part
  UNION ALL SELECT 'part', '{EX}part/' || p_partkey, '{EX}name', p_name, 'lit', NULL, NULL FROM part
  UNION ALL SELECT 'order', '{EX}order/' || o_orderkey, '{TYPE}', '{EX}class/order', 'iri', NULL, NULL FROM orders
  UNION ALL SELECT 'order', '{EX}order/' || o_orderkey, '{EX}by', '{EX}customer/' || o_custkey, 'iri', NULL, NULL FROM orders
  UNION ALL SELECT 'order', '{EX}order/' || o_orderkey, '{EX}total', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 'lit', '{XSD}double', NULL FROM orders
  UNION ALL SELECT 'order', '{EX}order/' || o_orderkey, '{EX}date', strftime(o_orderdate, '%Y-%m-%d'), 'lit', '{XSD}date', NULL FROM orders
  UNION ALL SELECT DISTINCT 'order', '{EX}order/' || l_orderkey, '{EX}hasPart', '{EX}part/' || l_partkey, 'iri', NULL, NULL FROM lineitem
  UNION ALL SELECT DISTINCT 'order', '{EX}order/' || l_orderkey, '{EX}fromSupplier', '{EX}supplier/' || l_suppkey, 'iri', NULL, NULL FROM lineitem)""",
    "contacts": f"""contacts AS (
  SELECT 'contacts' AS graph, '{EX}supplier/' || s_suppkey AS s, 'iri' AS s_kind, '{EX}contact' AS p, 'c' || s_suppkey AS o, 'bnode' AS o_kind,
         CAST(NULL AS VARCHAR) AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM supplier
  UNION ALL SELECT 'contacts', 'c' || s_suppkey, 'bnode', '{EX}name', s_name, 'lit', NULL, NULL FROM supplier
  UNION ALL SELECT 'contacts', 'c' || s_suppkey, 'bnode', '{EX}phone', CASE WHEN s_acctbal >= 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END, 'lit', NULL, NULL FROM supplier
  UNION ALL SELECT 'contacts', '{EX}supplier/' || s_suppkey, 'iri', '{OWL}sameAs', 'https://register.example.net/s#' || s_suppkey, 'iri', NULL, NULL
    FROM supplier WHERE s_acctbal >= 0)""",
    "linked": """linked AS (
  SELECT graph, s, 'iri' AS s_kind, p, o, o_kind, o_dt, o_lang FROM triples UNION ALL SELECT graph, s, s_kind, p, o, o_kind, o_dt, o_lang FROM contacts)""",
    "member": f"""member AS (
  SELECT '{EX}region/' || n_regionkey AS s, '{EX}nation/' || n_nationkey AS o FROM nation
  UNION ALL SELECT '{EX}nation/' || c_nationkey, '{EX}customer/' || c_custkey FROM customer
  UNION ALL SELECT '{EX}customer/' || o_custkey, '{EX}order/' || o_orderkey FROM orders)""",
    "texts": f"""texts AS (
  SELECT 'documents' AS graph, '{EX}document/' || doc_id AS s, 'http://purl.org/dc/terms/description' AS p, coalesce(text, '') AS o,
         'lit' AS o_kind, CAST(NULL AS VARCHAR) AS o_dt, lang AS o_lang FROM documents)""",
    "emb": """emb AS (
  SELECT CAST(vec_id AS INTEGER) AS i0, CAST(u.pos - 1 AS INTEGER) AS i1, CAST(embedding[u.pos] AS DOUBLE) AS v, label
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS pos) u)""",
    "series": f"""series AS (
  SELECT {_FILE} AS dataset, CAST(floor(epoch(ts)) AS BIGINT) AS coord, arg_min(value, event_id) AS v FROM events GROUP BY 1, 2)""",
    "component": """component AS (
  SELECT event_type AS name, user_id, strftime(ts, '%Y-%m-%d') AS day,
         CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS v FROM events GROUP BY 1, 2, 3)""",
}


def views(*names: str) -> str:
    return "WITH " + ",\n".join(CTES[n].replace(" AS (", " AS MATERIALIZED (", 1) for n in names) + "\n"
