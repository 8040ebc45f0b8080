"""Lists, lookups, validity checks and reconciliation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagefacts.checks.graph_sql import LINKS_SQL
from pagefacts.checks.registry import AS_OF, MIDDLE, query
from pagefacts.checks.rollup_queries import _BUILD_KEY, _nested_sql
from pagefacts.operators import lookups as L
from pagefacts.operators import reconcile as C
from pagefacts.operators import star as S
from pagefacts.session import durable_dir
from pagefacts.sources.driver_tables import KG_SQL, driver_store, knowledge_graph, store_sql, stored, table
from pagefacts.vocab import DEFAULT, RDF_TYPE, SCHEMA


@query("b13_website_search", store_sql("SELECT id, name, seedurl, default_language FROM websites WHERE contains(name, '_1')"))
def b13(spark, sf):
    return L.websites(driver_store(spark, sf), "_1").select("id", "name", "seedurl", "default_language")


@query(
    "b14_site_rules",
    store_sql("""SELECT s.id AS source_id, w.seedurl, s.selected, s.property_id, p.label, s.language AS rule_language, s.algorithm_value
FROM sources s JOIN properties p ON s.property_id = p.id JOIN websites w ON s.website_id = w.id"""),
)
def b14(spark, sf):
    return L.site_rules(driver_store(spark, sf)).select(
        "source_id", "seedurl", "selected", "property_id", "label", "rule_language", "algorithm_value"
    )


@query(
    "b15_output_decision",
    store_sql(f""",
{_nested_sql("star", _BUILD_KEY)},
x AS (SELECT n.rdf_uri, s.label FROM nested n JOIN star s USING (statement_id) WHERE n.role = 'selected' AND s.rdfs_class_name = 'Event'
  AND s.predicate IN ('{SCHEMA}name', '{SCHEMA}startDate', '{SCHEMA}location')
  AND (n.status NOT IN ('ok', 'updated') OR trim(n.value) IN ('', '[]'))),
i AS (SELECT rdf_uri, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels FROM x GROUP BY rdf_uri)
SELECT w.id AS webpage_id, w.url, CASE WHEN jsonld_output_id = 1 THEN 'none' WHEN labels IS NOT NULL THEN 'message'
  WHEN jsonld_output_id = 2 THEN 'own frame' ELSE 'class frame' END AS decision,
  CASE WHEN jsonld_output_id IS DISTINCT FROM 1 AND labels IS NOT NULL THEN 'Event needs review in the console. Issues with ' || labels || '.' END AS message
FROM webpages w LEFT JOIN i ON i.rdf_uri = w.rdf_uri"""),
)
def b15(spark, sf):
    return L.output_decision(driver_store(spark, sf)).select("webpage_id", "url", "decision", "message")


@query(
    "b15_unknown_pages",
    store_sql("SELECT DISTINCT url, 'Webpage fits URL pattern but has no events in the console.' AS message FROM pages WHERE url NOT IN (SELECT url FROM webpages)"),
)
def b15_unknown(spark, sf):
    return L.unknown_pages(driver_store(spark, sf), table(spark, sf, "pages"))


@query(
    "b16_violations",
    store_sql("""
SELECT 'websites' AS table_name, 'graph_name' AS rule, CAST(id AS VARCHAR) AS key FROM websites WHERE NOT regexp_matches(graph_name, '^http.*\\..*\\w$')
UNION ALL SELECT 'webpages', 'unique url, website_id', url || '|' || website_id FROM webpages GROUP BY url, website_id HAVING count(*) > 1
UNION ALL SELECT 'statements', 'unique source_id, webpage_id', source_id || '|' || webpage_id FROM statements GROUP BY source_id, webpage_id HAVING count(*) > 1
UNION ALL SELECT 'statements', 'status', CAST(id AS VARCHAR) FROM statements WHERE status NOT IN ('initial', 'missing', 'ok', 'problem', 'updated')"""),
)
def b16(spark, sf):
    return L.validate_store(driver_store(spark, sf, with_cache=False))


@query(
    "b17_repeated_rule_page",
    """SELECT 'raw_statements' AS table_name, 'unique source_id, webpage_id' AS rule, source_id || '|' || webpage_id AS key FROM (
  SELECT ((l_orderkey // 2) % 25) * 100 + l_linenumber * 10 + l_suppkey % 3 AS source_id, l_orderkey AS webpage_id FROM lineitem)
GROUP BY source_id, webpage_id HAVING count(*) > 1""",
)
def b17(spark, sf):
    """Uniqueness over the values before they are reduced to the newest."""
    raw = table(spark, sf, "lineitem").select(
        F.lit("ok").alias("status"),
        F.col("l_orderkey").alias("id"),
        (F.floor(F.col("l_orderkey") / 2) % 25 * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 3).alias("source_id"),
        F.col("l_orderkey").alias("webpage_id"),
    )
    found = L.validate_store(driver_store(spark, sf, False).with_(statements=raw))
    return found.filter("rule = 'unique source_id, webpage_id'").withColumn("table_name", F.lit("raw_statements"))


@query("b18_page_statements", store_sql("SELECT statement_id, label, cache, status FROM star WHERE url = 'http://site4.example/p/8'"))
def b18(spark, sf):
    return L.page_statements(driver_store(spark, sf), "http://site4.example/p/8").select("statement_id", "label", "cache", "status")


@query("b18_page_urls", store_sql("SELECT rdf_uri, url, language FROM webpages WHERE rdf_uri = 'adr:r7'"))
def b18_urls(spark, sf):
    return L.page_urls(driver_store(spark, sf, False), "adr:r7")


@query(
    "c8_resource_uris",
    store_sql(""",
first AS (SELECT rdf_uri, min(id) AS webpage_id FROM webpages GROUP BY rdf_uri),
n AS (SELECT webpage_id, arg_min(cache, statement_id) AS name FROM star WHERE label = 'Name' GROUP BY webpage_id)
SELECT DISTINCT s.seedurl, c.name AS page_class, w.rdf_uri, n.name FROM webpages w JOIN websites s ON w.website_id = s.id JOIN rdfs_classes c ON c.id = w.rdfs_class_id
JOIN first f ON f.rdf_uri = w.rdf_uri LEFT JOIN n ON n.webpage_id = f.webpage_id"""),
)
def c8(spark, sf):
    return L.resource_uris(driver_store(spark, sf))


@query("c9_other_entities", store_sql("SELECT DISTINCT seedurl, rdf_uri FROM star WHERE selected_individual AND page_class <> 'Event'"))
def c9(spark, sf):
    return L.other_entities(driver_store(spark, sf, False))


@query(
    "c10_uri_statements",
    store_sql("""
SELECT statement_id, rdf_uri, label, cache FROM star WHERE selected_individual
  AND rdf_uri IN (SELECT rdf_uri FROM star WHERE selected AND label = 'Price' AND cache = 'NaN')"""),
)
def c10(spark, sf):
    store = driver_store(spark, sf)
    unpriced = S.query_statements(store, prop=4, selected=True, ordered=False).filter("cache = 'NaN'")
    return L.uri_statements(store, unpriced).select("statement_id", "rdf_uri", "label", "cache")


@query(
    "c11_places",
    store_sql("""
SELECT g.statement_id, s.rdf_uri, s.seedurl, s.rule_language AS language, s.url, g.gi - 1 AS pos, json_extract_string(g.g, '$[0]') AS search,
  json_extract_string(g.g, '$[1]') AS class, (SELECT count(*) FROM links l WHERE l.statement_id = g.statement_id AND l.gi = g.gi) AS n_links
FROM grouped g JOIN star s USING (statement_id) WHERE s.selected AND s.label = 'Location'""", LINKS_SQL),
)
def c11(spark, sf):
    return L.places(driver_store(spark, sf))


@query(
    "c12_source_report",
    store_sql(f""",
t AS (SELECT webpage_id, min(cache) AS event_title FROM star WHERE selected AND label = 'Title'
  AND archive_date BETWEEN TIMESTAMP '{MIDDLE}' - INTERVAL 10 YEAR AND TIMESTAMP '{MIDDLE}' + INTERVAL 10 YEAR GROUP BY webpage_id)
SELECT statement_id, source_id, cache, event_title, CASE WHEN page_class = 'Event' THEN archive_date END AS event_archive_date,
  CASE WHEN page_class = 'Event' THEN rdf_uri END AS rdf_uri
FROM star LEFT JOIN t USING (webpage_id) WHERE archive_date BETWEEN TIMESTAMP '{MIDDLE}' AND TIMESTAMP '{MIDDLE}' + INTERVAL 18 MONTH"""),
)
def c12(spark, sf):
    return L.source_report(driver_store(spark, sf), None, None, None, MIDDLE, ordered=False)


@query(
    "c19_next_to_review",
    store_sql("""
SELECT seedurl, min(created_at) AS created_at, arg_min(rdf_uri, (created_at, rdf_uri)) AS rdf_uri FROM star
WHERE selected AND page_class = 'Event' AND status IN ('initial', 'updated') GROUP BY seedurl"""),
)
def c19(spark, sf):
    return L.next_to_review(driver_store(spark, sf, False))


# the names asked for: part names as written on pages, for two classes
_ASKED = """
asked AS (SELECT DISTINCT upper(p_name) AS text, CASE WHEN p_partkey % 2 = 0 THEN 'Place' ELSE 'Organization' END AS class FROM part
  UNION SELECT s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Place' ELSE 'Organization' END FROM supplier)
"""


def asked(spark, sf):
    part = table(spark, sf, "part").select(
        F.upper("p_name").alias("text"), F.when(F.col("p_partkey") % 2 == 0, "Place").otherwise("Organization").alias("class")
    )
    supplier = table(spark, sf, "supplier").select(
        F.col("s_name").alias("text"), F.when(F.col("s_suppkey") % 2 == 0, "Place").otherwise("Organization").alias("class")
    )
    return part.unionByName(supplier).distinct()


_LOCAL = """
ln AS (SELECT DISTINCT cache AS label, rdfs_class_name AS fc, rdf_uri FROM star WHERE selected AND status IN ('ok', 'updated') AND label IN ('Name', 'alternateName')),
lx AS (SELECT e.name AS label, c.name AS class FROM search_exceptions e JOIN rdfs_classes c ON c.id = e.rdfs_class_id),
local_hits AS (
  SELECT DISTINCT a.text, a.class, ln.label, ln.rdf_uri FROM asked a JOIN ln ON lower(a.text) = lower(ln.label)
    AND (ln.fc = a.class OR (a.class = 'Organization' AND ln.fc = 'Person'))
  WHERE NOT EXISTS (SELECT 1 FROM lx WHERE lx.label = ln.label AND lx.class = a.class))
"""


@query("c2_search_local", store_sql("SELECT * FROM local_hits", _ASKED, _LOCAL))
def c2(spark, sf):
    return C.search_local(asked(spark, sf), driver_store(spark, sf))


@query(
    "c3_drop_exceptions",
    store_sql("""
SELECT DISTINCT p_name AS label, CASE WHEN p_size % 2 = 0 THEN 'Place' ELSE 'Organization' END AS class FROM part
WHERE NOT EXISTS (SELECT 1 FROM lx WHERE lx.label = p_name AND lx.class = CASE WHEN p_size % 2 = 0 THEN 'Place' ELSE 'Organization' END)""",
              _ASKED, _LOCAL),
)
def c3(spark, sf):
    names = table(spark, sf, "part").select(
        F.col("p_name").alias("label"), F.when(F.col("p_size") % 2 == 0, "Place").otherwise("Organization").alias("class")
    )
    return C.drop_exceptions(names.distinct(), driver_store(spark, sf))


_KG_HITS = f"""
kn AS (SELECT n.s AS uri, n.o AS label, substr(t.o, length('{SCHEMA}') + 1) AS fc, n.p LIKE '%alternateName' AS alias
  FROM kg n JOIN kg t ON t.s = n.s AND t.p = '{RDF_TYPE}' AND starts_with(t.o, '{SCHEMA}') WHERE n.p IN ('{SCHEMA}name', '{SCHEMA}alternateName'))
"""


@query(
    "c4_search_kg",
    store_sql("""SELECT DISTINCT a.text, a.class, kn.label, kn.uri FROM asked a JOIN kn ON lower(kn.label) = lower(a.text) AND kn.fc = a.class WHERE length(a.text) > 3""",
              _ASKED, KG_SQL, _KG_HITS),
)
def c4(spark, sf):
    return C.search_kg(asked(spark, sf), knowledge_graph(spark, sf), driver_store(spark, sf))


@query(
    "c5_reconcile",
    store_sql(f"""
SELECT text, class, label, replace(rdf_uri, 'adr:', '{DEFAULT.kg_base}') AS uri, 0 AS origin FROM local_hits
UNION ALL
SELECT DISTINCT a.text, a.class, kn.label, kn.uri, CASE WHEN kn.fc = a.class THEN 1 ELSE 2 END FROM asked a JOIN kn ON lower(kn.label) = lower(a.text)
  AND (kn.fc = a.class OR (a.class = 'Organization' AND kn.fc = 'Person'))
WHERE NOT EXISTS (SELECT 1 FROM local_hits h WHERE h.text = a.text AND h.class = a.class)""", _ASKED, _LOCAL, KG_SQL, _KG_HITS),
)
def c5(spark, sf):
    return C.reconcile(asked(spark, sf), driver_store(spark, sf), knowledge_graph(spark, sf))


@query(
    "c6_link_values",
    store_sql("""
SELECT DISTINCT s.statement_id, g.gi - 1 AS item_pos, json_extract_string(g.g, '$[0]') AS text, s.expected_class AS class, kn.label, kn.uri
FROM star s JOIN grouped g ON g.statement_id = s.statement_id
LEFT JOIN kn ON lower(kn.label) = lower(json_extract_string(g.g, '$[0]'))
  AND (kn.fc = s.expected_class OR (s.expected_class = 'Organization' AND kn.fc = 'Person'))""", LINKS_SQL, KG_SQL, _KG_HITS),
)
def c6(spark, sf):
    """Scraped texts are those the stored links were once found with."""
    store = stored(driver_store(spark, sf))
    rows = S.star(store).filter("value_datatype = 'xsd:anyURI'")
    from pagefacts.functions import values as V

    texts = F.transform(V.parse_links("cache"), lambda g: g["search"])
    return C.link_values(rows.withColumn("values", texts), store, knowledge_graph(spark, sf)).drop("origin")


@query(
    "c7_recon",
    store_sql("""
SELECT DISTINCT h.name, h.webpage_id, h.id, d.cache AS description FROM (
  SELECT DISTINCT cache AS name, webpage_id, rdf_uri AS id FROM star WHERE selected AND status IN ('ok', 'updated') AND label = 'Name'
    AND rdfs_class_name = 'Place' AND contains(lower(cache), 'ring')) h
LEFT JOIN star d ON d.webpage_id = h.webpage_id AND d.label = 'Disambiguating Description'"""),
)
def c7(spark, sf):
    store = driver_store(spark, sf)
    return C.recon(_index(spark, store), store, "RING", "Place").distinct()


def _index(spark, store):
    return C.recon_index(store, f"{durable_dir(spark).rstrip('/')}/names-{uuid.uuid4().hex}")


# searches: the second to sixth letter of every part's name, its first letters, and whole supplier names, in three classes
_SEARCHES = """
q AS (SELECT DISTINCT text, class FROM (SELECT substr(p_name, 2, 5) AS text FROM part UNION SELECT left(p_name, 2) FROM part UNION SELECT upper(s_name) FROM supplier UNION SELECT left(s_name, 1) FROM supplier),
  (VALUES ('Place'), ('Organization'), ('Event')) AS c(class)),
nn AS (SELECT DISTINCT cache AS name, webpage_id, rdf_uri AS id, rdfs_class_name AS class FROM star
  WHERE selected AND status IN ('ok', 'updated') AND label IN ('Name', 'alternateName')),
nd AS (SELECT DISTINCT name, class FROM nn)
"""


@query(
    "c7_recon_many",
    store_sql("""
SELECT DISTINCT h.text, h.class, n.name, n.webpage_id, n.id, d.cache AS description
FROM (SELECT q.text, q.class, nd.name FROM q JOIN nd ON nd.class = q.class AND contains(lower(nd.name), lower(q.text))) h
JOIN nn n ON n.name = h.name AND n.class = h.class LEFT JOIN star d ON d.webpage_id = n.webpage_id AND d.label = 'Disambiguating Description'""", _SEARCHES),
)
def c7_many(spark, sf):
    store = driver_store(spark, sf)
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    texts = part.select(F.substring("p_name", 2, 5).alias("text")).unionByName(part.select(F.substring("p_name", 1, 2).alias("text")))
    texts = texts.unionByName(supplier.select(F.upper("s_name").alias("text"))).unionByName(supplier.select(F.substring("s_name", 1, 1).alias("text")))
    searches = texts.distinct().withColumn("class", F.explode(F.array(*map(F.lit, ("Place", "Organization", "Event")))))
    return C.recon_many(_index(spark, store), store, searches).distinct()
