"""Graph building, rewriting and series over the store's own statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefacts.checks.graph_sql import GRAPH_SQL, LINKS_SQL, OFFERS_SQL, SERIES_SQL, VARIANT_SQL, describe_sql
from pagefacts.checks.registry import query
from pagefacts.operators import graph as G
from pagefacts.operators import series as E
from pagefacts.operators import star as S
from pagefacts.sources.driver_tables import KG_SQL, driver_store, knowledge_graph, store_sql
from pagefacts.session import cut_lineage
from pagefacts.vocab import DEFAULT, RDF_TYPE, SCHEMA

_COLS = "graph_id, s, p, o, o_kind, lang, datatype"


def statement_graph(spark, sf):
    rows = S.star(driver_store(spark, sf)).filter("selected_individual")
    return G.build_graph(rows)


def stored_graph(spark, sf):
    """The same, written once: the series steps read it several times."""
    return cut_lineage(statement_graph(spark, sf), "graph")


@query("i1_build_graph", store_sql(f"SELECT {_COLS}, pos FROM graph", GRAPH_SQL))
def i1(spark, sf):
    return statement_graph(spark, sf)


@query("i2_drop_annotations", store_sql(f"SELECT {_COLS} FROM graph WHERE pos IS NULL", GRAPH_SQL))
def i2(spark, sf):
    return G.drop_annotations(statement_graph(spark, sf)).drop("pos")


@query(
    "i3_schema_types",
    "WITH " + KG_SQL + f"SELECT s, p, o FROM kg WHERE p <> '{RDF_TYPE}' OR contains(o, 'schema.org')",
)
def i3(spark, sf):
    return G.keep_schema_types(knowledge_graph(spark, sf)).select("s", "p", "o")


@query(
    "d10_annotation_counts",
    store_sql("SELECT graph_id, p, count(*) AS n FROM graph WHERE pos IS NOT NULL GROUP BY graph_id, p", GRAPH_SQL),
)
def d10(spark, sf):
    return G.count_annotations(statement_graph(spark, sf))


@query("i5_offer_series", store_sql(f"SELECT {_COLS}, pos FROM moved_offers", GRAPH_SQL, OFFERS_SQL.format(src="graph", dst="moved_offers")))
def i5(spark, sf):
    return E.offer_series(stored_graph(spark, sf))


@query("i6_series_variant", store_sql("SELECT * FROM variants", GRAPH_SQL, VARIANT_SQL))
def i6(spark, sf):
    return E.series_variant(statement_graph(spark, sf))


@query("i6_rejected_series", store_sql("SELECT * FROM variants WHERE variant = 'rejected'", GRAPH_SQL, VARIANT_SQL))
def i6_rejected(spark, sf):
    return E.rejected_series(statement_graph(spark, sf))


@query("i7_event_series", store_sql(f"SELECT {_COLS}, pos FROM series", GRAPH_SQL, VARIANT_SQL, SERIES_SQL))
def i7(spark, sf):
    return E.event_series(stored_graph(spark, sf))


@query(
    "c17_object_uris",
    store_sql("SELECT DISTINCT graph_id, o AS uri FROM graph WHERE pos IS NULL AND o_kind = 'uri'", GRAPH_SQL),
)
def c17_uris(spark, sf):
    return G.object_uris(statement_graph(spark, sf))


_URIS = "uris AS (SELECT DISTINCT graph_id, o AS uri FROM graph WHERE pos IS NULL AND o_kind = 'uri')"
_EXPORT_URIS = f"""uris AS (SELECT DISTINCT graph_id, o AS uri FROM graph WHERE pos IS NULL AND o_kind = 'uri'
  AND NOT contains(o, '{DEFAULT.kg_entity}'))"""


@query(
    "c16_describe",
    store_sql("SELECT graph_id, s, p, o, o_kind, lang FROM found", GRAPH_SQL, KG_SQL, _URIS, describe_sql("uris", "found")),
)
def c16(spark, sf):
    uris = G.object_uris(statement_graph(spark, sf))
    return G.describe(knowledge_graph(spark, sf), uris).drop("datatype", "pos")


@query(
    "c17_enrich_export",
    store_sql(
        f"SELECT {_COLS}, pos FROM graph UNION SELECT graph_id, s, p, o, o_kind, lang, '', NULL FROM found",
        GRAPH_SQL, KG_SQL, _EXPORT_URIS, describe_sql("uris", "found"),
    ),
)
def c17(spark, sf):
    return G.enrich(stored_graph(spark, sf), knowledge_graph(spark, sf), export=True)


@query(
    "c20_place_address",
    "WITH " + KG_SQL + f"""
SELECT e.s AS uri, CAST(NULL AS VARCHAR) AS "streetAddress", CAST(NULL AS VARCHAR) AS "addressLocality", max(r.o) AS "addressRegion", CAST(NULL AS VARCHAR) AS "postalCode", max(c.o) AS "addressCountry"
FROM kg e JOIN kg t ON t.s = e.o AND t.p = '{RDF_TYPE}' AND t.o = '{SCHEMA}PostalAddress'
JOIN kg c ON c.s = e.o AND c.p = '{SCHEMA}addressCountry' JOIN kg r ON r.s = e.o AND r.p = '{SCHEMA}addressRegion'
WHERE e.o_kind = 'uri' GROUP BY e.s""",
)
def c20(spark, sf):
    kg = knowledge_graph(spark, sf)
    uris = kg.filter((F.col("p") == SCHEMA + "address")).select(F.col("s").alias("uri"))
    return G.place_address(kg, uris)


def _rank(lang: str) -> str:
    return f"CASE WHEN lang = '{lang}' THEN 0 WHEN lang = '' THEN 1 WHEN lang = 'en' THEN 2 ELSE 3 END"


@query(
    "d14_coalesce_language",
    store_sql(f""",
ranked AS (SELECT *, {_rank("fr")} AS rk, pos IS NULL AND o_kind = 'literal' AND p IN ('{SCHEMA}name', '{SCHEMA}description', '{SCHEMA}url') AS cand
  FROM graph)
SELECT {_COLS} FROM ranked r WHERE pos IS NULL AND (NOT cand OR rk = (SELECT min(rk) FROM ranked q WHERE q.cand AND q.graph_id = r.graph_id AND q.s = r.s AND q.p = r.p))""", GRAPH_SQL).replace("),,", "),"),
)
def d14(spark, sf):
    return G.coalesce_language(G.drop_annotations(stored_graph(spark, sf)), "fr").drop("pos")


@query(
    "h19_strip_typed_dates",
    store_sql(f"SELECT DISTINCT graph_id, s, p, o, o_kind, lang, '' AS datatype FROM graph WHERE pos IS NULL", GRAPH_SQL),
)
def h19(spark, sf):
    return G.strip_typed_dates(G.drop_annotations(statement_graph(spark, sf))).drop("pos")


@query(
    "h4_link_uris",
    store_sql("SELECT statement_id, pos, uri FROM kept_uris", LINKS_SQL),
)
def h4(spark, sf):
    from pagefacts.functions import values as V

    rows = S.star(driver_store(spark, sf)).filter("value_datatype = 'xsd:anyURI'")
    return rows.select("statement_id", F.posexplode(V.link_uris(V.parse_links("cache"))).alias("pos", "uri"))


@query(
    "h5_missing_links",
    store_sql("""
, m AS (SELECT statement_id, gi, bool_and(search NOT IN ('Manually added', 'Manually deleted')) AS scraped, max(search) AS search,
    min(uri) FILTER (hi = 1) AS first_uri
  FROM (SELECT g.statement_id, g.gi, json_extract_string(g.g, '$[0]') AS search, l.uri, l.hi FROM grouped g LEFT JOIN links l
    ON l.statement_id = g.statement_id AND l.gi = g.gi) GROUP BY statement_id, gi)
SELECT statement_id, CASE WHEN count(first_uri) FILTER (scraped) = 0
  THEN NOT coalesce(bool_or(starts_with(first_uri, 'http')) FILTER (search = 'Manually added'), false)
  ELSE bool_or(first_uri IS NULL OR NOT starts_with(first_uri, 'http')) FILTER (scraped) END AS missing
FROM m GROUP BY statement_id""", LINKS_SQL),
)
def h5(spark, sf):
    from pagefacts.functions import values as V

    rows = S.star(driver_store(spark, sf)).filter("value_datatype = 'xsd:anyURI'")
    return rows.select("statement_id", V.missing_links(V.parse_links("cache")).alias("missing"))


@query(
    "a4_local_graph",
    store_sql("""
SELECT DISTINCT s, p, o, o_kind, lang, datatype FROM graph JOIN (SELECT DISTINCT rdf_uri FROM star WHERE page_class IN ('Place', 'Organization')) r
  ON replace(r.rdf_uri, 'adr:', '""" + DEFAULT.kg_base + """') = graph_id WHERE pos IS NULL""", GRAPH_SQL),
)
def a4(spark, sf):
    rows = S.star(driver_store(spark, sf))
    return G.local_graph(rows).drop("graph_id", "pos")
