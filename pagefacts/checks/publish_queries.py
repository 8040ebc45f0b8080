"""Export, markup, documents and extracts over the store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagefacts.checks.graph_queries import stored_graph
from pagefacts.checks.graph_sql import GRAPH_SQL, OFFERS_SQL, SERIES_SQL, VARIANT_SQL, describe_sql
from pagefacts.checks.registry import AS_OF, query
from pagefacts.checks.rollup_queries import _BUILD_KEY, _INDEX, _nested_sql
from pagefacts.operators import graph as G
from pagefacts.operators import jsonld as D
from pagefacts.plans import publish as P
from pagefacts.session import cut_lineage, discard, durable_dir
from pagefacts.sources import exports as X
from pagefacts.sources.driver_tables import KG_SQL, driver_store, knowledge_graph, store_sql, table
from pagefacts.vocab import DEFAULT, RDF_TYPE, SCHEMA

_NODE = "map<string,array<struct<`@id`:string,`@value`:string,`@language`:string,`@type`:string>>>"


def read_back(docs, *keys):
    """Flat documents as rows again: (s, p, o, lang, datatype)."""
    values = docs.select(
        *keys, "s", F.explode(F.from_json("json", _NODE)).alias("p", "vs")
    ).select(*keys, "s", "p", F.explode("vs").alias("v"))
    return values.select(
        *keys, "s", "p", F.coalesce("v.@value", "v.@id").alias("o"), F.coalesce("v.@language", F.lit("")).alias("lang"),
        F.coalesce("v.@type", F.lit("")).alias("datatype"),
    )


def _types(docs, *keys):
    """Class names, which are plain texts in a document."""
    names = F.explode(F.from_json(F.get_json_object("json", "$.@type"), "array<string>"))
    return docs.select(*keys, "s", F.lit(RDF_TYPE).alias("p"), names.alias("o"), F.lit("").alias("lang"), F.lit("").alias("datatype"))


def document_rows(docs, *keys):
    facts = docs.withColumn("json", F.regexp_replace("json", r'"@id":"((?:[^"\\]|\\.)*)","@type":\[[^\]]*\],?', ""))
    facts = facts.withColumn("json", F.regexp_replace("json", r'^\{"@id":"(?:[^"\\]|\\.)*",', "{"))
    return read_back(facts, *keys).unionByName(_types(docs, *keys))


@query(
    "i10_jsonld_objects",
    store_sql("SELECT DISTINCT s, p, o, lang, datatype FROM graph WHERE pos IS NULL", GRAPH_SQL),
)
def i10(spark, sf):
    """The flat documents, read back as facts. A small part limit makes split subjects occur."""
    docs = D.to_jsonld(stored_graph(spark, sf).withColumn("graph_id", F.lit("")), limit=12)
    return document_rows(docs)


_MERGED_LOCAL = f"""
local AS (SELECT DISTINCT g.s, g.p, g.o, g.o_kind, g.lang FROM graph g JOIN (SELECT DISTINCT rdf_uri FROM star WHERE page_class IN ('Place', 'Organization')) r
  ON replace(r.rdf_uri, 'adr:', '{DEFAULT.kg_base}') = g.graph_id WHERE g.pos IS NULL)
"""


def _export_sql(uri: str | None = None, version: str | None = None) -> str:
    """All publishable events and other entities as facts; with ``uri`` the events part for that resource."""
    events = _INDEX.lstrip().lstrip(",")
    of = "folded WHERE publishable" if uri is None else f"webpages JOIN websites ON websites.id = website_id WHERE rdf_uri = '{uri}'"
    chosen = f"""
pub AS (SELECT DISTINCT seedurl, replace(rdf_uri, 'adr:', '{DEFAULT.kg_base}') AS graph_id FROM {of}),
ev AS MATERIALIZED (SELECT g.* FROM graph g JOIN (SELECT DISTINCT graph_id FROM pub) USING (graph_id))
"""
    offers = OFFERS_SQL.format(src="ev", dst="ev_split")
    variants = VARIANT_SQL.replace("FROM graph ", "FROM ev_split ")
    series = SERIES_SQL.replace("FROM graph g", "FROM ev_split g")
    uris = f"""uris AS (SELECT DISTINCT graph_id, o AS uri FROM series WHERE pos IS NULL AND o_kind = 'uri' AND NOT contains(o, '{DEFAULT.kg_entity}')),
kg_only AS (SELECT * FROM kg UNION SELECT * FROM local)"""
    found = describe_sql("uris", "found").replace("JOIN kg k", "JOIN kg_only k")
    others = f"""
oth AS (SELECT DISTINCT seedurl, replace(rdf_uri, 'adr:', '{DEFAULT.kg_base}') AS graph_id FROM star WHERE selected_individual AND page_class <> 'Event')"""
    body = """
SELECT DISTINCT 'events' AS dump, seedurl, s, p, o, lang, datatype FROM (SELECT graph_id, s, p, o, lang, datatype FROM series WHERE pos IS NULL
  UNION SELECT graph_id, s, p, o, lang, '' FROM found) JOIN pub USING (graph_id)
UNION ALL SELECT DISTINCT 'others', seedurl, s, p, o, lang, datatype FROM graph JOIN oth USING (graph_id) WHERE pos IS NULL"""
    if uri is not None:
        body = f"SELECT seedurl, s, p, o, lang, datatype FROM ({body.split('UNION ALL')[0]})"
    if version is not None:
        body = f"SELECT *, '{version}' AS version FROM ({body})"
    return store_sql(body, events, GRAPH_SQL, KG_SQL, _MERGED_LOCAL, chosen, offers, variants, series, uris, found, others)


@query("a9_site_export", _export_sql())
def a9(spark, sf):
    """The whole export, read back from its documents as facts per site."""
    store = driver_store(spark, sf)
    docs = cut_lineage(P.export_site(store, knowledge_graph(spark, sf)), "dumps")  # read twice
    return document_rows(docs, "dump", "seedurl")


@query("a9b_resource_export", _export_sql("adr:r20"))
def a9b(spark, sf):
    """The export of one resource, read back as facts."""
    store = driver_store(spark, sf)
    docs = cut_lineage(P.export_resource(store, knowledge_graph(spark, sf), uri="adr:r20"), "dumps")  # read twice
    return document_rows(docs, "seedurl")


def leaves(docs, *keys, depth: int = 7):
    """(keys, path, value) of JSON documents: the scalar values by their names; list positions are left out.

    A document is parsed once and opened level by level; what is no longer an object or a list stays as it is."""
    rows = docs.select(*keys, F.lit("").alias("path"), F.parse_json("json").alias("v"))
    for _ in range(depth - 1):
        rows = spread(rows, *keys)
    # what is still open here is empty or deeper than asked for
    return rows.filter(~F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).select(*keys, "path", F.col("v").cast("string").alias("value"))


def spread(rows, *keys):
    opened = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    closed = F.col("pos").isNull()
    step = F.concat("path", F.when(F.col("key").isNull(), "").otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), "key")))
    return opened.select(
        *keys, F.when(closed, F.col("path")).otherwise(step).alias("path"), F.when(closed, F.col("v")).otherwise(F.col("value")).alias("v")
    )


def _nodes(spark, sf):
    """The enriched graph, gathered for its documents; it is read once for that, so it is not written itself."""
    graph = stored_graph(spark, sf)
    nodes = D.frame_nodes(G.drop_annotations(G.enrich(graph, knowledge_graph(spark, sf))))
    discard(graph)
    return nodes


_FRAMED = f"""
fr AS (SELECT DISTINCT graph_id, s, p, o, o_kind, lang FROM graph WHERE pos IS NULL UNION SELECT graph_id, s, p, o, o_kind, lang FROM found),
main AS (SELECT graph_id FROM fr WHERE s = graph_id AND p = '{RDF_TYPE}' AND o = '{SCHEMA}Event')
"""


@query(
    "i8_framed_event_fields",
    store_sql(f"""
SELECT m.graph_id,
  (SELECT count(*) FROM fr WHERE fr.graph_id = m.graph_id AND s = m.graph_id AND p = '{SCHEMA}startDate') AS n_starts,
  (SELECT count(DISTINCT l.o) FROM fr l JOIN fr t ON t.graph_id = l.graph_id AND t.s = l.o AND t.p = '{RDF_TYPE}' AND t.o = '{SCHEMA}Place'
    WHERE l.graph_id = m.graph_id AND l.s = m.graph_id AND l.p = '{SCHEMA}location') AS n_places,
  (SELECT count(DISTINCT l.o) FROM fr l JOIN fr t ON t.graph_id = l.graph_id AND t.s = l.o AND t.p = '{RDF_TYPE}' AND t.o IN ('{SCHEMA}Person', '{SCHEMA}Organization')
    WHERE l.graph_id = m.graph_id AND l.s = m.graph_id AND l.p = '{SCHEMA}performer') AS n_performers,
  (SELECT count(DISTINCT c.o) FROM fr l JOIN fr t ON t.graph_id = l.graph_id AND t.s = l.o AND t.p = '{RDF_TYPE}' AND t.o = '{SCHEMA}Place'
    JOIN fr a ON a.graph_id = l.graph_id AND a.s = l.o AND a.p = '{SCHEMA}address' JOIN fr c ON c.graph_id = a.graph_id AND c.s = a.o AND c.p = '{SCHEMA}addressCountry'
    WHERE l.graph_id = m.graph_id AND l.s = m.graph_id AND l.p = '{SCHEMA}location') AS n_countries
FROM main m""", GRAPH_SQL, KG_SQL,
              "uris AS (SELECT DISTINCT graph_id, o AS uri FROM graph WHERE pos IS NULL AND o_kind = 'uri')",
              describe_sql("uris", "found"), _FRAMED),
)
def i8_fields(spark, sf):
    """Counts read from the nested event documents."""
    docs = D.frame_texts(D.frame_entries(None, nodes=_nodes(spark, sf))).filter("cls = 'Event'")

    def items(path):
        found = F.get_json_object("json", path)
        return F.when(found.isNull(), F.array().cast("array<string>")).otherwise(
            F.coalesce(F.from_json(F.when(F.startswith(found, F.lit("[")), found), "array<string>"), F.array(found))
        )

    countries = F.array_distinct(
        F.filter(
            F.transform(items("$.location"), lambda x: F.get_json_object(x, "$.address.addressCountry")),
            lambda x: x.isNotNull(),
        )
    )
    return docs.select(
        "graph_id",
        F.size(items("$.startDate")).cast("bigint").alias("n_starts"),
        F.size(items("$.location")).cast("bigint").alias("n_places"),
        F.size(items("$.performer")).cast("bigint").alias("n_performers"),
        F.size(countries).cast("bigint").alias("n_countries"),
    )


def _documents_sql() -> str:
    """The entries of every framed document as (graph_id, path, value)."""
    local = f"replace(p, '{SCHEMA}', '')"
    ids = ", ".join(f"'{p}'" for p in D.ID_PROPS)
    top = ", ".join(f"'{p}'" for p in D.EVENT_PROPS)
    specs = ", ".join(f"('{c.prop}', {list(c.types)}, {list(c.props)}, {c.only_listed}, {c.address})" for c in D.EVENT_CHILDREN)
    expected = ", ".join(f"('{p}')" for p in (*D.EVENT_PROPS, *(c.prop for c in D.EVENT_CHILDREN)))
    return f"""
facts AS (SELECT DISTINCT graph_id, s, p, o, o_kind, lang, datatype FROM graph WHERE pos IS NULL UNION SELECT graph_id, s, p, o, o_kind, lang, '' FROM found),
short AS (SELECT graph_id, s, k, k || tail AS path, value, o, o_kind FROM (
  SELECT *, unnest(CASE WHEN k = '@type' THEN [{{'tail': '', 'value': replace(o, '{SCHEMA}', '')}}] WHEN o_kind <> 'literal' AND k NOT IN ({ids}) THEN [{{'tail': '.@id', 'value': o}}]
    WHEN o_kind = 'literal' AND k NOT IN ({ids}) AND (lang <> '' OR datatype <> '') THEN list_filter([{{'tail': '.@language', 'value': lang}}, {{'tail': '.@type', 'value': datatype}}, {{'tail': '.@value', 'value': o}}], lambda x: x.value <> '' OR x.tail = '.@value')
    ELSE [{{'tail': '', 'value': o}}] END, recursive := true) FROM (SELECT *, CASE WHEN p = '{RDF_TYPE}' THEN '@type' ELSE {local} END AS k FROM facts))),
cls AS (SELECT DISTINCT graph_id, value AS cls FROM short WHERE s = graph_id AND k = '@type'),
spec(prop, types, props, listed, address) AS (VALUES {specs}),
child AS (SELECT DISTINCT l.graph_id, l.o AS c, spec.* FROM short l JOIN cls USING (graph_id) JOIN spec ON spec.prop = l.k
  JOIN short t ON t.graph_id = l.graph_id AND t.s = l.o AND t.k = '@type' AND list_contains(spec.types, t.value) WHERE l.s = l.graph_id AND cls = 'Event' AND l.o_kind <> 'literal'),
addr AS (SELECT DISTINCT a.graph_id, a.s, a.o AS node FROM short a JOIN short t ON t.graph_id = a.graph_id AND t.s = a.o AND t.k = '@type' AND t.value = 'PostalAddress' WHERE a.k = 'address'),
parts AS (SELECT a.graph_id, a.s, 'address.' || f.path AS path, f.value FROM addr a JOIN short f ON f.graph_id = a.graph_id AND f.s = a.node UNION ALL SELECT graph_id, s, 'address.@id', node FROM addr),
others AS (SELECT c.graph_id, s, count(*) OVER (PARTITION BY c.graph_id, cls) AS n, cls FROM cls c JOIN (SELECT DISTINCT graph_id, s FROM short) USING (graph_id) WHERE cls NOT IN ('Event', 'Place')),
doc AS (
  SELECT graph_id, cls, path, value FROM short JOIN cls USING (graph_id) WHERE s = graph_id AND ((cls = 'Event' AND k IN ('@type', {top})) OR (cls = 'Place' AND k <> 'address'))
  UNION ALL SELECT graph_id, 'Event', e, NULL FROM cls, (VALUES {expected}) x(e) WHERE cls = 'Event' AND NOT EXISTS (SELECT 1 FROM short f WHERE f.graph_id = cls.graph_id AND f.s = f.graph_id AND f.k = e AND e IN ({top}))
    AND NOT EXISTS (SELECT 1 FROM child c WHERE c.graph_id = cls.graph_id AND c.prop = e)
  UNION ALL SELECT graph_id, 'Event', prop || '.@id', c FROM child
  UNION ALL SELECT c.graph_id, 'Event', prop || '.' || f.path, f.value FROM child c JOIN short f ON f.graph_id = c.graph_id AND f.s = c.c WHERE (NOT listed OR f.k = '@type' OR list_contains(props, f.k)) AND NOT (address AND f.k = 'address')
  UNION ALL SELECT c.graph_id, 'Event', prop || '.' || e, NULL FROM (SELECT *, unnest(props) AS e FROM child) c WHERE NOT EXISTS (SELECT 1 FROM short f WHERE f.graph_id = c.graph_id AND f.s = c.c AND f.k = e)
  UNION ALL SELECT c.graph_id, 'Event', prop || '.' || path, value FROM child c JOIN parts x ON x.graph_id = c.graph_id AND x.s = c.c WHERE c.address
  UNION ALL SELECT graph_id, 'Place', path, value FROM parts JOIN cls USING (graph_id) WHERE s = graph_id AND cls = 'Place'
  UNION ALL SELECT graph_id, cls, '@context.@vocab', 'http://schema.org/' FROM cls
  UNION ALL SELECT o.graph_id, cls, CASE WHEN n > 1 THEN '@graph.' ELSE '' END || f.path, f.value FROM others o JOIN short f ON f.graph_id = o.graph_id AND f.s = o.s
    WHERE NOT (n > 1 AND f.k = 'offers' AND (SELECT count(DISTINCT (z.p, z.o, z.lang, z.datatype)) FROM facts z WHERE z.graph_id = o.graph_id AND z.s = o.s AND {local.replace("p,", "z.p,")} = 'offers') = 1)
  UNION ALL SELECT graph_id, cls, '@graph.@id', s FROM others WHERE n > 1 AND NOT contains(s, '{DEFAULT.kg_base}') AND NOT contains(s, '{DEFAULT.mint_base}'))
"""


@query(
    "i8_framed_documents",
    store_sql("SELECT graph_id, cls, path, value FROM doc", GRAPH_SQL, KG_SQL,
              "uris AS (SELECT DISTINCT graph_id, o AS uri FROM graph WHERE pos IS NULL AND o_kind = 'uri')",
              describe_sql("uris", "found"), _documents_sql()),
)
def i8(spark, sf):
    """Every framed document, read back as its entries."""
    nodes = _nodes(spark, sf)
    docs = cut_lineage(D.frame_texts(D.frame_entries(None, nodes=nodes)), "framed")
    discard(nodes)
    return leaves(docs, "graph_id", "cls")


@query("i9_page_markup")
def i9(spark, sf):
    """Markup of every page, without ids of the main object."""
    store = driver_store(spark, sf)
    return P.page_markup(store, knowledge_graph(spark, sf))


@query("a5_a6_exports", _export_sql(version=AS_OF[:10]))
def a5(spark, sf):
    """Write both dumps of the whole export, list what is there, and read the listed files back as facts."""
    store = driver_store(spark, sf)
    root = f"{durable_dir(spark)}/exports-{uuid.uuid4().hex}"
    docs = cut_lineage(P.export_site(store, knowledge_graph(spark, sf)), "dumps")
    facts = []
    for dump in ("events", "others"):
        folder = X.write_export(docs.filter(F.col("dump") == dump), root, AS_OF, group=dump)
        lines = spark.read.text(folder).select(
            F.col("artifact").cast("string").alias("seedurl"), F.col("version").cast("string").alias("version"), F.col("value").alias("json")
        )
        listed = X.list_exports(spark, root, group=dump).withColumnRenamed("artifact", "seedurl")
        named = lines.join(listed, ["seedurl", "version"]).withColumn("s", F.get_json_object("json", "$.@id"))
        facts.append(document_rows(named.withColumn("dump", F.lit(dump)), "dump", "seedurl", "version"))
    return facts[0].unionByName(facts[1])


@query(
    "a8_training_set",
    store_sql(f""",
{_nested_sql("star", _BUILD_KEY)},
fld AS (SELECT n.rdf_uri, n.key, n.value, s.algorithm_value FROM nested n JOIN star s USING (statement_id) WHERE n.role = 'selected'),
f AS (SELECT website_id, rdf_uri, label, arg_max(status IN ('ok', 'updated') AND (label <> 'Dates' OR length(cache) > 3), statement_id) AS fine
  FROM star WHERE selected AND rdfs_class_name = 'Event' AND label IN ('Location', 'Dates', 'Title') GROUP BY website_id, rdf_uri, label),
m AS (SELECT website_id, rdf_uri FROM f GROUP BY website_id, rdf_uri HAVING count(*) = 3 AND bool_and(fine))
SELECT w.id AS webpage_id, w.url, length(p.html) AS n_html, t.value AS title, t.algorithm_value AS title_rule, d.value AS dates, l.value AS location, b.value AS performed_by
FROM webpages w JOIN m USING (website_id, rdf_uri) JOIN pages p ON p.page_id = w.id
LEFT JOIN fld t ON t.rdf_uri = w.rdf_uri AND t.key = 'title_en' LEFT JOIN fld d ON d.rdf_uri = w.rdf_uri AND d.key = 'dates'
LEFT JOIN fld l ON l.rdf_uri = w.rdf_uri AND l.key = 'location' LEFT JOIN fld b ON b.rdf_uri = w.rdf_uri AND b.key = 'performed_by'
WHERE w.rdfs_class_id = 1 AND w.language = 'en'"""),
)
def a8(spark, sf):
    """Captures are the given pages, taken at the address of the store's page of that number."""
    store = driver_store(spark, sf)
    captures = (
        table(spark, sf, "pages")
        .join(store.webpages.select(F.col("id").alias("page_id"), F.col("url").alias("at")), "page_id")
        .select("page_id", F.col("at").alias("url"), "html")
    )
    rows = X.extract_training_set(store, captures, "en")
    return rows.select(
        "webpage_id", "url", F.length("html").cast("bigint").alias("n_html"), F.col("title.value").alias("title"),
        F.col("title.algorithm").alias("title_rule"), F.col("dates.value").alias("dates"),
        F.col("location.value").alias("location"), F.col("performed_by.value").alias("performed_by"),
    )
