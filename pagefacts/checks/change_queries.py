"""Refresh, review, edits, activation and housekeeping over the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefacts.checks.change_sql import OUT, callbacks
from pagefacts.checks.registry import AS_OF, MIDDLE, query
from pagefacts.functions import dates as D
from pagefacts.operators import changes as J
from pagefacts.operators import star as S
from pagefacts.session import cut_lineage
from pagefacts.sources import schemas
from pagefacts.sources.driver_tables import driver_store, literal_rows, store_sql, stored, table
from pagefacts.vocab import DEFAULT

_COLS = [c.strip() for c in OUT.split(",")]
_ID_COLS = ["id", *_COLS]

CLOSURE_SQL = """
closure AS (
  WITH RECURSIVE reach AS (
    SELECT name AS root_class, name AS class_name FROM rdfs_classes
    UNION
    SELECT r.root_class, p.expected_class FROM reach r JOIN rdfs_classes c ON c.name = r.class_name
      JOIN properties p ON p.rdfs_class_id = c.id AND p.value_datatype = 'bnode' AND p.expected_class <> r.class_name)
  SELECT DISTINCT r.root_class, p.id AS property_id FROM reach r JOIN rdfs_classes c ON c.name = r.class_name JOIN properties p ON p.rdfs_class_id = c.id)
"""

SCAFFOLD_SQL = """
missing_rows AS (
  SELECT DISTINCT s.id AS source_id, w.id AS webpage_id, s.selected AS selected_individual, starts_with(s.algorithm_value, 'manual=') AS manual
  FROM webpages w JOIN rdfs_classes c ON c.id = w.rdfs_class_id JOIN websites si ON si.id = w.website_id
  JOIN closure x ON x.root_class = c.name JOIN sources s ON s.property_id = x.property_id AND s.website_id = w.website_id
    AND (s.language = w.language OR (s.language = '' AND w.language = si.default_language))
  WHERE NOT EXISTS (SELECT 1 FROM statements st WHERE st.source_id = s.id AND st.webpage_id = w.id))
"""


@query(
    "c18_property_closure",
    store_sql("SELECT root_class, property_id, count(s.id) AS n_rules FROM closure LEFT JOIN sources s USING (property_id) GROUP BY ALL", CLOSURE_SQL),
)
def c18(spark, sf):
    """The closure with the number of rules that the sites have for each of its properties."""
    store = driver_store(spark, sf)
    rules = store.sources.select("property_id", F.col("id").alias("source_id"))
    return J.property_closure(store).join(rules, "property_id", "left").groupBy("root_class", "property_id").agg(
        F.count("source_id").alias("n_rules")
    )


@query("c13_scaffold", store_sql(f"SELECT source_id, webpage_id, selected_individual, manual, 'initial' AS status, '{DEFAULT.origin_create}' AS status_origin FROM missing_rows", CLOSURE_SQL, SCAFFOLD_SQL))
def c13(spark, sf):
    return J.scaffold(driver_store(spark, sf, False), AS_OF).select(
        "source_id", "webpage_id", "selected_individual", "manual", "status", "status_origin"
    )


_NEW_LINK = '["Hall","Place",["Hall","http://kg.example.org/resource/S1"]]'


def captured(spark, sf, store):
    """A capture run made from the stored values: unchanged, changed, blank, failed, broken."""
    rows = S.star(store).select("statement_id", "source_id", "webpage_id", "cache", "value_datatype")
    k = F.col("statement_id") % 7
    uri, date = F.col("value_datatype") == "xsd:anyURI", F.col("value_datatype") == "xsd:dateTime"
    value = (
        F.when(k == 1, "")
        .when(k == 4, F.when(uri, _NEW_LINK).when(date, "2001-09-09").otherwise(F.concat("cache", F.lit(" new"))))
        .when(k == 5, F.when(uri, '["x","Place"]').when(date, "Bad input").otherwise("see abort_update"))
        .when(k == 6, F.when(uri, F.replace("cache", F.lit("Supplier#"), F.lit("Venue "))).otherwise(F.col("cache")))
        .otherwise(F.col("cache"))
    )
    known = rows.filter(k != 0).select(
        "source_id", "webpage_id", value.alias("value"), (k == 1).alias("is_blank"), F.when(k == 2, "timeout").alias("error")
    )
    fresh = J.scaffold(store, AS_OF).select(
        "source_id", "webpage_id", F.lit("fresh text").alias("value"), F.lit(False).alias("is_blank"),
        F.lit(None).cast("string").alias("error"),
    )
    return known.unionByName(fresh)


_REFRESH_SQL = f"""
cap AS (
  SELECT *, statement_id % 7 AS k, value_datatype = 'xsd:anyURI' AS is_uri, value_datatype = 'xsd:dateTime' AS is_date FROM star),
seen AS (
  SELECT c.statement_id, auto_review, false AS is_new, k, CASE k WHEN 1 THEN '' WHEN 4 THEN CASE WHEN is_uri THEN '{_NEW_LINK}' WHEN is_date THEN '2001-09-09' ELSE cache || ' new' END
    WHEN 5 THEN CASE WHEN is_uri THEN '["x","Place"]' WHEN is_date THEN 'Bad input' ELSE 'see abort_update' END
    WHEN 6 THEN CASE WHEN is_uri THEN replace(cache, 'Supplier#', 'Venue ') ELSE cache END ELSE cache END AS value
  FROM cap c JOIN sources so ON so.id = c.source_id),
before AS (
  SELECT s.cache, s.status, s.status_origin, s.cache_refreshed, s.cache_changed, s.source_id, s.webpage_id, s.selected_individual, s.manual,
    s.label, s.value_datatype, n.is_new, n.value, n.k, n.auto_review FROM star s JOIN seen n USING (statement_id)
  UNION ALL
  SELECT NULL, 'initial', '{DEFAULT.origin_create}', NULL, NULL, m.source_id, m.webpage_id, m.selected_individual, m.manual, p.label, p.value_datatype, true, 'fresh text', 3, so.auto_review
  FROM missing_rows m JOIN sources so ON so.id = m.source_id JOIN properties p ON p.id = so.property_id),
decided AS (
  SELECT *, k <> 0 AND NOT (manual AND status IN ('ok', 'updated')) AS open,
    k NOT IN (0, 2) AND NOT (manual AND status IN ('ok', 'updated')) AND (is_new OR k <> 1) AND CASE
      WHEN contains(value, 'abort_update') THEN status IN ('initial', 'problem', 'missing') OR coalesce(contains(cache, 'abort_update'), false)
      WHEN trim(value) = '' THEN is_new OR coalesce(contains(cache, 'abort_update'), false) ELSE true END AS saved FROM before),
kept AS (
  SELECT * REPLACE (CASE WHEN NOT saved THEN cache WHEN value_datatype = 'xsd:anyURI' AND contains(cache, '"Manually') THEN
      '[' || (CASE WHEN value LIKE '[[%' THEN array_to_string(list_transform(json_extract(value, '$[*]'), lambda g: CAST(g AS VARCHAR)), ',') ELSE value END) || ',' ||
      array_to_string(list_transform(list_filter(json_extract(cache, '$[*]'), lambda g: starts_with(json_extract_string(g, '$[0]'), 'Manually')), lambda g: CAST(g AS VARCHAR)), ',') || ']'
    ELSE value END AS cache,
    CASE WHEN saved THEN TIMESTAMP '{AS_OF}' ELSE cache_refreshed END AS cache_refreshed), cache AS old_cache FROM decided)
"""


@query(
    "j1_refresh",
    store_sql(f"SELECT {OUT} FROM reviewed WHERE NOT is_new OR first_save OR saved", CLOSURE_SQL, SCAFFOLD_SQL, _REFRESH_SQL,
              callbacks("kept", "refreshed", AS_OF),
              """
auto_saves AS (SELECT * EXCLUDE (changed) REPLACE (cache AS old_cache, auto_review AND status = 'initial' AND open AS saved,
  CASE WHEN auto_review AND status = 'initial' AND open THEN 'updated' ELSE status END AS status), saved AS first_save FROM refreshed)""",
              callbacks("auto_saves", "reviewed", AS_OF)),
)
def j1(spark, sf):
    store = stored(driver_store(spark, sf))
    run = cut_lineage(captured(spark, sf, store), "captured")  # read by the scaffold and by the refresh
    return J.refresh(store, run, AS_OF).select(_COLS)


_EDIT_SQL = """
edited AS (
  SELECT statement_id AS id, CASE WHEN statement_id % 5 = 0 THEN coalesce(cache, '') || '!' ELSE cache END AS cache, cache AS old_cache,
    CASE WHEN statement_id % 5 = 1 THEN 'ok' ELSE status END AS status, status_origin, cache_refreshed, cache_changed, source_id, webpage_id, selected_individual,
    CASE WHEN statement_id % 5 = 2 THEN false ELSE manual END AS manual, statement_id % 5 = 2 AND manual AS released,
    statement_id % 5 < 3 AS saved, label, value_datatype FROM star)
"""


@query(
    "j15_direct_edits",
    store_sql(f"SELECT id, {OUT.replace('manual', 'manual OR id % 5 = 0 AS manual')} FROM after", _EDIT_SQL, callbacks("edited", "after", AS_OF, "released")),
)
def j15(spark, sf):
    store = driver_store(spark, sf)
    k = F.col("id") % 5
    edits = store.statements.filter(k < 3).select(
        F.col("id").alias("statement_id"),
        F.when(k == 0, F.concat(F.coalesce("cache", F.lit("")), F.lit("!"))).alias("cache"),
        F.when(k == 1, "ok").alias("status"),
        F.when(k == 2, False).alias("manual"),
    )
    return J.apply_edits(store, edits, AS_OF).select(_ID_COLS)


_LINK_EDITS = """
link_edit AS (SELECT statement_id AS id, cache AS old_cache, cache, 'ok' AS status, status_origin, cache_refreshed, cache_changed, source_id, webpage_id, selected_individual, manual,
  label, value_datatype, true AS saved, json_extract_string(cache, '$[0]') AS t FROM star WHERE label = 'Location' AND statement_id % 3 <> 0),
gs AS (SELECT *, CASE WHEN cache LIKE '[[%' THEN list_transform(json_extract(cache, '$[*]'), lambda g: CAST(g AS VARCHAR)) ELSE [cache] END AS g,
  '["Annex","http://kg.example.org/resource/Annex"]' AS hit FROM link_edit),
link_done AS (SELECT * REPLACE (CASE
  WHEN id % 3 = 1 AND contains(cache, '"Manually added"') THEN '[' || array_to_string(list_transform(g, lambda x: CASE WHEN x LIKE '["Manually added%' THEN x[:-2] || ',' || hit || ']' ELSE x END), ',') || ']'
  WHEN id % 3 = 1 THEN '[' || array_to_string(list_append(g, '["Manually added","Place",' || hit || ']'), ',') || ']'
  WHEN contains(cache, '"Manually deleted"') THEN '[' || array_to_string(list_transform(g, lambda x: CASE WHEN x LIKE '["Manually deleted%' THEN x[:-2] || ',' || hit || ']' ELSE x END), ',') || ']'
  ELSE '[' || array_to_string(list_append(g, '["Manually deleted","Place",' || hit || ']'), ',') || ']' END AS cache) FROM gs)
"""


@query(
    "j13_j14_link_edits",
    store_sql(f"SELECT id, {OUT.replace('manual', 'true AS manual')} FROM after WHERE true", _LINK_EDITS, callbacks("link_done", "after", AS_OF)),
)
def j13(spark, sf):
    store = driver_store(spark, sf)
    rows = S.star(store).filter("label = 'Location' and statement_id % 3 <> 0")
    edits = rows.select(
        "statement_id",
        F.when(F.col("statement_id") % 3 == 1, "add").otherwise("remove").alias("action"),
        F.lit("Annex").alias("label"),
        F.lit("Place").alias("class"),
        F.lit("http://kg.example.org/resource/Annex").alias("uri"),
    )
    changed = J.apply_link_edits(store, edits, AS_OF)
    ids = edits.select(F.col("statement_id").alias("id"))
    return changed.join(ids, "id", "left_semi").select(_ID_COLS)


@query(
    "j12_review_all",
    store_sql(f"SELECT id, {OUT} FROM after", f"""
reviewed AS (SELECT statement_id AS id, cache, cache AS old_cache, label, value_datatype, cache_refreshed, cache_changed, source_id, webpage_id, selected_individual, manual,
  h AS saved, CASE WHEN h THEN 'ok' ELSE status END AS status, CASE WHEN h THEN 'reviewer' ELSE status_origin END AS status_origin
  FROM (SELECT *, selected_individual AND status IN ('ok', 'initial', 'updated') AND property_id IN (3, 4, 7) AS h FROM star))""",
              callbacks("reviewed", "after", AS_OF)),
)
def j12(spark, sf):
    scope = F.col("selected_individual") & F.col("property_id").isin(3, 4, 7)
    return J.review_all(driver_store(spark, sf), scope, "reviewer", AS_OF).select(_ID_COLS)


def _overridden(spark, sf, with_cache=False):
    """The store with some hand-picked statements of rules that are not selected."""
    store = driver_store(spark, sf, with_cache)
    picked = F.col("selected_individual") | (F.col("id") % 11 == 0)
    return store.with_(statements=store.statements.withColumn("selected_individual", picked))


_ACTIVATE = """
st2 AS (SELECT *, selected_individual OR statement_id % 11 = 0 AS si FROM star),
pick AS (SELECT so.website_id, so.property_id, so.language, max(so.id) AS chosen FROM st2 JOIN sources so ON so.id = st2.source_id
  WHERE st2.status = 'updated' AND st2.manual GROUP BY ALL),
tag AS (SELECT so.*, p.chosen FROM sources so LEFT JOIN pick p USING (website_id, property_id, language))
"""


@query("j10_activate_sources", store_sql("SELECT id, CASE WHEN chosen IS NULL THEN selected ELSE id = chosen END AS selected FROM tag", _ACTIVATE))
def j10_sources(spark, sf):
    store = _overridden(spark, sf)
    chosen = store.statements.filter("status = 'updated' and manual").select(F.col("id").alias("statement_id"))
    return J.activate_sources(store, chosen, AS_OF)[0].select("id", "selected")


@query(
    "j10_activated_statements",
    store_sql(f"SELECT id, {OUT} FROM after", _ACTIVATE, """
passed AS (SELECT *, chosen IS NOT NULL AND source_id <> chosen AND one AS pick FROM (
  SELECT s.*, t.website_id AS t_website, t.property_id AS t_property, t.language AS t_language, t.chosen,
    CASE WHEN t.chosen IS NULL THEN s.si WHEN s.source_id = t.chosen THEN true WHEN t.selected THEN false ELSE s.si END AS one
  FROM st2 s JOIN tag t ON t.id = s.source_id)),
act AS (SELECT q.statement_id AS id, cache, cache AS old_cache, label, value_datatype, status, status_origin, cache_refreshed, cache_changed, source_id, q.webpage_id, manual,
  CASE WHEN o.n IS NULL THEN q.one ELSE q.pick AND o.n = 1 END AS selected_individual, o.n IS NOT NULL AND NOT (q.pick AND o.n = 1) AS saved FROM passed q
LEFT JOIN (SELECT webpage_id, t_website, t_property, t_language, count(*) AS n FROM passed WHERE pick GROUP BY ALL) o
  ON o.webpage_id = q.webpage_id AND o.t_website = q.t_website AND o.t_property = q.t_property AND o.t_language = q.t_language)""", callbacks("act", "after", AS_OF)),
)
def j10_statements(spark, sf):
    store = stored(_overridden(spark, sf, True))  # read by the picks, their rules and what becomes of them
    chosen = store.statements.filter("status = 'updated' and manual").select(F.col("id").alias("statement_id"))
    return J.activate_sources(store, chosen, AS_OF)[1].select(_ID_COLS)


_INDIVIDUAL = """
c AS (SELECT webpage_id, property_id, max(statement_id) AS chosen FROM star WHERE status = 'problem' GROUP BY ALL),
ind AS (SELECT statement_id AS id, cache, cache AS old_cache, label, value_datatype, cache_refreshed, cache_changed, source_id, webpage_id, status_origin, manual, chosen IS NOT NULL AS saved,
  CASE WHEN chosen IS NULL THEN selected_individual ELSE {sel} END AS selected_individual, {status} AS status
  FROM star LEFT JOIN c USING (webpage_id, property_id))
"""


@query(
    "j11_activate_individual",
    store_sql(f"SELECT id, {OUT} FROM after",
              _INDIVIDUAL.format(sel="statement_id = chosen", status="CASE WHEN chosen IS NOT NULL AND statement_id <> chosen AND selected THEN 'ok' ELSE status END"),
              callbacks("ind", "after", AS_OF)),
)
def j11(spark, sf):
    store = driver_store(spark, sf)
    chosen = store.statements.filter("status = 'problem'").select(F.col("id").alias("statement_id"))
    return J.activate_individuals(store, chosen, AS_OF).select(_ID_COLS)


@query(
    "j11_deactivate_individual",
    store_sql(f"SELECT id, {OUT} FROM after", _INDIVIDUAL.format(sel="selected", status="status"), callbacks("ind", "after", AS_OF)),
)
def j11_off(spark, sf):
    store = driver_store(spark, sf)
    chosen = store.statements.filter("status = 'problem'").select(F.col("id").alias("statement_id"))
    return J.activate_individuals(store, chosen, AS_OF, active=False).select(_ID_COLS)


@query(
    "j16_archive_resources",
    store_sql(f"SELECT id, rdf_uri, CASE WHEN rdf_uri IN (SELECT rdf_uri FROM star WHERE status = 'problem') THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY ELSE archive_date END AS archive_date FROM webpages"),
)
def j16(spark, sf):
    store = driver_store(spark, sf, False)
    uris = S.star(store).filter("status = 'problem'").select("rdf_uri")
    return J.archive_resources(store, uris, AS_OF).select("id", "rdf_uri", "archive_date")


@query(
    "j16_delete_sites",
    store_sql("""SELECT 'page' AS kind, id FROM webpages WHERE website_id % 3 <> 0 UNION ALL SELECT 'rule', id FROM sources WHERE website_id % 3 <> 0
UNION ALL SELECT 'statement', statement_id FROM star WHERE website_id % 3 <> 0 UNION ALL SELECT 'site', id FROM websites WHERE id % 3 <> 0"""),
)
def j16_sites(spark, sf):
    store = driver_store(spark, sf, False)
    left = J.delete_sites(store, store.websites.filter("id % 3 = 0"))
    kinds = {"page": left.webpages, "rule": left.sources, "statement": left.statements, "site": left.websites}
    out = None
    for kind, df in kinds.items():
        part = df.select(F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "j16_delete_event_pages",
    store_sql("SELECT statement_id AS id FROM star WHERE NOT (website_id % 2 = 0 AND page_class = 'Event')"),
)
def j16_events(spark, sf):
    store = driver_store(spark, sf, False)
    return J.delete_sites(store, store.websites.filter("id % 2 = 0"), events_only=True).statements.select("id")


@query(
    "j17_create_resources",
    store_sql("""
SELECT 'mint:p' || p_partkey AS rdf_uri, 'Nation site ' || (p_partkey % 25) AS site_name, CAST(p_partkey % 25 AS BIGINT) AS website_id, p_name AS cache,
  (p_partkey % 25) * 100 + 10 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS source_id, 'updated' AS status
FROM part WHERE (p_partkey % 25) % 5 = 3 AND trim(p_name) <> ''"""),
)
def j17(spark, sf):
    """Places named after parts; sites that keep no rule for place names reject theirs."""
    store = driver_store(spark, sf, False)
    part = table(spark, sf, "part")
    site = F.col("p_partkey") % 25
    uri = F.concat(F.lit("mint:p"), F.col("p_partkey").cast("string"))
    resources = part.select(
        uri.alias("rdf_uri"), F.lit("Place").alias("class"), F.concat(F.lit("nation_"), site.cast("string")).alias("seedurl")
    )
    named = part.select(
        uri.alias("rdf_uri"),
        F.lit("name").alias("name"),
        F.col("p_name").alias("value"),
        F.when(F.col("p_size") % 2 == 0, "en").otherwise("fr").alias("language"),
        F.lit(None).cast("string").alias("rdfs_class_name"),
    )
    pages, statements, _ = J.create_resources(store, resources, named, AS_OF)
    return statements.join(pages.select(F.col("id").alias("webpage_id"), "rdf_uri", "website_id"), "webpage_id").select(
        "rdf_uri",
        F.concat(F.lit("Nation site "), F.col("website_id").cast("string")).alias("site_name"),
        "website_id", "cache", "source_id", "status",
    )


def _list_store(spark, sf):
    """A store whose resource lists are runs of four orders; half of the pages are known."""
    store = driver_store(spark, sf, False)
    run = F.floor(F.col("o_orderkey") / 4)
    grouped = (
        table(spark, sf, "orders")
        .groupBy(run.alias("run"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), "o_custkey"))).alias("xs"))
    )
    urls = F.to_json(F.transform("xs", lambda x: F.concat(F.lit("http://new.example/"), x["k"].cast("string"))))
    uris = F.to_json(
        F.transform("xs", lambda x: F.when(x["o_custkey"] % 5 == 0, "").otherwise(F.concat(F.lit("adr:n"), x["k"].cast("string"))))
    )
    texts = F.array(
        F.struct(F.lit(901).alias("source_id"), urls.alias("cache")),
        F.struct(F.lit(902).alias("source_id"), uris.alias("cache")),
        F.struct(F.lit(903).alias("source_id"), F.when(F.col("run") % 2 == 0, "Event").otherwise("Place").alias("cache")),
    )
    rows = grouped.select("run", F.explode(texts).alias("t"))
    base = store.statements.limit(0)
    statements = rows.select(
        (F.col("run") * 10 + F.col("t.source_id") % 10).alias("id"), "t.cache", F.lit("ok").alias("status"),
        F.lit("review").alias("status_origin"), F.lit(None).cast("timestamp_ntz").alias("cache_refreshed"),
        F.lit(None).cast("timestamp_ntz").alias("cache_changed"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.col("t.source_id").cast("bigint").alias("source_id"), (F.col("run") * 4).cast("bigint").alias("webpage_id"),
        F.lit(True).alias("selected_individual"), F.lit(False).alias("manual"),
    )
    labels = [(901, "Webpage URL List"), (902, "URI List"), (903, "RDF Class")]
    props = literal_rows(spark, [(i, n, "", "", 1, "") for i, n in labels], schemas.PROPERTIES)
    rule = literal_rows(
        spark, [(i, "", True, None, "", False, i, 0, n, False) for i, n in labels], schemas.SOURCES
    )
    known = store.webpages.withColumn(
        "url",
        F.when(F.col("id") % 6 == 0, F.concat(F.lit("http://new.example/"), F.col("id").cast("string"))).otherwise(F.col("url")),
    )
    return store.with_(
        statements=base.unionByName(statements),
        properties=store.properties.unionByName(props),
        sources=store.sources.unionByName(rule),
        webpages=known,
    )


@query(
    "c14_add_webpages",
    """WITH o AS (SELECT *, o_orderkey // 4 AS run, ((o_orderkey // 4) * 4 // 2) % 25 AS site, (o_orderkey // 2) % 25 AS own FROM orders)
SELECT 'http://new.example/' || o_orderkey AS url, CASE WHEN (run * 4) % 2 = 0 THEN 'en' ELSE 'fr' END AS language, 'adr:n' || o_orderkey AS rdf_uri,
  CASE WHEN run % 2 = 0 THEN 1 ELSE 2 END AS rdfs_class_id, site AS website_id
FROM o WHERE o_custkey % 5 <> 0 AND NOT (o_orderkey % 6 = 0 AND own = site)""",
)
def c14(spark, sf):
    return J.add_webpages(_list_store(spark, sf), AS_OF).select("url", "language", "rdf_uri", "rdfs_class_id", "website_id")


@query(
    "c15_refresh_worklist",
    store_sql(f"""SELECT w.id AS webpage_id, url, seedurl FROM webpages w JOIN websites s ON s.id = w.website_id
WHERE w.rdfs_class_id = 1 AND archive_date BETWEEN TIMESTAMP '{MIDDLE}' AND TIMESTAMP '{MIDDLE}' + INTERVAL 5 YEAR"""),
)
def c15(spark, sf):
    return J.refresh_worklist(driver_store(spark, sf, False), "upcoming", MIDDLE)


@query(
    "d11_archive_dates",
    store_sql("""
, d AS (SELECT rdf_uri, statement_id, cache_refreshed, list_max(list_filter(CASE WHEN cache LIKE '[%' THEN from_json(cache, '["VARCHAR"]') ELSE [cache] END,
    lambda v: regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}(T.*)?$'))) AS last
  FROM star WHERE selected_individual AND (contains(predicate, 'startDate') OR contains(predicate, 'endDate')) AND NOT contains(cache, 'error') AND NOT contains(cache, 'bad')),
u AS (SELECT rdf_uri, arg_max(last, (cache_refreshed, statement_id)) AS last FROM d WHERE last IS NOT NULL GROUP BY rdf_uri)
SELECT w.id AS webpage_id, w.rdf_uri, CAST(substr(last, 1, 10) || ' ' || substr(last, 12, 8) AS TIMESTAMP) + INTERVAL 4 HOUR - INTERVAL 24 HOUR AS archive_date
FROM u JOIN webpages w USING (rdf_uri)"""),
)
def d11(spark, sf):
    return J.archive_dates(driver_store(spark, sf))


@query(
    "d12_guard_archive_date",
    """SELECT o_orderkey AS id, CASE WHEN o_orderdate < TIMESTAMP '1996-06-01' OR o_orderdate > TIMESTAMP '2016-06-01'
  THEN TIMESTAMP '2007-06-01' ELSE o_orderdate END AS archive_date FROM orders""",
)
def d12(spark, sf):
    return driver_store(spark, sf, False).webpages.select(
        "id", D.guard_archive_date("archive_date", "2006-06-01 00:00:00").alias("archive_date")
    )


_OLD = f"""
big AS (SELECT website_id FROM webpages WHERE rdfs_class_id = 1 GROUP BY website_id HAVING count(*) > 100),
old AS (SELECT id FROM webpages WHERE rdfs_class_id = 1 AND website_id IN (SELECT website_id FROM big) AND archive_date < TIMESTAMP '{MIDDLE}' - INTERVAL 1 MONTH)
"""


@query(
    "d13_tidy",
    store_sql("""SELECT 'page' AS kind, id FROM webpages WHERE id NOT IN (SELECT id FROM old)
UNION ALL SELECT 'statement', id FROM statements WHERE webpage_id NOT IN (SELECT id FROM old)""", _OLD),
)
def d13(spark, sf):
    left = J.tidy(driver_store(spark, sf, False), MIDDLE)
    return left.webpages.select(F.lit("page").alias("kind"), "id").unionByName(
        left.statements.select(F.lit("statement").alias("kind"), "id")
    )


@query(
    "d13_tidy_messages",
    "SELECT props AS message, 'user ' || user_id AS artifact, ts AS created_at FROM events WHERE ts >= TIMESTAMP '2024-01-15'",
)
def d13_messages(spark, sf):
    return J.tidy(driver_store(spark, sf, False), "2024-02-15 09:00:00").messages


@query(
    "d16_due_sites",
    store_sql("""SELECT id, seedurl, last_refresh FROM websites WHERE schedule_every_days > 0 AND last_refresh IS NOT NULL
  AND date_diff('day', CAST(last_refresh AS DATE), DATE '2001-08-03') >= schedule_every_days AND schedule_time <= '14:10'"""),
)
def d16(spark, sf):
    return J.due_sites(driver_store(spark, sf, False), "2001-08-03 14:10:00")


@query(
    "a10_copy_sources",
    store_sql("SELECT algorithm_value, selected, language, property_id, CAST(7 AS BIGINT) AS website_id, label, auto_review FROM sources WHERE website_id = 3"),
)
def a10(spark, sf):
    return J.copy_sources(driver_store(spark, sf, False), 3, 7).select(
        "algorithm_value", "selected", "language", "property_id", "website_id", "label", "auto_review"
    )


@query(
    "b8_purge_404",
    store_sql("SELECT s.id FROM statements s JOIN webpages w ON w.id = s.webpage_id JOIN orders o ON o.o_orderkey = w.id WHERE o.o_orderpriority <> '5-LOW'"),
)
def b8(spark, sf):
    """Capture results: pages of low-priority orders are gone, every seventh fetch failed."""
    store = driver_store(spark, sf, False)
    priority = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    status = store.webpages.join(priority, "id").select(
        "url", F.when(F.col("o_orderpriority") == "5-LOW", 404).when(F.col("id") % 7 != 0, 200).alias("status")
    )
    return J.purge_404(store, status).statements.select("id")
