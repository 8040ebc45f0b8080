"""Roll-ups and lists over the store."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.checks.registry import AS_OF, MIDDLE, query
from pagefacts.functions import dates as D
from pagefacts.operators import rollups as R
from pagefacts.operators import star as S
from pagefacts.operators.ranks import rank_rows
from pagefacts.sources.driver_tables import driver_store, store_sql, table
from pagefacts.vocab import SCHEMA

_KEY = "regexp_replace(lower(label), ' ', '_') || CASE WHEN rule_language = '' THEN '' ELSE '_' || lower(rule_language) END"
_BY_EVENT = f""",
marked AS (SELECT *, {_KEY} AS key FROM star WHERE selected_individual AND page_class = 'Event'),
by_event AS (
  SELECT seedurl, rdf_uri, key, arg_max(cache, statement_id) AS cache,
    CASE WHEN count(*) > 1 THEN 'problem' ELSE max(status) END AS status, count(*) AS n,
    min(statement_id) AS first_id, arg_min(archive_date, statement_id) AS first_archive
  FROM marked GROUP BY seedurl, rdf_uri, key)
"""


@query(
    "c1_star_join",
    store_sql("""
SELECT statement_id, rdf_uri, label, predicate, value_datatype, rdfs_class_name, page_class, rule_language,
  page_language, seedurl, selected, status FROM star"""),
)
def c1(spark, sf):
    return S.star(driver_store(spark, sf, with_cache=False)).select(
        "statement_id", "rdf_uri", "label", "predicate", "value_datatype", "rdfs_class_name", "page_class",
        "rule_language", "page_language", "seedurl", "selected", "status",
    )


@query(
    "b1_flat_statements",
    store_sql("""
SELECT statement_id, cache AS value, value_datatype, rdf_uri AS subject, page_class, label, rule_language, source_label,
  expected_class, predicate, manual, NOT starts_with(algorithm_value, 'manual=') AS source_is_feed,
  selected AS selected_source, rdfs_class_name FROM star"""),
)
def b1(spark, sf):
    return S.flat_statements(driver_store(spark, sf)).select(
        "statement_id", F.col("cache").alias("value"), "value_datatype", "subject", "page_class", "label",
        "rule_language", "source_label", "expected_class", "predicate", "manual", "source_is_feed",
        F.col("selected").alias("selected_source"), "rdfs_class_name",
    )


@query(
    "b2_query_statements",
    store_sql("""
SELECT statement_id, rdf_uri, cache, status FROM star
WHERE property_id = 1 AND contains(cache, 'ring') AND status = 'ok' AND NOT manual AND selected AND selected_individual"""),
)
def b2(spark, sf):
    store = driver_store(spark, sf)
    rows = S.query_statements(
        store, seedurl="all", prop=1, cache="ring", status="ok", manual=False, selected=True, selected_individual=True
    )
    return rows.select("statement_id", "rdf_uri", "cache", "status")


@query(
    "b4_archive_timespan",
    store_sql(f"""
SELECT id, rdf_uri, archive_date >= TIMESTAMP '{MIDDLE}' AND archive_date <= TIMESTAMP '{MIDDLE}' + INTERVAL 60 MONTH AS upcoming,
  archive_date >= TIMESTAMP '1999-01-31' AND archive_date <= TIMESTAMP '{MIDDLE}' + INTERVAL 18 MONTH AS in_report
FROM webpages"""),
)
def b4(spark, sf):
    return driver_store(spark, sf, False).webpages.select(
        "id",
        "rdf_uri",
        D.timespan("archive_date", None, "not a date", MIDDLE).alias("upcoming"),
        D.timespan("archive_date", "1999-01-31", None, MIDDLE, months=18).alias("in_report"),
    )


@query(
    "b9_missing_required",
    store_sql(f"""
SELECT statement_id, rdf_uri, label, status FROM star
WHERE selected_individual AND rdfs_class_name = 'Event'
  AND predicate IN ('{SCHEMA}name', '{SCHEMA}startDate', '{SCHEMA}location')
  AND (status NOT IN ('ok', 'updated') OR trim(cache) IN ('', '[]'))"""),
)
def b9(spark, sf):
    flat = S.flat_statements(driver_store(spark, sf)).filter("selected_individual")
    return R.missing_required(flat.withColumn("value", F.col("cache"))).select(
        "statement_id", "rdf_uri", "label", "status"
    )


@query(
    "d1_site_dashboard",
    store_sql(f""",
s AS (SELECT seedurl, count(*) AS statements,
   count(*) FILTER (cache_refreshed BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}') AS refreshed_24h,
   count(*) FILTER (cache_changed BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}') AS changed_24h,
   count(*) FILTER (status = 'problem' AND selected_individual AND page_class = 'Event') AS flags,
   count(*) FILTER (status = 'updated' AND selected_individual AND page_class = 'Event') AS updated
  FROM star GROUP BY seedurl),
p AS (SELECT website_id, count(*) AS webpages FROM webpages GROUP BY website_id)
SELECT w.name, w.seedurl, s.statements, coalesce(s.refreshed_24h, 0) AS refreshed_24h,
  coalesce(s.changed_24h, 0) AS changed_24h, p.webpages, nullif(s.flags, 0) AS flags, nullif(s.updated, 0) AS updated
FROM websites w LEFT JOIN s ON s.seedurl = w.seedurl LEFT JOIN p ON p.website_id = w.id"""),
)
def d1(spark, sf):
    return R.site_dashboard(driver_store(spark, sf, with_cache=False), AS_OF)


@query(
    "d2_global_counts",
    store_sql(f"""
SELECT count(*) AS total_statements, count(*) FILTER (contains(cache, 'error') AND cache_refreshed
  BETWEEN TIMESTAMP '{MIDDLE}' - INTERVAL 24 HOUR AND TIMESTAMP '{MIDDLE}') AS error_statements FROM statements"""),
)
def d2(spark, sf):
    return R.global_counts(driver_store(spark, sf), MIDDLE)


@query("d3_statements_by_event", store_sql(_BY_EVENT + "SELECT seedurl, rdf_uri, key, cache, status, n FROM by_event"))
def d3(spark, sf):
    return R.statements_by_event(driver_store(spark, sf)).select(
        "seedurl", "rdf_uri", "key", "cache", "status", "n"
    )


_INDEX = f"""{_BY_EVENT},
folded AS (SELECT seedurl, rdf_uri, bool_or(status = 'initial') AS to_review, bool_or(status = 'updated') AS updated,
   bool_or(status = 'problem') AS problem,
   bool_or(key = 'dates' AND status IN ('ok', 'updated')) AND bool_or(key IN ('location', 'virtuallocation') AND status IN ('ok', 'updated'))
     AND bool_or(key IN ('title', 'title_en', 'title_fr') AND status IN ('ok', 'updated')) AS publishable,
   max(cache) FILTER (key = 'photo') AS photo,
   coalesce(max(cache) FILTER (key = 'title'), max(cache) FILTER (key = 'title_fr'), max(cache) FILTER (key = 'title_en')) AS t,
   max(cache) FILTER (key = 'dates') AS d, arg_max(first_archive, first_id) AS archive_date
  FROM by_event GROUP BY seedurl, rdf_uri)
"""


@query(
    "d4_event_index",
    store_sql(f"""{_INDEX}
SELECT seedurl, rdf_uri, to_review, updated, problem, publishable, photo,
  CASE WHEN t IS NULL OR trim(t) = '' OR contains(t, 'error:') THEN 'Error' ELSE t END AS title,
  coalesce(nullif(regexp_extract(d, '{D.FIRST_DATE}'), ''), '2002-06-01T00:00:00') AS date, archive_date
FROM folded"""),
)
def d4(spark, sf):
    return R.event_index(driver_store(spark, sf), AS_OF)


@query("d5_publishable_events", store_sql(f"{_INDEX} SELECT seedurl, rdf_uri FROM folded WHERE publishable"))
def d5(spark, sf):
    return R.publishable_events(driver_store(spark, sf, with_cache=False))


def _nested_sql(source: str, key: str) -> str:
    return f"""
k AS (SELECT *, {key} AS key FROM {source}),
nested AS (
  SELECT rdf_uri, key, 'selected' AS role, min(statement_id) AS statement_id,
    CASE WHEN count(*) > 1 THEN 'problem' ELSE max(status) END AS status,
    CASE WHEN count(*) > 1 THEN 'Duplicate selected properties: ' || min(statement_id) || ' and ' || max(statement_id)
      ELSE max(cache) END AS value
  FROM k WHERE selected_individual GROUP BY rdf_uri, key
  UNION ALL
  SELECT rdf_uri, key, 'alternative', statement_id, status, cache FROM k WHERE NOT selected_individual)
"""


_BUILD_KEY = "regexp_replace(lower(label), ' ', '_') || CASE WHEN rule_language = '' THEN '' ELSE '_' || rule_language END"


@query(
    "d6_events_by_property",
    store_sql(f""",
w AS (SELECT * FROM star WHERE property_id IN (1, 3) AND archive_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-01-01'),
{_nested_sql("w", _BUILD_KEY)},
a AS (SELECT rdf_uri, arg_max(archive_date, webpage_id) AS archive_date FROM w GROUP BY rdf_uri)
SELECT n.*, a.archive_date FROM nested n JOIN a USING (rdf_uri)"""),
)
def d6(spark, sf):
    return R.events_by_property(driver_store(spark, sf), 3, "1997-01-01", "1999-01-01")


@query(
    "d7_nested_statements",
    store_sql("," + _nested_sql("star", _BUILD_KEY) + "SELECT * FROM nested"),
)
def d7(spark, sf):
    return R.nested_statements(S.star(driver_store(spark, sf)))


@query(
    "d8_resource_status",
    store_sql("""
SELECT rdf_uri, count(*) FILTER (selected AND status = 'initial') AS initial, count(*) FILTER (selected AND status = 'missing') AS missing,
  count(*) FILTER (selected AND status = 'ok') AS ok, count(*) FILTER (selected AND status = 'updated') AS updated,
  count(*) FILTER (selected AND status = 'problem') AS problem FROM star GROUP BY rdf_uri"""),
)
def d8(spark, sf):
    return R.resource_status(driver_store(spark, sf, with_cache=False))


@query(
    "d9_webpage_index",
    store_sql(""",
f AS (SELECT website_id, rdf_uri, label, arg_max(status IN ('ok', 'updated') AND (label <> 'Dates' OR length(cache) > 3), statement_id) AS fine
  FROM star WHERE selected AND rdfs_class_name = 'Event' AND label IN ('Location', 'Dates', 'Title') GROUP BY website_id, rdf_uri, label),
m AS (SELECT website_id, rdf_uri, count(*) = 3 AND bool_and(fine) AS yes FROM f GROUP BY website_id, rdf_uri)
SELECT w.id AS webpage_id, w.url, s.seedurl, w.rdf_uri, w.archive_date,
  CASE WHEN w.rdfs_class_id = 1 THEN CASE WHEN m.yes THEN 'Yes' ELSE 'No' END END AS publishable
FROM webpages w JOIN websites s ON w.website_id = s.id LEFT JOIN m ON m.website_id = w.website_id AND m.rdf_uri = w.rdf_uri"""),
)
def d9(spark, sf):
    return R.webpage_index(driver_store(spark, sf))


@query(
    "f1_statement_page",
    store_sql("""
SELECT statement_id, rdf_uri, status FROM star WHERE seedurl = 'nation_3' ORDER BY statement_id LIMIT 100 OFFSET 100"""),
)
def f1(spark, sf):
    rows = S.query_statements(driver_store(spark, sf, False), seedurl="nation_3", ordered=False)
    return rank_rows(rows.select("statement_id", "rdf_uri", "status"), "statement_id").page(2, 100)


@query(
    "f1_deep_page",
    store_sql("""
SELECT statement_id, rdf_uri, status, label FROM star ORDER BY status DESC, rdf_uri, statement_id LIMIT 1000 OFFSET (SELECT 4 * count(*) // 5 // 1000 * 1000 FROM star)"""),
)
def f1_deep(spark, sf):
    """A page four fifths into all statements of the store."""
    rows = S.star(driver_store(spark, sf, False)).select("statement_id", "rdf_uri", "status", "label")
    ranked = rank_rows(rows, F.desc("status"), "rdf_uri", "statement_id")
    return ranked.page(4 * len(ranked) // 5 // 1000 + 1, 1000)


@query(
    "f2_list_orders",
    store_sql("""
SELECT 'events' AS list, row_number() OVER (ORDER BY archive_date NULLS FIRST, rdf_uri, id) AS place, CAST(id AS VARCHAR) AS key FROM webpages WHERE rdfs_class_id = (SELECT id FROM rdfs_classes WHERE name = 'Event')
UNION ALL SELECT 'pages', row_number() OVER (ORDER BY archive_date NULLS FIRST, id), CAST(id AS VARCHAR) FROM webpages
UNION ALL SELECT 'websites', row_number() OVER (ORDER BY name, id), CAST(id AS VARCHAR) FROM websites
UNION ALL SELECT 'properties', row_number() OVER (ORDER BY rdfs_class_id, label, id), CAST(id AS VARCHAR) FROM properties
UNION ALL SELECT 'rules', row_number() OVER (ORDER BY selected DESC, property_id, language, id), CAST(id AS VARCHAR) FROM sources
UNION ALL SELECT 'statements', row_number() OVER (ORDER BY selected DESC, property_id, statement_id), CAST(statement_id AS VARCHAR) FROM star
UNION ALL SELECT 'messages', row_number() OVER (ORDER BY ts DESC, user_id, props, event_id), 'user ' || user_id FROM events"""),
)
def f2(spark, sf):
    """The seven ordered lists as places, equal keys told apart by id."""
    store = driver_store(spark, sf, False)
    events = store.webpages.join(store.rdfs_classes.filter("name = 'Event'").select(F.col("id").alias("rdfs_class_id")), "rdfs_class_id")
    lists = {
        "events": (events, "archive_date", "rdf_uri", "id"),
        "pages": (store.webpages, "archive_date", "id"),
        "websites": (store.websites, "name", "id"),
        "properties": (store.properties, "rdfs_class_id", "label", "id"),
        "rules": (store.sources, F.desc("selected"), "property_id", "language", "id"),
        "statements": (S.star(store).withColumnRenamed("statement_id", "id"), F.desc("selected"), "property_id", "id"),
        "messages": (
            table(spark, sf, "events").selectExpr("ts", "user_id", "props", "event_id", "concat('user ', user_id) as id"),
            F.desc("ts"), "user_id", "props", "event_id",
        ),
    }
    parts = [
        rank_rows(rows, *order).places().select(F.lit(name).alias("list"), "place", F.col("id").cast("string").alias("key"))
        for name, (rows, *order) in lists.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)
