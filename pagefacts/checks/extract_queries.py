"""Extraction over the given pages, legacy markup, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagefacts.checks.change_queries import _COLS, captured
from pagefacts.checks.registry import AS_OF, QUERIES, ORACLES, query
from pagefacts.operators import extract as X
from pagefacts.operators import legacy as Y
from pagefacts.operators import rollups as R
from pagefacts.session import durable_dir
from pagefacts.sources.driver_tables import captures, driver_store, literal_rows, sources, store_sql, stored, table
from pagefacts.sources.statement_log import StatementLog
from pagefacts.streaming import jobs as T
from pagefacts.vocab import DEFAULT, SCHEMA

RULES = [
    (1, "xpath=//title"),
    (2, "xpath=//h1"),
    (3, "xpath=//nav//a/@href"),
    (4, "if_xpath=//nothing;xpath=//title"),
    (5, "unless_xpath=//nothing;css=article h1;time_zone=Eastern Time (US & Canada)"),
    (6, "manual=Constant;ruby=$array.first"),
    (7, "//title"),
    (8, "ruby=system('x')"),
]


def _asked(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("webpage_id"), "url", F.lit(0).alias("rule_set"))
    rules = literal_rows(spark, [(0, i, a) for i, a in RULES], "rule_set int, source_id bigint, algorithm_value string")
    return pages, rules


# pages with the body kept for their address
_BODIES = """bodies AS (SELECT p.page_id, b.html FROM pages p JOIN (
  SELECT regexp_replace(trim(url), '#.*$', '') AS at, arg_max(html, page_id) AS html FROM pages GROUP BY 1) b ON b.at = regexp_replace(trim(p.url), '#.*$', ''))"""
_KEPT = "(SELECT max(page_id) AS page_id FROM pages GROUP BY regexp_replace(trim(url), '#.*$', ''))"
_UNESCAPE = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(
    "l1_extract",
    f"""WITH {_BODIES}, t AS (SELECT page_id, {_UNESCAPE.format("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, {_UNESCAPE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS h1,
  array_to_string(regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>'), 'href="([^"]*)"', 1), '|') AS hrefs FROM bodies)
SELECT page_id AS webpage_id, i AS source_id, CASE i WHEN 1 THEN title WHEN 2 THEN h1 WHEN 3 THEN hrefs WHEN 5 THEN h1 || '|time_zone: Eastern Time (US & Canada)' WHEN 6 THEN 'Constant' ELSE '' END AS found,
  CASE i WHEN 7 THEN 'MissingPrefix' WHEN 8 THEN 'UnsupportedExpression' END AS error_type FROM t, (SELECT unnest(range(1, 9)) AS i) r""",
)
def l1(spark, sf):
    """Every rule by the page reader, without the native shortcut."""
    pages, rules = _asked(spark, sf)
    out = X.extract(pages, rules, captures(spark, sf), native=False)
    return out.select("webpage_id", "source_id", F.array_join("values", "|").alias("found"), "error_type")


@query(
    "l15_native_rules",
    f"""SELECT page_id AS webpage_id, i AS source_id, CASE i WHEN 1 THEN {_UNESCAPE.format("regexp_extract(html, '<title>(.*?)</title>', 1)")} ELSE {_UNESCAPE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} END AS found
FROM pages JOIN {_KEPT} k USING (page_id), (SELECT unnest([1, 2]) AS i) r""",
)
def l15(spark, sf):
    """Single-tag rules as column expressions, without Python."""
    rows = captures(spark, sf).withColumn("r", F.explode(F.expr("array(struct(1L as id, 'xpath=//title' as a), struct(2L as id, 'xpath=//h1' as a))")))
    return rows.select(
        F.col("page_id").alias("webpage_id"), F.col("r.id").alias("source_id"),
        F.array_join(X.fast_path(F.col("html"), F.col("r.a")), "|").alias("found"),
    )


@query("l10_page_switch", "SELECT page_id AS webpage_id, 1 AS source_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) IS NOT NULL AS found, 3 AS steps FROM pages")
def l10(spark, sf):
    """A rule that notes the title, goes to the page's own address again and reads its heading."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("webpage_id"), "url", F.lit(0).alias("rule_set"))
    rules = literal_rows(
        spark, [(0, 1, "xpath=//title;url=$url;xpath=//h1")], "rule_set int, source_id bigint, algorithm_value string"
    )
    out = X.extract(pages, rules, captures(spark, sf))
    return out.select("webpage_id", "source_id", (F.size("values") == 2).alias("found"), F.size("trace").alias("steps"))


@query("l1_site_rules")
def l1_site(spark, sf):
    """The store's own rules over the given pages, one site's rules per page."""
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("webpage_id"), "url", (F.col("page_id") % 25).alias("rule_set")
    )
    rules = sources(spark, sf).select(F.col("website_id").alias("rule_set"), F.col("id").alias("source_id"), "algorithm_value")
    out = X.extract(pages, rules, captures(spark, sf))
    return out.select("webpage_id", "source_id", F.size("values").alias("n"), F.md5(F.array_join("values", "|")).alias("digest"), "error_type")


_LEGACY = f"""
u AS (SELECT *, regexp_extract(predicate, '[^/]*$') AS prop FROM star WHERE selected AND status IN ('ok', 'updated') AND (rule_language = page_language OR rule_language = '')),
v AS (SELECT webpage_id, rdf_uri, page_language, prop, arg_max(value_datatype, statement_id) AS dt, arg_max(cache, statement_id) AS c FROM u
  WHERE prop <> 'performer' AND (value_datatype <> 'xsd:anyURI' OR c_list(cache)) GROUP BY ALL),
x AS (SELECT webpage_id, rdf_uri, page_language, max(c) FILTER (prop = 'startDate') AS d, max(c) FILTER (prop = 'location') AS l, max(c) FILTER (prop = 'name') AS name,
  max(c) FILTER (prop = 'price') AS price FROM v GROUP BY ALL),
y AS (SELECT *, CASE WHEN d LIKE '[%' THEN from_json(d, '["VARCHAR"]') ELSE [d] END AS ds,
   CASE WHEN l LIKE '[[%' THEN json_extract(l, '$[0]') ELSE CAST(l AS JSON) END AS g FROM x WHERE d IS NOT NULL AND l IS NOT NULL AND trim(coalesce(name, '')) <> ''),
z AS (SELECT *, CASE WHEN json_array_length(g) > 2 THEN json_array_length(g) - 2 ELSE 0 END AS n FROM y),
e AS (SELECT *, ds[i] AS "startDate", json_extract(g, '$[' || CASE WHEN n = len(ds) THEN i + 1 ELSE 2 END || ']') AS place FROM (SELECT *, generate_subscripts(ds, 1) AS i FROM z WHERE n > 0 AND (n = 1 OR n = len(ds)))),
own AS (SELECT webpage_id, CASE WHEN prop IN ('name', 'description') THEN prop || '_' || page_language ELSE prop END AS key,
  CASE dt WHEN 'xsd:dateTime' THEN to_json(CASE WHEN c LIKE '[%' THEN from_json(c, '["VARCHAR"]') ELSE [c] END) ELSE coalesce(to_json(c), 'null') END::VARCHAR AS value
  FROM v WHERE prop NOT IN ('startDate', 'endDate', 'location', 'duration', 'price')),
doc AS (
  SELECT *, unnest([{{'k': 'name', 'v': name}}, {{'k': 'startDate', 'v': "startDate"}}, {{'k': 'place_id', 'v': place->>1}}, {{'k': 'place_name', 'v': place->>0}}, {{'k': 'place_type', 'v': g->>1}}], recursive := true) FROM e
)
""".replace("c_list(cache)", "json_valid(cache) AND json_type(cache) = 'ARRAY'")


@query(
    "i11_legacy_events",
    store_sql(f"""
SELECT webpage_id, replace(rdf_uri, 'adr:', '{DEFAULT.kg_base}') AS super_event, type, date_pos, k, v FROM (
  SELECT webpage_id, rdf_uri, 'Event' AS type, i - 1 AS date_pos, k, v FROM doc
  UNION ALL SELECT webpage_id, rdf_uri, 'EventSeries', -1, k, v FROM doc WHERE i = 1
  UNION ALL SELECT webpage_id, rdf_uri, 'Event', i - 1, unnest(['endDate', 'price', 'valid_from', 'availability']), unnest([left("startDate", 10), price,
    CASE WHEN trim(price) <> '' THEN strftime(DATE '{AS_OF[:10]}' - INTERVAL 1 MONTH, '%Y-%m-%d') END, CASE WHEN trim(price) <> '' THEN '{SCHEMA}InStock' END]) FROM e
  UNION ALL SELECT webpage_id, rdf_uri, 'Event', i - 1, 'properties.' || key, value FROM e JOIN own USING (webpage_id)
) WHERE v IS NOT NULL""", _LEGACY),
)
def i11(spark, sf):
    """Every event and series, with all properties, one row a name."""
    rows = Y.legacy_events(driver_store(spark, sf), AS_OF).drop("page_language", "description", "image")
    keys = ["webpage_id", "super_event", "type", "date_pos"]
    plain = [c for c in rows.columns if c not in (*keys, "properties")]
    given = F.create_map(*[x for c in plain for x in (F.lit(c), F.col(c))])
    own = F.transform_keys(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("properties."), k))
    return rows.select(*keys, F.explode(F.map_concat(given, own)).alias("k", "v")).filter("v is not null")


@query(
    "i11_legacy_documents",
    store_sql(f"""
SELECT webpage_id, CASE WHEN last THEN 'EventSeries' ELSE 'Event' END AS type, CASE WHEN last THEN -1 ELSE i - 1 END AS date_pos,
  CASE WHEN last THEN '{SCHEMA}EventSeries' ELSE '{SCHEMA}Event' END AS cls, replace(rdf_uri, 'adr:', '{DEFAULT.kg_base}') AS about, "startDate",
  replace(place->>1, 'adr:', '{DEFAULT.kg_base}') AS place, name, CASE WHEN NOT last AND trim(price) <> '' THEN price END AS price, CASE WHEN NOT last THEN desc_ END AS description
FROM (SELECT *, unnest(CASE WHEN i = 1 THEN [false, true] ELSE [false] END) AS last FROM e
  LEFT JOIN (SELECT webpage_id, value::JSON->>'$' AS desc_ FROM own WHERE key LIKE 'description_%') USING (webpage_id))""", _LEGACY),
)
def i11_documents(spark, sf):
    """The objects of the markup, read back."""
    docs = Y.legacy_documents(Y.legacy_events(driver_store(spark, sf), AS_OF))
    at = lambda path: F.get_json_object("json", path)
    either = lambda name: F.coalesce(at(f"$.{name}_en"), at(f"$.{name}_fr"))
    return docs.select(
        "webpage_id", "type", "date_pos", F.concat(F.get_json_object("json", "$.@context.@vocab"), at("$.@type")).alias("cls"),
        F.coalesce(at("$.superEvent.@id"), at("$.@id")).alias("about"), at("$.startDate").alias("startDate"),
        at("$.location.@id").alias("place"), either("name").alias("name"), at("$.offers.price").alias("price"),
        either("description").alias("description"),
    )


@query(
    "i12_offers",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 'http://schema.org/SoldOut' ELSE 'http://schema.org/InStock' END AS availability,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS price, 'CAD' AS currency, CASE WHEN l_returnflag <> 'R' THEN 'http://tickets.example/' || l_partkey END AS url, '2001-05-01' AS valid_from FROM lineitem""",
)
def i12(spark, sf):
    url = F.when(F.col("l_returnflag") == "R", '["Complet"]').otherwise(F.expr("concat('http://tickets.example/', l_partkey)"))
    offer = Y.offer_struct(F.expr("cast(cast(l_quantity as bigint) as string)"), url, AS_OF)
    rows = table(spark, sf, "lineitem").withColumn("offer", offer)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "offer.availability", "offer.price",
        F.col("offer.priceCurrency").alias("currency"), F.get("offer.url", F.lit(0)).alias("url"), F.col("offer.validFrom").alias("valid_from"),
    )


@query(
    "d15_legacy_publishable",
    store_sql("SELECT webpage_id, n > 0 AND (n = 1 OR n = len(ds)) AS publishable FROM z", _LEGACY),
)
def d15(spark, sf):
    from pagefacts.functions import values as V
    from pagefacts.operators.star import star

    rows = star(driver_store(spark, sf)).filter(
        "selected and status in ('ok', 'updated') and (rule_language = page_language or rule_language = '')"
    )
    pick = lambda p: F.max_by(
        F.when(F.col("prop") == p, F.col("cache")), F.when(F.col("prop") == p, F.col("statement_id"))
    )
    wide = rows.withColumn("prop", V.local_name("predicate")).groupBy("webpage_id").agg(
        pick("startDate").alias("d"), pick("location").alias("l"), pick("name").alias("n")
    )
    wide = wide.filter(F.col("d").isNotNull() & F.col("l").isNotNull() & ~F.coalesce(V.is_blank("n"), F.lit(True)))
    return wide.select(
        "webpage_id", Y.legacy_publishable(V.to_array("d"), Y.nested_links(F.col("l")), F.col("n")).alias("publishable")
    )


@query(
    "e4_latest_captures",
    """SELECT user_id AS webpage_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS source_id, max(ts) AS captured_at, arg_max(value, ts) AS value FROM events GROUP BY user_id, event_type""",
)
def e4(spark, sf):
    log = table(spark, sf, "events").selectExpr(
        "user_id as webpage_id",
        "cast(case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 when 'error' then 4 else 5 end as bigint) as source_id",
        "ts as captured_at", "value",
    )
    return T.latest_captures(log)


@query("k1_stream_refresh", None)
def k1(spark, sf):
    """The capture run of the batch refresh, arriving as files: the same result."""
    store = stored(driver_store(spark, sf))
    root = f"{durable_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = captured(spark, sf, store).withColumn("captured_at", F.lit(AS_OF).cast("timestamp_ntz"))
    run.repartition(4, "webpage_id").write.parquet(f"{root}/in")
    T.refresh_stream(store, T.read_captures(spark, f"{root}/in", files_per_batch=1), root, AS_OF, buckets=16, limit=2).awaitTermination()
    return T.streamed_statements(spark, root).select(_COLS)


ORACLES["k1_stream_refresh"] = ORACLES["j1_refresh"]
assert "j1_refresh" in QUERIES


# the statements after the run: those it refreshed, and those without a capture as they were
_AFTER = ORACLES["j1_refresh"]


@query(
    "d1_dashboard_from_feed",
    f"""WITH after AS ({_AFTER}), sites AS ({store_sql("SELECT id, name, seedurl FROM websites")}), pg AS ({store_sql("SELECT w.id, w.website_id, c.name = 'Event' AS is_event FROM webpages w JOIN rdfs_classes c ON c.id = w.rdfs_class_id")}),
s AS (SELECT website_id, count(*) AS statements,
   count(*) FILTER (cache_refreshed BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}') AS refreshed_24h,
   count(*) FILTER (cache_changed BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}') AS changed_24h,
   count(*) FILTER (status = 'problem' AND selected_individual AND is_event) AS flags, count(*) FILTER (status = 'updated' AND selected_individual AND is_event) AS updated
  FROM after JOIN pg ON pg.id = after.webpage_id GROUP BY website_id),
p AS (SELECT website_id, count(*) AS webpages FROM pg GROUP BY website_id)
SELECT w.name, w.seedurl, s.statements, coalesce(s.refreshed_24h, 0) AS refreshed_24h, coalesce(s.changed_24h, 0) AS changed_24h, p.webpages,
  nullif(s.flags, 0) AS flags, nullif(s.updated, 0) AS updated FROM sites w LEFT JOIN s ON s.website_id = w.id LEFT JOIN p ON p.website_id = w.id""",
)
def d1_feed(spark, sf):
    """The dashboard after a streamed capture run, from counters of the first version and the changes since."""
    store = stored(driver_store(spark, sf))
    root = f"{durable_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = captured(spark, sf, store).withColumn("captured_at", F.lit(AS_OF).cast("timestamp_ntz"))
    run.repartition(2, "webpage_id").write.parquet(f"{root}/in")
    T.refresh_stream(store, T.read_captures(spark, f"{root}/in", files_per_batch=1), root, AS_OF, buckets=16).awaitTermination()
    log = StatementLog(spark, f"{root}/statements")
    counters = R.update_counters(R.page_counters(log.read(0)), log.changes(0, columns=R.COUNTED))
    return R.site_dashboard(store.with_(statements=log.read()), AS_OF, counters)


@query(
    "k2_message_stream",
    "SELECT props AS message, 'user ' || user_id AS artifact, ts AS created_at FROM events",
)
def k2(spark, sf):
    root = f"{durable_dir(spark)}/messages-{uuid.uuid4().hex}"
    driver_store(spark, sf, False).messages.write.option("timestampNTZFormat", T.MESSAGE_TIME).json(f"{root}/in")
    T.append_messages(T.messages_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(
    "a7_messages",
    "SELECT props AS message, 'user ' || user_id AS artifact, ts AS created_at FROM events",
)
def a7(spark, sf):
    return T.messages(driver_store(spark, sf, False))


@query(
    "k3_change_windows",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, 'u' || (user_id % 10) AS site, count(*) AS refreshed, count(*) FILTER (value > 50) AS changed,
  count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL""",
)
def k3(spark, sf):
    """Daily windows over the event log, streamed; the given file is read as a stream."""
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    log = stream.selectExpr(
        "concat('u', user_id % 10) as site", "cast(concat(cast(ts as string), '+00:00') as timestamp) as at", "value > 50 as changed", "event_type as value"
    )
    out = f"{durable_dir(spark)}/windows-{uuid.uuid4().hex}"

    def store(batch, number):
        # a batch holds the windows it touched; a replay writes the same folder again
        batch.write.mode("overwrite").parquet(f"{out}/result/batch={number}")

    T.change_windows(log).writeStream.outputMode("update").foreachBatch(store).option(
        "checkpointLocation", f"{out}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    newest = Window.partitionBy("window_start", "site").orderBy(F.desc("batch"))
    result = spark.read.parquet(f"{out}/result").withColumn("n", F.row_number().over(newest)).filter("n = 1")
    day = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window_start").cast("timestamp_ntz")), "yyyy-MM-dd")
    return result.select(day.alias("day"), "site", "refreshed", "changed", "errors")
