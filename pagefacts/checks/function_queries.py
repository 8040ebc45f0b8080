"""Column functions over values, texts and dates derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.checks.graph_sql import LINKS_SQL
from pagefacts.checks.registry import AS_OF, query
from pagefacts.functions import classify as K
from pagefacts.functions import dates as D
from pagefacts.functions import jsoncanon as N
from pagefacts.functions import values as V
from pagefacts.operators import star as S
from pagefacts.sources.driver_tables import driver_store, store_sql, table
from pagefacts.sources.store import typed
from pagefacts.vocab import DEFAULT, SCHEMA

_ITEMS = """CASE WHEN cache LIKE '[%' THEN from_json(cache, '["VARCHAR"]') ELSE [cache] END"""


def _values(spark, sf, where="true"):
    return S.star(driver_store(spark, sf)).filter(where)


@query(
    "a1_typed_values",
    store_sql(f"""
SELECT statement_id, 'value' AS kind, unnest(vs) AS item, generate_subscripts(vs, 1) - 1 AS pos, -1 AS hit, NULL AS class, NULL AS uri
  FROM (SELECT statement_id, {_ITEMS} AS vs FROM star WHERE value_datatype <> 'xsd:anyURI' AND cache NOT LIKE '["abort%')
UNION ALL SELECT statement_id, 'group', json_extract_string(g, '$[0]'), gi - 1, -1, json_extract_string(g, '$[1]'), NULL FROM grouped
UNION ALL SELECT statement_id, 'link', hit_label, gi - 1, hi - 1, class, uri FROM links
UNION ALL SELECT statement_id, 'aborted', cache, -1, -1, NULL, NULL FROM star WHERE cache LIKE '["abort%'""", LINKS_SQL),
)
def a1(spark, sf):
    """Every statement's parsed shape: plain values, link groups with their links, and aborted ones as stored."""
    store = driver_store(spark, sf)
    rows = typed(store.statements).withColumnRenamed("id", "statement_id").join(
        S.rules(store).select("source_id", (F.col("value_datatype") == "xsd:anyURI").alias("linked")), "source_id"
    )
    # one pass: every statement's entries as one list; ``links`` and ``values`` are named once each
    item = lambda kind, text, pos=-1, hit=-1, cls=None, uri=None: F.struct(
        F.lit(kind).alias("kind"), text.alias("item"), *[(F.lit(n) if isinstance(n, int) else n).cast("int").alias(c) for c, n in (("pos", pos), ("hit", hit))],
        *[(F.lit(t).cast("string") if t is None else t).alias(c) for c, t in (("class", cls), ("uri", uri))],
    )
    group = lambda g, i: F.concat(
        F.array(item("group", g["search"], i, cls=g["class"])),
        F.transform(F.coalesce(g["links"], F.array()), lambda h, j: item("link", h["label"], i, j, g["class"], h["uri"])),
    )
    entries = F.concat(
        F.when(F.col("linked"), F.flatten(F.transform("links", group)))
        .when(~F.col("linked") & ~F.col("aborted"), F.transform("values", lambda v, i: item("value", v, i)))
        .otherwise(F.array()),
        F.when(F.col("aborted"), F.array(item("aborted", F.col("cache")))).otherwise(F.array()),
    )
    return rows.select("statement_id", F.explode(entries).alias("e")).select("statement_id", "e.*")


@query("b3_property_keys", store_sql("""SELECT DISTINCT label, rule_language, regexp_replace(lower(label), ' ', '_') || CASE WHEN rule_language = '' THEN '' ELSE '_' || rule_language END AS build_key,
  CASE WHEN label IS NULL THEN 'failed to make key' ELSE lower(regexp_replace(label, ' ', '_')) || CASE WHEN rule_language = '' THEN '' ELSE '_' || lower(rule_language) END END AS make_key FROM star"""))
def b3(spark, sf):
    return _values(spark, sf).select(
        "label", "rule_language", V.build_key("label", "rule_language").alias("build_key"), V.make_key("label", "rule_language").alias("make_key")
    ).distinct()


@query("b5_normalized_urls", "SELECT page_id, regexp_replace(trim('  ' || url || ' '), '#.*$', '') AS url FROM pages")
def b5(spark, sf):
    return table(spark, sf, "pages").select("page_id", V.normalize_url(F.concat(F.lit("  "), "url", F.lit(" "))).alias("url"))


@query(
    "b6_url_gate",
    """WITH p AS (SELECT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path, page_id FROM pages),
pat AS (SELECT DISTINCT host, regexp_extract(path, '^(/[a-z]+/)', 1) AS prefix FROM p WHERE page_id % 3 = 0)
SELECT url, CASE WHEN host NOT IN (SELECT host FROM pat) THEN 'domain_missing'
  WHEN EXISTS (SELECT 1 FROM pat WHERE pat.host = p.host AND starts_with(p.path, pat.prefix)) THEN 'ok' ELSE 'outside_pattern' END AS decision FROM p""",
)
def b6(spark, sf):
    pages = table(spark, sf, "pages")
    patterns = pages.filter("page_id % 3 = 0").select(
        F.expr("try_parse_url(url, 'HOST')").alias("host"),
        F.regexp_extract(F.expr("try_parse_url(url, 'PATH')"), "^(/[a-z]+/)", 1).alias("prefix"),
    ).distinct()
    return K.gate_urls(pages, patterns)


_MARKED = """CASE page_id % 5 WHEN 0 THEN replace(html, '<title>', '<title>Queue-it ') WHEN 1 THEN html || '<p>Attention Required</p>' ELSE html END"""


@query(
    "b7_blocked_pages",
    f"""SELECT page_id, CASE WHEN contains(regexp_extract(h, '<title>(.*?)</title>', 1), 'Queue-it') THEN 'system_queue'
  WHEN contains(h, 'Attention Required') OR contains(h, 'Cloudflare') THEN 'system_cloudflare' END AS error_code FROM (SELECT page_id, {_MARKED} AS h FROM pages)""",
)
def b7(spark, sf):
    pages = table(spark, sf, "pages").withColumn("html", F.expr(_MARKED.replace("|| '<p>Attention Required</p>'", "|| '<p>Attention Required</p>'")))
    return K.flag_blocked(pages).select("page_id", "error_code")


@query(
    "b10_b11_b12_uris",
    store_sql(f"""SELECT DISTINCT replace(rdf_uri, 'adr:', '{DEFAULT.kg_base}') AS full_uri, replace(rdf_uri, 'adr:', '{DEFAULT.kg_base}') || '#Offer' AS node,
  replace(rdf_uri, 'adr:', '{DEFAULT.kg_base}') || '#Offer-PostalAddress' AS nested, true AS short_is_invalid, false AS full_is_invalid FROM webpages"""),
)
def b10(spark, sf):
    full = V.full_uri("rdf_uri")
    node = V.node_uri(full, "Offer")
    return driver_store(spark, sf, False).webpages.select(
        full.alias("full_uri"), node.alias("node"), V.node_uri(node, "PostalAddress").alias("nested"),
        V.invalid_uri("rdf_uri").alias("short_is_invalid"), V.invalid_uri(full).alias("full_is_invalid"),
    ).distinct()


# French dates written from the order dates; the clock is 10 h to 19 h 30
_FR = ("janvier", "février", "mars", "avr", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
_MONTH = "CASE month(o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(_FR)) + " END"
# North American daylight saving of 1995 to 2006: first Sunday of April to last Sunday of October
_DST = """(month(d) BETWEEN 5 AND 9 OR (month(d) = 4 AND day(d) - (dayofweek(d)) >= 1) OR (month(d) = 10 AND day(d) + 7 - dayofweek(d) <= 31))"""


def _french(spark, sf):
    text = f"""concat(day(o_orderdate), ' ', {_MONTH}, ' ', year(o_orderdate), ' - ', 10 + o_orderkey % 10, ' h ', if(o_orderkey % 2 = 0, '30', '00'))"""
    return table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate", f"{text} as text")


@query(
    "h6_french_months",
    f"""SELECT o_orderkey, day(o_orderdate) || ' ' || CASE month(o_orderdate) {" ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")))} END
  || ' ' || year(o_orderdate) || ' - ' || (10 + o_orderkey % 10) || ' h ' || CASE WHEN o_orderkey % 2 = 0 THEN '30' ELSE '00' END AS english FROM orders""",
)
def h6(spark, sf):
    return _french(spark, sf).select("o_orderkey", D.french_month_to_en("text").alias("english"))


@query(
    "h7_iso_datetime",
    f"""SELECT o_orderkey, strftime(d, '%Y-%m-%d') || 'T' || (10 + o_orderkey % 10) || ':' || CASE WHEN o_orderkey % 2 = 0 THEN '30' ELSE '00' END || ':00' ||
  CASE WHEN {_DST} THEN '-04:00' ELSE '-05:00' END AS iso FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""",
)
def h7(spark, sf):
    return _french(spark, sf).select("o_orderkey", D.iso_datetime("text").alias("iso"))


@query(
    "h8_h9_zoned_lists",
    f"""SELECT o_orderkey, strftime(d, '%Y-%m-%d') || 'T15:00:00' || CASE WHEN {_DST} THEN '-07:00' ELSE '-08:00' END AS first,
  strftime(d, '%Y-%m-%d') AS second, 2 AS n, strftime(d, '%Y-%m-%d') AS day FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""",
)
def h8(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    items = F.array(
        F.concat(day, F.lit(" 15:00")), F.lit("time_zone: Pacific Time (US & Canada)"), day, F.concat(F.lit("le "), day)
    )
    rows = table(spark, sf, "orders").select("o_orderkey", items.alias("items"))
    out = rows.withColumn("x", D.convert_datetimes("items")).withColumn("y", D.convert_dates("items", F.col("x")))
    return out.select(
        "o_orderkey", F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("second"), F.size("x").alias("n"),
        F.get("y", F.lit(0)).alias("day"),
    )


@query(
    "h10_durations",
    """SELECT l_orderkey, l_linenumber, l_quantity, 'PT' || CAST(CAST(l_quantity AS BIGINT) % 4 * 3600 + CAST(l_quantity AS BIGINT) % 59 * 60 AS VARCHAR) || 'S' AS duration FROM lineitem""",
)
def h10(spark, sf):
    q = "cast(l_quantity as bigint)"
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity", f"concat('durée ', if({q} % 4 = 0, '', concat({q} % 4, ' hrs ')), {q} % 59, ' min') as text"
    )
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", D.iso_duration("text").alias("duration"))


_PHRASE = """CASE event_type WHEN 'view' THEN 'The show is CANCELLED' WHEN 'click' THEN 'Spectacle de danse reporté - Jeune public'
  WHEN 'signup' THEN 'Soirée suspendue, humour et musique' WHEN 'error' THEN 'derescheduled movie, OnlineEventAttendanceMode' ELSE 'Performance OfflineEventAttendanceMode MixedEventAttendanceMode' END"""


@query(
    "h11_h12_h13_classes",
    f"""SELECT event_id, CASE event_type WHEN 'view' THEN 'EventCancelled' WHEN 'click' THEN 'EventRescheduled' WHEN 'signup' THEN 'EventPostponed' ELSE 'EventScheduled' END AS status,
  CASE event_type WHEN 'click' THEN 'ChildrensEvent,DanceEvent' WHEN 'signup' THEN 'ComedyEvent,MusicEvent' WHEN 'error' THEN 'TheaterEvent' WHEN 'purchase' THEN 'Performance' ELSE '' END AS types,
  CASE event_type WHEN 'error' THEN 'Online' WHEN 'purchase' THEN 'In-person,Mixed' ELSE '' END AS modes FROM events""",
)
def h11(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(_PHRASE).alias("text"))
    labels = lambda hits: F.array_join(F.transform(hits, lambda h: h["label"]), ",")
    return rows.select(
        "event_id", labels(K.event_status(F.col("text"))).alias("status"), labels(K.event_types(F.col("text"))).alias("types"),
        labels(K.attendance_mode(F.col("text"))).alias("modes"),
    )


@query(
    "h14_formatted_values",
    f"""WITH e AS (SELECT event_id, ts, {_PHRASE} AS text, CASE event_type WHEN 'view' THEN 'EventCancelled' WHEN 'click' THEN 'EventRescheduled' WHEN 'signup' THEN 'EventPostponed' ELSE 'EventScheduled' END AS st FROM events)
SELECT event_id, 'status' AS kind, '["' || text || '","EventStatusType",["' || st || '","{SCHEMA}' || st || '"]]' AS value FROM e
UNION ALL SELECT event_id, 'duration', 'PT3600S' FROM e UNION ALL SELECT event_id, 'list', '["a","b"]' FROM e UNION ALL SELECT event_id, 'text', text FROM e
UNION ALL SELECT event_id, 'day', strftime(ts, '%Y-%m-%d') FROM e""",
)
def h14(spark, sf):
    """Five kinds of values per event, formatted by one expression over their datatype."""
    case = "struct({} as kind, array({}) as values, {} as dt, {} as cls)"
    cases = ", ".join(
        [
            case.format("'status'", "text", "'xsd:anyURI'", "'EventStatusType'"),
            case.format("'duration'", "concat(text, ' 1 h')", "'xsd:duration'", "''"),
            case.format("'list'", "'a', 'b'", "''", "''"),
            case.format("'text'", "text", "''", "''"),
            case.format("'day'", "date_format(ts, 'dd-MMM-yyyy')", "'xsd:date'", "''"),
        ]
    )
    cases = f"inline(array({cases}))"
    rows = table(spark, sf, "events").select("event_id", "ts", F.expr(_PHRASE).alias("text")).selectExpr("event_id", cases)
    return rows.select(
        "event_id", "kind", K.format_value(F.col("values"), F.col("dt"), F.col("cls")).alias("value")
    )


@query(
    "h15_h17_valid_values",
    store_sql(f"""SELECT statement_id, CASE WHEN label = 'Dates' THEN len(list_filter({_ITEMS}, lambda v: regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}'))) > 0 END AS has_date,
  CASE WHEN label = 'Price' THEN len(list_filter({_ITEMS}, lambda v: v <> '' AND NOT regexp_matches(v, '^\\d+(\\.\\d+)?$'))) = 0 END AS good_price FROM star WHERE label IN ('Dates', 'Price')"""),
)
def h15(spark, sf):
    rows = _values(spark, sf, "label in ('Dates', 'Price')")
    return rows.select(
        "statement_id",
        F.when(F.col("label") == "Dates", V.any_valid_date(V.ensure_array("cache"))).alias("has_date"),
        F.when(F.col("label") == "Price", V.prices_ok(V.to_array("cache"))).alias("good_price"),
    )


@query(
    "h16_first_dates",
    store_sql(f"""SELECT statement_id, coalesce(nullif(regexp_extract(cache, '{D.FIRST_DATE}'), ''), '2002-06-01T00:00:00') AS first_date FROM star WHERE label = 'Dates'"""),
)
def h16(spark, sf):
    return _values(spark, sf, "label = 'Dates'").select("statement_id", D.first_valid_date("cache", AS_OF).alias("first_date"))


@query("h18_squished_texts", r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s ]+', ' ', 'g'))) AS digest FROM documents")
def h18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(V.squish("text")).alias("digest"))


@query(
    "h20_json_diff",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'only left' WHEN event_id % 4 = 1 THEN 'differs' END AS change FROM events WHERE event_id % 4 IN (0, 1)""",
)
def h20(spark, sf):
    """Props on one side; the same with other key order, other bookkeeping, one changed."""
    events = table(spark, sf, "events")
    body = F.regexp_extract("props", r"^\{(.*)\}$", 1)
    left = events.select("event_id", F.concat(F.lit('{"z":[1,2],"updated_at":"a",'), body, F.lit("}")).alias("json"))
    z = F.when(F.col("event_id") % 4 == 1, "[2,1]").otherwise("[1,2]")
    right = events.filter("event_id % 4 <> 0").select(
        "event_id", F.concat(F.lit("{"), body, F.lit(',"created_at":"b","z": '), z, F.lit("}")).alias("json")
    )
    return N.json_diff(left, right, "event_id")


@query(
    "h22_h24_local_names",
    store_sql("SELECT DISTINCT predicate, regexp_extract(predicate, '[^/]*$') AS local_name, starts_with(cache, '[') AS link_text FROM star WHERE value_datatype = 'xsd:anyURI'"),
)
def h22(spark, sf):
    rows = _values(spark, sf, "value_datatype = 'xsd:anyURI'")
    return rows.select(
        "predicate", V.local_name("predicate").alias("local_name"), V.is_link_text(F.array("cache")).alias("link_text")
    ).distinct()


@query("h23_instance_ids", f"SELECT c_custkey, '{DEFAULT.mint_prefix}' || sha256(c_name) AS id FROM customer")
def h23(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", V.instance_id("c_name").alias("id"))


@query("g3_list_minus", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_partkey % 2 = 0 THEN 'a,a,c' ELSE 'b,c' END AS kept FROM lineitem")
def g3(spark, sf):
    items = F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("c"))
    gone = F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.array_join(V.list_minus(items, gone), ",").alias("kept")
    )
