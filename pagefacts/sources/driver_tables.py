"""The given tables seen as a statement store (the only module that knows them).

orders are pages (two per resource), nation rows are websites, lineitem rows are
extracted values, supplier/nation/region form the knowledge graph, and events are
a log of newly captured values. ``STORE_SQL`` says the same in plain SQL for the
comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefacts.session import cut_lineage
from pagefacts.sources import schemas
from pagefacts.sources.captures import load_captures
from pagefacts.sources.store import Store
from pagefacts.vocab import DEFAULT, RDF_TYPE, SCHEMA

CLASSES = [(1, "Event"), (2, "Place"), (3, "Organization"), (4, "Offer"), (5, "Person")]
PROPERTIES = [
    (1, "Title", "", SCHEMA + "name", 1, ""),
    (2, "Dates", "xsd:dateTime", SCHEMA + "startDate", 1, ""),
    (3, "Location", "xsd:anyURI", SCHEMA + "location", 1, "Place"),
    (4, "Price", "", SCHEMA + "price", 4, ""),
    (5, "Description", "", SCHEMA + "description", 1, ""),
    (6, "Photo", "", SCHEMA + "image", 1, ""),
    (7, "Performed by", "xsd:anyURI", SCHEMA + "performer", 1, "Organization"),
    (8, "Name", "", SCHEMA + "name", 2, ""),
    (9, "Name", "", SCHEMA + "name", 3, ""),
    (10, "Disambiguating Description", "", SCHEMA + "disambiguatingDescription", 2, ""),
    (11, "Disambiguating Description", "", SCHEMA + "disambiguatingDescription", 3, ""),
    (12, "Offers", "bnode", SCHEMA + "offers", 1, "Offer"),
    (13, "Sub event", "bnode", SCHEMA + "subEvent", 1, "Event"),
    (14, "End date", "xsd:dateTime", SCHEMA + "endDate", 1, ""),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows as a local relation. Unlike rows sent from Python its size is known
    to the planner, so it is broadcast by the usual size check instead of making the large
    side move by a column of few values."""

    def literal(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(v).lower() if isinstance(v, bool) else str(v)

    fields = [f.split() for f in schema.split(", ")]
    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"cast({name} as {kind}) as {name}" for name, kind in fields)
    return spark.sql(f"select {casts} from values {values} as t({', '.join(name for name, _ in fields)})")


def _kg_uri(key: str) -> str:
    return f"concat('{DEFAULT.kg_base}', if(({key}) % 2 = 0, 'K', 'S'), cast({key} as string))"


def _supplier(key: str) -> str:
    return f"concat('Supplier#', lpad(cast({key} as string), 9, '0'))"


def websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) as id",
        "n_name as name",
        "lower(n_name) as seedurl",
        "if(n_nationkey % 10 = 9, 'kg-example', concat('http://kg.example.org/g', n_nationkey)) as graph_name",
        "if(n_nationkey % 2 = 0, 'en', 'fr') as default_language",
        "cast(n_nationkey % 4 as int) as schedule_every_days",
        "if(n_nationkey % 6 <> 5, timestamp_ntz'2001-08-02 00:00:00' - make_dt_interval(0, n_nationkey * 7), null) "
        "as last_refresh",
        "concat(lpad(n_nationkey % 24, 2, '0'), ':30') as schedule_time",
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 rules per website: seven properties, three rules each."""
    rules = table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) as website_id", "n_nationkey % 5 as kind", "explode(sequence(0, 20)) as i"
    )
    return rules.selectExpr("website_id", "kind", "i div 3 + 1 as line", "i % 3 as m").selectExpr(
        "website_id * 100 + line * 10 + m as id",
        """case when m = 2 then concat('manual=Rule ', line)
             when line = 1 then if(m = 0, 'xpath=//title', 'xpath=//h1')
             when line = 2 then 'xpath=//time/@datetime;time_zone=Eastern Time (US & Canada)'
             when line = 5 then 'if_xpath=//article;css=article p'
             when line = 6 then 'xpath=//nav//a/@href'
             else 'xpath_sanitize=(//article/p)[1];ruby=$array.first' end as algorithm_value""",
        "m <> 2 as selected",
        "cast(null as string) as selected_by",
        "case when line in (1, 5) and m = 0 then 'en' when line in (1, 5) and m = 1 then 'fr' else '' end as language",
        "false as render_js",
        """cast(case when line = 1 and kind = 3 then 8 when line = 1 and kind = 4 then 9
             when line = 5 and kind = 3 then 10 when line = 5 and kind = 4 then 11
             when line = 6 and m = 1 and kind not in (3, 4) then 14 else line end as bigint) as property_id""",
        "website_id",
        "concat('rule ', line) as label",
        "(website_id + line) % 4 = 0 as auto_review",
    )


def webpages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "o_orderdate", "o_orderkey div 2 as res", "(o_orderkey div 2) % 25 as site"
    )
    return orders.selectExpr(
        "id",
        "concat('http://site', site, '.example/p/', id) as url",
        "if(id % 2 = 0, 'en', 'fr') as language",
        "concat('adr:r', res) as rdf_uri",
        "cast(case res % 5 when 3 then 2 when 4 then 3 else 1 end as bigint) as rdfs_class_id",
        "cast(site as bigint) as website_id",
        "cast(o_orderdate as timestamp_ntz) as archive_date",
        "cast(case id % 50 when 0 then 1 when 2 then 2 end as bigint) as jsonld_output_id",
    )


def _group(key: str, cls: str, linked: bool = True) -> str:
    name = _supplier(key)
    link = f""", ',["', {name}, '","', {_kg_uri(key)}, '"]'""" if linked else ""
    return f"""concat('["', {name}, '","{cls}"'{link}, ']')"""


def _manual(mark: str, key: str) -> str:
    return f"""concat('["{mark}","Place",["', {_supplier(key)}, '","', {_kg_uri(key)}, '"]]')"""


def _location() -> str:
    k, nxt = "l_suppkey", "l_suppkey + 1"
    one, bare = _group(k, "Place"), _group(k, "Place", linked=False)
    pair = lambda a, b: f"concat('[', {a}, ',', {b}, ']')"
    return f"""case l_partkey % 10
      when 0 then {pair(one, _manual("Manually deleted", nxt))}
      when 1 then {bare}
      when 2 then {pair(bare, _manual("Manually added", nxt))}
      when 3 then {pair(one, _group(nxt, "Place"))}
      when 4 then {pair(one, _group(nxt, "Place"))}
      when 5 then {pair(one, _manual("Manually deleted", k))}
      else {one} end"""


def _dates(time: str) -> str:
    at = lambda d: f"concat(cast(date_add(cast(l_shipdate as date), {d}) as string), 'T{time}-04:00')"
    return f"""if(l_quantity > 25, concat('["', {at(0)}, '","', {at(1)}, '"]'), {at(0)})"""


def _cache() -> str:
    return f"""case l_linenumber
      when 1 then if(l_tax = 0.08, '', p_name)
      when 2 then if(l_partkey % 17 = 0, 'error: no date', {_dates("20:00:00")})
      when 3 then {_location()}
      when 4 then case when l_discount = 0 then 'NaN'
        when l_partkey % 5 = 0 then concat('["', cast(l_quantity as bigint), '","","12.5"]')
        else cast(cast(l_quantity as bigint) as string) end
      when 5 then if(l_tax = 0, '["abort_update",{{"error":"timeout"}}]', p_type)
      when 6 then if(l_suppkey % 3 = 1 and (l_orderkey div 2) % 5 not in (3, 4), {_dates("22:00:00")},
        concat('http://img.example.org/', l_partkey, '.jpg'))
      when 7 then {_group("l_suppkey", "Organization")} end"""


def statements(spark: SparkSession, sf_dir: str, with_cache: bool = True) -> DataFrame:
    """Newest value per (page, rule). The top-1 filter is pushed below the shuffle,
    so a page or rule with very many rows is reduced on the map side."""
    newest = Window.partitionBy("l_orderkey", "l_linenumber", "m").orderBy(
        F.col("l_shipdate").desc(), "l_partkey", "l_suppkey", "l_extendedprice"
    )
    rows = (
        table(spark, sf_dir, "lineitem")
        .withColumns({"m": F.expr("l_suppkey % 3")})
        .withColumn("_rn", F.row_number().over(newest))
        .filter("_rn = 1")
    )
    if with_cache:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
        rows = rows.join(part, rows.l_partkey == part.p_partkey)
    return rows.selectExpr(
        "l_orderkey * 100 + l_linenumber * 10 + m as id",
        f"{_cache() if with_cache else 'cast(null as string)'} as cache",
        """case concat(l_returnflag, l_linestatus) when 'AF' then 'ok' when 'NO' then 'ok' when 'AO' then 'updated'
             when 'RO' then 'updated' when 'NF' then 'initial' else 'problem' end as status""",
        f"if(l_tax > 0.04, '{DEFAULT.origin_refresh}', 'review') as status_origin",
        "l_shipdate + interval 1 day as cache_refreshed",
        "l_shipdate as cache_changed",
        "l_shipdate - interval 1 day as created_at",
        "cast(((l_orderkey div 2) % 25) * 100 + l_linenumber * 10 + m as bigint) as source_id",
        "l_orderkey as webpage_id",
        "m <> 2 as selected_individual",
        "l_quantity > 45 as manual",
    )


def _exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .filter("p_partkey % 40 = 7")
        .selectExpr(
            "p_name as name",
            "cast(if(p_partkey % 80 = 7, 2, 3) as bigint) as rdfs_class_id",
            "cast(null as string) as uri",
        )
        .distinct()
    )


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .selectExpr("props as message", "concat('user ', user_id) as artifact", "ts as created_at")
    )


OUTPUTS = [(1, "none", "{}"), (2, "short", '{"@explicit":true,"name":{},"startDate":{}}')]


def driver_store(spark: SparkSession, sf_dir: str, with_cache: bool = True) -> Store:
    """The store over the given tables; ``with_cache=False`` leaves the values out, for
    queries that never read them."""
    return Store(
        websites=lambda: websites(spark, sf_dir),
        rdfs_classes=lambda: literal_rows(spark, CLASSES, schemas.RDFS_CLASSES),
        properties=lambda: literal_rows(spark, PROPERTIES, schemas.PROPERTIES),
        sources=lambda: sources(spark, sf_dir),
        webpages=lambda: webpages(spark, sf_dir),
        statements=lambda: statements(spark, sf_dir, with_cache),
        search_exceptions=lambda: _exceptions(spark, sf_dir),
        jsonld_outputs=lambda: literal_rows(spark, OUTPUTS, schemas.JSONLD_OUTPUTS),
        messages=lambda: _messages(spark, sf_dir),
    )


def stored(store: Store) -> Store:
    """The store with its newest statements written once, for jobs that read them several times."""
    return store.with_(statements=cut_lineage(store.statements, "statements"))


def knowledge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier, nation and region as graph rows; one exploded select, so one pass."""
    rows = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr("s_suppkey as k", f"{_kg_uri('s_suppkey')} as uri", "s_name", "n_name", "r_name")
    )
    cls = "case k % 3 when 0 then 'Organization' when 1 then 'Person' else 'Place' end"
    address = "concat(uri, '#PostalAddress')"

    def row(s: str, p: str, o: str, kind: str = "literal", lang: str = "", when: str | None = None) -> str:
        text = f"named_struct('s', {s}, 'p', '{p}', 'o', {o}, 'o_kind', '{kind}', 'lang', '{lang}')"
        return f"if({when}, {text}, null)" if when else text

    facts = [
        row("uri", RDF_TYPE, f"concat('{SCHEMA}', {cls})", "uri"),
        row("uri", RDF_TYPE, f"'{DEFAULT.ontology_base}Venue'", "uri", when="k % 3 = 2"),
        row("uri", SCHEMA + "name", "s_name", lang="en", when="k % 4 = 0"),
        row("uri", SCHEMA + "name", "s_name", lang="fr", when="k % 4 <= 1"),
        row("uri", SCHEMA + "name", "s_name", when="k % 4 >= 2"),
        row("uri", SCHEMA + "alternateName", "concat('House ', s_name)", when="k % 7 = 0"),
        row("uri", SCHEMA + "address", address, "uri"),
        row(address, RDF_TYPE, f"'{SCHEMA}PostalAddress'", "uri"),
        row(address, SCHEMA + "addressCountry", "n_name"),
        row(address, SCHEMA + "addressRegion", "r_name"),
    ]
    return rows.selectExpr(f"inline(filter(array({', '.join(facts)}), t -> t is not null))").selectExpr(
        "'' as graph_id", "*", "'' as datatype", "cast(null as int) as pos"
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_captures(spark, f"{sf_dir}/pages.parquet")


_P = "\n".join(
    f"    ({i}, '{label}', '{dt}', '{uri}', {cls}, '{exp}')," for i, label, dt, uri, cls, exp in PROPERTIES
).rstrip(",")
_C = ", ".join(f"({i}, '{n}')" for i, n in CLASSES)
_SUP = "'Supplier#' || lpad(CAST({k} AS VARCHAR), 9, '0')"
_URI = "'" + DEFAULT.kg_base + "' || CASE WHEN ({k}) % 2 = 0 THEN 'K' ELSE 'S' END || CAST({k} AS VARCHAR)"
_S1, _S2 = _SUP.format(k="l_suppkey"), _SUP.format(k="(l_suppkey + 1)")
_U1, _U2 = _URI.format(k="l_suppkey"), _URI.format(k="(l_suppkey + 1)")
_ONE = f"""'["' || {_S1} || '","Place",["' || {_S1} || '","' || {_U1} || '"]]'"""
_TWO = f"""'["' || {_S2} || '","Place",["' || {_S2} || '","' || {_U2} || '"]]'"""
_BARE = f"""'["' || {_S1} || '","Place"]'"""


def _sql_dates(time: str) -> str:
    d = lambda n: f"strftime(l_shipdate + INTERVAL {n} DAY, '%Y-%m-%d') || 'T{time}-04:00'"
    return f"""CASE WHEN l_quantity > 25 THEN '["' || {d(0)} || '","' || {d(1)} || '"]' ELSE {d(0)} END"""


STORE_SQL = f"""
websites AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, lower(n_name) AS seedurl,
    CASE WHEN n_nationkey % 10 = 9 THEN 'kg-example' ELSE 'http://kg.example.org/g' || n_nationkey END AS graph_name,
    CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END AS default_language,
    n_nationkey % 4 AS schedule_every_days,
    CASE WHEN n_nationkey % 6 <> 5 THEN TIMESTAMP '2001-08-02 00:00:00' - to_hours(n_nationkey * 7) END AS last_refresh,
    lpad(CAST(n_nationkey % 24 AS VARCHAR), 2, '0') || ':30' AS schedule_time
  FROM nation),
rdfs_classes AS (SELECT * FROM (VALUES {_C}) t(id, name)),
properties AS (SELECT * FROM (VALUES
{_P}
  ) t(id, label, value_datatype, uri, rdfs_class_id, expected_class)),
sources AS (
  SELECT w * 100 + line * 10 + m AS id,
    CASE WHEN m = 2 THEN 'manual=Rule ' || line
      WHEN line = 1 THEN CASE WHEN m = 0 THEN 'xpath=//title' ELSE 'xpath=//h1' END
      WHEN line = 2 THEN 'xpath=//time/@datetime;time_zone=Eastern Time (US & Canada)'
      WHEN line = 5 THEN 'if_xpath=//article;css=article p'
      WHEN line = 6 THEN 'xpath=//nav//a/@href'
      ELSE 'xpath_sanitize=(//article/p)[1];ruby=$array.first' END AS algorithm_value,
    m <> 2 AS selected,
    CASE WHEN line IN (1, 5) THEN CASE m WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE '' END ELSE '' END AS language,
    CAST(CASE WHEN line = 1 AND w % 5 = 3 THEN 8 WHEN line = 1 AND w % 5 = 4 THEN 9
      WHEN line = 5 AND w % 5 = 3 THEN 10 WHEN line = 5 AND w % 5 = 4 THEN 11
      WHEN line = 6 AND m = 1 AND w % 5 NOT IN (3, 4) THEN 14 ELSE line END AS BIGINT) AS property_id,
    w AS website_id, 'rule ' || line AS label, (w + line) % 4 = 0 AS auto_review
  FROM (SELECT CAST(n_nationkey AS BIGINT) AS w, unnest(range(1, 8)) AS line FROM nation) a,
       (SELECT unnest(range(0, 3)) AS m) b),
webpages AS (
  SELECT o_orderkey AS id, 'http://site' || (res % 25) || '.example/p/' || o_orderkey AS url,
    CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'fr' END AS language, 'adr:r' || res AS rdf_uri,
    CASE WHEN res % 5 = 3 THEN 2 WHEN res % 5 = 4 THEN 3 ELSE 1 END AS rdfs_class_id,
    res % 25 AS website_id, o_orderdate AS archive_date,
    CASE WHEN o_orderkey % 50 = 0 THEN 1 WHEN o_orderkey % 50 = 2 THEN 2 END AS jsonld_output_id
  FROM (SELECT *, o_orderkey // 2 AS res FROM orders) o),
statements AS (
  SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 3 AS id,
    CASE l_linenumber
      WHEN 1 THEN CASE WHEN l_tax = 0.08 THEN '' ELSE p_name END
      WHEN 2 THEN CASE WHEN l_partkey % 17 = 0 THEN 'error: no date' ELSE {_sql_dates("20:00:00")} END
      WHEN 3 THEN CASE l_partkey % 10
        WHEN 0 THEN '[' || {_ONE} || ',["Manually deleted","Place",["' || {_S2} || '","' || {_U2} || '"]]]'
        WHEN 1 THEN {_BARE}
        WHEN 2 THEN '[' || {_BARE} || ',["Manually added","Place",["' || {_S2} || '","' || {_U2} || '"]]]'
        WHEN 3 THEN '[' || {_ONE} || ',' || {_TWO} || ']'
        WHEN 4 THEN '[' || {_ONE} || ',' || {_TWO} || ']'
        WHEN 5 THEN '[' || {_ONE} || ',["Manually deleted","Place",["' || {_S1} || '","' || {_U1} || '"]]]'
        ELSE {_ONE} END
      WHEN 4 THEN CASE WHEN l_discount = 0 THEN 'NaN'
        WHEN l_partkey % 5 = 0 THEN '["' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '","","12.5"]'
        ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END
      WHEN 5 THEN CASE WHEN l_tax = 0 THEN '["abort_update",{{"error":"timeout"}}]' ELSE p_type END
      WHEN 6 THEN CASE WHEN l_suppkey % 3 = 1 AND (l_orderkey // 2) % 5 NOT IN (3, 4) THEN {_sql_dates("22:00:00")}
        ELSE 'http://img.example.org/' || l_partkey || '.jpg' END
      WHEN 7 THEN '["' || {_S1} || '","Organization",["' || {_S1} || '","' || {_U1} || '"]]' END AS cache,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'ok' WHEN 'NO' THEN 'ok' WHEN 'AO' THEN 'updated'
      WHEN 'RO' THEN 'updated' WHEN 'NF' THEN 'initial' ELSE 'problem' END AS status,
    CASE WHEN l_tax > 0.04 THEN '{DEFAULT.origin_refresh}' ELSE 'review' END AS status_origin,
    l_shipdate + INTERVAL 1 DAY AS cache_refreshed, l_shipdate AS cache_changed,
    l_shipdate - INTERVAL 1 DAY AS created_at,
    ((l_orderkey // 2) % 25) * 100 + l_linenumber * 10 + l_suppkey % 3 AS source_id,
    l_orderkey AS webpage_id, l_suppkey % 3 <> 2 AS selected_individual, l_quantity > 45 AS manual
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey % 3
          ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) l
  JOIN part ON l_partkey = p_partkey WHERE rn = 1),
search_exceptions AS (
  SELECT DISTINCT p_name AS name, CASE WHEN p_partkey % 80 = 7 THEN 2 ELSE 3 END AS rdfs_class_id
  FROM part WHERE p_partkey % 40 = 7),
star AS (
  SELECT st.id AS statement_id, st.cache, st.status, st.status_origin, st.cache_refreshed, st.cache_changed,
    st.created_at, st.source_id, st.webpage_id, st.selected_individual, st.manual,
    so.algorithm_value, so.selected, so.language AS rule_language, so.label AS source_label, so.property_id,
    p.label, p.value_datatype, p.uri AS predicate, p.expected_class, pc.name AS rdfs_class_name,
    w.url, w.language AS page_language, w.rdf_uri, wc.name AS page_class, w.archive_date, w.website_id,
    w.jsonld_output_id, si.seedurl, si.default_language
  FROM statements st JOIN sources so ON st.source_id = so.id JOIN properties p ON so.property_id = p.id
  JOIN rdfs_classes pc ON p.rdfs_class_id = pc.id JOIN webpages w ON st.webpage_id = w.id
  JOIN rdfs_classes wc ON w.rdfs_class_id = wc.id JOIN websites si ON w.website_id = si.id)
"""

KG_SQL = f"""
kg_base AS (
  SELECT {_URI.format(k="s_suppkey")} AS uri, s_suppkey AS k, s_name, n_name, r_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
kg AS (
  SELECT uri AS s, '{RDF_TYPE}' AS p, '{SCHEMA}' || CASE k % 3 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Person' ELSE 'Place' END AS o,
    'uri' AS o_kind, '' AS lang FROM kg_base
  UNION ALL SELECT uri, '{RDF_TYPE}', '{DEFAULT.ontology_base}Venue', 'uri', '' FROM kg_base WHERE k % 3 = 2
  UNION ALL SELECT uri, '{SCHEMA}name', s_name, 'literal', 'en' FROM kg_base WHERE k % 4 = 0
  UNION ALL SELECT uri, '{SCHEMA}name', s_name, 'literal', 'fr' FROM kg_base WHERE k % 4 <= 1
  UNION ALL SELECT uri, '{SCHEMA}name', s_name, 'literal', '' FROM kg_base WHERE k % 4 >= 2
  UNION ALL SELECT uri, '{SCHEMA}alternateName', 'House ' || s_name, 'literal', '' FROM kg_base WHERE k % 7 = 0
  UNION ALL SELECT uri, '{SCHEMA}address', uri || '#PostalAddress', 'uri', '' FROM kg_base
  UNION ALL SELECT uri || '#PostalAddress', '{RDF_TYPE}', '{SCHEMA}PostalAddress', 'uri', '' FROM kg_base
  UNION ALL SELECT uri || '#PostalAddress', '{SCHEMA}addressCountry', n_name, 'literal', '' FROM kg_base
  UNION ALL SELECT uri || '#PostalAddress', '{SCHEMA}addressRegion', r_name, 'literal', '' FROM kg_base)
"""


def store_sql(body: str, *more: str) -> str:
    """A statement over the store tables (and further named blocks)."""
    return "WITH " + ",".join((STORE_SQL, *more)) + body
