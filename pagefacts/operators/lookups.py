"""Lists and lookups over the store, and its validity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.functions import values as V
from pagefacts.functions.dates import timespan
from pagefacts.operators.rollups import missing_required, nested_statements
from pagefacts.operators.star import pages, rules, star
from pagefacts.sources.store import Store
from pagefacts.vocab import STATUSES


def websites(store: Store, q: str | None = None) -> DataFrame:
    """Websites whose name contains a text, else all, by name."""
    rows = store.websites
    return rows.filter(F.contains("name", F.lit(q))) if q else rows.orderBy("name")


def site_rules(store: Store, seedurl: str | None = None, ordered: bool = True) -> DataFrame:
    """Rules of a site: selected first, then property and language."""
    sites = store.websites.select(F.col("id").alias("rule_website_id"), "seedurl")
    rows = rules(store).join(sites, "rule_website_id")
    if seedurl:
        rows = rows.filter(F.col("seedurl") == seedurl)
    order = [F.col("selected").desc(), F.col("property_id"), F.col("rule_language")]
    return rows.orderBy(*order) if ordered else rows


def output_decision(store: Store, flat: DataFrame | None = None) -> DataFrame:
    """What each page's markup should be: nothing, a message, its own frame or the
    frame of its class. ``flat`` are the rows of the star join, made here when not given."""
    flat = star(store) if flat is None else flat
    nested = nested_statements(flat).filter("role = 'selected'").drop("role")
    shown = nested.join(
        flat.select("statement_id", "label", "predicate", "rdfs_class_name"), "statement_id"
    )
    # the labels of the required fields are few (name, startDate, location), so the list is short
    issues = (
        missing_required(shown)
        .groupBy("rdf_uri")
        .agg(F.array_sort(F.collect_set("label")).alias("labels"))
    )
    frames = store.jsonld_outputs.select(F.col("id").alias("jsonld_output_id"), "frame")
    page = pages(store).join(frames, "jsonld_output_id", "left").join(issues, "rdf_uri", "left")
    decision = (
        F.when(F.col("jsonld_output_id") == 1, "none")
        .when(F.col("labels").isNotNull(), "message")
        .when(F.col("frame").isNotNull(), "own frame")
        .otherwise("class frame")
    )
    # Fixed values, here and in unknown_pages: the messages that take the place of markup.
    message = F.when(
        decision == "message",
        F.concat(
            F.lit("Event needs review in the console. Issues with "), F.array_join("labels", ", "), F.lit(".")
        ),
    )
    return page.select(
        "webpage_id", "url", "rdf_uri", "page_class", decision.alias("decision"), message.alias("message"), "frame"
    )


def unknown_pages(store: Store, asked: DataFrame) -> DataFrame:
    """Asked URLs that are no page of the store, with the message to show."""
    known = store.webpages.select("url").distinct()
    return (
        asked.select("url")
        .distinct()
        .join(known, "url", "left_anti")
        .withColumn("message", F.lit("Webpage fits URL pattern but has no events in the console."))
    )


def validate_store(store: Store) -> DataFrame:
    """Rows that break the store's rules, one row per violation."""

    def bad(df: DataFrame, table: str, rule: str, key: str, test) -> DataFrame:
        return df.filter(F.coalesce(test, F.lit(True))).select(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key")
        )

    def repeated(df: DataFrame, table: str, *cols: str) -> DataFrame:
        return (
            df.groupBy(*cols)
            .agg(F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
            .select(
                F.lit(table).alias("table_name"),
                F.lit("unique " + ", ".join(cols)).alias("rule"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"),
            )
        )

    w = store.websites
    parts = [
        bad(w, "websites", "default_language", "id", ~F.col("default_language").isin("en", "fr")),
        bad(w, "websites", "graph_name", "id", ~F.col("graph_name").rlike(r"\Ahttp.*\..*\w\z")),
        bad(store.webpages, "webpages", "rdf_uri", "id", V.is_blank("rdf_uri")),
        bad(store.jsonld_outputs, "jsonld_outputs", "frame", "id", V.is_blank("frame")),
        bad(store.statements, "statements", "status", "id", ~F.col("status").isin(*STATUSES)),
        repeated(store.webpages, "webpages", "url", "website_id"),
        repeated(store.statements, "statements", "source_id", "webpage_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page_statements(store: Store, url: str) -> DataFrame:
    """Statements of one page."""
    return star(store).filter(F.col("url") == url)


def page_urls(store: Store, rdf_uri: str) -> DataFrame:
    """Addresses of one resource."""
    return store.webpages.filter(F.col("rdf_uri") == rdf_uri).select("rdf_uri", "url", "language")


def resource_uris(store: Store, seedurl: str | None = None, cls: str | None = None) -> DataFrame:
    """Resources by site and class with the first name of their first page."""
    page = pages(store)
    if seedurl:
        page = page.filter(F.col("seedurl") == seedurl)
    if cls:
        page = page.filter(F.col("page_class") == cls)
    listed = page.select("seedurl", "page_class", "rdf_uri").distinct()
    first = store.webpages.groupBy("rdf_uri").agg(F.min("id").alias("webpage_id"))
    named = rules(store).filter("label = 'Name'").select("source_id")
    names = (
        store.statements.join(named, "source_id")
        .groupBy("webpage_id")
        .agg(F.min_by("cache", "id").alias("name"))
    )
    return listed.join(first, "rdf_uri").join(names, "webpage_id", "left").select(
        "seedurl", "page_class", "rdf_uri", "name"
    )


def other_entities(store: Store, seedurl: str | None = None, flat: DataFrame | None = None) -> DataFrame:
    """Resources that are no events and have a selected statement; ``flat`` may hold the star join's rows."""
    rows = (star(store) if flat is None else flat).filter(F.col("selected_individual") & (F.col("page_class") != "Event"))
    if seedurl:
        rows = rows.filter(F.col("seedurl") == seedurl)
    return rows.select("seedurl", "rdf_uri").distinct()


def uri_statements(store: Store, uris: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """Selected statements of all pages of the given resources; ``flat`` may hold the star join's rows."""
    return (
        (star(store) if flat is None else flat)
        .filter("selected_individual")
        .join(uris.select("rdf_uri").distinct(), "rdf_uri", "left_semi")
    )


def places(store: Store, seedurl: str | None = None) -> DataFrame:
    """C11: link groups of the location statements of a site, one row per group;
    a value that holds no groups is kept as the text of one."""
    rows = star(store).filter(
        F.col("selected") & (F.col("label") == "Location") & (F.col("rdfs_class_name") == "Event")
    )
    if seedurl:
        rows = rows.filter(F.col("seedurl") == seedurl)
    bare = F.struct(
        F.col("cache").alias("search"),
        F.lit(None).cast("string").alias("class"),
        F.array().cast("array<struct<label:string,uri:string>>").alias("links"),
    )
    groups = V.parse_links("cache")
    shown = F.when(F.size(groups) > 0, groups).otherwise(F.array(bare))
    return rows.select(
        "rdf_uri",
        "seedurl",
        F.col("rule_language").alias("language"),
        "url",
        "statement_id",
        F.posexplode(shown).alias("pos", "g"),
    ).select(
        "statement_id", "rdf_uri", "seedurl", "language", "url", "pos",
        F.col("g.search").alias("search"), F.col("g.class").alias("class"), F.size("g.links").alias("n_links"),
    )


def source_report(
    store: Store, source_id: int | None, start: str | None, end: str | None, as_of: str, ordered: bool = True,
    titles_in_range: bool = True,
) -> DataFrame:
    """Statements of a rule in an archive range with the event's title and date.

    Titles are looked up for the pages of the same range, so none is missing; with
    ``titles_in_range=False`` all pages are asked.
    """
    rows = star(store).filter(timespan("archive_date", start, end, as_of, months=18))
    if source_id is not None:
        rows = rows.filter(F.col("source_id") == source_id)
    title_rules = rules(store).filter("label = 'Title' and selected").select("source_id", F.col("rule_website_id").alias("website_id"))
    pages = store.webpages.filter(timespan("archive_date", start, end, as_of, months=18)) if titles_in_range else store.webpages
    near_pages = pages.select(F.col("id").alias("webpage_id"), "website_id")
    titles = (
        store.statements.join(title_rules, "source_id")
        .join(near_pages, ["webpage_id", "website_id"])
        .groupBy("webpage_id")
        .agg(F.min("cache").alias("event_title"))
    )
    is_event = F.col("page_class") == "Event"
    out = rows.join(titles, "webpage_id", "left").select(
        "statement_id",
        "source_id",
        "cache",
        "event_title",
        F.when(is_event, F.col("archive_date")).alias("event_archive_date"),
        F.when(is_event, F.col("rdf_uri")).alias("rdf_uri"),
    )
    return out.orderBy("cache") if ordered else out


def next_to_review(store: Store, seedurl: str | None = None) -> DataFrame:
    """Per site the event whose statement has waited longest for a review."""
    rows = star(store).filter(
        F.col("selected") & (F.col("page_class") == "Event") & F.col("status").isin("initial", "updated")
    )
    if seedurl:
        rows = rows.filter(F.col("seedurl") == seedurl)
    return rows.groupBy("seedurl").agg(
        F.min(F.struct("created_at", "rdf_uri"))["rdf_uri"].alias("rdf_uri"),
        F.min("created_at").alias("created_at"),
    )


