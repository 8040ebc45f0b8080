"""Roll-ups of statements by event, page and website.

Counting aggregates are numeric, so they run as hash aggregates with a map-side
part; values are picked with ``max_by``/``min_by`` over the statement id, never by
collecting a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.functions import dates as D
from pagefacts.functions import values as V
from pagefacts.operators.star import pages, rules, star
from pagefacts.sources.store import Store
from pagefacts.vocab import REVIEWED, SCHEMA

REQUIRED = (SCHEMA + "name", SCHEMA + "startDate", SCHEMA + "location")


def as_time(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _reviewed(col: str = "status") -> Column:
    return F.col(col).isin(*REVIEWED)


def _event_statements(
    store: Store, seedurl: str | None, start: str | None, end: str | None
) -> DataFrame:
    rows = star(store).filter(F.col("selected_individual") & (F.col("page_class") == "Event"))
    if seedurl:
        rows = rows.filter(F.col("seedurl") == seedurl)
    if start:
        rows = rows.filter(F.col("archive_date") >= as_time(start))
    if end:
        rows = rows.filter(F.col("archive_date") <= as_time(end))
    return rows


def statements_by_event(
    store: Store, seedurl: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """D3: one row per event and key; a second selected statement makes it a problem
    and the newest statement (by id) gives the value."""
    rows = _event_statements(store, seedurl, start, end)
    grouped = rows.groupBy(
        "seedurl", "rdf_uri", V.make_key("label", "rule_language").alias("key")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct("cache", "status"), "statement_id").alias("last"),
        F.min("statement_id").alias("first_id"),
        F.min_by("archive_date", "statement_id").alias("first_archive"),
    )
    return grouped.select(
        "seedurl",
        "rdf_uri",
        "key",
        F.col("last.cache").alias("cache"),
        F.when(F.col("n") > 1, "problem").otherwise(F.col("last.status")).alias("status"),
        "n",
        "first_id",
        "first_archive",
    )


def event_index(
    store: Store,
    as_of: str,
    seedurl: str | None = None,
    start: str | None = None,
    end: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """One row per event with review flags, title, first date and archive date."""
    by_key = statements_by_event(store, seedurl, start, end)
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("cache")))
    has = lambda *keys: F.max(F.col("key").isin(*keys) & _reviewed())
    title = F.coalesce(value("title"), value("title_fr"), value("title_en"))
    events = by_key.groupBy("seedurl", "rdf_uri").agg(
        F.max(F.col("status") == "initial").alias("to_review"),
        F.max(F.col("status") == "updated").alias("updated"),
        F.max(F.col("status") == "problem").alias("problem"),
        (has("dates") & has("location", "virtuallocation") & has("title", "title_fr", "title_en")).alias(
            "publishable"
        ),
        value("photo").alias("photo"),
        F.when(V.is_blank(title) | F.contains(title, F.lit("error:")), "Error")
        .otherwise(title)
        .alias("title"),
        D.first_valid_date(value("dates"), as_of).alias("date"),
        F.max_by("first_archive", "first_id").alias("archive_date"),
    )
    return events.orderBy("archive_date") if ordered else events


# The keys that decide publication; one conditional counter pair each.
_PUBLISH_KEYS = ("dates", "location", "virtuallocation", "title", "title_en", "title_fr")


def publishable_events(store: Store, seedurl: str | None = None, flat: DataFrame | None = None) -> DataFrame:
    """Events with a reviewed date, a reviewed place and a reviewed title.

    A key counts only if exactly one selected statement holds it. Statements are
    first reduced to counters per page, so only one narrow row per page meets the
    page table and moves to its event. ``flat`` may hold the rows of the star join that are selected; they
    have their page's fields and are counted by event at once.
    """
    key = V.make_key("label", "rule_language")
    if flat is None:
        marked = (
            store.statements.filter("selected_individual")
            .select("webpage_id", "source_id", "status")
            .join(rules(store).select("source_id", key.alias("key")), "source_id")
        )
    else:
        marked = flat.filter(F.col("selected_individual") & (F.col("page_class") == "Event")).withColumn("key", key)
        if seedurl:
            marked = marked.filter(F.col("seedurl") == seedurl)
    marked = marked.filter(F.col("key").isin(*_PUBLISH_KEYS))
    counters = []
    for k in _PUBLISH_KEYS:
        counters += [
            F.count_if(F.col("key") == k).alias(f"n_{k}"),
            F.count_if((F.col("key") == k) & _reviewed()).alias(f"ok_{k}"),
        ]
    if flat is None:
        per_page = marked.groupBy("webpage_id").agg(*counters)
        events = pages(store).filter(F.col("page_class") == "Event")
        if seedurl:
            events = events.filter(F.col("seedurl") == seedurl)
        events = events.select("webpage_id", "seedurl", "rdf_uri")
        totals = (
            per_page.join(events, "webpage_id")
            .groupBy("seedurl", "rdf_uri")
            .agg(*[F.sum(f"{m}_{k}").alias(f"{m}_{k}") for k in _PUBLISH_KEYS for m in ("n", "ok")])
        )
    else:
        totals = marked.groupBy("seedurl", "rdf_uri").agg(*counters)
    good = lambda k: (F.col(f"n_{k}") == 1) & (F.col(f"ok_{k}") == 1)
    return totals.filter(
        good("dates")
        & (good("location") | good("virtuallocation"))
        & (good("title_en") | good("title_fr") | good("title"))
    ).select("seedurl", "rdf_uri")


def _marks(rows: str = "") -> dict[str, Column]:
    """What the dashboard counts of a statement whatever the day; ``rows`` is a prefix of its columns."""
    chosen, status = F.col(f"{rows}selected_individual"), F.col(f"{rows}status")
    return {
        "statements": F.lit(True),
        "flags": F.coalesce(chosen & (status == "problem"), F.lit(False)),
        "updated": F.coalesce(chosen & (status == "updated"), F.lit(False)),
    }


#: The columns of a statement that the counters read.
COUNTED = ("selected_individual", "status")


def page_counters(statements: DataFrame) -> DataFrame:
    """Counters of each page for the dashboard: webpage_id, statements, flags, updated."""
    return statements.groupBy("webpage_id").agg(*[F.count_if(test).alias(name) for name, test in _marks().items()])


def update_counters(counters: DataFrame, changes: DataFrame) -> DataFrame:
    """The counters after a feed of changes (``StatementLog.changes`` with the columns ``COUNTED``): only what changed is
    read, and once for both of its sides."""
    was, now = _marks("before."), _marks("after.")
    n = lambda side, test: F.when(F.col(side).isNotNull(), test.cast("long")).otherwise(F.lit(0))
    moved = changes.select("webpage_id", *[(n("after", now[k]) - n("before", was[k])).alias(k) for k in now])
    rows = counters.unionByName(moved)
    return rows.groupBy("webpage_id").agg(*[F.sum(name).alias(name) for name in _marks()])


def site_dashboard(store: Store, as_of: str, counters: DataFrame | None = None) -> DataFrame:
    """Counters per website in one pass over the statements.

    Counted per page first: the many statements of a large site are reduced before
    anything is moved by site. With ``counters`` that were kept up by changes, only the
    statements of the last day are read.
    """
    now = as_time(as_of)
    day = F.expr("interval 24 hours")
    recent = lambda c: (F.col(c) >= now - day) & (F.col(c) <= now)
    new = [F.count_if(recent("cache_refreshed")).alias("refreshed"), F.count_if(recent("cache_changed")).alias("changed")]
    if counters is None:
        marks = [F.count_if(test).alias(name) for name, test in _marks().items()]
        per_page = store.statements.groupBy("webpage_id").agg(*marks, *new)
    else:
        late = store.statements.filter(recent("cache_refreshed") | recent("cache_changed")).groupBy("webpage_id").agg(*new)
        per_page = counters.join(late, "webpage_id", "left")
    page = pages(store).select("webpage_id", "website_id", (F.col("page_class") == "Event").alias("is_event"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    per_site = (
        page.join(per_page, "webpage_id", "left")
        .groupBy("website_id")
        .agg(
            F.sum(n("statements")).alias("statements"),
            F.sum(n("refreshed")).alias("refreshed_24h"),
            F.sum(n("changed")).alias("changed_24h"),
            F.count(F.lit(1)).alias("webpages"),
            F.sum(F.when(F.col("is_event"), n("flags")).otherwise(0)).alias("flags"),
            F.sum(F.when(F.col("is_event"), n("updated")).otherwise(0)).alias("updated"),
        )
    )
    sites = store.websites.select(F.col("id").alias("website_id"), "name", "seedurl")
    return sites.join(per_site, "website_id", "left").select(
        "name",
        "seedurl",
        F.nullif("statements", F.lit(0)).alias("statements"),
        n("refreshed_24h").alias("refreshed_24h"),
        n("changed_24h").alias("changed_24h"),
        "webpages",
        F.nullif("flags", F.lit(0)).alias("flags"),
        F.nullif("updated", F.lit(0)).alias("updated"),
    )


def global_counts(store: Store, as_of: str) -> DataFrame:
    """All statements, and those with an error refreshed in the last day."""
    now = as_time(as_of)
    recent = (F.col("cache_refreshed") >= now - F.expr("interval 24 hours")) & (
        F.col("cache_refreshed") <= now
    )
    return store.statements.agg(
        F.count(F.lit(1)).alias("total_statements"),
        F.count_if(F.contains("cache", F.lit("error")) & recent).alias("error_statements"),
    )


def nested_statements(rows: DataFrame, *keep: str) -> DataFrame:
    """The chosen statement per resource and key, and its alternatives as rows.

    ``role`` is ``selected`` (one row per resource and key that has any selected
    statement) or ``alternative`` (one row each). Two selected statements give
    status ``problem`` and a text naming the first and the last of them. Kept flat:
    a resource may have any number of alternatives, so they are not gathered here.
    """
    keyed = rows.withColumn("key", V.build_key("label", "rule_language"))
    chosen = (
        keyed.filter("selected_individual")
        .groupBy("rdf_uri", "key", *keep)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("statement_id").alias("statement_id"),
            F.max("statement_id").alias("last_id"),
            F.min_by(F.struct("cache", "status"), "statement_id").alias("first"),
        )
        .select(
            "rdf_uri",
            "key",
            *keep,
            F.lit("selected").alias("role"),
            "statement_id",
            F.when(F.col("n") > 1, "problem").otherwise(F.col("first.status")).alias("status"),
            F.when(
                F.col("n") > 1,
                F.concat(
                    F.lit("Duplicate selected properties: "),
                    F.col("statement_id").cast("string"),
                    F.lit(" and "),
                    F.col("last_id").cast("string"),
                ),
            )
            .otherwise(F.col("first.cache"))
            .alias("value"),
        )
    )
    others = keyed.filter(~F.col("selected_individual")).select(
        "rdf_uri",
        "key",
        *keep,
        F.lit("alternative").alias("role"),
        "statement_id",
        "status",
        F.col("cache").alias("value"),
    )
    return chosen.unionByName(others)


def events_by_property(
    store: Store, property_id: int, start: str, end: str, seedurl: str | None = None, title_property: int = 1
) -> DataFrame:
    """Title and one more property of all pages in an archive range, nested per event."""
    rows = star(store).filter(
        F.col("property_id").isin(title_property, property_id)
        & F.col("archive_date").between(as_time(start), as_time(end))
    )
    if seedurl:
        rows = rows.filter(F.col("seedurl") == seedurl)
    dates = rows.groupBy("rdf_uri").agg(
        F.max_by("archive_date", F.struct("webpage_id", "statement_id")).alias("archive_date")
    )
    return nested_statements(rows).join(dates, "rdf_uri")


def resource_status(store: Store) -> DataFrame:
    """Five status counters per resource over selected rules."""
    counted = [
        F.count_if(F.col("selected") & (F.col("status") == s)).alias(s)
        for s in ("initial", "missing", "ok", "updated", "problem")
    ]
    return star(store).groupBy("rdf_uri").agg(*counted)


def webpage_index(store: Store, seedurl: str | None = None) -> DataFrame:
    """Pages with a Yes/No publication mark for event pages.

    The last statement of a selected rule wins per event and label; the date value
    must be longer than three characters.
    """
    facts = star(store).filter(
        F.col("selected")
        & (F.col("rdfs_class_name") == "Event")
        & F.col("label").isin("Location", "Dates", "Title")
    )
    fine = _reviewed() & ((F.col("label") != "Dates") | (F.length("cache") > 3))
    last = facts.groupBy("website_id", "rdf_uri", "label").agg(
        F.max_by(F.coalesce(fine, F.lit(False)), "statement_id").alias("fine")
    )
    marks = last.groupBy("website_id", "rdf_uri").agg(
        (F.count(F.lit(1)) == 3).alias("complete"), F.min("fine").alias("all_fine")
    )
    page = pages(store)
    if seedurl:
        page = page.filter(F.col("seedurl") == seedurl)
    return page.join(marks, ["website_id", "rdf_uri"], "left").select(
        "webpage_id",
        "url",
        "seedurl",
        "rdf_uri",
        "archive_date",
        F.when(
            F.col("page_class") == "Event",
            F.when(F.col("complete") & F.col("all_fine"), "Yes").otherwise("No"),
        ).alias("publishable"),
    )


def missing_required(flat: DataFrame) -> DataFrame:
    """Problem statements of events; a reviewed virtual location clears missing places.

    Works on nested or flat statements with label, predicate, status and value.
    """
    value = F.col("value")
    filled = ~F.coalesce(V.is_empty_value(value), F.lit(True))
    problem = (
        (F.col("rdfs_class_name") == "Event")
        & F.col("predicate").isin(*REQUIRED)
        & (~_reviewed() | ~filled)
    )
    virtual = (
        flat.filter((F.col("label") == "VirtualLocation") & _reviewed() & filled)
        .groupBy("rdf_uri")
        .agg(F.lit(True).alias("has_virtual"))
    )
    return (
        flat.filter(problem)
        .join(virtual, "rdf_uri", "left")
        .filter((F.col("predicate") != SCHEMA + "location") | F.col("has_virtual").isNull())
        .drop("has_virtual")
    )
