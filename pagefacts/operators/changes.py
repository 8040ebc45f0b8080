"""State changes: refresh, review, edits and activation as bulk snapshot updates.

Each function takes the store and a frame of changes and returns the next snapshot.
Changes meet statements by equi-join on their id (or page and rule); nothing is
looped over, and the clock is always the ``as_of`` parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefacts.functions import dates as D
from pagefacts.functions import values as V
from pagefacts.operators.rollups import as_time
from pagefacts.operators.star import rules
from pagefacts.session import cut_lineage
from pagefacts.sources.store import Store
from pagefacts.vocab import ADDED, DEFAULT, DELETED, REVIEWED, Vocabulary

STATEMENT = (
    "id", "cache", "status", "status_origin", "cache_refreshed", "cache_changed", "created_at",
    "source_id", "webpage_id", "selected_individual", "manual",
)
HAND_KEPT = ("Performed by", "Organized by")


def _is(c: Column) -> Column:
    """Null counts as no."""
    return F.coalesce(c, F.lit(False))


def with_rules(store: Store, statements: DataFrame | None = None) -> DataFrame:
    """Statements with the fields of their rule."""
    rows = store.statements if statements is None else statements
    return rows.select(*STATEMENT).join(rules(store), "source_id")


def save_decision(value: Column, status: Column, old: Column, is_new: Column) -> Column:
    """May this extraction result replace the stored value?"""
    old_aborted = V.is_aborted(old)
    return (
        F.when(V.is_aborted(value), _is(status.isin("initial", "problem", "missing")) | old_aborted)
        .when(V.is_blank(value), is_new | old_aborted)
        .otherwise(True)
    )


def with_manual_links(new: Column, old: Column) -> Column:
    """J3 on parsed links: hand-made groups of the old value follow the new groups."""
    manual = F.filter(old, lambda g: F.coalesce(g["search"].isin(ADDED, DELETED), F.lit(False)))
    return F.concat(new, F.coalesce(manual, F.array().cast(V.LINKS)))


def keep_manual_links(new: Column, old: Column) -> Column:
    """J3 on stored texts."""
    kept = with_manual_links(V.parse_links(new), V.parse_links(old))
    return F.when(F.size(kept) == F.size(V.parse_links(new)), new).otherwise(V.links_text(kept))


def apply_callbacks(
    rows: DataFrame,
    saved: Column,
    as_of: str,
    vocab: Vocabulary = DEFAULT,
    only_manual_removed: Column | None = None,
) -> DataFrame:
    """What every save does, in order: J4 change, J5 required values, J7 hand-kept
    labels, J6 abort and price. Rows with ``saved`` false stay as they are.

    Needs the statement columns, ``old_cache``, label and value_datatype; parsed links
    may come along as ``_links`` and ``_old_links``. Archive dates (D11) go to the page
    table; see :func:`archive_dates`. Works in stages, so a parsed value is computed once.
    """
    cache, old, label = F.col("cache"), F.col("old_cache"), F.col("label")
    is_uri = F.col("value_datatype") == "xsd:anyURI"
    stage = {"_saved": saved}  # a second call starts over
    if "_links" not in rows.columns:
        linked = saved & (is_uri | (label == "Location"))
        stage["_links"] = F.when(linked, V.parse_links(cache))
        stage["_old_links"] = F.when(linked & is_uri & ~cache.eqNullSafe(old), V.parse_links(old))
    rows = rows.withColumns(stage)
    links, old_links, was_saved = F.col("_links"), F.col("_old_links"), F.col("_saved")
    same_links = is_uri & old.isNotNull() & (F.array_sort(V.link_uris(old_links)) == F.array_sort(V.link_uris(links)))
    released = F.lit(False) if only_manual_removed is None else _is(only_manual_removed)
    missing = (
        F.when(label == "Location", V.missing_links(links, vocab))
        .when(label == "Dates", ~V.any_valid_date(V.ensure_array(cache)))
        .when(label == "Title", V.is_blank(cache))
        .when(label == "VirtualLocation", V.is_empty_value(cache))
    )
    bad_price = (label == "Price") & ~V.prices_ok(V.to_array(cache))
    rows = rows.withColumns(
        {
            "_changed": was_saved & ~cache.eqNullSafe(old) & ~_is(same_links),
            "_missing": was_saved & _is(missing),
            "_broken": was_saved & (V.is_aborted(cache) | _is(bad_price)),
            "_first_look": _is((F.col("status") == "initial") & (F.col("status_origin") == vocab.origin_refresh)),
            "_by_hand": was_saved & ~F.col("manual") & label.isin(*HAND_KEPT) & ~released,
        }
    )
    changed = F.col("_changed")
    looked = F.when(changed & ~F.col("_first_look"), "updated").otherwise(F.col("status"))
    rows = rows.withColumns(
        {
            "status": F.when(F.col("_missing") & ~looked.eqNullSafe("problem"), "missing").otherwise(looked),
            "cache_changed": F.when(changed, as_time(as_of)).otherwise(F.col("cache_changed")),
            "status_origin": F.when(changed, vocab.origin_refresh).otherwise(F.col("status_origin")),
        }
    )
    return rows.withColumns(
        {
            "manual": F.col("manual") | (F.col("_by_hand") & ~_is(F.col("status").isin("problem", "initial"))),
            "status": F.when(F.col("_broken"), "problem").otherwise(F.col("status")),
        }
    )


def scaffold(store: Store, as_of: str, vocab: Vocabulary = DEFAULT, pairs: DataFrame | None = None) -> DataFrame:
    """Statements that pages should have and do not, as new rows without a value.

    With ``pairs`` (source_id, webpage_id) only these are considered: those that have a
    statement go first, and rules are expanded for the pages that remain.
    """
    known = store.statements.select("source_id", "webpage_id")
    pages = store.webpages
    if pairs is not None:
        pairs = pairs.select("source_id", "webpage_id").distinct().join(known, ["source_id", "webpage_id"], "left_anti")
        pages = pages.join(pairs.select(F.col("webpage_id").alias("id")), "id", "left_semi")
    page = pages.join(
        store.rdfs_classes.select(F.col("id").alias("rdfs_class_id"), F.col("name").alias("page_class")), "rdfs_class_id"
    ).join(
        store.websites.select(F.col("id").alias("website_id"), "default_language"), "website_id"
    )
    wanted = F.when(
        F.col("language") == F.col("default_language"), F.array(F.col("language"), F.lit(""))
    ).otherwise(F.array(F.col("language")))
    page = page.select(
        F.col("id").alias("webpage_id"), "website_id", "page_class", F.explode(wanted).alias("rule_language")
    )
    site_rules = rules(store).join(property_closure(store), "property_id").select(
        "source_id",
        F.col("root_class").alias("page_class"),
        F.col("rule_website_id").alias("website_id"),
        "rule_language",
        "selected",
        "algorithm_value",
    )
    due = page.join(site_rules, ["website_id", "page_class", "rule_language"])
    if pairs is None:
        fresh = due.join(known, ["source_id", "webpage_id"], "left_anti")
    else:
        fresh = due.join(pairs, ["source_id", "webpage_id"], "left_semi")
    null = F.lit(None)
    return fresh.select(
        F.expr("xxhash64(source_id, webpage_id)").alias("id"),
        null.cast("string").alias("cache"),
        F.lit("initial").alias("status"),
        F.lit(vocab.origin_create).alias("status_origin"),
        null.cast("timestamp_ntz").alias("cache_refreshed"),
        null.cast("timestamp_ntz").alias("cache_changed"),
        as_time(as_of).alias("created_at"),
        "source_id",
        "webpage_id",
        F.col("selected").alias("selected_individual"),
        F.startswith("algorithm_value", F.lit("manual=")).alias("manual"),
    )


def property_closure(store: Store) -> DataFrame:
    """All properties per class, following nested classes.

    A recursive query over two small dimensions; a class already on the path is not
    entered again, so cycles end.
    """
    return store.once("closure", lambda: _closure(store))


def _closure(store: Store) -> DataFrame:
    spark = store.properties.sparkSession
    cls = store.rdfs_classes.select("id", "name")
    props = store.properties.select("id", "rdfs_class_id", "value_datatype", "expected_class")
    return spark.sql(
        """
        WITH RECURSIVE reach(root_class, class_name, path) AS (
          SELECT name, name, array(name) FROM {cls}
          UNION ALL
          SELECT r.root_class, n.name, concat(r.path, array(n.name))
          FROM reach r
          JOIN {cls} c ON c.name = r.class_name
          JOIN {props} p ON p.rdfs_class_id = c.id AND p.value_datatype = 'bnode' AND p.expected_class <> r.class_name
          JOIN {cls} n ON array_contains(split(p.expected_class, ','), n.name)
          WHERE NOT array_contains(r.path, n.name))
        SELECT DISTINCT r.root_class, p.id AS property_id
        FROM reach r JOIN {cls} c ON c.name = r.class_name JOIN {props} p ON p.rdfs_class_id = c.id
        """,
        cls=cls,
        props=props,
    )


def refresh(store: Store, formatted: DataFrame, as_of: str, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """The next snapshot after a capture run.

    ``formatted`` has one row per (source_id, webpage_id) with ``value`` (stored form,
    H14), ``is_blank`` (nothing was extracted) and ``error``. New statements are
    scaffolded only for pages and rules that were captured.
    """
    new = scaffold(store, as_of, vocab, formatted)
    known = store.statements.select(*STATEMENT).withColumn("is_new", F.lit(False))
    rows = known.unionByName(new.select(*STATEMENT).withColumn("is_new", F.lit(True)))
    captured = formatted.select("source_id", "webpage_id", "value", "is_blank", "error").withColumn(
        "captured", F.lit(True)
    )
    rows = (
        rows.join(rules(store), "source_id")
        .join(captured, ["source_id", "webpage_id"], "left")
        .withColumn("old_cache", F.col("cache"))
    )
    locked = F.col("manual") & _is(F.col("status").isin(*REVIEWED))
    usable = (
        _is(F.col("captured"))
        & ~locked
        & F.col("error").isNull()
        & (F.col("is_new") | ~_is(F.col("is_blank")))
    )
    saved = usable & save_decision(F.col("value"), F.col("status"), F.col("cache"), F.col("is_new"))
    rows = rows.withColumns({"_save": saved, "_open": _is(F.col("captured")) & ~locked})
    # a new statement that is saved neither now nor by automatic review does not come
    # into being; decided here, on plain columns, so the filter stays small when pushed down
    rows = rows.filter(~F.col("is_new") | F.col("_save") | (F.col("auto_review") & F.col("_open")))
    linked = (F.col("value_datatype") == "xsd:anyURI") | (F.col("label") == "Location")
    rows = rows.withColumns(
        {
            "_value_links": F.when(F.col("_save") & linked, V.parse_links("value")),
            "_old_links": F.when(F.col("_open") & linked, V.parse_links("old_cache")),
        }
    )
    kept = with_manual_links(F.col("_value_links"), F.col("_old_links"))
    rows = rows.withColumns({"_links": F.when(F.col("_save"), kept).otherwise(F.col("_old_links"))})
    merged = (F.col("value_datatype") == "xsd:anyURI") & (F.size("_links") > F.size("_value_links"))
    value = F.when(merged, V.links_text(F.col("_links"))).otherwise(F.col("value"))
    rows = rows.withColumns(
        {
            "cache": F.when(F.col("_save"), value).otherwise(F.col("cache")),
            "cache_refreshed": F.when(F.col("_save"), as_time(as_of)).otherwise(F.col("cache_refreshed")),
        }
    )
    rows = apply_callbacks(rows, F.col("_save"), as_of, vocab)
    # Rules with automatic review; the change of status is a save of its own
    auto = _is(F.col("auto_review") & (F.col("status") == "initial") & F.col("_open"))
    rows = rows.withColumns({"_auto": auto, "old_cache": F.col("cache")})
    rows = rows.withColumn("status", F.when(F.col("_auto"), "updated").otherwise(F.col("status")))
    rows = apply_callbacks(rows, F.col("_auto"), as_of, vocab)
    return rows.select(*STATEMENT)


def apply_edits(store: Store, edits: DataFrame, as_of: str, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Direct edits by statement id, one per statement; null columns are not touched.

    ``edits`` has statement_id and any of cache, status, status_origin, manual,
    selected_individual. A new value marks the statement manual unless the edit says.
    """
    editable = ("cache", "status", "status_origin", "manual", "selected_individual")
    given = [c for c in editable if c in edits.columns]
    change = edits.select(
        F.col("statement_id").alias("id"), *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_edited")
    )
    rows = with_rules(store).join(change, "id", "left").withColumn("old_cache", F.col("cache"))
    was_manual = F.col("manual")
    rows = rows.withColumn("_was_manual", was_manual)
    for c in given:
        rows = rows.withColumn(c, F.coalesce(f"_new_{c}", c))
    others = [F.col(f"_new_{c}").isNull() for c in given if c != "manual"]
    released = F.lit(False)
    if "manual" in given:
        released = F.col("_was_manual") & ~F.col("manual")
        for test in others:
            released = released & test
    rows = apply_callbacks(rows, _is(F.col("_edited")), as_of, vocab, released)
    if "cache" in given:
        unsaid = F.col("_new_manual").isNull() if "manual" in given else F.lit(True)
        rows = rows.withColumn("manual", F.col("manual") | (F.col("_new_cache").isNotNull() & unsaid))
    return rows.select(*STATEMENT)


def add_link(groups: Column, label: Column, cls: Column, uri: Column) -> Column:
    """Append a link to the hand-made group of parsed links, or start one."""
    hit = F.struct(label.alias("label"), uri.alias("uri"))
    grown = F.transform(
        groups,
        lambda g: F.when(
            g["search"].eqNullSafe(ADDED),
            F.struct(
                g["search"].alias("search"), g["class"].alias("class"), F.concat(g["links"], F.array(hit)).alias("links")
            ),
        ).otherwise(g),
    )
    fresh = F.struct(F.lit(ADDED).alias("search"), cls.alias("class"), F.array(hit).alias("links"))
    has = F.exists(groups, lambda g: g["search"].eqNullSafe(ADDED))
    return F.when(has, grown).otherwise(F.concat(groups, F.array(fresh)))


def remove_link(groups: Column, label: Column, cls: Column, uri: Column) -> Column:
    """Take a link out of the hand-made groups (empty groups vanish); if it was in
    none, note it as deleted."""
    by_hand = lambda g: F.coalesce(g["search"].isin(ADDED, DELETED), F.lit(False))
    listed = F.exists(groups, lambda g: by_hand(g) & F.exists(g["links"], lambda h: h["uri"].eqNullSafe(uri)))
    without = F.filter(
        F.transform(
            groups,
            lambda g: F.when(
                by_hand(g),
                F.struct(
                    g["search"].alias("search"),
                    g["class"].alias("class"),
                    F.filter(g["links"], lambda h: ~h["uri"].eqNullSafe(uri)).alias("links"),
                ),
            ).otherwise(g),
        ),
        lambda g: ~by_hand(g) | (F.size(g["links"]) > 0),
    )
    hit = F.struct(label.alias("label"), uri.alias("uri"))
    noted = F.transform(
        groups,
        lambda g: F.when(
            g["search"].eqNullSafe(DELETED),
            F.struct(
                g["search"].alias("search"), g["class"].alias("class"), F.concat(g["links"], F.array(hit)).alias("links")
            ),
        ).otherwise(g),
    )
    fresh = F.struct(F.lit(DELETED).alias("search"), cls.alias("class"), F.array(hit).alias("links"))
    has = F.exists(groups, lambda g: g["search"].eqNullSafe(DELETED))
    return F.when(listed, without).when(has, noted).otherwise(F.concat(groups, F.array(fresh)))


def apply_link_edits(
    store: Store, edits: DataFrame, as_of: str, vocab: Vocabulary = DEFAULT
) -> DataFrame:
    """J13/J14 in bulk: edits have statement_id, action (``add``/``remove``), label, class, uri."""
    wanted = edits.join(
        store.statements.select(F.col("id").alias("statement_id"), F.col("cache").alias("_old")), "statement_id"
    )
    wanted = wanted.withColumn("_groups", V.parse_links(F.coalesce("_old", F.lit(""))))
    args = (F.col("_groups"), F.col("label"), F.col("class"), F.col("uri"))
    wanted = wanted.withColumn(
        "_next", F.when(F.col("action") == "add", add_link(*args)).otherwise(remove_link(*args)).cast(V.LINKS)
    )
    changed = wanted.select("statement_id", V.links_text(F.col("_next")).alias("cache"), F.lit("ok").alias("status"))
    return apply_edits(store, changed.withColumn("manual", F.lit(None).cast("boolean")), as_of, vocab)


def activate_sources(
    store: Store, chosen: DataFrame, as_of: str, vocab: Vocabulary = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Make the rules of the given statements the selected ones.

    Returns the next sources and statements. Rules of the same site, property and
    language are switched off with their statements; a page where a reviewer picked a
    statement of another rule keeps that choice (two such picks cancel each other). The
    statements beside a pick are switched off one by one, so the save callbacks run on them.
    """
    group = ["website_id", "property_id", "language"]
    src = store.sources
    picked = (
        store.statements.join(chosen.select(F.col("statement_id").alias("id")).distinct(), "id", "left_semi")
        .select("source_id")
        .distinct()
        .join(src.select(F.col("id").alias("source_id"), *group), "source_id")
        .groupBy(*group)
        .agg(F.max("source_id").alias("_chosen"))
    )
    tagged = src.join(picked, group, "left")
    next_sources = tagged.withColumn(
        "selected", F.when(F.col("_chosen").isNull(), F.col("selected")).otherwise(F.col("id") == F.col("_chosen"))
    ).select(*src.columns)
    info = tagged.filter("_chosen is not null").select(
        F.col("id").alias("source_id"), "_chosen", F.col("selected").alias("_was_selected"), *group
    )
    rows = store.statements.select(*STATEMENT).join(info, "source_id", "left")
    is_chosen = F.col("source_id") == F.col("_chosen")
    first = (
        F.when(F.col("_chosen").isNull(), F.col("selected_individual"))
        .when(is_chosen, True)
        .when(F.col("_was_selected"), False)
        .otherwise(F.col("selected_individual"))
    )
    rows = rows.withColumn("selected_individual", first).withColumn(
        "_override", F.col("_chosen").isNotNull() & ~_is(is_chosen) & F.col("selected_individual")
    )
    picks = (
        rows.filter("_override")
        .groupBy("webpage_id", *group)
        .agg(F.count(F.lit(1)).alias("_picks"))
        .withColumnsRenamed({g: f"_{g}" for g in group})
    )
    same_slot = (
        (F.col("webpage_id") == F.col("_page"))
        & (F.col("website_id") == F.col("_website_id"))
        & (F.col("property_id") == F.col("_property_id"))
        & F.col("language").eqNullSafe(F.col("_language"))
    )
    rows = rows.join(picks.withColumnRenamed("webpage_id", "_page"), same_slot, "left")
    final = F.when(F.col("_picks").isNull(), F.col("selected_individual")).otherwise(
        F.col("_override") & (F.col("_picks") == 1)
    )
    switched_off = F.col("_picks").isNotNull() & ~_is(final)
    labels = rules(store).select("source_id", "label", "value_datatype")
    rows = (
        rows.withColumn("_hit", switched_off)
        .withColumn("selected_individual", final)
        .withColumn("old_cache", F.col("cache"))
        .join(labels, "source_id", "left")
    )
    return next_sources, apply_callbacks(rows, F.col("_hit"), as_of, vocab).select(*STATEMENT)


def activate_individuals(
    store: Store, chosen: DataFrame, as_of: str, active: bool = True, vocab: Vocabulary = DEFAULT
) -> DataFrame:
    """Choose a statement for its page and property, or fall back to the rules' choice.

    Activating also marks the statements of the selected rules reviewed.
    """
    rows = with_rules(store).withColumn("old_cache", F.col("cache"))
    picked = (
        rows.select("id", "webpage_id", "property_id")
        .join(chosen.select(F.col("statement_id").alias("id")).distinct(), "id", "left_semi")
        .groupBy("webpage_id", "property_id")
        .agg(F.max("id").alias("_chosen"))
    )
    rows = rows.join(picked, ["webpage_id", "property_id"], "left")
    touched = F.col("_chosen").isNotNull()
    mine = F.col("id") == F.col("_chosen")
    if active:
        rows = rows.withColumn(
            "selected_individual", F.when(touched, mine).otherwise(F.col("selected_individual"))
        ).withColumn("status", F.when(touched & ~mine & F.col("selected"), "ok").otherwise(F.col("status")))
    else:
        rows = rows.withColumn(
            "selected_individual", F.when(touched, F.col("selected")).otherwise(F.col("selected_individual"))
        )
    return apply_callbacks(rows, touched, as_of, vocab).select(*STATEMENT)


def review_all(
    store: Store, scope: Column, origin: str, as_of: str, among: tuple[str, ...] = ("ok", "initial", "updated"),
    vocab: Vocabulary = DEFAULT,
) -> DataFrame:
    """Mark statements in ``scope`` reviewed. ``scope`` may use statement, rule and
    page fields; the save callbacks run as for any change."""
    page = store.webpages.select(F.col("id").alias("webpage_id"), "rdf_uri", "website_id", "url")
    rows = with_rules(store).join(page, "webpage_id").withColumn("old_cache", F.col("cache"))
    hit = _is(scope & F.col("status").isin(*among))
    rows = rows.withColumn("_hit", hit)
    rows = rows.withColumn("status", F.when(F.col("_hit"), "ok").otherwise(F.col("status"))).withColumn(
        "status_origin", F.when(F.col("_hit"), origin).otherwise(F.col("status_origin"))
    )
    return apply_callbacks(rows, F.col("_hit"), as_of, vocab).select(*STATEMENT)


def archive_dates(store: Store) -> DataFrame:
    """New archive date per page from reviewed start and end dates.

    Per resource the statement refreshed last decides; its latest date (as text) minus
    one day goes to all pages of the resource.
    """
    dated = rules(store).filter(
        F.contains("predicate", F.lit("startDate")) | F.contains("predicate", F.lit("endDate"))
    ).select("source_id")
    last = F.array_max(F.filter(V.ensure_array("cache"), V.valid_iso_date))
    rows = (
        store.statements.filter(
            F.col("selected_individual")
            & F.col("cache").isNotNull()
            & ~F.contains("cache", F.lit("error"))
            & ~F.contains("cache", F.lit("bad"))
        )
        .join(dated, "source_id")
        .select("id", "webpage_id", "cache_refreshed", last.alias("last_date"))
        .filter("last_date is not null")
    )
    page = store.webpages.select(F.col("id").alias("webpage_id"), "rdf_uri")
    per_uri = (
        rows.join(page, "webpage_id")
        .groupBy("rdf_uri")
        .agg(F.max_by("last_date", F.struct("cache_refreshed", "id")).alias("last_date"))
    )
    return page.join(per_uri, "rdf_uri").select(
        "webpage_id", "rdf_uri", (D.utc_instant("last_date") - F.expr("interval 24 hours")).alias("archive_date")
    )


def with_archive_dates(store: Store, as_of: str) -> DataFrame:
    """The page table with new, guarded archive dates."""
    fresh = archive_dates(store).select(F.col("webpage_id").alias("id"), F.col("archive_date").alias("_fresh"))
    pages = store.webpages.join(fresh, "id", "left")
    date = F.coalesce("_fresh", D.guard_archive_date("archive_date", as_of))
    return pages.withColumn("archive_date", date).select(*store.webpages.columns)


def saved(store: Store, statements: DataFrame, as_of: str) -> Store:
    """The store after a change of its statements, with the archive dates of its pages.

    ``statements`` is read by both, so it should be a written snapshot where it was expensive.
    """
    changed = store.with_(statements=statements)
    return changed.with_(webpages=with_archive_dates(changed, as_of))


def drop_pages(store: Store, gone: DataFrame) -> Store:
    """Cascade: pages by id, with their statements."""
    ids = gone.select(F.col("id").alias("_id")).distinct()
    return store.with_(
        webpages=store.webpages.join(ids, store.webpages.id == F.col("_id"), "left_anti"),
        statements=store.statements.join(ids, store.statements.webpage_id == F.col("_id"), "left_anti"),
    )


def tidy(store: Store, as_of: str) -> Store:
    """Drop messages, and old event pages of large sites, older than one month."""
    limit = F.date_trunc("day", as_time(as_of)) - F.expr("interval 1 month")
    events = store.webpages.join(
        store.rdfs_classes.filter("name = 'Event'").select(F.col("id").alias("rdfs_class_id")), "rdfs_class_id"
    )
    large = events.groupBy("website_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 100").select("website_id")
    old = events.join(large, "website_id", "left_semi").filter(F.col("archive_date") < limit)
    kept = drop_pages(store, old.select("id"))
    return kept.with_(messages=store.messages.filter(F.col("created_at") >= limit))


def purge_404(store: Store, capture_status: DataFrame) -> Store:
    """Drop pages whose own address was answered with 404; an outage is not a 404."""
    gone = capture_status.filter("status = 404").select("url").distinct()
    return drop_pages(store, store.webpages.join(gone, "url", "left_semi").select("id"))


def archive_resources(store: Store, uris: DataFrame, as_of: str) -> DataFrame:
    """Pages of the resources get an archive date of yesterday."""
    hit = uris.select("rdf_uri").distinct().withColumn("_hit", F.lit(True))
    date = F.when(F.col("_hit"), as_time(as_of) - F.expr("interval 1 day")).otherwise(F.col("archive_date"))
    return store.webpages.join(hit, "rdf_uri", "left").withColumn("archive_date", date).select(*store.webpages.columns)


def delete_resources(store: Store, uris: DataFrame) -> Store:
    """J16."""
    return drop_pages(store, store.webpages.join(uris.select("rdf_uri").distinct(), "rdf_uri", "left_semi").select("id"))


def delete_sites(store: Store, seedurls: DataFrame, events_only: bool = False) -> Store:
    """A site with its rules, pages and statements, or only its event pages."""
    sites = store.websites.join(seedurls.select("seedurl").distinct(), "seedurl", "left_semi").select(
        F.col("id").alias("website_id")
    )
    pages = store.webpages.join(sites, "website_id", "left_semi")
    if events_only:
        event = store.rdfs_classes.filter("name = 'Event'").select(F.col("id").alias("rdfs_class_id"))
        return drop_pages(store, pages.join(event, "rdfs_class_id", "left_semi").select("id"))
    kept = drop_pages(store, pages.select("id"))
    return kept.with_(
        websites=store.websites.join(seedurls.select("seedurl").distinct(), "seedurl", "left_anti"),
        sources=store.sources.join(sites, "website_id", "left_anti"),
    )


def property_label(name: str) -> Column:
    """The label of a property by its name: startDate and start_date are both "Start Date"."""
    words = F.regexp_replace(F.regexp_replace(name, r"([a-z\d])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.initcap(F.regexp_replace(words, "[_ -]+", " "))


def create_resources(store: Store, resources: DataFrame, named: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages and reviewed statements for hand-made resources.

    ``resources``: rdf_uri, class, seedurl. ``named``: rdf_uri, name, value, language,
    rdfs_class_name (null = the resource's class). Returns new pages, new statements and
    the rejected resources (no rule fits any value).
    """
    site = store.websites.select(F.col("id").alias("website_id"), "seedurl", "default_language")
    cls = store.rdfs_classes.select(F.col("id").alias("rdfs_class_id"), F.col("name").alias("class"))
    pages = (
        resources.join(site, "seedurl")
        .join(cls, "class")
        .select(
            F.expr("xxhash64(rdf_uri, website_id)").alias("id"),
            F.col("rdf_uri").alias("url"),
            F.col("default_language").alias("language"),
            "rdf_uri",
            "rdfs_class_id",
            "website_id",
            (as_time(as_of) + F.expr("interval 1 year")).alias("archive_date"),
            F.lit(None).cast("bigint").alias("jsonld_output_id"),
            "class",
        )
    )
    rule = (
        rules(store)
        .groupBy("rule_website_id", "label", "rdfs_class_name", "rule_language")
        .agg(F.min_by(F.struct("source_id"), "source_id")["source_id"].alias("source_id"))
    )
    values = named.join(pages.select("rdf_uri", "website_id", "class", F.col("id").alias("webpage_id")), "rdf_uri").select(
        "webpage_id",
        F.col("website_id").alias("rule_website_id"),
        property_label("name").alias("label"),
        F.coalesce("rdfs_class_name", "class").alias("rdfs_class_name"),
        F.col("language").alias("rule_language"),
        "value",
    )
    made = values.join(rule, ["rule_website_id", "label", "rdfs_class_name", "rule_language"])
    first = Window.partitionBy("source_id", "webpage_id").orderBy("value")
    made = made.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    null = F.lit(None)
    statements = made.select(
        F.expr("xxhash64(source_id, webpage_id)").alias("id"),
        F.col("value").alias("cache"),
        F.lit("ok").alias("status"),
        null.cast("string").alias("status_origin"),
        null.cast("timestamp_ntz").alias("cache_refreshed"),
        null.cast("timestamp_ntz").alias("cache_changed"),
        as_time(as_of).alias("created_at"),
        "source_id",
        "webpage_id",
        F.lit(True).alias("selected_individual"),
        F.lit(True).alias("manual"),
    )
    used = statements.select(F.col("webpage_id").alias("id")).distinct()
    saved = (
        with_rules(store, statements)
        .withColumn("old_cache", null.cast("string"))
    )
    saved = apply_callbacks(saved, F.lit(True), as_of).select(*STATEMENT)
    return (
        pages.join(used, "id", "left_semi").drop("class"),
        saved,
        pages.join(used, "id", "left_anti").select("rdf_uri"),
    )


def add_webpages(store: Store, as_of: str) -> DataFrame:
    """C14: new pages from resource lists; addresses and URIs meet by position.

    Known (url, site) pairs, repeats and rows without a URI are skipped.
    """
    labels = ("RDF Class", "URI List", "Webpage URL List")
    listed = rules(store).filter(F.col("label").isin(*labels)).select("source_id", "label")
    firsts = (
        store.statements.join(listed, "source_id")
        .groupBy("webpage_id", "label")
        .agg(F.min_by("cache", "id").alias("cache"))
    )
    part = lambda name: firsts.filter(F.col("label") == name)
    items = lambda name, out: part(name).select(
        "webpage_id", F.posexplode(V.to_array("cache")).alias("pos", out)
    )
    page = store.webpages.select(F.col("id").alias("webpage_id"), "language", "website_id")
    classes = store.rdfs_classes.select(F.col("id").alias("rdfs_class_id"), F.col("name").alias("class_name"))
    rows = (
        items("Webpage URL List", "url")
        .join(items("URI List", "rdf_uri"), ["webpage_id", "pos"])
        .join(part("RDF Class").select("webpage_id", F.col("cache").alias("class_name")), "webpage_id")
        .join(classes, "class_name")
        .join(page, "webpage_id")
        .filter(~V.is_blank("rdf_uri") & F.col("url").isNotNull())
    )
    first = Window.partitionBy("url", "website_id").orderBy("webpage_id", "pos")
    fresh = (
        rows.withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .join(store.webpages.select("url", "website_id"), ["url", "website_id"], "left_anti")
    )
    return fresh.select(
        F.expr("xxhash64(url, website_id)").alias("id"),
        "url",
        "language",
        "rdf_uri",
        "rdfs_class_id",
        "website_id",
        (as_time(as_of) + F.expr("interval 1 year")).alias("archive_date"),
        F.lit(None).cast("bigint").alias("jsonld_output_id"),
    )


def refresh_worklist(store: Store, kind: str, as_of: str, seedurl: str | None = None) -> DataFrame:
    """Pages to capture: ``upcoming`` events, ``lists``, or ``all``."""
    site = store.websites.select(F.col("id").alias("website_id"), "seedurl")
    cls = store.rdfs_classes.select(F.col("id").alias("rdfs_class_id"), F.col("name").alias("page_class"))
    rows = store.webpages.join(site, "website_id").join(cls, "rdfs_class_id")
    if seedurl:
        rows = rows.filter(F.col("seedurl") == seedurl)
    if kind == "upcoming":
        rows = rows.filter((F.col("page_class") == "Event") & D.timespan("archive_date", None, None, as_of))
    elif kind == "lists":
        rows = rows.filter("page_class = 'ResourceList'")
    elif kind != "all":
        raise ValueError(f"unknown work list {kind!r}")
    return rows.select(F.col("id").alias("webpage_id"), "url", "seedurl")


def due_sites(store: Store, as_of: str) -> DataFrame:
    """Sites whose schedule asks for a refresh now (UTC)."""
    now = as_time(as_of)
    days = F.datediff(now.cast("date"), F.col("last_refresh").cast("date"))
    due = (
        (F.col("schedule_every_days") > 0)
        & F.col("last_refresh").isNotNull()
        & (days >= F.col("schedule_every_days"))
        & (F.date_format(now, "HHmm") >= F.replace("schedule_time", F.lit(":"), F.lit("")))
    )
    return store.websites.filter(due).select("id", "seedurl", "last_refresh")


def copy_sources(store: Store, from_site: int, to_site: int) -> DataFrame:
    """A10: all rules of one site, copied to another."""
    copied = store.sources.filter(F.col("website_id") == from_site).withColumn(
        "id", F.expr(f"xxhash64(id, {int(to_site)}L)")
    )
    return copied.withColumn("website_id", F.lit(to_site).cast("bigint"))
