"""The star join of the store, flat statements, and the composable statement filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.sources.store import Store


def rules(store: Store) -> DataFrame:
    """Rules with their property and class: a dimension, joined once."""
    s, p, c = store.sources, store.properties, store.rdfs_classes
    return (
        s.join(p, s.property_id == p.id)
        .join(c, p.rdfs_class_id == c.id)
        .select(
            s.id.alias("source_id"),
            s.algorithm_value,
            s.selected,
            s.language.alias("rule_language"),
            s.label.alias("source_label"),
            s.render_js,
            s.auto_review,
            s.website_id.alias("rule_website_id"),
            p.id.alias("property_id"),
            p.label.alias("label"),
            p.value_datatype,
            p.uri.alias("predicate"),
            p.expected_class,
            c.name.alias("rdfs_class_name"),
        )
    )


def pages(store: Store) -> DataFrame:
    """Pages with their class and website."""
    w, c, s = store.webpages, store.rdfs_classes, store.websites
    return (
        w.join(c, w.rdfs_class_id == c.id)
        .join(s, w.website_id == s.id)
        .select(
            w.id.alias("webpage_id"),
            w.url,
            w.language.alias("page_language"),
            w.rdf_uri,
            c.name.alias("page_class"),
            w.archive_date,
            w.website_id,
            w.jsonld_output_id,
            s.seedurl,
            s.default_language,
        )
    )


def star(store: Store) -> DataFrame:
    """Statement, rule, property, class, page and website in one row.

    Join sides are chosen by Spark from measured sizes. Statements meet the small
    rule dimension first, so filters on rule fields cut rows before the page join.
    """
    st = store.statements
    statement = [F.col("id").alias("statement_id")] + [F.col(c) for c in st.columns if c != "id"]
    return st.select(statement).join(rules(store), "source_id").join(pages(store), "webpage_id")


def flat_statements(store: Store) -> DataFrame:
    """B1: one row per statement with the fields the publishing side needs."""
    rows = star(store)
    return rows.withColumn("subject", F.col("rdf_uri")).withColumn(
        "source_is_feed", ~F.startswith("algorithm_value", F.lit("manual="))
    )


def query_statements(
    store: Store,
    *,
    rdf_uri: str | None = None,
    seedurl: str | None = None,
    prop: int | None = None,
    source: int | None = None,
    cache: str | None = None,
    status: str | None = None,
    manual: bool | None = None,
    selected: bool | None = None,
    selected_individual: bool | None = None,
    ordered: bool = True,
) -> DataFrame:
    """B2: every given filter narrows the statements; text search is case-sensitive."""
    rows = star(store)
    tests: list[Column] = []
    if rdf_uri:
        tests.append(F.col("rdf_uri") == rdf_uri)
    if seedurl and seedurl != "all":
        tests.append(F.col("seedurl") == seedurl)
    if cache:
        tests.append(F.contains("cache", F.lit(cache)))
    exact = {
        "property_id": prop,
        "source_id": source,
        "status": status,
        "manual": manual,
        "selected": selected,
        "selected_individual": selected_individual,
    }
    tests += [F.col(name) == value for name, value in exact.items() if value is not None]
    for test in tests:
        rows = rows.filter(test)
    order: list[Column] = []
    if rdf_uri:
        order += [F.col("selected").desc(), F.col("property_id")]
    if seedurl and seedurl != "all":
        order.append(F.col("statement_id"))
    return rows.orderBy(*order) if ordered and order else rows
