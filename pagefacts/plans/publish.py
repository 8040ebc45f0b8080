"""Publishing: the export of a site and the markup of its pages, each as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.functions import values as V
from pagefacts.operators import graph as G
from pagefacts.operators import jsonld as D
from pagefacts.operators import lookups as L
from pagefacts.operators import rollups as R
from pagefacts.operators import series as E
from pagefacts.operators.star import star
from pagefacts.session import cut_lineage, discard
from pagefacts.sources.store import Store
from pagefacts.vocab import DEFAULT, Vocabulary


#: What an export reads of the star join.
EXPORTED = (
    "webpage_id", "seedurl", "rdf_uri", "page_class", "label", "rule_language", "status", "cache", "value_datatype",
    "predicate", "rdfs_class_name", "cache_refreshed", "selected", "selected_individual",
)


def exported_rows(store: Store) -> DataFrame:
    """The rows of the star join that an export reads, written once for all its readers."""
    local = F.col("selected") & F.col("page_class").isin(*G.LOCAL_CLASSES)
    return cut_lineage(star(store).filter(F.col("selected_individual") | local).select(*EXPORTED), "flat")


def known_graph(store: Store, kg: DataFrame, vocab: Vocabulary = DEFAULT, flat: DataFrame | None = None) -> DataFrame:
    """The knowledge graph with the store's own entities, written once per job."""
    rows = star(store) if flat is None else flat
    return cut_lineage(G.merge(kg, G.local_graph(rows, vocab=vocab)), "known")


def event_graphs(statements: DataFrame, kg: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Graphs of events as they are exported: nodes and events split into series, and
    the described objects added. Each stage is read several times by the next, so it is
    written once instead of being recomputed."""
    graph = cut_lineage(G.build_graph(statements, annotate=True, vocab=vocab), "built")
    graph = cut_lineage(E.split_by_position(graph, E.CONTACTS, E.OFFERS), "split")
    graph = cut_lineage(E.event_series(graph), "series")
    return G.drop_annotations(G.enrich(graph, kg, export=True, vocab=vocab))


def _documents(graph: DataFrame, sites: DataFrame, vocab: Vocabulary) -> DataFrame:
    owned = sites.select("seedurl", V.full_uri("rdf_uri", vocab).alias("graph_id")).distinct()
    return D.to_jsonld(graph.join(owned, "graph_id"), keys=("seedurl",))


def export_events(
    store: Store, kg: DataFrame, uris: DataFrame, vocab: Vocabulary = DEFAULT, flat: DataFrame | None = None
) -> DataFrame:
    """Export of the given events (seedurl, rdf_uri); ``flat`` are the :func:`exported_rows`, made here when not given."""
    flat = exported_rows(store) if flat is None else flat
    uris = cut_lineage(uris.select("seedurl", "rdf_uri").distinct(), "uris")
    known = known_graph(store, kg, vocab, flat)
    graph = cut_lineage(event_graphs(L.uri_statements(store, uris, flat), known, vocab), "events")
    return _documents(graph, uris, vocab)


def export_others(store: Store, uris: DataFrame, vocab: Vocabulary = DEFAULT, flat: DataFrame | None = None) -> DataFrame:
    """Export of entities that are no events; ``flat`` as for events."""
    flat = exported_rows(store) if flat is None else flat
    uris = cut_lineage(uris.select("seedurl", "rdf_uri").distinct(), "uris")
    graph = cut_lineage(G.build_graph(L.uri_statements(store, uris, flat), annotate=False, vocab=vocab), "others")
    return _documents(graph, uris, vocab)


def export_site(store: Store, kg: DataFrame, seedurl: str | None = None, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """All publishable events and all other entities of a site (or of all sites),
    one after the other: (seedurl, s, part, json)."""
    flat = exported_rows(store)
    events = export_events(store, kg, R.publishable_events(store, seedurl, flat), vocab, flat)
    others = export_others(store, L.other_entities(store, seedurl, flat), vocab, flat)
    return events.withColumn("dump", F.lit("events")).unionByName(others.withColumn("dump", F.lit("others")))


def export_resource(
    store: Store, kg: DataFrame, url: str | None = None, uri: str | None = None, vocab: Vocabulary = DEFAULT
) -> DataFrame:
    """Export of the resource of one page, or of one URI."""
    if (url is None) == (uri is None):
        raise ValueError("give a page url or a resource uri")
    site = store.websites.select(F.col("id").alias("website_id"), "seedurl")
    hit = store.webpages.filter(F.col("url") == url if url is not None else F.col("rdf_uri") == uri)
    return export_events(store, kg, hit.join(site, "website_id").select("seedurl", "rdf_uri").distinct(), vocab)


def page_markup(store: Store, kg: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """The markup of every page: nothing, a message, or the nested document.

    The document describes the page's resource in the page's language, so the graph id
    is the page's own: two pages of one resource may choose different languages.
    """
    flat = cut_lineage(star(store).select("statement_id", *EXPORTED), "flat")  # read by every step
    decisions = cut_lineage(L.output_decision(store, flat), "decisions")
    chosen = (
        R.nested_statements(flat)
        .filter("role = 'selected'")
        .select("statement_id", F.col("status").alias("_status"))
    )
    shown = flat.join(chosen, "statement_id").withColumn("status", F.col("_status")).drop("_status")
    wanted = decisions.filter("decision in ('own frame', 'class frame')")
    shown = shown.join(wanted.select("rdf_uri").distinct(), "rdf_uri", "left_semi")
    known = known_graph(store, kg, vocab, flat)
    built = cut_lineage(G.build_graph(shown, annotate=False, vocab=vocab), "markup")
    discard(flat)
    graph = cut_lineage(G.enrich(built, known, vocab=vocab), "enriched")
    discard(built, known)
    page = wanted.join(
        store.webpages.select(F.col("id").alias("webpage_id"), "language"), "webpage_id"
    ).select("webpage_id", "language", V.full_uri("rdf_uri", vocab).alias("graph_id"), "frame", "url")
    variants = page.select("graph_id", "language").distinct()
    per_language = graph.join(variants, "graph_id").withColumn("main_id", F.col("graph_id"))
    tagged = per_language.withColumn("graph_id", F.concat("graph_id", F.lit("|"), "language"))
    best = G.coalesce_language(tagged, F.col("language")).drop("language")
    plain = G.strip_typed_dates(best)
    # the frame looks for the main subject under the graph id
    main_rows = plain.withColumn("s", F.when(F.col("s") == F.col("main_id"), F.col("graph_id")).otherwise(F.col("s")))
    framed = page.withColumn("graph_id", F.concat("graph_id", F.lit("|"), "language"))
    # the entries of a document are the same whichever names of it a frame keeps
    nodes = D.frame_nodes(main_rows.drop("main_id"))
    discard(graph)
    entries = cut_lineage(D.frame_entries(None, vocab=vocab, nodes=nodes), "entries")
    discard(nodes)
    own, plain_pages = framed.filter("frame is not null"), framed.filter("frame is null")
    docs = D.frame_texts(entries.join(plain_pages.select("graph_id").distinct(), "graph_id", "left_semi"))
    own_docs = D.frame_texts(
        entries.join(own.select("graph_id").distinct(), "graph_id", "left_semi"), own.select("graph_id", "frame").distinct()
    )
    documents = (
        plain_pages.join(docs, "graph_id").unionByName(own.join(own_docs, "graph_id"))
    ).select("webpage_id", F.col("json").alias("markup"))
    return decisions.select("webpage_id", "url", "decision", "message").join(documents, "webpage_id", "left").select(
        "webpage_id", "url", "decision",
        F.coalesce(
            "markup",
            F.when(F.col("message").isNotNull(), F.to_json(F.struct("message"))),
        ).alias("markup"),
    )
