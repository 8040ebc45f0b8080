"""Explicit schemas of the nine statement-store tables."""

from __future__ import annotations

WEBSITES = (
    "id BIGINT, name STRING, seedurl STRING, graph_name STRING, default_language STRING, "
    "schedule_every_days INT, last_refresh TIMESTAMP_NTZ, schedule_time STRING"
)
RDFS_CLASSES = "id BIGINT, name STRING"
PROPERTIES = (
    "id BIGINT, label STRING, value_datatype STRING, uri STRING, rdfs_class_id BIGINT, "
    "expected_class STRING"
)
SOURCES = (
    "id BIGINT, algorithm_value STRING, selected BOOLEAN, selected_by STRING, language STRING, "
    "render_js BOOLEAN, property_id BIGINT, website_id BIGINT, label STRING, auto_review BOOLEAN"
)
WEBPAGES = (
    "id BIGINT, url STRING, language STRING, rdf_uri STRING, rdfs_class_id BIGINT, "
    "website_id BIGINT, archive_date TIMESTAMP_NTZ, jsonld_output_id BIGINT"
)
STATEMENTS = (
    "id BIGINT, cache STRING, status STRING, status_origin STRING, cache_refreshed TIMESTAMP_NTZ, "
    "cache_changed TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, source_id BIGINT, webpage_id BIGINT, "
    "selected_individual BOOLEAN, manual BOOLEAN"
)
SEARCH_EXCEPTIONS = "name STRING, rdfs_class_id BIGINT, uri STRING"
JSONLD_OUTPUTS = "id BIGINT, name STRING, frame STRING"
MESSAGES = "message STRING, artifact STRING, created_at TIMESTAMP_NTZ"

TABLES = {
    "websites": WEBSITES,
    "rdfs_classes": RDFS_CLASSES,
    "properties": PROPERTIES,
    "sources": SOURCES,
    "webpages": WEBPAGES,
    "statements": STATEMENTS,
    "search_exceptions": SEARCH_EXCEPTIONS,
    "jsonld_outputs": JSONLD_OUTPUTS,
    "messages": MESSAGES,
}

# graph rows: pos is null for a triple and set for a "this triple has position n" annotation
GRAPH = (
    "graph_id STRING, s STRING, p STRING, o STRING, o_kind STRING, lang STRING, "
    "datatype STRING, pos INT"
)
GRAPH_COLUMNS = ("graph_id", "s", "p", "o", "o_kind", "lang", "datatype", "pos")
TRIPLE_COLUMNS = GRAPH_COLUMNS[:-1]

CAPTURES = "page_id BIGINT, url STRING, html STRING"
