"""The graph of the given tables in plain SQL, for comparison."""

from __future__ import annotations

from pagefacts.vocab import DEFAULT, RDF_TYPE, SCHEMA, XSD_DATETIME

V = DEFAULT

# link groups of every URI statement: one row per hit
LINKS_SQL = """
grouped AS (
  SELECT statement_id, unnest(gs) AS g, generate_subscripts(gs, 1) AS gi FROM (
    SELECT statement_id, CASE WHEN json_type(cache, '$[0]') = 'ARRAY' THEN json_extract(cache, '$[*]')
      ELSE [CAST(cache AS JSON)] END AS gs
    FROM star WHERE value_datatype = 'xsd:anyURI')),
hits AS (
  SELECT statement_id, gi, search, class, unnest(hs) AS h, generate_subscripts(hs, 1) AS hi FROM (
    SELECT statement_id, gi, json_extract_string(g, '$[0]') AS search, json_extract_string(g, '$[1]') AS class,
      json_extract(g, '$[*]')[3:] AS hs FROM grouped)),
links AS (
  SELECT statement_id, gi, hi, search, class, json_extract_string(h, '$[0]') AS hit_label, json_extract_string(h, '$[1]') AS uri FROM hits),
kept_uris AS (
  SELECT statement_id, uri, row_number() OVER (PARTITION BY statement_id ORDER BY gi, hi) - 1 AS pos
  FROM links l WHERE search <> 'Manually deleted' AND NOT EXISTS (
    SELECT 1 FROM links d WHERE d.statement_id = l.statement_id AND d.search = 'Manually deleted' AND d.uri = l.uri))
"""

GRAPH_SQL = f"""{LINKS_SQL},
f AS (
  SELECT *, replace(replace(rdf_uri, '{V.kg_prefix}', '{V.kg_base}'), '{V.mint_prefix}', '{V.mint_base}') AS s0
  FROM star WHERE selected_individual AND status NOT IN ('initial', 'problem') AND trim(cache) NOT IN ('', '[]')
    AND (value_datatype <> 'xsd:anyURI' OR statement_id IN (SELECT statement_id FROM kept_uris))),
vals AS (
  SELECT *, unnest(vs) AS v, generate_subscripts(vs, 1) - 1 AS vpos FROM (
    SELECT *, CASE WHEN starts_with(cache, '[') THEN from_json(cache, '["VARCHAR"]') ELSE [cache] END AS vs
    FROM f WHERE value_datatype <> 'xsd:anyURI')),
located AS (SELECT f.s0, f.predicate, k.uri, k.pos FROM f JOIN kept_uris k USING (statement_id)),
both_pos AS (SELECT unnest([true, false]) AS numbered),
graph AS MATERIALIZED (
  SELECT DISTINCT s0 AS graph_id, s, p, o, o_kind, lang, datatype, CAST(pos AS INTEGER) AS pos FROM (
    SELECT s0, s0 AS s, '{RDF_TYPE}' AS p, '{SCHEMA}' || page_class AS o, 'uri' AS o_kind, '' AS lang, '' AS datatype, NULL AS pos FROM f
    UNION ALL SELECT s0, s0, '{SCHEMA}offers', s0 || '#Offer', 'uri', '', '', NULL FROM f WHERE rdfs_class_name = 'Offer'
    UNION ALL SELECT s0, s0 || '#Offer', '{RDF_TYPE}', '{SCHEMA}Offer', 'uri', '', '', NULL FROM f WHERE rdfs_class_name = 'Offer'
    UNION ALL SELECT s0, s0 || '#Offer', predicate, v, 'literal', rule_language, '', CASE WHEN numbered THEN vpos END
      FROM vals, both_pos WHERE rdfs_class_name = 'Offer'
    UNION ALL SELECT s0, s0, predicate, uri, 'uri', '', '', CASE WHEN numbered THEN pos END FROM located, both_pos
      WHERE NOT numbered OR contains(predicate, 'location')
    UNION ALL SELECT s0, s0, predicate, v, 'literal', '', '{XSD_DATETIME}', CASE WHEN numbered THEN vpos END FROM vals, both_pos
      WHERE rdfs_class_name <> 'Offer' AND value_datatype = 'xsd:dateTime' AND regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T')
    UNION ALL SELECT s0, s0, predicate, cache, 'literal', rule_language, '', NULL FROM f
      WHERE rdfs_class_name <> 'Offer' AND value_datatype = ''))
"""

VARIANT_SQL = f"""
counted AS (
  SELECT graph_id, count(*) FILTER (p = '{SCHEMA}startDate') AS starts, count(*) FILTER (p = '{SCHEMA}location') AS locations,
    count(*) FILTER (p = '{SCHEMA}endDate') AS ends FROM graph WHERE pos IS NOT NULL GROUP BY graph_id),
variants AS (
  SELECT *, CASE WHEN starts <= 1 THEN 'unchanged'
    WHEN locations > 1 AND starts = locations AND starts = ends THEN 'locations'
    WHEN locations > 1 AND starts = locations THEN 'locations_only_start'
    WHEN locations < 2 AND ends <> starts THEN 'dates_only_start'
    WHEN locations < 2 THEN 'dates' ELSE 'rejected' END AS variant FROM counted)
"""

SERIES_SQL = f"""
live AS (SELECT g.*, v.variant FROM graph g LEFT JOIN variants v USING (graph_id) WHERE coalesce(v.variant, 'unchanged') <> 'rejected'),
act AS (SELECT *, starts_with(variant, 'locations') AS by_place FROM live WHERE variant <> 'unchanged' AND s = graph_id),
ready AS (SELECT DISTINCT graph_id FROM act WHERE pos IS NULL AND p = '{SCHEMA}name'
  INTERSECT SELECT graph_id FROM act WHERE pos IS NULL AND p = '{RDF_TYPE}' AND o = '{SCHEMA}Event'),
st AS (SELECT * FROM act JOIN ready USING (graph_id) WHERE pos IS NOT NULL AND p = '{SCHEMA}startDate'),
se AS (SELECT st.graph_id, st.variant, st.by_place, st.pos, st.o AS start, en.o AS finish
  FROM st LEFT JOIN act en ON en.graph_id = st.graph_id AND en.pos = st.pos AND en.p = '{SCHEMA}endDate'),
parts AS (
  SELECT se.*, lo.o AS place FROM se JOIN act lo ON lo.graph_id = se.graph_id AND lo.p = '{SCHEMA}location'
    AND ((se.by_place AND lo.pos = se.pos) OR (NOT se.by_place AND lo.pos IS NULL))),
gone AS (
  SELECT graph_id, graph_id AS s, '{RDF_TYPE}' AS p, '{SCHEMA}Event' AS o FROM parts
  UNION SELECT graph_id, graph_id, '{SCHEMA}startDate', start FROM parts
  UNION SELECT graph_id, graph_id, '{SCHEMA}endDate', finish FROM parts WHERE finish IS NOT NULL
  UNION SELECT graph_id, graph_id, '{SCHEMA}location', place FROM parts WHERE by_place),
edges AS (SELECT graph_id, min(o) AS low, max(o) AS high FROM act WHERE pos IS NULL AND p = '{SCHEMA}startDate' GROUP BY graph_id),
first_place AS (SELECT graph_id, arg_min(o, (pos, o)) AS place FROM act WHERE pos IS NOT NULL AND p = '{SCHEMA}location' GROUP BY graph_id),
sub AS (SELECT *, graph_id || '#' || replace(start, ':', '') AS uri FROM parts),
series AS (
  SELECT graph_id, s, p, o, o_kind, lang, datatype, pos FROM live l
    WHERE pos IS NOT NULL OR NOT EXISTS (SELECT 1 FROM gone d WHERE d.graph_id = l.graph_id AND d.s = l.s AND d.p = l.p AND d.o = l.o)
  UNION SELECT graph_id, graph_id, '{SCHEMA}subEvent', uri, 'uri', '', '', NULL FROM sub
  UNION SELECT graph_id, uri, '{RDF_TYPE}', '{SCHEMA}Event', 'uri', '', '', NULL FROM sub
  UNION SELECT graph_id, uri, '{SCHEMA}startDate', start, 'literal', '', '{XSD_DATETIME}', NULL FROM sub
  UNION SELECT graph_id, uri, '{SCHEMA}endDate', finish, 'literal', '', '{XSD_DATETIME}', NULL FROM sub
    WHERE variant IN ('dates', 'locations') AND finish IS NOT NULL
  UNION SELECT graph_id, uri, '{SCHEMA}location', place, 'uri', '', '', NULL FROM sub
  UNION SELECT sub.graph_id, sub.uri, n.p, n.o, n.o_kind, n.lang, n.datatype, NULL FROM sub JOIN act n ON n.graph_id = sub.graph_id AND n.p = '{SCHEMA}name'
  UNION SELECT graph_id, graph_id, '{RDF_TYPE}', '{SCHEMA}EventSeries', 'uri', '', '', NULL FROM parts
  UNION SELECT graph_id, graph_id, '{SCHEMA}startDate', low, 'literal', '', '{XSD_DATETIME}', NULL FROM edges WHERE graph_id IN (SELECT graph_id FROM parts)
  UNION SELECT graph_id, graph_id, '{SCHEMA}endDate', high, 'literal', '', '{XSD_DATETIME}', NULL FROM edges WHERE graph_id IN (SELECT graph_id FROM parts)
  UNION SELECT graph_id, graph_id, '{SCHEMA}location', place, 'uri', '', '', NULL FROM first_place WHERE graph_id IN (SELECT graph_id FROM parts WHERE by_place))
"""

# offers of one graph move to a node per position; reads {src}, defines {dst}
OFFERS_SQL = f"""
nodes AS (SELECT DISTINCT l.graph_id, l.o AS node FROM {{src}} l JOIN {{src}} t ON t.graph_id = l.graph_id AND t.s = l.o
  AND t.p = '{RDF_TYPE}' AND t.o = '{SCHEMA}Offer' AND t.pos IS NULL
  WHERE l.p = '{SCHEMA}offers' AND l.s = l.graph_id AND l.pos IS NULL),
moved AS (SELECT g.*, g.s || '_' || g.pos AS fresh FROM {{src}} g JOIN nodes n ON n.graph_id = g.graph_id AND n.node = g.s WHERE g.pos IS NOT NULL),
{{dst}} AS (
  SELECT * FROM {{src}} g WHERE pos IS NOT NULL OR NOT (
    EXISTS (SELECT 1 FROM moved m WHERE m.graph_id = g.graph_id AND ((m.s = g.s AND m.p = g.p AND m.o = g.o AND m.lang = g.lang)
      OR (m.s = g.s AND g.p = '{RDF_TYPE}') OR (m.s = g.o AND g.p = '{SCHEMA}offers'))))
  UNION SELECT graph_id, graph_id, '{SCHEMA}offers', fresh, 'uri', '', '', NULL FROM moved
  UNION SELECT graph_id, fresh, '{RDF_TYPE}', '{SCHEMA}Offer', 'uri', '', '', NULL FROM moved
  UNION SELECT graph_id, fresh, p, o, o_kind, lang, datatype, NULL FROM moved)
"""


def describe_sql(uris: str, out: str) -> str:
    """Facts about (graph_id, uri) rows of ``uris``."""
    return f"""
{out}_first AS (SELECT DISTINCT u.graph_id, k.* FROM {uris} u JOIN kg k ON k.s = u.uri),
{out}_nodes AS (SELECT DISTINCT graph_id, o AS uri FROM {out}_first WHERE o_kind = 'uri'
  AND (NOT starts_with(o, '{V.kg_entity}') OR contains(o, '#PostalAddress'))),
{out} AS (SELECT * FROM {out}_first UNION SELECT n.graph_id, k.* FROM {out}_nodes n JOIN kg k ON k.s = n.uri)
"""
