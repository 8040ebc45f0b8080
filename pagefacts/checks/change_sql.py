"""What a save does, in plain SQL, for comparison."""

from __future__ import annotations

from pagefacts.vocab import DEFAULT

_OUT = "cache, status, status_origin, cache_refreshed, cache_changed, source_id, webpage_id, selected_individual, manual"


def groups(c: str) -> str:
    return (
        f"""CASE WHEN NOT json_valid({c}) THEN CAST([] AS JSON[]) WHEN {c} LIKE '[[%' THEN json_extract({c}, '$[*]') WHEN {c} LIKE '["%' THEN [CAST({c} AS JSON)] ELSE CAST([] AS JSON[]) END"""
    )


def _uris(c: str, test: str) -> str:
    return f"""flatten(list_transform(list_filter({groups(c)}, lambda g: {test}),
      lambda g: list_transform(json_extract(g, '$[*]')[3:], lambda h: json_extract_string(h, '$[1]'))))"""


def uris(c: str) -> str:
    """Live URIs of a stored value, sorted."""
    live = _uris(c, "json_extract_string(g, '$[0]') <> 'Manually deleted'")
    gone = _uris(c, "json_extract_string(g, '$[0]') = 'Manually deleted'")
    return f"list_sort(list_filter({live}, lambda u: NOT list_contains({gone}, u)))"


def missing(c: str) -> str:
    scraped = f"list_filter({groups(c)}, lambda g: json_extract_string(g, '$[0]') NOT IN ('Manually deleted', 'Manually added'))"
    added = f"list_filter({groups(c)}, lambda g: json_extract_string(g, '$[0]') = 'Manually added')"
    firsts = f"list_transform({scraped}, lambda g: coalesce(json_extract_string(g, '$[2][1]'), ''))"
    return f"""CASE WHEN len(list_filter({firsts}, lambda u: u <> '')) = 0
      THEN NOT coalesce(starts_with(json_extract_string({added}[1], '$[2][1]'), 'http'), false)
      ELSE len(list_filter({firsts}, lambda u: NOT starts_with(u, 'http'))) > 0 END"""


def values(c: str) -> str:
    return f"""CASE WHEN json_valid({c}) AND {c} LIKE '[%' THEN from_json({c}, '["VARCHAR"]') ELSE [{c}] END"""


def callbacks(src: str, dst: str, as_of: str, released: str = "false") -> str:
    """Named blocks from ``src`` (statement columns, old_cache, saved, label, value_datatype) to ``dst``."""
    return f"""
{dst}_1 AS (SELECT *, saved AND cache IS DISTINCT FROM old_cache AND NOT coalesce(value_datatype = 'xsd:anyURI' AND old_cache IS NOT NULL
    AND {uris("old_cache")} = {uris("cache")}, false) AS changed FROM {src}),
{dst}_2 AS (SELECT * REPLACE (CASE WHEN changed THEN TIMESTAMP '{as_of}' ELSE cache_changed END AS cache_changed,
    CASE WHEN changed AND NOT coalesce(status = 'initial' AND status_origin = '{DEFAULT.origin_refresh}', false) THEN 'updated' ELSE status END AS status,
    CASE WHEN changed THEN '{DEFAULT.origin_refresh}' ELSE status_origin END AS status_origin) FROM {dst}_1),
{dst}_3 AS (SELECT * REPLACE (CASE WHEN saved AND status <> 'problem' AND coalesce(CASE label
    WHEN 'Location' THEN {missing("coalesce(cache, '')")}
    WHEN 'Dates' THEN len(list_filter({values("coalesce(cache, '')")}, lambda d: regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}(T\\d{{2}}:\\d{{2}}:\\d{{2}}[+-]\\d{{2}}:\\d{{2}})?$'))) = 0
    WHEN 'Title' THEN trim(coalesce(cache, '')) = '' ELSE false END, false) THEN 'missing' ELSE status END AS status) FROM {dst}_2),
{dst}_4 AS (SELECT * REPLACE (manual OR (saved AND status NOT IN ('problem', 'initial') AND label IN ('Performed by', 'Organized by') AND NOT ({released})) AS manual) FROM {dst}_3),
{dst} AS (SELECT * REPLACE (CASE WHEN saved AND (coalesce(contains(cache, 'abort_update'), false) OR (label = 'Price' AND
    len(list_filter({values("coalesce(cache, '')")}, lambda v: NOT regexp_matches(v, '^\\s*$') AND NOT regexp_matches(v, '^[+-]?\\d+(\\.\\d+)?$'))) > 0))
    THEN 'problem' ELSE status END AS status) FROM {dst}_4)
"""


OUT = _OUT
