"""Nested and flat JSON documents from graph rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.operators.graph import triples
from pagefacts.plans.skew import split_hot
from pagefacts.session import cut_lineage
from pagefacts.vocab import DEFAULT, RDF_TYPE, SCHEMA, Vocabulary

# one value in expanded form, and in the short form used under a vocabulary context
_FULL_VALUE = """case when o_kind = 'literal' then to_json(named_struct('@language', nullif(lang, ''), '@type', nullif(datatype, ''), '@value', o))
  else to_json(named_struct('@id', o)) end"""
# a text of plain characters is its own JSON string but for the quotes
_TEXT = r"""if(not({c} rlike '[^ !#-\\[\\]-~]'), concat('"', {c}, '"'), substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2))"""
_SHORT_VALUE = f"""case when o_kind = 'literal' and lang = '' and datatype = '' then {_TEXT.format(c="o")}
  when o_kind = 'literal' then to_json(named_struct('@language', nullif(lang, ''), '@type', nullif(datatype, ''), '@value', o))
  else to_json(named_struct('@id', o)) end"""


def to_jsonld(graph: DataFrame, keys: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """One JSON object per subject, with arrays per predicate.

    A subject is one object whatever its size. A line format with a fixed line length may
    ask for ``limit`` values an object; a larger subject is then several objects with the
    same ``@id``, which means the same in JSON-LD.
    """
    rows = triples(graph).select(*keys, "s", "p", "o", "o_kind", "lang", "datatype").distinct()
    parts = rows.withColumn("part", F.lit(0)) if limit is None else split_hot(rows, [*keys, "s"], limit)
    entries = parts.selectExpr(
        *keys,
        "s",
        "part",
        f"if(p = '{RDF_TYPE}', '@type', p) as p",
        f"if(p = '{RDF_TYPE}', {_TEXT.format(c='o')}, {_FULL_VALUE}) as v",
    )
    nodes = entries.groupBy(*keys, "s", "part").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("es"))
    body = f"""array_join(transform(array_distinct(transform(es, e -> e.p)), k -> concat({_TEXT.format(c="k")}, ':[',
      array_join(transform(filter(es, e -> e.p = k), e -> e.v), ','), ']')), ',')"""
    return nodes.selectExpr(*keys, "s", "part", f"""concat('{{"@id":', {_TEXT.format(c="s")}, ',', {body}, '}}') as json""")


@dataclass(frozen=True)
class Child:
    """How one linked object is shown: allowed classes, listed properties, and whether others
    are left out. A listed property that the object lacks is null; an address may be absent."""

    prop: str
    types: tuple[str, ...]
    props: tuple[str, ...]
    only_listed: bool = True
    address: bool = False


# What an event document shows, and the context that shortens its names.
EVENT_PROPS = (
    "name", "startDate", "endDate", "description", "duration", "url", "eventStatus", "eventAttendanceMode", "image",
    "workPerformed",
)
EVENT_CHILDREN = (
    Child("location", ("Place", "VirtualLocation"), ("name", "url", "sameAs"), address=True),
    Child("performer", ("Organization", "Person"), ("name", "sameAs", "url", "alternateName")),
    Child("mainEntityOfPage", ("WebPage",), ("url", "inLanguage", "lastReviewed"), only_listed=False),
    Child("offers", ("Offer",), ("url",), only_listed=False),
    Child("organizer", ("Organization", "Person"), ("name", "sameAs", "url", "alternateName"), address=True),
)
ID_PROPS = ("additionalType", "sameAs", "eventAttendanceMode", "eventStatus")
CONTEXT = '"@context":{"@vocab":"http://schema.org/"}'


def _short(rows: DataFrame) -> DataFrame:
    """Facts with local names and short values; a type also with its class name."""
    ids = ", ".join(f"'{p}'" for p in ID_PROPS)
    return rows.selectExpr(
        "graph_id",
        "s",
        f"if(p = '{RDF_TYPE}', '@type', replace(p, '{SCHEMA}', '')) as k",
        f"""case when p = '{RDF_TYPE}' then {_TEXT.format(c=f"replace(o, '{SCHEMA}', '')")}
            when replace(p, '{SCHEMA}', '') in ({ids}) then {_TEXT.format(c="o")} else {_SHORT_VALUE} end as v""",
        f"if(p = '{RDF_TYPE}', replace(o, '{SCHEMA}', ''), o) as o",
        "o_kind",
    )


def _object(entries: str) -> str:
    """JSON object text of an array of (k, v) structs in order of k: several values become a list.
    An entry looks only at its neighbours."""
    before, after = "get(es, i - 1).k <=> e.k", "get(es, i + 1).k <=> e.k"
    member = f"""concat(if({before}, ',', concat(if(i = 0, '', ','), {_TEXT.format(c="e.k")}, ':', if({after}, '[', ''))), e.v,
      if({before} and not ({after}), ']', ''))"""
    return f"""concat('{{', get(transform(array({entries}), es -> array_join(transform(es, (e, i) -> {member}), '')), 0), '}}')"""


def _entry(k: Column | str, v: Column | str) -> Column:
    return F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), (F.col(v) if isinstance(v, str) else v).alias("v"))


def _id(of: str) -> Column:
    return _entry("@id", F.expr(_TEXT.format(c=of)))


def _nodes(facts: DataFrame) -> DataFrame:
    """(graph_id, s, es, types, links): one row per subject with its entries in order, its classes, and the objects
    of the properties that a document shows in full."""
    shown = F.col("k").isin("@type", "address", *[c.prop for c in EVENT_CHILDREN])
    fact = F.struct("k", "v", F.when(shown, F.struct("o", "o_kind")).alias("to"))
    return (
        facts.groupBy("graph_id", "s")
        .agg(F.sort_array(F.collect_list(fact)).alias("es"))
        .selectExpr(
            "graph_id",
            "s",
            "transform(es, e -> named_struct('k', e.k, 'v', e.v)) as es",
            "array_distinct(transform(filter(es, e -> e.k = '@type' and e.to.o is not null), e -> e.to.o)) as types",
            "transform(filter(es, e -> e.k <> '@type' and e.to is not null), e -> named_struct('k', e.k, 'o', e.to.o, 'o_kind', e.to.o_kind)) as links",
        )
    )


def _addresses(nodes: DataFrame) -> DataFrame:
    """(graph_id, s, addresses): complete address objects by the node that carries them."""
    places = nodes.filter(F.array_contains("types", "PostalAddress")).select("graph_id", F.col("s").alias("o"), "es")
    # an address that is named n times has its entries n times
    carriers = nodes.selectExpr("graph_id", "s", "transform(filter(links, l -> l.k = 'address'), l -> l.o) as os").selectExpr(
        "graph_id", "s", "explode(transform(array_distinct(os), o -> named_struct('o', o, 'n', size(filter(os, x -> x = o))))) as a"
    )
    found = carriers.select("graph_id", "s", "a.*").join(places, ["graph_id", "o"])
    whole = found.withColumn("es", F.concat("es", F.array(_id("o")))).withColumn(
        "es", F.expr("sort_array(if(n = 1, es, flatten(array_repeat(es, n))))")
    )
    return whole.selectExpr("graph_id", "s", f"{_object('es')} as v").groupBy("graph_id", "s").agg(
        F.collect_list("v").alias("addresses")
    )


_WITH_ADDRESSES = "concat(es, transform(coalesce(addresses, array()), a -> named_struct('k', 'address', 'v', a)))"


def _children(nodes: DataFrame, parents: DataFrame, specs: tuple[Child, ...], addresses: DataFrame) -> DataFrame:
    """(graph_id, k, v): linked objects of the parents as JSON texts."""
    props = ", ".join(f"'{c.prop}'" for c in specs)
    links = parents.selectExpr(
        "graph_id",
        f"""explode(array_distinct(transform(filter(links, l -> l.k in ({props}) and l.o_kind <> 'literal'),
          l -> named_struct('prop', l.k, 's', l.o)))) as l""",
    ).select("graph_id", "l.*")
    texts = F.array().cast("array<string>")
    fits, own_address, expected, listed = F.lit(False), F.lit(False), texts, F.lit(None).cast("array<string>")
    for c in specs:
        is_prop = F.col("prop") == c.prop
        fits = F.when(is_prop, F.arrays_overlap("types", F.array(*map(F.lit, c.types)))).otherwise(fits)
        own_address = F.when(is_prop, F.lit(c.address)).otherwise(own_address)
        expected = F.when(is_prop, F.array(*map(F.lit, c.props))).otherwise(expected)
        if c.only_listed:
            listed = F.when(is_prop, F.array(*map(F.lit, ("@type", *c.props)))).otherwise(listed)
    typed = links.join(nodes.select("graph_id", "s", "es", "types"), ["graph_id", "s"]).filter(fits)
    rows = typed.join(addresses, ["graph_id", "s"], "left").withColumns(
        {"expected": expected, "listed": listed, "own_address": own_address}
    )
    own = "filter(es, e -> (listed is null or array_contains(listed, e.k)) and not (own_address and e.k = 'address'))"
    docs = (
        rows.withColumn("es", F.expr(own))
        .withColumn("es", F.expr(f"if(own_address, {_WITH_ADDRESSES}, es)"))
        .withColumn("es", F.concat("es", F.array(_id("s"))))
        .withColumn("es", F.expr(_FILLED))
    )
    return docs.selectExpr("graph_id", "prop as k", f"{_object('es')} as v")


# the entries in order, with null for the expected names that have none
_FILLED = """sort_array(concat(es, transform(array_except(expected, transform(es, e -> e.k)),
  n -> named_struct('k', n, 'v', 'null'))))"""


def frame(
    graph: DataFrame, main: DataFrame | None = None, keep_id: bool = False, own_frames: DataFrame | None = None,
    vocab: Vocabulary = DEFAULT,
) -> DataFrame:
    """One document per graph about its main subject, whatever its size.

    Events show the listed properties and linked objects (missing ones as null);
    places show everything with their address; other classes show the one node of their
    graph, or list all of them. ``own_frames`` (graph_id, frame) narrows a document to the top-level names of
    its frame. The top-level ``@id`` is left out unless ``keep_id``.
    """
    return frame_texts(frame_entries(graph, main, keep_id, vocab), own_frames)


def frame_nodes(graph: DataFrame) -> DataFrame:
    """The facts of graphs gathered once, by their subject, and written once: what :func:`frame_entries` works on."""
    return cut_lineage(_nodes(_short(triples(graph))), "nodes")


def frame_entries(
    graph: DataFrame | None, main: DataFrame | None = None, keep_id: bool = False, vocab: Vocabulary = DEFAULT,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """The entries of the documents of :func:`frame`, before they become texts: (graph_id, cls, es).

    The graph is read once, for its :func:`frame_nodes`, and not at all where these are given; objects then meet each
    other as whole nodes."""
    nodes = frame_nodes(graph) if nodes is None else nodes
    top = nodes.filter("s = graph_id")
    if main is None:
        top = top.withColumn("cls", F.explode("types"))
        main = top.select("graph_id", "cls")
    else:
        main = main.select("graph_id", "cls").distinct()
        top = top.join(main, "graph_id")
    addresses = _addresses(nodes)
    event = top.filter("cls = 'Event'")
    children = _children(nodes, event, EVENT_CHILDREN, addresses)
    props = ", ".join(f"'{p}'" for p in ("@type", *EVENT_PROPS))
    plain = event.selectExpr("graph_id", "cls", f"filter(es, e -> e.k in ({props})) as es")
    place = top.filter("cls = 'Place'").join(addresses, ["graph_id", "s"], "left")
    place_rows = place.withColumn("es", F.expr("filter(es, e -> e.k <> 'address')")).selectExpr(
        "graph_id", "cls", f"{_WITH_ADDRESSES} as es"
    )
    child_rows = children.select("graph_id", F.lit("Event").alias("cls"), F.array(_entry(F.col("k"), "v")).alias("es"))
    other = plain_nodes(nodes, main.filter("cls not in ('Event', 'Place')"), keep_id, vocab)
    rows = plain.unionByName(child_rows).unionByName(place_rows).unionByName(other)
    if keep_id:
        rows = rows.unionByName(
            main.filter("cls in ('Event', 'Place')").select("graph_id", "cls", F.array(_id("graph_id")).alias("es"))
        )
    expected = "array(" + ",".join(f"'{p}'" for p in (*EVENT_PROPS, *(c.prop for c in EVENT_CHILDREN))) + ")"
    docs = rows.filter(F.size("es") > 0).groupBy("graph_id", "cls").agg(F.flatten(F.collect_list("es")).alias("es"))
    wanted = f"if(cls = 'Event', {expected}, array())"
    return docs.withColumn("expected", F.expr(wanted)).select("graph_id", "cls", F.expr(_FILLED).alias("es"))


def frame_texts(entries: DataFrame, own_frames: DataFrame | None = None) -> DataFrame:
    """The documents of :func:`frame_entries` as texts: (graph_id, cls, json)."""
    if own_frames is not None:
        entries = entries.join(own_frames.select("graph_id", "frame"), "graph_id", "left").withColumn(
            "es",
            F.expr("""if(frame is null, es, filter(es, e -> startswith(e.k, '@') or
              array_contains(json_object_keys(frame), e.k)))"""),
        )
    return entries.selectExpr(
        "graph_id", "cls", f"""concat('{{{CONTEXT}', ',', substr({_object('es')}, 2)) as json"""
    )


def plain_nodes(nodes: DataFrame, main: DataFrame, keep_id: bool = False, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """(graph_id, cls, es): the entries of graphs without a layout of their own.

    A single node stands at the top; several are the list ``@graph``. In published markup
    the top has no id, and in the list neither have nodes of the knowledge graph, nor an
    only offer of a node.
    """
    whole = nodes.join(main, "graph_id").withColumn("es", F.sort_array(F.concat("es", F.array(_id("s")))))
    graphs = whole.groupBy("graph_id", "cls").agg(F.sort_array(F.collect_list(F.struct("s", "es"))).alias("nodes"))
    hidden = "false" if keep_id else " or ".join(f"contains(g.s, '{base}')" for base in (vocab.kg_base, vocab.mint_base))
    offer = "size(filter(g.es, x -> x.k = 'offers')) = 1 and e.k = 'offers'"
    cleaned = f"""transform(filter(g.es, e -> e.k <> '@id' or not ({hidden})),
      e -> if({"false" if keep_id else offer}, named_struct('k', e.k, 'v', '{{}}'), e))"""
    listed = f"""array(named_struct('k', '@graph', 'v', concat('[', array_join(transform(nodes, g -> {_object(cleaned)}), ','), ']')))"""
    single = "nodes[0].es" if keep_id else "filter(nodes[0].es, e -> e.k <> '@id')"
    return graphs.selectExpr("graph_id", "cls", f"if(size(nodes) = 1, {single}, {listed}) as es")
