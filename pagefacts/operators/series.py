"""Series: contact points and offers split by position, events split by start date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.operators.graph import annotations, count_annotations, merge, rewrite, triples
from pagefacts.session import cut_lineage
from pagefacts.sources.schemas import TRIPLE_COLUMNS
from pagefacts.vocab import RDF_TYPE, SCHEMA

START, END, LOCATION, NAME = (SCHEMA + n for n in ("startDate", "endDate", "location", "name"))
_VALUE = ("o", "o_kind", "lang", "datatype")


def _triple(
    graph_id: str, s: Column, p: Column | str, o: Column, kind: Column | str, lang: Column | str = "",
    datatype: Column | str = "",
) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.col(graph_id).alias("graph_id"),
        s.alias("s"),
        lit(p).alias("p"),
        o.alias("o"),
        lit(kind).alias("o_kind"),
        lit(lang).alias("lang"),
        lit(datatype).alias("datatype"),
        F.lit(None).cast("int").alias("pos"),
    )


def _explode(rows: DataFrame, *triples_: Column) -> DataFrame:
    return rows.select(F.explode(F.array(*triples_)).alias("t")).select("t.*")


CONTACTS = (SCHEMA + "contactPoint", SCHEMA + "ContactPoint")
OFFERS = (SCHEMA + "offers", SCHEMA + "Offer")


def split_by_position(graph: DataFrame, *kinds: tuple[str, str]) -> DataFrame:
    """Every annotated value of a linked node moves to a node of its position.

    ``kinds`` are (link, class) pairs, all handled in one pass. The node, its link and
    the moved values are removed; values without a position stay.
    """
    facts = triples(graph)
    classes = F.col("cls")
    pairs = F.lit(None).cast("string")
    for link, cls in kinds:
        pairs = F.when(F.col("p") == link, cls).otherwise(pairs)
    links = (
        facts.filter(F.col("p").isin(*[k[0] for k in kinds]) & (F.col("s") == F.col("graph_id")))
        .select("graph_id", F.col("s").alias("owner"), F.col("p").alias("link"), F.col("o").alias("node"), pairs.alias("cls"))
    )
    typed = facts.filter((F.col("p") == RDF_TYPE) & F.col("o").isin(*[k[1] for k in kinds])).select(
        "graph_id", F.col("s").alias("node"), F.col("o").alias("cls")
    )
    nodes = links.join(typed, ["graph_id", "node", "cls"], "left_semi").distinct()
    # only the values of linked nodes are compared, not those of every annotation
    ends = nodes.select("graph_id", F.col("node").alias("s")).distinct()
    placed = annotations(graph).join(ends, ["graph_id", "s"], "left_semi")
    placed = placed.join(facts.drop("pos"), list(TRIPLE_COLUMNS), "left_semi").withColumnRenamed("s", "node")
    moved = nodes.join(placed, ["graph_id", "node"])
    value = (F.col("o"), F.col("o_kind"), F.col("lang"), F.col("datatype"))
    node, owner, link = F.col("node"), F.col("owner"), F.col("link")
    new = F.concat(node, F.lit("_"), F.col("pos").cast("string"))
    delete = _explode(
        moved,
        _triple("graph_id", owner, link, node, "uri"),
        _triple("graph_id", node, RDF_TYPE, classes, "uri"),
        _triple("graph_id", node, F.col("p"), *value),
    )
    insert = _explode(
        moved,
        _triple("graph_id", owner, link, new, "uri"),
        _triple("graph_id", new, RDF_TYPE, classes, "uri"),
        _triple("graph_id", new, F.col("p"), *value),
    )
    return rewrite(graph, delete, insert)


def contact_series(graph: DataFrame) -> DataFrame:
    """I4."""
    return split_by_position(graph, CONTACTS)


def offer_series(graph: DataFrame) -> DataFrame:
    """I5."""
    return split_by_position(graph, OFFERS)


def series_variant(graph: DataFrame) -> DataFrame:
    """How each graph is split, from its numbers of dated and placed values.

    ``unchanged`` up to one start; ``rejected`` when the numbers fit no form.
    """
    n = lambda p: F.coalesce(F.sum(F.when(F.col("p") == p, F.col("n"))), F.lit(0))
    counted = (
        count_annotations(graph)
        .groupBy("graph_id")
        .agg(n(START).alias("starts"), n(LOCATION).alias("locations"), n(END).alias("ends"))
    )
    starts, locations, ends = F.col("starts"), F.col("locations"), F.col("ends")
    return counted.withColumn(
        "variant",
        F.when(starts <= 1, "unchanged")
        .when((locations > 1) & (starts == locations) & (starts == ends), "locations")
        .when((locations > 1) & (starts == locations), "locations_only_start")
        .when((locations < 2) & (ends != starts), "dates_only_start")
        .when(locations < 2, "dates")
        .otherwise("rejected"),
    )


def rejected_series(graph: DataFrame) -> DataFrame:
    """Graphs whose numbers of starts, places and ends fit no form, with the numbers."""
    return series_variant(graph).filter("variant = 'rejected'")


def event_series(graph: DataFrame) -> DataFrame:
    """An event with several starts becomes a series with one sub-event per start.

    Graphs in no series form vanish (see :func:`rejected_series`). Every join carries
    the graph id, and values meet by (graph, position), so no group is gathered.
    """
    variant = series_variant(graph).select("graph_id", "variant")
    tagged = graph.join(variant, "graph_id", "left").filter("variant is null or variant <> 'rejected'")
    active = tagged.filter("variant not in ('unchanged')").filter(F.col("s") == F.col("graph_id"))
    by_place = F.col("variant").startswith("locations")

    facts, marks = triples(active), annotations(active)
    has = lambda p, extra=None: (
        facts.filter((F.col("p") == p) if extra is None else (F.col("p") == p) & extra).select("graph_id").distinct()
    )
    value = F.struct(*_VALUE)
    at = lambda p, name: marks.filter(F.col("p") == p).select("graph_id", "pos", value.alias(name))

    ready = has(NAME).join(has(RDF_TYPE, F.col("o") == SCHEMA + "Event"), "graph_id", "left_semi")
    starts = at(START, "start").join(variant, "graph_id").join(ready, "graph_id", "left_semi")
    with_end = starts.join(at(END, "end"), ["graph_id", "pos"], "left")
    aligned = with_end.filter(by_place).join(at(LOCATION, "place"), ["graph_id", "pos"])
    shared_places = facts.filter((F.col("p") == LOCATION) & ~by_place).select("graph_id", value.alias("place"))
    shared = with_end.filter(~by_place).join(shared_places, "graph_id")
    columns = ["graph_id", "variant", "start", "end", "place"]
    parts = cut_lineage(aligned.select(columns).unionByName(shared.select(columns)), "parts")  # read by four consumers

    uri = F.col("graph_id")
    sub = F.concat(uri, F.lit("#"), F.replace(F.col("start.o"), F.lit(":"), F.lit("")))
    struct = lambda c: [F.col(f"{c}.{f}") for f in _VALUE]
    full = F.col("variant").isin("dates", "locations") & F.col("end").isNotNull()
    event = F.lit(SCHEMA + "Event")

    delete = _explode_some(
        parts,
        _triple("graph_id", uri, RDF_TYPE, event, "uri"),
        _triple("graph_id", uri, START, *struct("start")),
        F.when(F.col("end").isNotNull(), _triple("graph_id", uri, END, *struct("end"))),
        F.when(by_place, _triple("graph_id", uri, LOCATION, *struct("place"))),
    )
    body = _explode_some(
        parts,
        _triple("graph_id", uri, SCHEMA + "subEvent", sub, "uri"),
        _triple("graph_id", sub, RDF_TYPE, event, "uri"),
        _triple("graph_id", sub, START, *struct("start")),
        F.when(full, _triple("graph_id", sub, END, *struct("end"))),
        _triple("graph_id", sub, LOCATION, *struct("place")),
    )
    names = facts.filter(F.col("p") == NAME).select("graph_id", value.alias("name"))
    named = (
        parts.select("graph_id", sub.alias("sub"))
        .distinct()
        .join(names, "graph_id")
    )
    titles = _explode_some(named, _triple("graph_id", F.col("sub"), NAME, *struct("name")))

    started = parts.select("graph_id", "variant").distinct()
    edge = facts.filter(F.col("p") == START).groupBy("graph_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    first_place = (
        marks.filter((F.col("p") == LOCATION) & by_place)
        .groupBy("graph_id")
        .agg(F.min(F.struct("pos", value.alias("v")))["v"].alias("place"))
    )
    head = started.join(edge, "graph_id").join(first_place, "graph_id", "left")
    parent = _explode_some(
        head,
        _triple("graph_id", uri, RDF_TYPE, F.lit(SCHEMA + "EventSeries"), "uri"),
        _triple("graph_id", uri, START, *struct("low")),
        _triple("graph_id", uri, END, *struct("high")),
        F.when(by_place, _triple("graph_id", uri, LOCATION, *struct("place"))),
    )
    return rewrite(tagged.drop("variant"), delete, merge(body, titles, parent))


def _explode_some(rows: DataFrame, *maybe: Column) -> DataFrame:
    kept = F.filter(F.array(*maybe), lambda t: t.isNotNull())
    return rows.select(F.explode(kept).alias("t")).select("t.*")
