"""Graph fixtures: series, contacts, offers, languages, documents."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagefacts.operators import graph as G
from pagefacts.operators import jsonld as J
from pagefacts.operators import series as E
from pagefacts.plans.skew import split_hot
from pagefacts.sources import schemas
from pagefacts.vocab import RDF_TYPE, SCHEMA, XSD_DATE, XSD_DATETIME

U = "http://kg.example.org/resource/show"


def graph(spark, rows, gid=U):
    """rows: (s, p, o, kind, lang, datatype, positions)."""
    out = []
    for s, p, o, kind, lang, dt, positions in rows:
        out += [(gid, s, p, o, kind, lang, dt, pos) for pos in (None, *positions)]
    return spark.createDataFrame(out, schemas.GRAPH)


def uri(s, p, o, *pos):
    return (s, SCHEMA + p if p != "type" else RDF_TYPE, SCHEMA + o if p == "type" else o, "uri", "", "", pos)


def text(s, p, o, *pos, lang="", dt=""):
    return (s, SCHEMA + p, o, "literal", lang, dt, pos)


def when(p, o, *pos):
    return text(U, p, o, *pos, dt=XSD_DATETIME)


BASE = [uri(U, "type", "Event"), text(U, "name", "Event Name")]
S1, S2 = "2023-01-01T20:00:00-04:00", "2023-02-02T20:00:00-04:00"
P1, P2 = "http://place.com/1", "http://place.com/2"
STARTS = [when("startDate", S1, 1), when("startDate", S2, 2)]
PLACES = [uri(U, "location", P1, 1), uri(U, "location", P2, 2)]
ENDS = [when("endDate", "2023-01-01T22:00:00-04:00", 1), when("endDate", "2023-02-02T22:00:00-04:00", 2)]
ONE_PLACE = [uri(U, "location", P1)]

CASES = {
    "two dates": (BASE + ONE_PLACE + STARTS, "dates_only_start", 7, 17),
    "two dates and ends": (BASE + ONE_PLACE + STARTS + ENDS, "dates", 11, 21),
    "one end only": (BASE + ONE_PLACE + STARTS + [when("endDate", "2023-02-02T23:00:00-04:00", 2)], "dates_only_start", 9, 18),
    "two places": (BASE + PLACES + STARTS, "locations_only_start", 10, 19),
    "two places and ends": (BASE + PLACES + STARTS + ENDS, "locations", 14, 23),
    "four places": (BASE + [uri(U, "location", P1, 1, 3), uri(U, "location", P2, 2, 4)] + STARTS, "rejected", 12, 0),
    "single date": (BASE + ONE_PLACE + STARTS[:1], "unchanged", 5, 5),
}


@pytest.mark.parametrize("name", CASES)
def test_event_series(spark, name):
    rows, variant, before, after = CASES[name]
    g = graph(spark, rows)
    assert g.count() == before
    assert E.series_variant(g).first().variant == variant
    out = E.event_series(g)
    assert out.count() == after == out.distinct().count()
    facts = {(r.s, r.p, r.o) for r in G.triples(out).collect()}
    if variant not in ("unchanged", "rejected"):
        subs = {o for s, p, o in facts if p == SCHEMA + "subEvent"}
        assert subs == {f"{U}#{d.replace(':', '')}" for d in (S1, S2)}
        assert (U, SCHEMA + "endDate", S2) in facts and (U, SCHEMA + "startDate", S1) in facts
        assert (U, RDF_TYPE, SCHEMA + "EventSeries") in facts and (U, RDF_TYPE, SCHEMA + "Event") not in facts
        with_end = {s for s, p, o in facts if p == SCHEMA + "endDate" and s in subs}
        assert with_end == (subs if variant in ("dates", "locations") else set())
    assert (E.rejected_series(g).count() == 1) == (variant == "rejected")


def test_series_do_not_mix_between_graphs(spark):
    rows, _, _, after = CASES["two places and ends"]
    other = [(s.replace("show", "other") if s == U else s, p, o, k, lang, dt, pos) for s, p, o, k, lang, dt, pos in rows]
    both = graph(spark, rows).unionByName(graph(spark, other, U.replace("show", "other")))
    counts = {r.graph_id: r["count"] for r in E.event_series(both).groupBy("graph_id").count().collect()}
    assert set(counts.values()) == {after} and len(counts) == 2


def test_contacts_and_offers(spark):
    c = "http://kg.example.org/resource/contactA"
    rows = BASE + ONE_PLACE + [when("startDate", S1), uri(U, "contactPoint", c), uri(c, "type", "ContactPoint")] + [
        text(c, "name", "Contact 1", 1), text(c, "name", "Contact 2", 2),
        text(c, "telephone", "Phone 1", 1), text(c, "telephone", "Phone 2", 2),
    ]
    g = graph(spark, rows)
    assert (g.count(), E.contact_series(g).count()) == (14, 16)
    o = "http://offer.com/1"
    rows = [uri(U, "type", "Event"), uri(U, "offers", o), uri(o, "type", "Offer")] + [
        text(o, "price", "123", 1), text(o, "price", "456", 2),
        text(o, "name", "kids", 1, lang="fr"), text(o, "name", "adults", 2, lang="fr"),
    ]
    g = graph(spark, rows)
    out = E.offer_series(g)
    assert (g.count(), out.count()) == (11, 13)
    moved = {(r.s, r.o) for r in G.triples(out).collect() if r.p == SCHEMA + "price"}
    assert moved == {(o + "_1", "123"), (o + "_2", "456")}


def test_annotations_dropped(spark):
    assert G.drop_annotations(graph(spark, CASES["two dates"][0])).count() == 5


@pytest.mark.parametrize("lang, want", [("", "Mien"), ("fr", "Mon"), ("de", "Mien"), ("en", "My")])
def test_language_choice(spark, lang, want):
    g = graph(spark, [text("h", "name", "My", lang="en"), text("h", "name", "Mon", lang="fr"), text("h", "name", "Mien")])
    assert [r.o for r in G.coalesce_language(g, lang).collect()] == [want]


def test_language_fallback_and_no_change(spark):
    g = graph(spark, [text("h", "name", "Mon", lang="fr"), text("h", "image", "x", lang="de"), text("i", "name", "Mein", lang="de")])
    assert G.coalesce_language(g, "en").count() == 3


def test_typed_dates_and_types(spark):
    g = graph(spark, [when("startDate", S1), text(U, "endDate", "2020-07-14", dt=XSD_DATE)])
    assert {r.datatype for r in G.strip_typed_dates(g).collect()} == {""}
    g = graph(spark, [uri(U, "type", "Event"), (U, RDF_TYPE, "http://other.org/X", "uri", "", "", ())])
    assert G.keep_schema_types(g).count() == 1


FLAT = (
    "rdf_uri string, page_class string, status string, cache string, value_datatype string, predicate string, "
    "rule_language string, rdfs_class_name string, cache_refreshed timestamp_ntz"
)


def flat(spark, *rows):
    base = ("adr:e", "Event", "ok")
    return spark.createDataFrame([(*base, *r, None) for r in rows], FLAT)


def test_build_graph_branches(spark):
    p = lambda n: SCHEMA + n
    rows = flat(
        spark,
        ("Name", "", p("name"), "en", "Event"),
        ('["5","6"]', "", p("price"), "", "Offer"),
        ("http://v", "", p("url"), "", "VirtualLocation"),
        ("Main st", "", p("streetAddress"), "", "PostalAddress"),
        ("http://page", "", p("url"), "fr", "WebPage"),
        ('["Ann","Bo"]', "", p("name"), "", "ContactPoint"),
        ('["1","2"]', "", p("lowPrice"), "", "AggregateOffer"),
        ('["x","Thing",["x","http://same"]]', "xsd:anyURI", p("sameAs"), "", "Event"),
        ('["x","Place",["x","mint:1"],["y","http://y"]]', "xsd:anyURI", p("location"), "", "Event"),
        ('["2020-01-01","2020-01-02T10:00:00-05:00","soon"]', "xsd:dateTime", p("startDate"), "", "Event"),
        ("[]", "", p("image"), "", "Event"),
        ("x", "", "", "", "Event"),
    )
    got = G.build_graph(rows).collect()
    s = "http://kg.example.org/resource/e"
    facts = {(r.s.replace(s, "e"), r.p.replace(SCHEMA, ""), r.o.replace(s, "e"), r.o_kind, r.pos) for r in got}
    for want in [
        ("e", RDF_TYPE, SCHEMA + "Event", "uri", None),
        ("e", "offers", "e#Offer", "uri", None), ("e#Offer", "price", "6", "literal", 1),
        ("e", "location", "e#VirtualLocation", "uri", None), ("e", "address", "e#PostalAddress", "uri", None),
        ("e", "mainEntityOfPage", "http://page#WebPage", "uri", None), ("http://page#WebPage", "inLanguage", "fr", "literal", None),
        ("e#ContactPoint", "name", "Bo", "literal", 1), ("e#AggregateOffer", "lowPrice", "2", "literal", None),
        ("e", "sameAs", "http://same", "literal", None), ("e", "location", "http://kg.example.org/minted/1", "uri", 0),
        ("e", "startDate", "2020-01-02T10:00:00-05:00", "literal", 1), ("e", "name", "Name", "literal", None),
    ]:
        assert want in facts, want
    assert not [f for f in facts if f[1] == "image" or f[2] == "soon" or (f[1] == "lowPrice" and f[4] is not None)]
    assert {r.datatype for r in got if r.p == p("startDate")} == {XSD_DATE, XSD_DATETIME}
    assert not [r for r in G.build_graph(rows, annotate=False).collect() if r.pos is not None]


def test_problem_and_initial_give_nothing(spark):
    rows = spark.createDataFrame(
        [("adr:e", "Event", st, "N", "", SCHEMA + "name", "", "Event", None) for st in ("problem", "initial")], FLAT
    )
    assert G.build_graph(rows).count() == 0


def test_ntriples(spark):
    lines = [
        '<http://a> <http://p> "x \\"y\\" \\u00e9"@fr .', "<http://a> <http://p> <http://b> . # note", "_:n1 <http://p> _:n2 .",
        '<http://a> <http://q> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .', "# comment", "broken", "",
    ]
    got = {(r.s, r.o, r.o_kind, r.lang) for r in G.parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {
        ("http://a", 'x "y" é', "literal", "fr"), ("http://a", "http://b", "uri", ""), ("_:n1", "_:n2", "bnode", ""), ("http://a", "5", "literal", ""),
    }


def test_describe_follows_addresses_and_blank_nodes(spark):
    k = "http://kg.example.org/resource/K1"
    kg = graph(spark, [
        uri(k, "address", k + "#PostalAddress"), text(k + "#PostalAddress", "addressCountry", "CA"),
        uri(k, "sameAs", "http://kg.example.org/resource/K2"), text("http://kg.example.org/resource/K2", "name", "no"),
        (k, SCHEMA + "geo", "_:g", "bnode", "", "", ()), text("_:g", "latitude", "1"),
    ], gid="")
    uris = spark.createDataFrame([("g", k)], "graph_id string, uri string")
    got = {(r.s, r.o) for r in G.describe(kg, uris).collect()}
    assert (k + "#PostalAddress", "CA") in got and ("_:g", "1") in got and len(got) == 5


def test_large_subject_is_split_without_loss(spark):
    rows = [text(U, "name", f"n{i}") for i in range(50)] + [text("small", "name", "x")]
    docs = J.to_jsonld(graph(spark, rows), limit=10).collect()
    big = [json.loads(d.json) for d in docs if d.s == U]
    assert len(big) > 1 and {d["@id"] for d in big} == {U}
    assert sorted(v["@value"] for d in big for v in d[SCHEMA + "name"]) == sorted(f"n{i}" for i in range(50))
    assert len([d for d in docs if d.s == "small"]) == 1


def test_split_hot_keeps_rows(spark):
    df = spark.range(300).select((F.col("id") % 3 == 0).alias("k"), "id")
    out = split_hot(df, ["k"], limit=40)
    assert out.count() == 300
    assert out.groupBy("k", "part").count().agg(F.max("count")).first()[0] < 80


def test_frame_event(spark):
    k = "http://kg.example.org/resource/K1"
    g = graph(spark, BASE + STARTS + [
        uri(U, "location", k), uri(k, "type", "Place"), text(k, "name", "Hall"), text(k, "secret", "x"),
        uri(k, "address", k + "#a"), uri(k + "#a", "type", "PostalAddress"), text(k + "#a", "postalCode", "J0R"),
        uri(U, "performer", "http://p"), uri("http://p", "type", "Robot"), text(U, "hidden", "x"),
    ])
    doc = json.loads(J.frame(G.drop_annotations(g)).first().json)
    assert doc["@type"] == "Event" and doc["name"] == "Event Name" and "@id" not in doc and "hidden" not in doc
    assert doc["location"]["name"] == "Hall" and "secret" not in doc["location"]
    assert doc["location"]["address"]["postalCode"] == "J0R"
    assert doc["performer"] is None and doc["duration"] is None and len(doc["startDate"]) == 2
    own = spark.createDataFrame([(U, '{"@explicit":true,"name":{}}')], "graph_id string, frame string")
    assert set(json.loads(J.frame(G.drop_annotations(g), own_frames=own).first().json)) == {"@context", "@type", "name"}


def test_size_does_not_change_a_document(spark):
    many = [text(f"http://x/{i}", "name", f"n{i}") for i in range(6000)]
    small = BASE + STARTS
    docs = [json.loads(r.json) for g in (small, small + many) for r in J.frame(G.drop_annotations(graph(spark, g))).collect()]
    assert len(docs) == 2 and docs[0] == docs[1]
    flat = J.to_jsonld(graph(spark, [text("http://x", "name", f"n{i}") for i in range(6000)])).collect()
    assert len(flat) == 1 and len(json.loads(flat[0].json)[SCHEMA + "name"]) == 6000


def test_listed_fields_of_linked_objects_are_null(spark):
    g = graph(spark, BASE + [
        uri(U, "location", "http://p"), uri("http://p", "type", "Place"), text("http://p", "name", "Hall"),
        uri(U, "offers", "http://o"), uri("http://o", "type", "Offer"), text("http://o", "price", "5"),
    ])
    doc = json.loads(J.frame(G.drop_annotations(g)).first().json)
    assert doc["location"] == {"@id": "http://p", "@type": "Place", "name": "Hall", "sameAs": None, "url": None}
    assert doc["offers"]["url"] is None and doc["offers"]["price"] == "5"


def test_documents_of_other_classes(spark):
    org = [uri(U, "type", "Organization"), text(U, "name", "Choir")]
    doc = json.loads(J.frame(graph(spark, org)).first().json)
    assert doc == {"@context": {"@vocab": "http://schema.org/"}, "@type": "Organization", "name": "Choir"}
    more = org + [text("http://kg.example.org/resource/K2", "name", "Part"), text("http://else", "name", "Other"), uri("http://else", "offers", "http://o")]
    doc = json.loads(J.frame(graph(spark, more)).first().json)
    ids = [n.get("@id") for n in doc["@graph"]]
    assert len(ids) == 3 and ids.count("http://else") == 1 and "http://kg.example.org/resource/K2" not in ids
    assert [n["offers"] for n in doc["@graph"] if "offers" in n] == [{}]


def test_graph_values_are_parsed_once(spark):
    """No join or filter below the graph parses values, links without a URI give nothing, and the rest is whole."""
    facts = spark.range(0, 30, 1, 2).selectExpr(
        "id as page", "'ok' as status", "'xsd:anyURI' as value_datatype", f"'{SCHEMA}location' as predicate", "'' as rule_language",
        "'Event' as rdfs_class_name", "cast(null as timestamp_ntz) as cache_refreshed",
        """case id % 3 when 0 then '["x","Place"]' when 1 then '["x","Place",["x","http://x"]]' when 2 then ' ' end as cache""",
    )
    pages = spark.range(0, 30, 1, 2).selectExpr("id as page", "concat('adr:e', id) as rdf_uri", "'Event' as page_class")
    graph = G.build_graph(facts.join(pages, "page"), annotate=False)
    plan = graph._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [line for line in plan if "from_json" in line and (" Join " in line or " Filter " in line)]
    assert {(r.p, r.o) for r in graph.collect()} == {(RDF_TYPE, SCHEMA + "Event"), (SCHEMA + "location", "http://x")}
    assert graph.count() == 20


def test_rewrite_meets_in_one_aggregate(spark):
    """what stays, goes and comes is settled by the aggregate of the set, without a join."""
    a, b, c = text(U, "name", "a"), text(U, "name", "b", 0), text(U, "name", "c")
    g = graph(spark, [a, a, b, c])
    out = G.rewrite(g, graph(spark, [b, c]), graph(spark, [c, text(U, "name", "d")]))
    assert sorted((r.o, r.pos) for r in out.select("o", F.coalesce("pos", F.lit(-1)).alias("pos")).collect()) == [
        ("a", -1), ("b", 0), ("c", -1), ("d", -1)
    ]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    lost = graph(spark, [a], gid=None)
    assert G.rewrite(lost, lost, g).filter("graph_id is null").count() == 1


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_facts_are_gathered_once(spark):
    """A frame's facts are written as one row a subject; later steps read that, not the graph."""
    g = graph(spark, BASE + STARTS + [uri(U, "location", "http://p"), uri("http://p", "type", "Place"), text("http://p", "name", "Hall")])
    docs = J.frame(G.drop_annotations(g))
    assert "RDD" not in _plan(docs) and "LocalTableScan" not in _plan(docs)
    assert json.loads(docs.first().json)["location"]["name"] == "Hall"


def test_marks_in_texts_and_lists_of_objects(spark):
    odd = 'a "b" \\ c\né '
    g = graph(spark, [
        uri(U, "type", "Event"), text(U, "name", odd), text(U, "name", "Nom", lang="fr"), text(U, "description", ""),
        uri(U, "location", "http://a"), uri("http://a", "type", "Place"), uri(U, "location", "http://b"),
        uri("http://b", "type", "VirtualLocation"), uri("http://a", "address", "http://a#1"), uri("http://a", "address", "http://a#2"),
        uri("http://a#1", "type", "PostalAddress"), uri("http://a#2", "type", "PostalAddress"), text("http://a#2", "postalCode", "J"),
    ])
    doc = json.loads(J.frame(g).first().json)
    assert odd in doc["name"] and {"@language": "fr", "@value": "Nom"} in doc["name"] and doc["description"] == ""
    place = {p["@id"]: p for p in doc["location"]}
    assert set(place) == {"http://a", "http://b"} and len(place["http://a"]["address"]) == 2
    assert place["http://a"]["address"][1] == {"@id": "http://a#2", "@type": "PostalAddress", "postalCode": "J"}


def test_documents_are_parsed_once(spark):
    from pagefacts.checks.publish_queries import leaves

    docs = spark.createDataFrame([(1, '{"a":[1,{"b":null,"c":{}},[]],"d":"x","e":{"f":{"g":true}}}'), (2, '"t"'), (3, "{}")], "id int, json string")
    rows = leaves(docs, "id")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [(1, "a", "1"), (1, "a.b", None), (1, "d", "x"), (1, "e.f.g", "true"), (2, "", "t")], key=str
    )
    deep = spark.createDataFrame([(1, '{"a":[[[[[7]]]]],"b":[[[[[[8]]]]]]}')], "id int, json string")
    assert [tuple(r) for r in leaves(deep, "id").collect()] == [(1, "a", "7")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1


def test_enriched_facts_are_dealt_once(spark, monkeypatch):
    """the set of the enriched facts is dealt by subject, as its documents gather it, and neither the graph nor the set stays."""
    from pagefacts import session
    from pagefacts.checks import publish_queries as Q
    from pagefacts.sources import files

    known = graph(spark, [uri(P1, "type", "Place"), text(P1, "name", "Hall"), text(P1, "name", "Hall")], gid="")
    g = graph(spark, BASE + STARTS + ONE_PLACE + BASE)
    rich = G.enrich(g, known)
    assert rich.count() == rich.distinct().count() == 9
    assert rich.filter("pos is null").count() == 7
    assert "hashpartitioning(graph_id#" in (plan := J._nodes(J._short(G.triples(rich)))._jdf.queryExecution().executedPlan().toString())
    assert plan.split("RepartitionByExpression")[0].count("REPARTITION_BY_COL") == 1
    above = plan.split("REPARTITION_BY_COL")[0]
    assert above.count("Exchange") == 1
    monkeypatch.setattr(Q, "stored_graph", lambda *_: session.cut_lineage(g, "graph"))
    monkeypatch.setattr(Q, "knowledge_graph", lambda *_: known)
    held = set(files.names(spark, session.durable_dir(spark)))
    docs = Q.i8(spark, "")
    left = {n.split("-")[0] for n in set(files.names(spark, session.durable_dir(spark))) - held}
    assert left == {"framed"}
    assert ("location.name", "Hall") in {(r.path, r.value) for r in docs.collect()}
