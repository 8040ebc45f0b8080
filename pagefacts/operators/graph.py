"""Graph rows: building triples, describing and enriching, and the simple rewrites.

A graph frame has one row per triple (``pos`` null) and one per annotation
(``pos`` set); all graphs of a job sit in one frame under ``graph_id``, so every
rewrite is one batch job. ``lang`` and ``datatype`` are ``''`` when absent, which
keeps row equality plain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefacts.functions import values as V
from pagefacts.sources.schemas import GRAPH_COLUMNS, TRIPLE_COLUMNS
from pagefacts.vocab import DEFAULT, RDF_TYPE, SCHEMA, XSD_DATE, XSD_DATETIME, Vocabulary

# A dateTime needs date and time; the offset is optional. A date may carry an offset.
_XSD_DATETIME_RE = (
    r"^-?\d{4,}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-4]):[0-5]\d:[0-5]\d(?:\.\d+)?"
    r"(?:Z|[+-]\d{2}:\d{2})?$"
)
_XSD_DATE_RE = r"^-?\d{4,}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:Z|[+-]\d{2}:\d{2})?$"


def triples(graph: DataFrame) -> DataFrame:
    return graph.filter("pos is null")


def annotations(graph: DataFrame) -> DataFrame:
    return graph.filter("pos is not null")


def drop_annotations(graph: DataFrame) -> DataFrame:
    """I2."""
    return triples(graph)


def as_set(graph: DataFrame) -> DataFrame:
    """G1: a graph is a set of rows."""
    return graph.select(*GRAPH_COLUMNS).distinct()


def merge(*graphs: DataFrame) -> DataFrame:
    """G1: union of graphs."""
    out = graphs[0].select(*GRAPH_COLUMNS)
    for g in graphs[1:]:
        out = out.unionByName(g.select(*GRAPH_COLUMNS))
    return out.distinct()


def _triple_key(rows: DataFrame) -> DataFrame:
    """Rows with a 128-bit hash of their triple beside the graph's id."""
    columns = [F.col(c) for c in TRIPLE_COLUMNS]
    return rows.withColumn("_k", F.xxhash64(*columns)).withColumn("_l", F.xxhash64(F.lit("second"), *columns))


def rewrite(graph: DataFrame, delete: DataFrame, insert: DataFrame | None = None) -> DataFrame:
    """(triples - deleted) + inserted; annotations stay.

    With insertions the result is a set, so what stays, goes and comes meets in the one aggregate that a set needs
    anyway. Without, triples meet the deletions by graph and hash, not by their texts; annotations meet nothing.
    """
    if insert is not None:
        marked = graph.select(*GRAPH_COLUMNS, F.lit(0).alias("_mark"))
        # a triple without a graph has no graph to be deleted from
        gone = delete.filter(F.col("graph_id").isNotNull()).select(*TRIPLE_COLUMNS, F.lit(None).cast("int").alias("pos"))
        marked = marked.unionByName(gone.select(*GRAPH_COLUMNS, F.lit(1).alias("_mark")))
        marked = marked.unionByName(insert.select(*GRAPH_COLUMNS, F.lit(2).alias("_mark")))
        # 2 wins, then 1, then 0
        return marked.groupBy(*GRAPH_COLUMNS).agg(F.max("_mark").alias("_mark")).filter("_mark <> 1").select(*GRAPH_COLUMNS)
    gone = _triple_key(delete.select(*TRIPLE_COLUMNS)).select("graph_id", "_k", "_l")
    kept = _triple_key(graph.filter("pos is null")).join(gone, ["graph_id", "_k", "_l"], "left_anti").select(*GRAPH_COLUMNS)
    return kept.unionByName(graph.filter("pos is not null").select(*GRAPH_COLUMNS))


def _row(
    s: Column,
    p: Column | str,
    o: Column,
    kind: str,
    lang: Column | str = "",
    datatype: Column | str = "",
    pos: Column | None = None,
) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        s.alias("s"),
        lit(p).alias("p"),
        o.alias("o"),
        F.lit(kind).alias("o_kind"),
        lit(lang).alias("lang"),
        lit(datatype).alias("datatype"),
        (F.lit(None) if pos is None else pos).cast("int").alias("pos"),
    )


def valid_datetime(c: Column) -> Column:
    return c.rlike(_XSD_DATETIME_RE) & F.substring(c, 1, 10).try_cast("date").isNotNull()


def valid_date(c: Column) -> Column:
    return c.rlike(_XSD_DATE_RE) & F.substring(c, 1, 10).try_cast("date").isNotNull()


def build_graph(flat: DataFrame, annotate: bool = True, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Graph rows of flat statements, in one select and one explode.

    Needs rdf_uri, page_class, status, cache, value_datatype, predicate, rule_language,
    rdfs_class_name, cache_refreshed. Statements never seen by a reviewer, problems,
    blank values and empty predicates give nothing.
    """
    value, pred = F.col("cache"), F.col("predicate")
    lang = F.coalesce(F.col("rule_language"), F.lit(""))
    subject = V.full_uri("rdf_uri", vocab)
    usable = (
        ~F.col("status").isin("initial", "problem")
        & V.has_value(value)
        & (F.coalesce(pred, F.lit("")) != "")
    )
    rows = flat.filter(usable).select(
        "*",
        subject.alias("_s"),
        F.when(F.col("value_datatype") == "xsd:anyURI", V.link_uris(V.parse_links(value))).alias("_uris"),
        V.to_array(value).alias("_values"),
    )
    s, uris, values = F.col("_s"), F.col("_uris"), F.col("_values")
    none = F.array().cast("array<struct<s:string,p:string,o:string,o_kind:string,lang:string,datatype:string,pos:int>>")

    def with_pos(items: Column, make) -> Column:
        """Triple rows, and annotation rows with the element's position."""
        plain = F.transform(items, lambda v, i: make(v, None))
        if not annotate:
            return plain
        return F.concat(plain, F.transform(items, lambda v, i: make(v, i)))

    def nested(link: str, cls: str, positions: str) -> Column:
        node = V.node_uri(s, cls)
        head = F.array(
            _row(s, SCHEMA + link, node, "uri"), _row(node, RDF_TYPE, F.lit(SCHEMA + cls), "uri")
        )
        if positions == "single":
            body = F.array(_row(node, pred, value, "literal", lang))
        else:
            items = F.filter(values, lambda v: v.isNotNull())
            body = (
                with_pos(items, lambda v, i: _row(node, pred, v, "literal", lang, pos=i))
                if positions == "numbered"
                else F.transform(items, lambda v: _row(node, pred, v, "literal", lang))
            )
        return F.concat(head, body)

    page_node = V.node_uri(value, "WebPage")
    web_page = F.concat(
        F.array(
            _row(s, SCHEMA + "mainEntityOfPage", page_node, "uri"),
            _row(page_node, RDF_TYPE, F.lit(SCHEMA + "WebPage"), "uri"),
            _row(page_node, pred, value, "literal"),
        ),
        F.when(lang != "", F.array(_row(page_node, SCHEMA + "inLanguage", lang, "literal"))).otherwise(none),
        F.when(
            F.col("cache_refreshed").isNotNull(),
            F.array(
                _row(
                    page_node,
                    SCHEMA + "lastReviewed",
                    F.concat(F.date_format("cache_refreshed", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")),
                    "literal",
                    datatype=XSD_DATETIME,
                )
            ),
        ).otherwise(none),
    )
    minted = lambda u: F.replace(u, F.lit(vocab.mint_prefix), F.lit(vocab.mint_base))
    link = (
        F.when(
            F.contains(pred, F.lit("sameAs")),
            F.transform(uris, lambda u: _row(s, pred, minted(u), "literal")),
        )
        .when(
            F.contains(pred, F.lit("location")),
            with_pos(uris, lambda u, i: _row(s, pred, minted(u), "uri", pos=i)),
        )
        .otherwise(F.transform(uris, lambda u: _row(s, pred, minted(u), "uri")))
    )
    # each date is tested once, for its triple and its annotation
    kinds = F.transform(
        values,
        lambda v, i: F.struct(
            v.alias("v"), F.when(valid_datetime(v), XSD_DATETIME).when(valid_date(v), XSD_DATE).alias("kind"), i.alias("i")
        ),
    )
    dated = V.once(
        F.filter(kinds, lambda d: d["kind"].isNotNull()),
        lambda found: with_pos(
            found, lambda d, i: _row(s, pred, d["v"], "literal", datatype=d["kind"], pos=None if i is None else d["i"])
        ),
    )
    cls, dt = F.col("rdfs_class_name"), F.col("value_datatype")
    facts = (
        F.when(cls == "Offer", nested("offers", "Offer", "numbered"))
        .when(cls == "VirtualLocation", nested("location", "VirtualLocation", "single"))
        .when(cls == "PostalAddress", nested("address", "PostalAddress", "single"))
        .when(cls == "WebPage", web_page)
        .when(cls == "ContactPoint", nested("contactPoint", "ContactPoint", "numbered"))
        .when(cls == "AggregateOffer", nested("offers", "AggregateOffer", "plain"))
        .when(dt == "xsd:anyURI", link)
        .when(dt.isin("xsd:dateTime", "xsd:date"), dated)
        .otherwise(F.array(_row(s, pred, value, "literal", lang)))
    )
    main_type = _row(s, RDF_TYPE, F.concat(F.lit(SCHEMA), F.col("page_class")), "uri")
    # links without a URI give nothing; said here and not in a filter, which would be moved below the
    # joins and parse every value once more
    unlinked = F.coalesce(F.size(uris) == 0, F.lit(False))
    return (
        rows.select(s.alias("graph_id"), F.explode(F.when(unlinked, none).otherwise(F.concat(F.array(main_type), facts))).alias("t"))
        .select("graph_id", "t.*")
        .distinct()
    )


def count_annotations(graph: DataFrame) -> DataFrame:
    """Annotations per graph and predicate."""
    return annotations(graph).groupBy("graph_id", "p").agg(F.count(F.lit(1)).alias("n"))


def keep_schema_types(graph: DataFrame) -> DataFrame:
    """Drop types of other vocabularies."""
    return graph.filter((F.col("p") != RDF_TYPE) | F.contains("o", F.lit("schema.org")) | F.col("pos").isNotNull())


def strip_typed_dates(graph: DataFrame) -> DataFrame:
    """Typed dates become plain texts."""
    typed = F.col("datatype").isin(XSD_DATETIME, XSD_DATE) & F.col("pos").isNull()
    return graph.withColumn("datatype", F.when(typed, "").otherwise(F.col("datatype"))).distinct()


_TEXTS = (SCHEMA + "name", SCHEMA + "description", SCHEMA + "url")


def coalesce_language(graph: DataFrame, lang: Column | str = "") -> DataFrame:
    """Name, description and url keep the best language per subject.

    Order: the wanted language, no language, en, fr; literals in other languages are
    left alone. ``lang`` may be a column of the frame (a language per graph). Only the texts
    concerned are compared, within their (graph, subject, predicate); other rows do not move.
    """
    wanted = F.lit(lang) if isinstance(lang, str) else lang
    base = F.lower(F.regexp_extract("lang", "^([A-Za-z]*)", 1))
    rank = (
        F.when(base == "", F.when(wanted == "", 0).otherwise(1))
        .when(base == wanted, 0)
        .when(base == "en", 2)
        .otherwise(3)
    )
    candidate = (
        F.col("p").isin(*_TEXTS)
        & (F.col("o_kind") == "literal")
        & F.col("pos").isNull()
        & base.isin("", "en", "fr")
    )
    others = graph.filter(~F.coalesce(candidate, F.lit(False)))
    group = Window.partitionBy("graph_id", "s", "p")
    ranked = graph.filter(candidate).withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(group))
    return others.unionByName(ranked.filter("_rank = _best").select(*graph.columns))


def object_uris(graph: DataFrame) -> DataFrame:
    """Distinct URI objects per graph (types included)."""
    return triples(graph).filter("o_kind = 'uri'").select("graph_id", F.col("o").alias("uri")).distinct()


#: Graphs that ask for one URI, beyond which its description is dealt out in several parts.
SHARED_LIMIT = 5000


def descriptions(kg: DataFrame, uris: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """C16 per distinct URI: (uri, s, p, o, ...), its outgoing triples and one hop more through address
    nodes, objects the graph does not itself maintain, and blank nodes."""
    facts = triples(kg).select("s", "p", "o", "o_kind", "lang", "datatype")
    first = uris.select("uri").distinct().join(facts, F.col("uri") == F.col("s"))
    onward = (F.col("o_kind") == "bnode") | (
        (F.col("o_kind") == "uri")
        & (~F.startswith("o", F.lit(vocab.kg_entity)) | F.contains("o", F.lit("#PostalAddress")))
    )
    nodes = first.filter(onward).select("uri", F.col("o").alias("node")).distinct()
    second = nodes.join(facts, F.col("node") == F.col("s")).drop("node")
    return first.unionByName(second).distinct()


def describe(kg: DataFrame, uris: DataFrame, vocab: Vocabulary = DEFAULT, limit: int = SHARED_LIMIT) -> DataFrame:
    """What is known about the URIs of each graph (graph_id, uri).

    Every URI is described once, whatever number of graphs ask for it; the descriptions meet the
    graphs in one join at the end. A class URI of all graphs is dealt to as many parts as its
    graphs need, each with its own copy of the few rows that describe it, so no task has all.
    """
    return _described(kg, uris, vocab, limit).distinct()


def _described(kg: DataFrame, uris: DataFrame, vocab: Vocabulary = DEFAULT, limit: int = SHARED_LIMIT) -> DataFrame:
    """The rows of :func:`describe`; what several URIs of a graph share may stand more than once."""
    wanted = uris.select("graph_id", "uri").distinct()
    shared = (
        wanted.groupBy("uri")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit)
        .select("uri", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    )
    asked = wanted.join(shared, "uri", "left").select(
        "graph_id", "uri", F.coalesce(F.pmod(F.xxhash64("graph_id"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    )
    known = descriptions(kg, wanted, vocab).join(shared, "uri", "left")
    copies = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    found = asked.join(copies, ["uri", "part"]).drop("uri", "part")
    return found.withColumn("pos", F.lit(None).cast("int"))


def enrich(graph: DataFrame, kg: DataFrame, export: bool = False, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """C17: add what is known about the URIs a graph points to; an export leaves out
    entities the knowledge graph maintains."""
    uris = object_uris(graph)
    if export:
        uris = uris.filter(~F.contains("uri", F.lit(vocab.kg_entity)))
    rows = graph.select(*GRAPH_COLUMNS).unionByName(_described(kg, uris, vocab).select(*GRAPH_COLUMNS))
    # a set, dealt by subject: documents gather it by subject next and need not deal it once more
    return rows.repartition("graph_id", "s").distinct()


def place_address(kg: DataFrame, uris: DataFrame) -> DataFrame:
    """C20: address fields of places; any edge to a PostalAddress node counts."""
    facts = triples(kg)
    address = facts.filter((F.col("p") == RDF_TYPE) & (F.col("o") == SCHEMA + "PostalAddress")).select(
        F.col("s").alias("node")
    )
    edges = uris.select("uri").distinct().join(facts.select(F.col("s").alias("uri"), F.col("o").alias("node")), "uri")
    edges = edges.join(address.distinct(), "node", "left_semi").distinct()
    fields = edges.join(facts.select(F.col("s").alias("node"), "p", "o"), "node")
    named = fields.withColumn("field", V.local_name("p"))
    pick = lambda name: F.max(F.when(F.col("field") == name, F.col("o"))).alias(name)
    return named.groupBy("uri").agg(
        *[
            pick(n)
            for n in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
        ]
    )


#: Classes of the store's own entities that may describe others.
LOCAL_CLASSES = ("Place", "Organization", "Person", "EventType")


def local_graph(
    star_rows: DataFrame,
    classes: tuple[str, ...] = LOCAL_CLASSES,
    vocab: Vocabulary = DEFAULT,
) -> DataFrame:
    """A4: triples of the store's own entities, from statements whose rule is selected."""
    rows = star_rows.filter(F.col("selected") & F.col("page_class").isin(*classes))
    return build_graph(rows, annotate=False, vocab=vocab).withColumn("graph_id", F.lit("")).distinct()


_NT = (
    r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"'
    r"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$"
)


def _unescape(c: Column) -> Column:
    """N-Triples string escapes. Only texts with a backslash are rewritten; the escape
    forms are those of JSON plus 8-digit code points and a quote."""
    safe = F.regexp_replace(F.replace(c, F.lit("\\'"), F.lit("'")), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    parsed = F.get(F.from_json(F.concat(F.lit('["'), safe, F.lit('"]')), "array<string>"), F.lit(0))
    return F.when(F.contains(c, F.lit("\\")), F.coalesce(parsed, c)).otherwise(c)


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """A3: graph rows of N-Triples lines; comments and broken lines give nothing."""
    part = lambda i: F.regexp_extract(column, _NT, i)
    rows = lines.filter(F.col(column).rlike(_NT))
    subject = F.when(F.startswith(part(1), F.lit("<")), F.regexp_replace(part(1), "^<|>$", "")).otherwise(part(1))
    kind = F.when(part(3) != "", "uri").when(part(4) != "", "bnode").otherwise("literal")
    return rows.select(
        F.lit("").alias("graph_id"),
        subject.alias("s"),
        part(2).alias("p"),
        F.when(kind == "uri", part(3)).when(kind == "bnode", part(4)).otherwise(_unescape(part(5))).alias("o"),
        kind.alias("o_kind"),
        part(6).alias("lang"),
        part(7).alias("datatype"),
        F.lit(None).cast("int").alias("pos"),
    ).distinct()


def load_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """A3: a dump file or folder, read line by line in parallel."""
    return parse_ntriples(spark.read.text(path))
