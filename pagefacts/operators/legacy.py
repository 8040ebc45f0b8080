"""The earlier page markup: one event per start date, plus one series row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.functions import values as V
from pagefacts.operators.star import star
from pagefacts.sources.store import Store
from pagefacts.vocab import DEFAULT, REVIEWED, SCHEMA, Vocabulary


def nested_links(cache: Column) -> Column:
    """Objects (class, name, id) of the first link group of a value."""
    first = F.get(V.parse_links(cache), F.lit(0))
    return F.coalesce(
        F.transform(
            first["links"],
            lambda h: F.struct(first["class"].alias("type"), h["label"].alias("name"), h["uri"].alias("id")),
        ),
        F.array().cast("array<struct<type:string,name:string,id:string>>"),
    )


def offer_struct(price: Column, url: Column, as_of: str) -> Column:
    """An offer from a price and a url value; a url value of sold-out words says so
    and gives no address."""
    sold_out = F.coalesce(F.contains(url, F.lit("Complet")), F.lit(False))
    day = F.lit(as_of).cast("timestamp_ntz").cast("date")
    priced = ~F.coalesce(V.is_blank(price), F.lit(True))
    return F.when(
        priced | url.isNotNull(),
        F.struct(
            F.date_format(F.add_months(day, -1), "yyyy-MM-dd").alias("validFrom"),
            F.when(sold_out, SCHEMA + "SoldOut").otherwise(SCHEMA + "InStock").alias("availability"),
            F.when(url.isNotNull() & ~sold_out, V.to_array(url)).alias("url"),
            F.when(priced, price).alias("price"),
            F.when(priced, F.lit("CAD")).alias("priceCurrency"),
        ),
    )


def work_struct(keywords: Column, video: Column) -> Column:
    """The performed work, from keywords and video addresses; null if neither is given."""
    has_words = ~F.coalesce(V.is_blank(keywords), F.lit(True))
    has_video = ~F.coalesce(V.is_empty_value(video), F.lit(True))
    return F.when(
        has_words | has_video,
        F.struct(
            F.lit("CreativeWork").alias("type"),
            F.when(has_words, keywords).alias("keywords"),
            F.when(
                has_video, F.struct(F.lit("VideoObject").alias("type"), V.to_array(video).alias("url"))
            ).alias("video"),
        ),
    )


def performer_struct(name: Column, url: Column) -> Column:
    """A performing group from its name and url; empty values are left out."""
    some = lambda c: F.when(~F.coalesce(V.is_empty_value(c), F.lit(True)), c)
    return F.when(
        some(name).isNotNull() | some(url).isNotNull(),
        F.struct(F.lit("PerformingGroup").alias("type"), some(name).alias("name"), some(url).alias("url")),
    )


def legacy_publishable(dates: Column, places: Column, *names: Column) -> Column:
    """A date, a place and a name; several places must match the dates one to one."""
    named = F.lit(False)
    for n in names:
        named = named | ~F.coalesce(V.is_blank(n), F.lit(True))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return (
        (count(dates) > 0) & (count(places) > 0) & named & ((count(places) <= 1) | (count(places) == count(dates)))
    )


def by_index(values: Column, dates: Column, i: Column) -> Column:
    """The value at the date's index when there are as many values as dates, else the first."""
    return F.when(F.size(values) == F.size(dates), F.get(values, i)).otherwise(F.get(values, F.lit(0)))


def events_per_date(rows: DataFrame) -> DataFrame:
    """One row per start date, with place, duration and offer address by index."""
    dated = rows.select("*", F.posexplode("start_dates").alias("date_pos", "startDate"))
    i, dates = F.col("date_pos"), F.col("start_dates")
    return (
        dated.withColumn("endDate", F.substring("startDate", 1, 10))
        .withColumn("place", by_index(F.col("places"), dates, i))
        .withColumn("duration", by_index(F.col("durations"), dates, i))
        .withColumn("offer_url", by_index(F.col("offer_urls"), dates, i))
    )


def markup_values(store: Store, offer_url_props: tuple[str, ...] = ()) -> DataFrame:
    """(webpage_id, rdf_uri, page_language, kind, key, cache): what a page's markup shows, the last statement (by id) of
    each name.

    From reviewed statements of selected rules in the page's language or without one. Performers are left out, as their
    class is not known; a name or description carries the page's language in its key; link values that are no JSON
    list do not count. ``offer_url_props`` are the local names of properties whose values are addresses of the offer.
    """
    rows = star(store).filter(
        F.col("selected")
        & F.col("status").isin(*REVIEWED)
        & ((F.col("rule_language") == F.col("page_language")) | (F.col("rule_language") == ""))
    )
    prop = F.col("prop")
    kind = (
        F.when(prop.isin(*offer_url_props), "offer_url")
        .when(F.col("value_datatype") == "xsd:anyURI", "links")
        .when(F.col("value_datatype") == "xsd:dateTime", "dates")
        .when(prop == "duration", "durations")
        .when(prop == "price", "price")
        .otherwise("text")
    )
    tagged = rows.withColumn("prop", V.local_name("predicate")).filter(prop.isNotNull() & (prop != "performer"))
    tagged = tagged.withColumn("kind", kind).filter((F.col("kind") != "links") | V.json_list("cache").isNotNull())
    key = F.when(
        (F.col("kind") == "text") & prop.isin("name", "description"), F.concat(prop, F.lit("_"), "page_language")
    ).otherwise(prop)
    return (
        tagged.withColumn("key", key)
        .groupBy("webpage_id", "rdf_uri", "page_language", "kind", "key")
        .agg(F.max_by("cache", "statement_id").alias("cache"))
    )


def _list_text(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _links_json(links: Column) -> Column:
    shown = lambda h: F.to_json(F.struct(h["type"].alias("@type"), h["name"].alias("name"), h["id"].alias("@id")))
    return _list_text(F.transform(links, shown))


def legacy_events(
    store: Store, as_of: str, vocab: Vocabulary = DEFAULT, offer_url_props: tuple[str, ...] = ()
) -> DataFrame:
    """Per page one event for each start date and one row of their series, with all of the page's properties.

    ``properties`` maps each further name to its JSON value: places and other linked objects as objects, dates and
    durations as lists, all else as text. Place, duration and offer address are those of the date's place in the list
    where there are as many, else the first. ``endDate`` is the day of the start; ``name`` is the page's own.
    """
    values = markup_values(store, offer_url_props)
    one = lambda kind, key=None: F.max(
        F.when((F.col("kind") == kind) & (F.lit(True) if key is None else F.col("key") == key), F.col("cache"))
    )
    links, stored = nested_links(F.col("cache")), V.to_array("cache")
    text = (
        F.when(F.col("kind") == "links", _links_json(links))
        .when(F.col("kind") == "dates", F.to_json(stored))
        .otherwise(F.coalesce(V.json_text(F.col("cache")), F.lit("null")))
    )
    own = F.col("kind").isin("links", "dates", "text") & ~F.col("key").isin("startDate", "endDate", "location", "duration")
    pages = values.groupBy("webpage_id", "rdf_uri", "page_language").agg(
        one("dates", "startDate").alias("startDate"),
        one("links", "location").alias("location"),
        F.max(F.when((F.col("kind") == "text") & (F.col("key") == F.concat(F.lit("name_"), "page_language")), F.col("cache"))).alias("name"),
        F.max(F.when((F.col("kind") == "text") & (F.col("key") == F.concat(F.lit("description_"), "page_language")), F.col("cache"))).alias("description"),
        one("text", "image").alias("image"),
        one("durations").alias("duration"),
        one("price").alias("price"),
        one("offer_url").alias("offer_url"),
        F.collect_list(F.when(own, F.struct("key", "kind", text.alias("v")))).alias("shown"),
    )
    # a name that two kinds of property share is shown once, the text last
    last = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform("shown", lambda e: e["key"])),
            lambda k: F.struct(k.alias("key"), F.array_max(F.filter("shown", lambda e: e["key"] == k))["v"].alias("v")),
        )
    )
    shaped = pages.select(
        "webpage_id",
        V.full_uri("rdf_uri", vocab).alias("super_event"),
        "page_language",
        "name",
        "description",
        "image",
        F.when(F.col("startDate").isNotNull(), V.to_array("startDate")).alias("start_dates"),
        nested_links(F.col("location")).alias("places"),
        F.filter(V.to_array("duration"), lambda d: F.startswith(d, F.lit("PT"))).alias("durations"),
        offer_struct(F.col("price"), F.col("offer_url"), as_of).alias("offer"),
        last.alias("properties"),
    ).withColumn("offer_urls", F.col("offer.url"))
    events = events_per_date(shaped.filter(legacy_publishable(F.col("start_dates"), F.col("places"), F.col("name"))))
    columns = [
        "webpage_id", "super_event", "page_language", F.lit("Event").alias("type"), "date_pos", "startDate", "endDate", "name",
        "description", "image", "duration", F.col("place.id").alias("place_id"), F.col("place.name").alias("place_name"),
        F.col("place.type").alias("place_type"), F.col("offer.price").alias("price"), F.col("offer.validFrom").alias("valid_from"),
        F.col("offer.availability").alias("availability"), "offer_url", "properties",
    ]
    shown = events.select(*columns)
    series = ("webpage_id", "super_event", "page_language", "startDate", "name", "place_id", "place_name", "place_type")
    fixed = {"type": F.lit("EventSeries"), "date_pos": F.lit(-1)}
    first = shown.filter("date_pos = 0").select(
        *[
            fixed.get(f.name, F.col(f.name) if f.name in series else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in shown.schema
        ]
    )
    return shown.unionByName(first)


def legacy_documents(events: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """(webpage_id, type, date_pos, json): the markup of ``legacy_events``, one object a row, ready for a page.

    Prefixed addresses are written in full; a context maps the names with a language.
    """
    text, member = V.json_text, lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v))
    is_event = F.col("type") == "Event"
    named = lambda p: f'"{p}_en":{{"@id":"{p}","@language":"en"}},"{p}_fr":{{"@id":"{p}","@language":"fr"}}'
    context = F.when(is_event, F.lit(f'{{"@vocab":"{SCHEMA}",{named("description")},{named("name")}}}')).otherwise(
        F.lit(f'{{"@vocab":"{SCHEMA}",{named("name")}}}')
    )
    place = F.to_json(
        F.struct(F.col("place_type").alias("@type"), F.col("place_name").alias("name"), F.col("place_id").alias("@id"))
    )
    offer = F.to_json(
        F.struct(
            F.lit("Offer").alias("@type"), F.col("valid_from").alias("validFrom"), "availability", "price",
            F.when(F.col("price").isNotNull(), F.lit("CAD")).alias("priceCurrency"), F.col("offer_url").alias("url"),
        )
    )
    own = F.array_join(
        F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(text(e["key"]), F.lit(":"), e["value"])), ","
    )
    series_name = F.when(~is_event, F.concat(F.lit('"name_'), "page_language", F.lit('":'), text(F.col("name"))))
    body = F.concat_ws(
        ",",
        member("@context", context),
        member("@type", text(F.col("type"))),
        member("superEvent", F.when(is_event, F.to_json(F.struct(F.col("super_event").alias("@id"))))),
        member("@id", F.when(~is_event, text(F.col("super_event")))),
        F.when(own != "", own),
        member("startDate", text(F.col("startDate"))),
        member("endDate", F.when(F.col("endDate").isNotNull(), text(F.col("endDate")))),
        member("location", place),
        member("duration", F.when(F.col("duration").isNotNull(), text(F.col("duration")))),
        member("offers", F.when(F.col("valid_from").isNotNull(), offer)),
        series_name,
    )
    whole = F.replace(F.concat(F.lit("{"), body, F.lit("}")), F.lit(vocab.kg_prefix), F.lit(vocab.kg_base))
    return events.select("webpage_id", "type", "date_pos", whole.alias("json"))
