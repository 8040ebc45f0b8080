"""Column functions over stored values: arrays, link groups, keys and URIs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefacts.vocab import ABORT, ADDED, DEFAULT, DELETED, Vocabulary

LINKS = "array<struct<search:string,class:string,links:array<struct<label:string,uri:string>>>>"
STRINGS = "array<string>"

# ISO 8601 calendar date with optional complete time and offset; a dangling "T" is not valid.
_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_TIME = r"(?:[01]\d|2[0-4]):[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?"
_ISO = rf"^\s*{_DATE}(?:[Tt ]{_TIME}(?:[Zz]|[+-]\d{{2}}(?::?\d{{2}})?)?)?\s*$"
_FLOAT = r"^\s*[+-]?(?:\d+(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+)?\s*$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_blank(col: Column | str) -> Column:
    """Null, empty or only white space."""
    c = _c(col)
    return c.isNull() | c.rlike(r"^\s*$")


def is_empty_value(col: Column | str) -> Column:
    """Blank, or an empty list."""
    return is_blank(col) | (_c(col) == "[]")


def has_value(col: Column | str) -> Column:
    """Neither null, blank nor an empty list; names the column once, so a filter that is moved below the
    making of the column works it out once."""
    return ~F.coalesce(_c(col).rlike(r"^\s*$|\A\[\]\z"), F.lit(True))


def is_aborted(col: Column | str) -> Column:
    return F.coalesce(F.contains(_c(col), F.lit(ABORT)), F.lit(False))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, however often ``use`` names it.

    A column named twice in an expression is evaluated twice wherever branches or lambdas stand around it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_list(col: Column | str) -> Column:
    """Elements of a text that is exactly one JSON list; null for anything else.

    Reading it inside one more list makes text after the list an error, which
    ``from_json`` would otherwise skip. The text is read once.
    """
    c = _c(col)
    outer = F.from_json(
        F.concat(F.lit("["), c, F.lit("]")), f"array<{STRINGS}>", {"allowSingleQuotes": "false"}
    )
    return once(outer, lambda o: F.when(F.size(o) == 1, F.get(o, F.lit(0))))


def to_array(col: Column | str) -> Column:
    """H1: a JSON list becomes an array, anything else a one-element array; null is empty."""
    c = _c(col)
    parsed = F.when(F.startswith(c, F.lit("[")), json_list(c))
    return F.when(c.isNull(), F.array().cast(STRINGS)).otherwise(F.coalesce(parsed, F.array(c)))


def ensure_array(col: Column | str) -> Column:
    """H2: whatever parses as a JSON list is a list; all else is wrapped."""
    c = _c(col)
    return F.when(c.isNull(), F.array().cast(STRINGS)).otherwise(
        F.coalesce(
            F.when(F.ltrim(c).startswith("["), json_list(c)),
            F.array(F.coalesce(F.when(c.rlike(r'^\s*"'), F.get_json_object(c, "$")), c)),
        )
    )


def is_link_text(values: Column | str) -> Column:
    """The first value is already a stored link group."""
    return F.coalesce(F.startswith(F.get(_c(values), F.lit(0)), F.lit("[")), F.lit(False))


def parse_links(col: Column | str) -> Column:
    """H3: link groups of a stored value; unparsable text gives no groups.

    Staged over arrays (texts, items, hits), so each JSON text is read once.
    """
    c = _c(col)
    none = F.array().cast(STRINGS)
    texts = (
        F.when(c.rlike(r"^\s*\[\s*\["), json_list(c)).when(c.rlike(r'^\s*\[\s*"'), F.array(c)).otherwise(none)
    )
    items = F.filter(F.transform(F.coalesce(texts, none), json_list), lambda i: F.size(i) > 0)
    halves = F.transform(
        items,
        lambda i: F.struct(
            F.get(i, F.lit(0)).alias("search"),
            F.get(i, F.lit(1)).alias("class"),
            F.transform(
                F.filter(F.slice(i, 3, 1 << 30), lambda h: F.startswith(h, F.lit("["))),
                lambda h: F.from_json(h, STRINGS),
            ).alias("pairs"),
        ),
    )
    return F.transform(
        halves,
        lambda g: F.struct(
            g["search"].alias("search"),
            g["class"].alias("class"),
            F.transform(
                F.filter(g["pairs"], lambda p: p.isNotNull() & ~F.array_contains(p, "abort")),
                lambda p: F.struct(F.get(p, F.lit(0)).alias("label"), F.get(p, F.lit(1)).alias("uri")),
            ).alias("links"),
        ),
    ).cast(LINKS)


def _uris(groups: Column) -> Column:
    return F.flatten(F.transform(groups, lambda g: F.transform(g["links"], lambda h: h["uri"])))


def list_minus(left: Column, right: Column) -> Column:
    """List difference that keeps duplicates."""
    return F.filter(left, lambda x: ~F.coalesce(F.array_contains(right, x), F.lit(False)))


def link_uris(links: Column | str) -> Column:
    """H4: URIs of all groups but the deleted ones, minus the deleted URIs."""
    return once(
        _c(links),
        lambda g: once(
            _uris(F.filter(g, lambda x: x["search"].eqNullSafe(DELETED))),
            lambda gone: list_minus(_uris(F.filter(g, lambda x: ~x["search"].eqNullSafe(DELETED))), gone),
        ),
    )


def invalid_uri(col: Column | str, vocab: Vocabulary = DEFAULT) -> Column:
    """Blank, or neither an http address nor a minted id."""
    c = _c(col)
    return is_blank(c) | ~(F.startswith(c, F.lit("http")) | F.startswith(c, F.lit(vocab.mint_prefix)))


def missing_links(links: Column | str, vocab: Vocabulary = DEFAULT) -> Column:
    """H5: does a value with link groups still lack a link?"""
    g = _c(links)
    scraped = F.filter(
        g, lambda x: ~x["search"].eqNullSafe(DELETED) & ~x["search"].eqNullSafe(ADDED)
    )
    added = F.filter(g, lambda x: x["search"].eqNullSafe(ADDED))
    first_added = F.get(F.get(added, F.lit(0))["links"], F.lit(0))["uri"]
    no_link = invalid_uri(first_added, vocab)
    first_bad = F.exists(
        scraped, lambda x: invalid_uri(F.get(x["links"], F.lit(0))["uri"], vocab)
    )
    return F.when(F.size(_uris(scraped)) == 0, no_link).otherwise(first_bad)


def valid_iso_date(col: Column | str) -> Column:
    """H15 for one text: the pattern fits and the calendar day exists."""
    c = F.trim(_c(col))
    return F.coalesce(
        c.rlike(_ISO) & F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False)
    )


def any_valid_date(values: Column | str) -> Column:
    """H15 for a list."""
    return F.exists(_c(values), valid_iso_date)


def prices_ok(values: Column | str) -> Column:
    """Blanks aside, every element is a plain number."""
    return F.forall(_c(values), lambda p: is_blank(p) | p.rlike(_FLOAT))


def squish(col: Column | str) -> Column:
    """Trim and collapse white space."""
    return F.trim(F.regexp_replace(_c(col), r"[\s ]+", " "))


def local_name(col: Column | str) -> Column:
    """Last path segment."""
    return F.element_at(F.split(_c(col), "/"), -1)


def instance_id(key: Column | str | None = None, vocab: Vocabulary = DEFAULT) -> Column:
    """Id of a hand-made resource; derived from ``key`` when given, else random."""
    tail = F.uuid() if key is None else F.sha2(_c(key), 256)
    return F.concat(F.lit(vocab.mint_prefix), tail)


def build_key(label: Column | str, language: Column | str) -> Column:
    """First space to underscore, lower-case label, language as it is."""
    lang = _c(language)
    key = F.regexp_replace(F.lower(_c(label)), "^([^ ]*) ", "$1_")
    return F.when(is_blank(lang), key).otherwise(F.concat(key, F.lit("_"), lang))


def make_key(label: Column | str, language: Column | str) -> Column:
    """B3, event variant: the language is lower-cased too and gaps give a fixed text."""
    lang = F.lower(_c(language))
    key = F.lower(F.regexp_replace(_c(label), "^([^ ]*) ", "$1_"))
    full = F.when(lang.rlike(r"^\s*$"), key).otherwise(F.concat(key, F.lit("_"), lang))
    return F.coalesce(full, F.lit("failed to make key"))


def full_uri(col: Column | str, vocab: Vocabulary = DEFAULT) -> Column:
    """Expand both prefixes."""
    c = F.replace(_c(col), F.lit(vocab.kg_prefix), F.lit(vocab.kg_base))
    return F.replace(c, F.lit(vocab.mint_prefix), F.lit(vocab.mint_base))


def node_uri(subject: Column | str, suffix: str) -> Column:
    """Address of a nested node."""
    s = _c(subject)
    return F.when(F.contains(s, F.lit("#")), F.concat(s, F.lit("-" + suffix))).otherwise(
        F.concat(s, F.lit("#" + suffix))
    )


def normalize_url(col: Column | str) -> Column:
    """Trim and drop the fragment; text that is no address is only trimmed."""
    c = F.trim(_c(col))
    return F.when(c.rlike(r"[\s<>\"{}|\\^`]"), c).otherwise(F.regexp_replace(c, "#.*$", ""))


def json_text(col: Column) -> Column:
    """A JSON string literal of a text."""
    wrapped = F.to_json(F.array(col))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def links_text(links: Column) -> Column:
    """Stored form of link groups: one group bare, several as a list."""
    group = lambda g: F.concat(
        F.lit("["),
        F.concat_ws(
            ",",
            F.concat(
                F.array(json_text(g["search"]), json_text(g["class"])),
                F.transform(g["links"], lambda h: F.to_json(F.array(h["label"], h["uri"]))),
            ),
        ),
        F.lit("]"),
    )
    texts = F.transform(links, group)
    return F.when(F.size(links) == 1, F.get(texts, F.lit(0))).otherwise(
        F.concat(F.lit("["), F.concat_ws(",", texts), F.lit("]"))
    )
