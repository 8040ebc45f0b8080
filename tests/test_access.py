"""Pages and places of ordered rows, substring search of names, URL prefixes, shared descriptions."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from pagefacts.functions import classify as K
from pagefacts.operators import graph as G
from pagefacts.operators.name_index import NameIndex
from pagefacts.operators.ranks import rank_rows
from pagefacts.vocab import RDF_TYPE, SCHEMA


def test_pages_read_their_ranges_only(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, rng.randrange(40)]), i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, id int, text string").repartition(5)
    ranked = rank_rows(df, F.col("a").desc_nulls_last(), "id", ranges=8)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert len(ranked) == 3000 and len(ranked.ranges) > 4
    for number, size in ((1, 100), (2, 700), (30, 100), (31, 100), (1, 5000), (3, 1400)):
        got = [tuple(r) for r in ranked.page(number, size).collect()]
        assert got == want[(number - 1) * size : number * size]
    plan = ranked.page(30, 10)._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\n]*?)\], PushedFilters", plan)[1]
    assert "_range" in filters and len(re.findall(r"\d+", re.sub(r"#\d+", "", filters))) <= 2
    places = {r.id: r.place for r in ranked.places().collect()}
    assert [places[r[1]] for r in want] == list(range(1, 3001))
    none = rank_rows(df.filter("id < 0"), "id")
    assert len(none) == 0 and none.page(1, 10).collect() == [] and none.places().collect() == []


def test_names_that_contain_a_text(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["ABC", "Éa", "%", "a%b", "aaaaaa"]
    rows = [(rng.choice(["Place", "Person"]), w, i, f"id{i}") for i, w in enumerate(words)]
    names = spark.createDataFrame(rows, "class string, name string, webpage_id int, id string")
    names = names.withColumn("key", F.lower("name")).withColumn("number", F.xxhash64("class", "key"))
    index = NameIndex.save(names, str(tmp_path / "names"))
    texts = ["", "a", "B", "éa", "abc", "ABCA", "a%", "zzz", "abzz", "aaaaaaa", *["".join(rng.choice("abc ") for _ in range(rng.randint(1, 6))) for _ in range(60)]]
    searches = spark.createDataFrame([(t, c) for t in texts for c in ("Place", "Person", "Thing")], "text string, class string")
    got = {(r.text, r["class"], r.id) for r in index.search(searches).collect()}
    want = {(t, c, i) for t in texts for c, w, _, i in rows if t.lower() in w.lower()}
    assert got == want and len(want) > 500
    for text in ("", "a", "ab", "abc", "bca b", "none of these"):
        assert {r.id for r in index.search_one(text, "Place").collect()} == {i for t, c, i in want if t == text and c == "Place"} or text not in texts
    one = {r.id for r in index.search_one("ABC", "Person").collect()}
    assert one == {i for c, w, _, i in rows if c == "Person" and "abc" in w.lower()}
    plan = index.search_one("abca", "Place")._jdf.queryExecution().executedPlan().toString()
    assert "In(piece, [abc,bca])" in plan


def test_url_prefixes_of_a_large_host(spark):
    """One host with a hundred thousand prefixes: they stay rows; the longest that fits is found."""
    many = spark.range(100_000).select(F.lit("big.example").alias("host"), F.concat(F.lit("/p"), F.col("id"), F.lit("/")).alias("prefix"))
    few = spark.createDataFrame([("big.example", "/p7/x"), ("a.example", "/"), ("b.example", ""), ("c.example", "/long/prefix")], "host string, prefix string")
    patterns = many.unionByName(few)
    urls = {
        "https://big.example/p99999/event": "ok", "https://big.example/p100000/event": "outside_pattern", "https://big.example/p7/x": "ok",
        "https://big.example": "outside_pattern", "https://a.example/any?q=1": "ok", "https://b.example": "ok", "https://c.example/long": "outside_pattern",
        "https://d.example/": "domain_missing", "not a url": "domain_missing",
    }
    pages = spark.createDataFrame([(u,) for u in urls] * 2, "url string")
    got = K.gate_urls(pages, patterns).collect()
    assert len(got) == 2 * len(urls) and {r.url: r.decision for r in got} == urls
    split = pages.select(F.expr("try_parse_url(url, 'HOST')").alias("host"), F.expr("try_parse_url(url, 'PATH')").alias("path"))
    longest = {r.path: r.prefix for r in K.matching_prefixes(split, patterns).filter("host = 'big.example'").collect()}
    assert longest == {"/p99999/event": "/p99999/", "/p7/x": "/p7/x"}


def test_descriptions_of_widely_used_uris(spark):
    """A class that every graph points to is dealt out in parts; the rows are those of one part."""
    schema = "graph_id string, s string, p string, o string, o_kind string, lang string, datatype string, pos int"
    facts = [("", "http://class", SCHEMA + "name", f"n{i}", "literal", "", "", None) for i in range(3)]
    facts += [("", "http://class", SCHEMA + "see", "http://more", "uri", "", "", None), ("", "http://more", RDF_TYPE, "http://x", "uri", "", "", None)]
    facts += [("", "http://own3", SCHEMA + "name", "own", "literal", "", "", None)]
    kg = spark.createDataFrame(facts, schema)
    uris = spark.range(400).select(F.concat(F.lit("g"), "id").alias("graph_id"), F.lit("http://class").alias("uri")).unionByName(
        spark.range(400).select(F.concat(F.lit("g"), "id").alias("graph_id"), F.concat(F.lit("http://own"), "id").alias("uri"))
    )
    plain, parted = (sorted(map(str, G.describe(kg, uris, limit=n).collect())) for n in (10_000, 30))
    assert plain == parted and len(plain) == 400 * 5 + 1
