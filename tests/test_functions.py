"""Golden rows of the column functions."""

from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from pagefacts.functions import classify as K
from pagefacts.functions import dates as D
from pagefacts.functions import jsoncanon as N
from pagefacts.functions import values as V
from pagefacts.operators.changes import add_link, keep_manual_links, remove_link, save_decision
from pagefacts.operators.reconcile import html_unescape, normal_name
from pagefacts.vocab import SCHEMA, Vocabulary


def apply(spark, rows, schema, expr):
    """Results of one expression, in the order of the given rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def check(spark, schema, expr, cases):
    want = [c[1] for c in cases]
    rows = [c[0] if isinstance(c[0], tuple) else (c[0],) for c in cases]
    assert apply(spark, rows, schema, expr) == want


def test_french_months(spark):
    check(spark, "c string", D.french_month_to_en("c"), [
        ("28 mai 2031, 9 h", "28 MAY 2031, 9 h"),
        ("le 4 fév 1988", "le 4 FEB 1988"),
        ("le 4 Fév 1988", "le 4 FEB 1988"),
        ("dès Février 1988 !", "dès FEB 1988 !"),
        ("22 avril 1977", "22 APRil 1977"),
    ])


def test_iso_datetime(spark):
    check(spark, "c string", D.iso_datetime("c"), [
        ("17 juillet 2033 - 8 h 05", "2033-07-17T08:05:00-04:00"),
        ("2 août 1999 - 23 h 45", "1999-08-02T23:45:00-04:00"),
        (" dimanche 9 octobre 2011, de 13 h à 16 h ", "2011-10-09T13:00:00-04:00"),
        ("1987-11-30", "1987-11-30"),
        ("2014-07-04T16:30:00-00:00", "2014-07-04T12:30:00-04:00"),
        ("2014-07-04T01:15:00-00:00", "2014-07-03T21:15:00-04:00"),
        ("24 mar 2009   Halifax   17 h 20 ", "2009-03-24T17:20:00-04:00"),
        ("19-DEC-1996", "1996-12-19"),
        ("19-DEC-1996 at 6pm", "1996-12-19T18:00:00-05:00"),
        ("23-NOV-2015 11 am", "2015-11-23T11:00:00-05:00"),
        ("30 avril 2008 9h", "2008-04-30T09:00:00-04:00"),
        ("June 21, 2017 10:10 pm", "2017-06-21T22:10:00-04:00"),
        (None, ""),
        ("to be told later", ""),
        ("2013-06-31", "Bad input for date/time: 2013-06-31.  (#<ArgumentError: argument out of range>)"),
    ])


def test_zone_does_not_depend_on_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        check(spark, "c string", D.iso_datetime("c"), [("17 juillet 2033 - 8 h 05", "2033-07-17T08:05:00-04:00")])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_date_lists(spark):
    bad = "Bad input for date/time: 2016-09-02T10:00:00-03:00.  (#<ArgumentError: Invalid Timezone: Atlantis Time>)"
    check(spark, "c array<string>", D.convert_datetimes("c"), [
        (["19-DEC-1996 at 6pm", "20-DEC-1996"], ["1996-12-19T18:00:00-05:00", "1996-12-20"]),
        (["8-AUG-2003", "9-AUG-2003  at 7pm", "9-AUG-2003 9 pm"], ["2003-08-08", "2003-08-09T19:00:00-04:00", "2003-08-09T21:00:00-04:00"]),
        (["time_zone:  Eastern Time (US & Canada) ", "2016-09-02T13:00:00-00:00", "2016-12-02T13:00:00-00:00"],
         ["2016-09-02T09:00:00-04:00", "2016-12-02T08:00:00-05:00"]),
        (["2016-09-02T10:00:00-03:00"], ["2016-09-02T09:00:00-04:00"]),
        (["time_zone:  Atlantis Time ", "2016-09-02T10:00:00-03:00"], [bad]),
        (["time_zone: America/Vancouver", "time_zone: Newfoundland", "2016-09-02 07:45"], ["2016-09-02T07:45:00-02:30"]),
    ])
    check(spark, "c array<string>", D.convert_dates("c"), [(["19-DEC-1996 at 6pm"], ["1996-12-19"])])


def test_durations(spark):
    check(spark, "c string", D.iso_duration("c"), [
        ("3 hrs 15 min", "PT11700S"), ("lasts 4 h", "PT14400S"), ("running time: 1 h 10 m", "PT4200S"),
        ("as long as you like", ""), ("2:45", "PT165S"), ("0:45:30", "PT2730S"),
    ])


def test_first_date_and_guard(spark):
    check(spark, "c string", D.first_valid_date("c", "2012-03-01 00:00:00"), [
        ("2012-10-08T11:15:00-04:00", "2012-10-08T11:15:00-04:00"),
        ('["2013-02-09T18:00:00-05:00", "2013-02-10T18:00:00-05:00"]', "2013-02-09T18:00:00-05:00"),
        ('["no such field"]', "2013-03-01T00:00:00"),
        ('["no such field","2013-02-09T18:00:00-05:00"]', "2013-02-09T18:00:00-05:00"),
        (None, "2013-03-01T00:00:00"),
    ])
    year = F.date_format(D.guard_archive_date(F.col("c").cast("timestamp_ntz"), "2012-03-01 00:00:00"), "yyyy-MM-dd")
    check(spark, "c string", year, [
        ("2011-07-07", "2011-07-07"), ("1998-01-01", "2013-03-01"), ("2028-01-01", "2013-03-01"), (None, "2013-03-01"),
    ])


def test_valid_dates_prices_and_arrays(spark):
    check(spark, "c string", V.any_valid_date(V.ensure_array("c")), [
        ("2018-01-15T09:00:00-05:00", True), ('["2018-01-15T09:00:00-05:00", "unreadable"]', True),
        ("[]", False), ('["someday"]', False), ("2018-01-15T", False), ("2018-04-31", False), (None, False),
    ])
    check(spark, "c string", V.prices_ok(V.to_array("c")), [
        ("17.25", True), ("NaN", False), ("8,5", False), ("[9.5, 11, 12.75]", True), ('[9.5, "free", 12.75]', False),
        ('[9.5, "11", "12.75"]', True), ('["9", "", "12.75"]', True),
    ])
    check(spark, "c string", V.to_array("c"), [
        ("A Title", ["A Title"]), ('["7",8.25]', ["7", "8.25"]), ("[half", ["[half"]), ("[]", []), (None, []),
        ('["p"],["q"]', ['["p"],["q"]']),
    ])
    check(spark, "c string", V.ensure_array("c"), [('["p"]', ["p"]), ("61", ["61"]), ("[6.25,9]", ["6.25", "9"])])


def links_of(value):
    return [(g.search, g["class"], [(h.label, h.uri) for h in g.links]) for g in value]


def test_parse_links(spark):
    u = "http://kg.example.org/resource/barn"
    cases = [
        (f'["Red Barn", "Place", ["The Red Barn", "{u}"]]', [("Red Barn", "Place", [("The Red Barn", u)])]),
        (f'[["Mill", "Place", ["Old Mill", "{u}"]],["Pier", "Place", ["North Pier", "{u}/n"],["South Pier","{u}/s"]]]',
         [("Mill", "Place", [("Old Mill", u)]), ("Pier", "Place", [("North Pier", u + "/n"), ("South Pier", u + "/s")])]),
        ('[["", "Person", "abort_update"], ["", "Person", "abort_update"]]', [("", "Person", []), ("", "Person", [])]),
        (None, []), ("words", []), ("[]", []), ("", []),
    ]
    got = apply(spark, [(c[0],) for c in cases], "c string", V.parse_links("c"))
    assert [links_of(g) for g in got] == [c[1] for c in cases]


def test_link_uris(spark):
    check(spark, "c string", V.link_uris(V.parse_links("c")), [
        ('["q","C",["x","u:one"],["y","u:two"]]', ["u:one", "u:two"]),
        ('[["q","C",["x","u:one"]],["r","C",["z","u:three"]],["Manually deleted","C",["x","u:one"]]]', ["u:three"]),
        ('[["q","C",["x","u:one"],["y","u:two"]],["Manually deleted","C",["x","u:one"]]]', ["u:two"]),
        ('[["q","C",["y","u:two"]],["r","C",["y","u:two"]]]', ["u:two", "u:two"]),
    ])


def test_missing_links(spark):
    mint = Vocabulary().mint_prefix
    check(spark, "c string", V.missing_links(V.parse_links("c")), [
        ('["Dock", "Place", ["Dock", "http://docks.test/9"]]', False),
        ('["Dock", "Place", ["Dock", "docks.test/9"]]', True),
        (f'[["Hut","Place",["Hut","{mint}h"]],["Inn","Place",["Inn","{mint}i"]],["Manually added","Place",["Hut","{mint}h"]]]', False),
        ('["Cove", "Place"]', True),
        (f'[["Hut","Place"],["Inn","Place",["Inn","{mint}i"]],["Manually added","Place",["Hut","{mint}h"]]]', True),
        ('[["Cove", "Place"]]', True),
        (f'[["Cove","Place"],["Cove","Place"],["Manually added","Place",["Cove","{mint}c"]]]', False),
    ])
    check(spark, "c string", V.invalid_uri("c"), [("http://docks.test", False), ("docks.test", True), ("", True), (None, True)])


def test_classes(spark):
    label = lambda hits: F.array_join(F.transform(hits, lambda h: h["uri"]), " ")
    check(spark, "c string", label(K.event_status(F.col("c"))), [
        ("Tonight's reading was cancelled", SCHEMA + "EventCancelled"),
        ("Le récital est reporté au printemps", SCHEMA + "EventRescheduled"),
        ("RÉCITAL REPORTÉ", SCHEMA + "EventRescheduled"),
        ("Harp quartet postponed until spring", SCHEMA + "EventPostponed"),
        ("Harp quartet until spring", SCHEMA + "EventScheduled"),
        ("the unrescheduledly plain evening", SCHEMA + "EventScheduled"),
    ])
    check(spark, "c string", label(K.event_types(F.col("c"))), [
        ("Une heure d'humour au jardin", SCHEMA + "ComedyEvent"), ("Nuit du cinéma", SCHEMA + "ScreeningEvent"), ("harp", ""),
    ])
    check(spark, "c string", label(K.attendance_mode(F.col("c"))), [
        ("Streamed: OnlineEventAttendanceMode", SCHEMA + "OnlineEventAttendanceMode"), ("Streamed", ""),
    ])


def test_format_value(spark):
    fmt = K.format_value(F.col("v"), F.col("dt"), F.col("cls"))
    check(spark, "v array<string>, dt string, cls string", fmt, [
        ((["cancelled by rain"], "xsd:anyURI", "EventStatusType"),
         f'["cancelled by rain","EventStatusType",["EventCancelled","{SCHEMA}EventCancelled"]]'),
        (([], "xsd:anyURI", "Person"), "[]"),
        ((["19-DEC-1996"], "xsd:dateTime", ""), "1996-12-19"),
        ((["19-DEC-1996", "20-DEC-1996"], "xsd:date", ""), '["1996-12-19","1996-12-20"]'),
        ((["4 h"], "xsd:duration", ""), "PT14400S"),
        ((["p", "q"], "", ""), '["p","q"]'),
        ((["p"], None, None), "p"),
    ])


def test_save_decision(spark):
    failed, before = "abort_update: no page", "abort_update: older"
    check(
        spark, "v string, s string, o string, n boolean",
        save_decision(F.col("v"), F.col("s"), F.col("o"), F.col("n")),
        [
            ((failed, "initial", None, True), True),
            ((failed, "problem", "half a title", False), True),
            ((failed, "missing", "[]", False), True),
            ((failed, "ok", before, False), True),
            ((failed, "updated", "a title", False), False),
            (("[]", "initial", None, True), True),
            (("", "ok", before, False), True),
            (("", "ok", "a title", False), False),
            (("a new title", "ok", "a title", False), True),
            ((None, "ok", before, False), True),
        ],
    )


def test_manual_links(spark):
    new = '["choir","Organization",["The Choir","http://choir.test"]]'
    check(spark, "n string, o string", keep_manual_links(F.col("n"), F.col("o")), [
        ((new, '["choir","Organization",["A Choir","http://old.test"]]'), new),
        ((new, '["Manually added","Organization",["A Choir","http://old.test"]]'),
         f'[{new},["Manually added","Organization",["A Choir","http://old.test"]]]'),
        ((new, None), new),
    ])


def test_remove_and_add_link(spark):
    def run(fn, cache, uri, label):
        df = spark.createDataFrame([(cache, label, "Place", uri)], "c string, l string, k string, u string")
        df = df.withColumn("g", V.parse_links("c"))
        out = df.select(V.links_text(fn(F.col("g"), F.col("l"), F.col("k"), F.col("u")).cast(V.LINKS)).alias("v")).first().v
        got = json.loads(out)
        return got if not got or isinstance(got[0], list) else [got]

    j = json.dumps
    cases = [
        (["Manually added", "Place", ["T1", "http://u"]], "http://u", []),
        (["Auto", "Place", ["T1", "http://u"]], "http://u",
         [["Auto", "Place", ["T1", "http://u"]], ["Manually deleted", "Place", ["T1", "http://u"]]]),
        ([["Auto", "Place", ["T9", "http://u9"]], ["Manually deleted", "Place", ["T1", "http://u"]]], "http://u",
         [["Auto", "Place", ["T9", "http://u9"]]]),
        ([["Auto", "Place", ["T9", "http://u9"]], ["Manually added", "Place", ["T1", "http://u"]], ["Manually deleted", "Place", ["T3", "http://u3"]]],
         "http://u", [["Auto", "Place", ["T9", "http://u9"]], ["Manually deleted", "Place", ["T3", "http://u3"]]]),
        ([["Auto", "Place", ["T1", "http://u"]], ["Manually added", "Place", ["T2", "http://u2"]], ["Manually deleted", "Place", ["T3", "http://u3"]]],
         "http://u",
         [["Auto", "Place", ["T1", "http://u"]], ["Manually added", "Place", ["T2", "http://u2"]],
          ["Manually deleted", "Place", ["T3", "http://u3"], ["T1", "http://u"]]]),
        ([["x", "Place", ["B", "http://u"]], ["Manually deleted", "Place", ["A", "http://a"], ["B", "http://u"]]], "http://u",
         [["x", "Place", ["B", "http://u"]], ["Manually deleted", "Place", ["A", "http://a"]]]),
    ]
    for cache, uri, want in cases:
        assert run(remove_link, j(cache), uri, "T1") == want
    assert run(add_link, "", "http://u", "L") == [["Manually added", "Place", ["L", "http://u"]]]
    grown = run(add_link, j([["a", "Place"], ["Manually added", "Place", ["M", "http://m"]]]), "http://u", "L")
    assert grown == [["a", "Place"], ["Manually added", "Place", ["M", "http://m"], ["L", "http://u"]]]


def test_keys_and_uris(spark):
    check(spark, "l string, g string", V.build_key("l", "g"), [
        (("Performed by", ""), "performed_by"), (("Disambiguating Long Text", "EN"), "disambiguating_long text_EN"), (("Title", "fr"), "title_fr"),
    ])
    check(spark, "l string, g string", V.make_key("l", "g"), [(("Title", "EN"), "title_en"), ((None, "en"), "failed to make key"), (("Title", None), "failed to make key")])
    check(spark, "c string", V.normalize_url("c"), [(" http://a.b/c?d=1#e ", "http://a.b/c?d=1"), (" not a url #x ", "not a url #x")])
    check(spark, "c string", V.squish("c"), [("  a \n b\t c  ", "a b c")])
    check(spark, "c string", html_unescape("c"), [("a &amp; b &#233; &#x41; &lt;", "a & b é A <"), ("&amp;lt;", "&lt;"), ("&#; x", "&#; x")])
    check(spark, "c string", normal_name("c"), [("L&#8217;Été  d’Or", "l'été d'or")])


def test_canonical_json(spark):
    df = spark.createDataFrame([
        ('{"a":[{"b":2,"updated_at":"y"}],"c":3}', '{"c":3,"a":[{"b":2,"updated_at":"t"}]}', True),
        ('[{"a":1},{"b":2}]', '[{"b":2},{"a":1}]', False), ("[1,2]", '{"a":1}', False), ("{}", "{}", True),
        ("jsonator", '{"a":1}', None), ('{"a":1,"created_at":"x"}', '{"a":1}', True),
    ], "l string, r string, same boolean")
    rows = df.select((N.canonical_json("l") == N.canonical_json("r")).alias("v"), "same").collect()
    assert all(r.v == r.same for r in rows)


def test_date_lists_do_not_make_errors(spark):
    """Texts without a clock time are read without failing casts, each of which costs a millisecond, and a row's
    zone is looked up once."""
    items = "array(concat(2000 + id % 20, '-05-06'), 'time_zone: Newfoundland', concat('le ', 1 + id % 28, ' mai 2010'), 'no date')"
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", f"{items} as items").select("id", D.convert_datetimes("items").alias("x"))
    assert rows._jdf.queryExecution().analyzed().toString().count("str_to_map") == 1
    rows.limit(1).collect()
    start = time.perf_counter()
    sizes = rows.groupBy(F.size("x").alias("n")).count().collect()
    assert time.perf_counter() - start < 10
    assert {r["n"]: r["count"] for r in sizes} == {3: 4000}
