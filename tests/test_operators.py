"""Pinned values of single operators, and properties."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom.corpus import Corpus, compact
from eventloom.functions import dates, geo, text
from eventloom.operators import dedupe, identity, merge, users, windows
from eventloom.schema import RECORDS, parse_categories, parse_texts, venue_of
from eventloom.sinks import ics, store
from eventloom.sources import feeds, html

D = dt.date
INDEX = "id string, t string, s date, e date, h string, c array<string>, f boolean, x boolean"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("past", "Past", D(2026, 6, 20), D(2026, 6, 30), None, ["other"], None, None),
        ("today", "today", D(2026, 7, 1), None, None, ["other"], None, None),
        ("span", "Span", D(2026, 6, 1), D(2026, 8, 31), None, ["other"], None, None),
        ("sat", "Sat", D(2026, 7, 4), None, "21:00", ["nightlife"], None, None),
        ("freebie", "Freebie", D(2026, 7, 3), None, None, ["other"], True, None),
        ("far", "Far", D(2026, 9, 1), None, None, ["music"], None, None),
        ("gem", "Gem", D(2026, 7, 8), None, None, ["other"], None, True),
    ]
    return spark.createDataFrame(rows, INDEX)


def ids(df):
    return {r.id for r in df.collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_windows(index):
    corpus = Corpus(index, D(2026, 7, 1))
    assert ids(corpus.day().index) == {"span", "today"}
    assert ids(Corpus(index, D(2026, 7, 4)).tonight().index) == {"sat"}
    assert ids(corpus.free().index) == {"freebie"}
    assert ids(corpus.gems().index) == {"gem"}
    assert ids(windows.of_category(index, "nightlife", "2026-07-01")) == {"sat"}
    assert ids(windows.of_category(index, "music", "2026-07-01")) == set()
    assert "past" not in ids(corpus.pruned().index) and "span" in ids(corpus.pruned().index)
    assert [r.id for r in corpus.weekend().events().collect()] == ["span", "sat"]
    assert corpus.search("GÉM").index.count() == 1


@pytest.mark.parametrize("day,start,end", [((2026, 7, 1), 4, 5), ((2026, 7, 4), 4, 5), ((2026, 7, 5), 5, 5)])
def test_weekends(spark, day, start, end):
    assert dates.weekend_window(D(*day)) == (D(2026, 7, start), D(2026, 7, end))
    row = spark.range(1).select(dates.weekend_from(F.lit(D(*day))).alias("a"), dates.weekend_to(F.lit(D(*day))).alias("b")).first()
    assert (row.a, row.b) == (D(2026, 7, start), D(2026, 7, end))


def test_covering_a_day_is_overlapping_it(index):
    for k in range(-5, 70, 7):
        day = D(2026, 7, 1) + dt.timedelta(days=k)
        assert ids(index.where(windows.covers_day(day))) == ids(index.where(windows.in_window(day, day)))


def test_local_time(spark):
    row = spark.sql("SELECT timestamp '2026-07-04 22:30:00' a, timestamp '2026-07-04 15:00:00' b").select(dates.local_day(F.col("a")).alias("a"), dates.local_hour(F.col("b")).alias("b")).first()
    assert (row.a, row.b) == (D(2026, 7, 5), 17)


@pytest.mark.parametrize("prefer,roll,expected", [(["music"], 0.7, "a"), (["music"], 0.8, "b"), ([], 0.0, "a"), ([], 0.99, "b")])
def test_weighted_pick(spark, prefer, roll, expected):
    rows = spark.createDataFrame([("a", "A", D(2026, 7, 2), None, None, ["music"], None, None), ("b", "B", D(2026, 7, 3), None, None, ["art"], None, None)], INDEX)
    assert [r.id for r in Corpus(rows, D(2026, 7, 1)).pick(prefer, roll).collect()] == [expected]


def test_titles(spark):
    cases = {"  Città  d'Arte: È! ": "citta d arte e", "Naïve ŠKODA 7": "naive skoda 7", "Концерт": "", "étude": "etude", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", text.normalize_title(F.col("t")).alias("n")).collect()} == cases
    assert one(spark, text.normalize_title(F.lit("Концерт!"), any_script=True)) == "концерт"
    assert one(spark, text.slug(F.lit("Forlì"))) == "forli" and one(spark, text.slug(F.lit("L'Aquila"))) == "l-aquila"
    assert one(spark, text.significant_tokens(F.lit("FuoriFormato 26. Festival internazionale di danza"))) == ["fuoriformato"]
    assert one(spark, text.significant_tokens(F.lit("Sagra del raviolo con musica"))) == ["raviolo"]


def test_event_ids_ignore_case_accents_and_marks(spark):
    same = [one(spark, identity.event_id(F.lit(t), F.lit("2026-07-01"))) for t in ("Mostra!", "MOSTRA", " mòstra ")]
    assert len(set(same)) == 1 and len(same[0]) == 12
    assert one(spark, identity.event_id(F.lit("Mostra"), F.lit("2026-07-02"))) != same[0]


@pytest.mark.parametrize(
    "said,start,end",
    [("Dal 16 al 25 ottobre 2026", "2026-10-16", "2026-10-25"), ("Dall’11 al 13 dicembre 2026", "2026-12-11", "2026-12-13"), ("1 gennaio 2027", "2027-01-01", None), ("prossimamente", None, None)],
)
def test_season_dates(spark, said, start, end):
    row = one(spark, dates.season_date(F.lit(said)))
    assert (row.start, row.end) == (start, end)


def test_date_grammars(spark):
    row = one(spark, dates.italian_dates(F.lit("Munizioniere 06 lug 2026 — 06 lug 2026, ore 9.30")))
    assert (row.start, row.end, row.time, row.prefix) == ("2026-07-06", None, "09:30", "Munizioniere")
    row = one(spark, dates.numeric_range(F.lit("Dal 09/07/2026 al 12/07/2026")))
    assert (row.start, row.end) == ("2026-07-09", "2026-07-12")


def test_text_facts(spark):
    assert one(spark, text.decode_entities(F.lit("a&nbsp;&#233;&#x20AC; &rsquo;x&amp; &bogus;"))) == "a é€ ’x& &bogus;"
    assert one(spark, text.free_from_price(F.lit("Вход БЕСПЛАТНО"))) and not one(spark, text.free_from_price(F.lit("10 euro")))
    assert one(spark, text.has_cjk(F.lit("ok"), F.lit("日"))) and not one(spark, text.has_cjk(F.lit("ok"), F.lit(None)))
    assert one(spark, text.detect_language(F.lit("что"))) == "ru"
    assert one(spark, text.category_hint(F.lit("Spettacolo e sport"))) == "theatre"
    assert one(spark, F.try_variant_get(text.tolerant_json(F.lit('x ```json\n{"k": 1}\n```')), "$.k", "int")) == 1
    assert one(spark, text.tolerant_json(F.lit("{broken")).isNull())


def test_geography(spark):
    dim = geo.geo_dim(spark)
    assert dim.count() == 107 and dim.select("region_slug").distinct().count() == 20
    centre = {r.city_slug: (r.lat, r.lng) for r in dim.collect()}
    km = one(spark, geo.distance_km(*(F.lit(x) for x in (*centre["genova"], *centre["trieste"]))))
    (a, b), (c, d) = (map(math.radians, centre[x]) for x in ("genova", "trieste"))
    assert km == pytest.approx(6371 * math.acos(math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d)), abs=0.01)
    points = spark.createDataFrame([(1, 45.402496, 9.139273)], "id long, lat double, lng double")
    centres = dim.select(F.col("city_slug").alias("city"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    assert geo.nearest(points, centres, "id", "city").first().city == "milano"
    filed = geo.with_city(spark.createDataFrame([("ge ",), ("zz",)], "p string"), dim, "p").collect()
    assert [(r.city_slug, r.region_slug) for r in filed] == [("genova", "liguria"), (None, None)]


RECORD = "id string, startDate date, endDate date, time string, venue string, address string, priceInfo string, rawDescription string, image string, url string, source string, free boolean, lat double, lng double, altLinks array<struct<source:string,url:string,image:string>>"


def record(**known):
    names = [x.split()[0] for x in RECORD.split(", ")]
    return tuple(known.get(n) for n in names)


def test_upsert_fills_widens_and_links(spark):
    stored = spark.createDataFrame([record(id="a", startDate=D(2026, 7, 5), url="u1", source="x", venue="V"), record(id="b", startDate=D(2026, 7, 1), url="u9", source="x")], RECORD)
    new = spark.createDataFrame([record(id="a", startDate=D(2026, 7, 3), endDate=D(2026, 7, 9), url="u2", source="y", venue="W", priceInfo="Ingresso libero", image="i", lat=1.0, lng=2.0)], RECORD).drop("free", "altLinks")
    got = {r.id: r for r in merge.upsert(stored, new).collect()}
    a, b = got["a"], got["b"]
    assert (a.startDate, a.endDate, a.venue, a.free, a.lat, a.lng, a.changed) == (D(2026, 7, 3), D(2026, 7, 9), "V", True, 1.0, 2.0, True)
    assert [tuple(x) for x in a.altLinks] == [("y", "u2", "i")]
    assert not b.changed and b.endDate is None
    again = {r.id: r for r in merge.upsert(merge.upsert(stored, new).drop("changed"), new).collect()}
    assert not again["a"].changed and tuple(again["a"])[:-1] == tuple(a)[:-1]


def test_links_fold(spark):
    links = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(u).alias("url"), F.lit(i).cast("string").alias("image")) for s, u, i in (("a", "1", None), ("b", "own", None), ("c", "1", "pic"), ("d", "2", None))))
    assert [tuple(x) for x in one(spark, merge.fold_links(links, F.lit("own")))] == [("a", "1", "pic"), ("d", "2", None)]


def test_containers(spark):
    schema = "id int, startDate date, endDate date, kind string, sessions array<struct<date:date,time:string,title:string>>"
    day = lambda d: (D(2026, 8, d), None, None)
    rows = [(1, D(2026, 6, 1), D(2026, 9, 30), "container", [day(20), day(5), day(12)]), (2, D(2026, 6, 1), D(2026, 9, 30), "container", [day(5)]), (3, D(2026, 6, 1), D(2026, 9, 30), None, [day(5)]), (4, D(2026, 6, 1), None, "container", None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: (r.startDate, r.endDate) for r in merge.with_derived_span(df).collect()}
    assert got == {1: (D(2026, 8, 5), D(2026, 8, 20)), 2: (D(2026, 8, 5), None), 3: (D(2026, 6, 1), D(2026, 9, 30)), 4: (D(2026, 6, 1), None)}
    named = df.withColumnsRenamed({"startDate": "s", "endDate": "e"})
    assert {r.id for r in named.where(windows.occurs_on("2026-08-08")).collect()} == {3}


def test_candidate_pairs(spark):
    rows = [("a", "FuoriFormato 26. Festival internazionale di danza contemporanea e videodanza", D(2026, 6, 30), D(2026, 7, 3)), ("b", "FuoriFormato Festival", D(2026, 6, 30), D(2026, 7, 3)), ("z", "Sagra del pesto a Rapallo", D(2026, 7, 1), None)]
    df = spark.createDataFrame(rows, "id string, t string, s date, e date").withColumn("tokens", text.significant_tokens(F.col("t")))
    assert [(r.a, r.b) for r in dedupe.candidate_pairs(df).collect()] == [("a", "b")]
    assert dedupe.greedy_merges([("a", "b"), ("b", "c"), ("d", "c")]) == [("a", "b"), ("d", "c")]


def test_sessions(spark):
    raw = "array<struct<date:string,time:string,title:string>>"
    df = spark.createDataFrame([([("2026-08-05", "21:00", ""), ("2026-08-05", "21:00", "again"), ("2026-08-05", "25:00", "odd"), ("2026-13-01", None, "no"), ("soon", None, None)],)], f"p {raw}")
    got = df.select(feeds.sessions_of(F.col("p")).alias("p")).first().p
    assert [tuple(x) for x in got] == [(D(2026, 8, 5), "21:00", None), (D(2026, 8, 5), None, "odd")]


def test_jsonld(spark):
    block = '{"@type":"MusicEvent","name":"Festa","startDate":"2026-08-0%dT21:00","location":{"name":"Monte Terminillo (RI)","geo":{"latitude":"0","longitude":0}},"offers":{"price":"0","url":"http://e/1"}}'
    page = "<script type='application/ld+json'>[" + ",".join(block % k for k in (1, 2, 3)) + ']</script><script type="application/ld+json">{"@graph":[{"@type":"Place"}]}</script><script type="application/ld+json">{oops</script>'
    rows = feeds.jsonld_events(spark.createDataFrame([(1, page)], "page_id int, html string"), "site", geo.geo_dim(spark), "roma").collect()
    assert len(rows) == 3
    assert {(r.title, r.city, r.venue, r.priceInfo, r.time, r.url, r.lat) for r in rows} == {("Festa", "rieti", "Monte Terminillo", "Ingresso libero", "21:00", "http://e/1", None)}
    df = spark.createDataFrame([(r.url, D.fromisoformat(r.startDate), None, i) for i, r in enumerate(rows)], "url string, s date, e date, seq int")
    run = merge.collapse_runs(df, "url", "s", "e").first()
    assert (run.s, run.e) == (D(2026, 8, 1), D(2026, 8, 3))


def test_html_cards(spark):
    page = '<div class="card"><a href="/e/1"><img data-src="https://x/i.jpg"><h3>Mostra <b>Uno</b></h3></a> Dal 09/07/2026 al 12/07/2026 <span class="category">MOSTRE</span></div><div class="card"><h3>No link</h3>01/01/2026</div><div class="card"><a href="/e/2"><h3>No date</h3></a></div>'
    grammar = html.CardGrammar("site", '<div class="card">', base="https://site")
    rows = html.read_cards(spark.createDataFrame([(page,)], "html string"), grammar).collect()
    assert [(r.title, r.url, r.image, r.startDate, r.endDate, r.categoryHint) for r in rows] == [("Mostra Uno", "https://site/e/1", "https://x/i.jpg", D(2026, 7, 9), D(2026, 7, 12), "art")]
    assert [one(spark, html.page_count(F.lit(x))) for x in ("Pagina 1 di 7", "Pagina 1 di 99", "")] == [7, 10, 1]


def test_calendar(spark):
    fold = one(spark, ics.fold(F.lit("x" * 200)))
    assert [len(p) for p in fold] == [74, 74, 54] and all(p.startswith(" ") for p in fold[1:])
    timing = lambda s, e, h: one(spark, ics.timing(F.lit(s), F.lit(e).cast("date"), F.lit(h).cast("string")))
    assert timing(D(2026, 7, 1), D(2026, 7, 20), None)[1] == "DTEND;VALUE=DATE:20260721"
    assert timing(D(2026, 7, 4), None, "21:00")[1].endswith("20260704T230000")
    assert timing(D(2026, 7, 4), None, "23:30")[1].endswith("20260705T013000")
    assert one(spark, ics.escape(F.lit("a;b,c\\d\r\ne"))) == "a\\;b\\,c\\\\d\\ne"


def split_lines(body, most):
    if len(body) <= most:
        return [body]
    parts, now = [], ""
    for line in body.split("\n"):
        for piece in [line[i : i + most] for i in range(0, len(line), most)] or [""]:
            if now == "":
                now = piece
            elif len(now) + 1 + len(piece) <= most:
                now += "\n" + piece
            else:
                parts.append(now)
                now = piece
    return parts + [now] if now else parts


def test_message_splitting(spark):
    draw = random.Random(1)
    bodies = ["", "short", "\n" * 30, *("".join(draw.choices("ab \n", weights=[8, 8, 2, draw.choice([0, 1, 4])], k=draw.randint(1, 160))) for _ in range(60))]
    df = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", windows.split_lines(F.col("b"), 20).alias("p"))
    for r in df.collect():
        assert r.p == split_lines(r.b, 20)


def test_users(spark):
    case = lambda mode, day: one(spark, users.digest_window(F.lit(mode), F.lit(9), F.lit(day), F.lit(9)))
    assert tuple(case("daily", D(2026, 7, 1))) == (D(2026, 7, 2), D(2026, 7, 2))
    assert case("weekly", D(2026, 7, 1)) is None and tuple(case("weekly", D(2026, 7, 3))) == (D(2026, 7, 4), D(2026, 7, 5))
    odd = spark.createDataFrame([("xx", None, 30.0), ("it", "daily", 7.0)], "language string, digest string, digestHour double")
    assert [tuple(r) for r in users.settings_defaults(odd).collect()] == [("auto", "off", 9), ("it", "daily", 7)]


def test_state(spark, tmp_path):
    assert one(spark, dates.ttl_seconds(F.lit(D(2020, 1, 1)), F.lit(1782900000))) == 3600
    versions = store.Versions(spark, f"file://{tmp_path}/t")
    versions.write(spark.range(3), 1)
    versions.write(spark.range(5), 2)
    assert versions.read().count() == 5


def test_parsing_of_records(spark):
    assert one(spark, parse_categories(F.array(F.lit("music"), F.lit("bogus")), F.lit("art"))) == ["music", "art"]
    assert one(spark, parse_categories(F.lit(None).cast("array<string>"), F.lit(None).cast("string"))) == ["other"]
    given = F.struct(F.lit("").alias("en"), F.lit("ciao").alias("it"), F.lit(None).cast("string").alias("ru"))
    assert tuple(one(spark, parse_texts(given, F.lit("old")))) == ("old", "ciao", "old")
    assert one(spark, venue_of(F.lit(None).cast("string"), F.lit("Genova, Italia"))) is None
    names = [x.strip().split(" ")[0] for x in spark.createDataFrame([], RECORDS).columns]
    full = compact(spark.createDataFrame([], RECORDS))
    assert "id" in names and {"id", "t", "s", "e", "c", "v", "g", "rg"} <= set(full.columns) and full.count() == 0


def test_stream_upserts_fill_gaps(spark, tmp_path):
    from eventloom.streaming.upsert import KeyedTable, upsert_stream

    schema = "id string, seq long, venue string, startDate date, endDate date"
    d = lambda n: dt.date(2026, 7, n)
    table = KeyedTable(spark, f"file://{tmp_path}/t", "id", ["venue", "startDate", "endDate"], buckets=3)
    for rows in [[("a", 1, None, d(3), None), ("b", 2, "B", d(3), None)], [("a", 3, "A", d(1), None), ("b", 5, None, d(4), None), ("c", 4, None, d(3), d(9))]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        upsert_stream(stream, table, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    expected = {("a", "A", d(1), d(3)), ("b", "B", d(3), d(4)), ("c", None, d(3), d(9))}
    assert {(r.id, r.venue, r.startDate, r.endDate) for r in table.read().collect()} == expected
    table.fold(spark.createDataFrame([("b", 5, None, d(4), None)], schema), 1)  # a batch that comes again
    assert {(r.id, r.venue, r.startDate, r.endDate) for r in table.read().collect()} == expected


def test_stream_table_expires(spark, tmp_path):
    from eventloom.streaming.upsert import KeyedTable

    now = [1782900000]
    table = KeyedTable(spark, f"file://{tmp_path}/t", "id", ["day"], buckets=1, last_day="day", now=lambda: now[0])
    schema = "id string, seq long, day date"
    table.fold(spark.createDataFrame([("old", 1, dt.date(2026, 1, 1)), ("new", 2, dt.date(2026, 12, 1))], schema), 0)
    assert {r.id for r in table.read().collect()} == {"old", "new"}  # an hour at least
    now[0] += 7200
    assert {r.id for r in table.read().collect()} == {"new"}
    table.fold(spark.createDataFrame([("next", 3, dt.date(2026, 12, 1))], schema), 1)
    assert {r.id for r in table._read(table._folders()).collect()} == {"new", "next"}
