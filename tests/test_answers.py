"""Models' answers, the stored index, cards, the feed, the lock and address lookup."""

import datetime as dt
import json
import time

from pyspark.sql import functions as F

from eventloom import answers, config, pipeline
from eventloom.functions.geo import geo_dim
from eventloom.operators import users
from eventloom.schema import RECORDS
from eventloom.sinks import listing, store


def bodies(spark, *texts):
    return spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t in texts], "body string")


def test_enrichments_are_checked(spark):
    good = {"id": "1", "categories": ["music", "bogus", "art", "food", "sport"], "descriptions": {"en": "E", "it": "I"}, "titles": {"en": "T"}, "time": "21:00", "durationMin": 90.4, "kind": "container", "sessions": [{"date": "2026-07-03", "time": "99:00", "title": "x"}, {"date": "never"}], "unusual": True}
    bare = {"id": "2", "category": "art", "description": "old", "time": "25:00", "durationMin": 5, "kind": "container", "sessions": []}
    bad = [{"id": "3", "categories": ["bogus"], "description": "d"}, {"id": "4", "categories": ["art"]}, {"categories": ["art"], "description": "d"}, {"id": "5", "categories": ["art"], "description": "日本"}]
    got = {r.id: r for r in answers.enrichments(bodies(spark, "```json\n" + json.dumps({"events": [good, *bad]}) + "\n```", {"events": [bare]}, "no json")).collect()}
    assert sorted(got) == ["1", "2"]
    one, two = got["1"], got["2"]
    assert (one.e_categories, tuple(one.e_descriptions), one.e_time, one.e_durationMin, one.e_kind, one.e_unusual, one.e_blocked) == (["music", "art", "food"], ("E", "I", "E"), "21:00", 90, "container", True, False)
    assert [tuple(s) for s in one.e_sessions] == [(dt.date(2026, 7, 3), None, "x")]
    assert (two.e_categories, two.e_descriptions.ru, two.e_titles, two.e_time, two.e_durationMin, two.e_kind, two.e_sessions) == (["art"], "old", None, None, None, None, None)
    enriched = spark.createDataFrame([], pipeline.ENRICHED)
    assert answers.enrichments(bodies(spark, "x")).unionByName(enriched).count() == 0


def test_events_found_in_posts(spark):
    def event(**more):
        return {"title": "Live", "startDate": "2026-07-10", "post": "chan/7", **more}

    found = answers.extracted(bodies(spark, {"events": [event(venue="V", description="D"), event(startDate="2026-02-31"), event(post="nowhere"), event(startDate="2026-06-01"), event(startDate="2026-06-01", endDate="2026-07-20"), event(endDate="soon"), {"title": "x"}]}), "2026-07-01", "https://t.example/")
    rows = sorted(found.collect(), key=lambda r: r.startDate)
    assert [(r.startDate, r.endDate, r.url, r.source, r.venue, r.rawDescription) for r in rows] == [
        (dt.date(2026, 6, 1), dt.date(2026, 7, 20), "https://t.example/chan/7", "tg:chan", None, None),
        (dt.date(2026, 7, 10), None, "https://t.example/chan/7", "tg:chan", "V", "D"),
    ]


def test_verdicts_on_pairs(spark):
    pairs = spark.createDataFrame([(0, "a", "b"), (1, "c", "d"), (2, "e", "f")], "i long, a string, b string")
    said = bodies(spark, {"pairs": [{"i": 1, "same": True}, {"i": 0, "same": False}, {"i": 99, "same": True}, {"same": True}]}, "broken")
    assert [r.a for r in answers.judged(pairs, said).collect()] == ["c"]


def test_a_stored_index_without_its_bad_rows(spark):
    rows = [{"id": "1", "t": "T", "s": "2026-07-01", "u": "http://x", "c": "music", "g": [1.5, 2.5], "f": True, "x": False, "l": [{"source": "s", "url": "u"}, {"url": "no source"}], "d": "flat"}, {"id": "2", "t": "", "s": "2026-07-01", "u": "y"}, {"id": "3", "t": "T", "s": "2026-07-01"}, 7]
    (row,) = answers.stored_index(bodies(spark, rows)).collect()
    assert (row.id, row.c, tuple(row.g), row.f, row.x, [x.url for x in row.l], row.d.it) == ("1", ["music"], (1.5, 2.5), True, None, ["u"], "flat")
    assert answers.stored_index(bodies(spark, "broken")).count() == 0


def record(spark, **values):
    empty = spark.createDataFrame([], RECORDS)
    return spark.createDataFrame([tuple(values.get(c) for c in empty.columns)], RECORDS)


def test_link_images_and_cards(spark):
    links = [("s", "http://a", None), ("t", "http://b", "kept")]
    df = record(spark, id="1", title="A & B", startDate=dt.date(2026, 7, 4), endDate=dt.date(2026, 7, 5), time="21:00", venue="V", categories=["music", "art"], descriptions=("D <1>", "", ""), url="http://u", source="src", free=True, unusual=True, altLinks=links)
    pages = spark.createDataFrame([("http://a", "<meta content='i.jpg' property='og:image'>"), ("http://b", '<meta property="og:image" content="new.jpg">')], "url string, html string")
    (row,) = answers.with_link_images(df, pages).collect()
    assert [x.image for x in row.altLinks] == ["i.jpg", "kept"]
    (text,) = df.select(listing.card("it", {"music": "Musica", "art": "Arte"}).alias("card")).collect()[0]
    assert text.split("\n") == ["💎 <b>A &amp; B</b>", "🎵 Musica · Arte · 04.07–05.07, 21:00", "📍 V", "💶 free", "", "D &lt;1&gt;", "", '<a href="http://u">→ src</a>']


def test_feed_document(spark):
    index = spark.createDataFrame([("2", dt.date(2026, 7, 2), "B"), ("1", dt.date(2026, 7, 1), "A")], "id string, s date, t string")
    (row,) = listing.feed_document(index, "2026-07-01T00:00:00Z", "id", "t").collect()
    assert json.loads(row.json) == {"generatedAt": "2026-07-01T00:00:00Z", "events": [{"id": "1", "t": "A"}, {"id": "2", "t": "B"}]}


def test_lock_and_users(spark, tmp_path):
    lock = store.Lock(spark, f"file://{tmp_path}/lock")
    assert lock.acquire(time.time()) and not lock.acquire(time.time())
    assert lock.acquire(time.time() + 400)  # the first one was left behind
    lock.release()
    assert lock.acquire(time.time())
    assert [r.user_id for r in users.known_users(spark.createDataFrame([(3,), (1,), (3,), (None,)], "user_id long")).collect()] == [1, 3]
    assert config.is_operator("7", 7) and not config.is_operator("", 7)


def test_addresses_in_four_questions_and_a_cache(spark):
    dim = geo_dim(spark)
    rows = [("1", "Via Roma 1, Genova"), ("2", "Castello, Recco"), ("3", "Faro, Nowhere"), ("4", "Old Miss, Genova"), ("5", "Old Hit, Genova")]
    index = spark.createDataFrame([(i, a, None, "genova") for i, a in rows], "id string, a string, v string, ct string")
    gazetteer = spark.createDataFrame(
        [("via roma 1, genova", 41.9, 12.5), ("via roma 1, genova", 44.41, 8.93), ("castello, genova", 40.0, 9.0), ("castello, italia", 44.6, 9.0), ("faro, italia", 37.0, 15.0), ("old miss, genova", 44.4, 8.9), ("old hit, genova", 44.4, 8.9)], "q string, lat double, lng double"
    )
    cache = spark.createDataFrame([("genova", "old miss, genova", None, None, 500), ("genova", "old hit, genova", 44.5, 8.8, None)], "city string, q string, lat double, lng double, expires_at long")
    got = {r.id: (r.found, r.lat) for r in pipeline.located(index, gazetteer, dim, cache=cache, now_seconds=100).collect()}
    assert got == {"1": (True, 44.41), "2": (True, 44.6), "3": (False, None), "4": (False, None), "5": (True, 44.5)}
    later = {r.id: r.lat for r in pipeline.located(index, gazetteer, dim, cache=cache, now_seconds=600).collect()}
    assert later["4"] == 44.4
    kept = {r.q: (r.lat, r.expires_at) for r in pipeline.answered(index, gazetteer, dim, cache=cache, now_seconds=100, keep_misses=50).collect()}
    assert kept["faro, nowhere"] == (None, 150) and kept["old miss, genova"] == (None, 500) and kept["castello, recco"] == (44.6, None) and kept["old hit, genova"] == (44.5, None)
