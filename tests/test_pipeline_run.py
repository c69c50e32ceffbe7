"""The batch run end to end on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from eventloom import config, pipeline
from eventloom.functions.geo import geo_dim
from eventloom.schema import RECORDS, SIGHTINGS

DAY, NOW = dt.date(2026, 7, 1), 1782900000


def sightings(spark, *rows):
    names = [f.split()[0] for f in spark.createDataFrame([], SIGHTINGS).columns]
    filled = [tuple({"seq": i, "source": "s", "url": f"http://s/{i}", **r}.get(n) for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(filled, SIGHTINGS)


def day(d, month=7):
    return dt.date(2026, month, d)


def test_runs_follow_each_other(spark):
    none = spark.createDataFrame([], RECORDS)
    first = pipeline.collect(sightings(spark, {"title": "Fresh Concert", "startDate": day(10)}, {"title": "Long Gone", "startDate": day(1, 6)}, {"title": "Mostra", "startDate": day(5), "categoryHint": "art"}), none, DAY, NOW)
    records = first.records.cache()
    assert {(r.t, tuple(r.c)) for r in first.index.collect()} == {("Fresh Concert", ("other",)), ("Mostra", ("art",))}
    assert [tuple(r) for r in first.stats.collect()] == [("s", 2, 2, 0, False)]
    again = pipeline.collect(sightings(spark, {"title": "MOSTRA!", "startDate": day(5), "venue": "V", "url": "http://t/9", "source": "t", "priceInfo": "gratuito"}), records, DAY, NOW + 9)
    rows = {r.t: r for r in again.index.collect()}
    assert len(rows) == 2 and rows["Mostra"].v == "V" and rows["Mostra"].f and [x.url for x in rows["Mostra"].l] == ["http://t/9"]
    assert [tuple(r) for r in again.stats.collect()] == [("t", 1, 0, 1, False)]
    # a sighting with a known URL is that event, whatever its title says now
    moved = pipeline.collect(sightings(spark, {"title": "Concerto rinviato", "startDate": day(12), "url": "http://s/0"}), records, DAY, NOW)
    row = next(r for r in moved.index.collect() if r.t == "Fresh Concert")
    assert (row.s, row.e) == (day(10), day(12)) and moved.index.count() == 2


def test_two_sources_in_one_run(spark):
    run = pipeline.collect(sightings(spark, {"title": "Electropark", "startDate": day(3), "source": "a"}, {"title": "ELECTROPARK", "startDate": day(3), "endDate": day(9), "venue": "Porto", "source": "b"}), spark.createDataFrame([], RECORDS), DAY, NOW)
    (row,) = run.records.collect()
    assert (row.source, row.venue, row.endDate, [x.source for x in row.altLinks]) == ("a", "Porto", None, ["b"])


def test_enrichment_fills_and_blocks(spark):
    def enrich(fresh):
        text = F.struct(F.lit("d").alias("en"), F.lit("d").alias("it"), F.lit("d").alias("ru"))
        none = lambda t: F.lit(None).cast(t)
        return fresh.select("id", F.array(F.lit("music")).alias("e_categories"), none("struct<en:string,it:string,ru:string>").alias("e_titles"), text.alias("e_descriptions"), F.lit("via Roma").alias("e_address"), F.lit("21:00").alias("e_time"), F.lit(90).alias("e_durationMin"), none("array<struct<date:date,time:string,title:string>>").alias("e_sessions"), none("string").alias("e_kind"), F.lit(True).alias("e_unusual"), (F.col("title") == "Spam").alias("e_blocked"))

    run = pipeline.collect(sightings(spark, {"title": "Ok", "startDate": day(3), "time": "20:00"}, {"title": "Spam", "startDate": day(3)}), spark.createDataFrame([], RECORDS), DAY, NOW, enrich)
    (row,) = run.records.collect()
    assert (row.title, row.time, row.address, row.categories, row.enriched, row.unusual) == ("Ok", "20:00", "via Roma", ["music"], True, True)
    assert run.records.where(pipeline.needs_enrichment()).count() == 0
    assert run.records.where(pipeline.needs_enrichment(9)).count() == 1


def test_one_event_told_twice_is_merged_and_a_judge_decides(spark):
    rows = ({"title": "Electropark Festival 2026 al Matitone", "startDate": day(3), "source": "a"}, {"title": "Matitone: Electropark!", "startDate": day(3), "venue": "Porto", "source": "b"}, {"title": "Matitone in festa", "startDate": day(20), "source": "c"})
    none = spark.createDataFrame([], RECORDS)
    run = pipeline.collect(sightings(spark, *rows), none, DAY, NOW)
    got = {r.title: r for r in run.records.collect()}
    assert len(got) == 2 and run.index.count() == 2
    (one,) = [r for t, r in got.items() if "Electropark" in t]
    assert one.venue == "Porto" and len(one.altLinks) == 1
    assert pipeline.collect(sightings(spark, *rows), none, DAY, NOW, judge=lambda pairs: pairs.limit(0)).records.count() == 3


def test_old_enrichments_are_retried_with_details_and_sources_may_fail(spark):
    first = pipeline.collect(sightings(spark, {"title": "Ok", "startDate": day(3)}), spark.createDataFrame([], RECORDS), DAY, NOW).records.cache()
    asked = []

    def details(rows):
        return rows.select("id", F.lit("a long body").alias("rawDescription"), F.lit("ingresso libero").alias("priceInfo"))

    def enrich(rows):
        asked.extend(r.id for r in rows.collect())
        text = F.struct(F.lit("d").alias("en"), F.lit("d").alias("it"), F.lit("d").alias("ru"))
        named = [f.split(" ", 1) for f in ("e_titles struct<en:string,it:string,ru:string>", "e_address string", "e_time string", "e_durationMin int", "e_sessions array<struct<date:date,time:string,title:string>>", "e_kind string", "e_unusual boolean", "e_blocked boolean")]
        return rows.select("id", F.array(F.lit("music")).alias("e_categories"), text.alias("e_descriptions"), *(F.lit(None).cast(t).alias(n) for n, t in named)).select("id", "e_categories", "e_titles", "e_descriptions", "e_address", "e_time", "e_durationMin", "e_sessions", "e_kind", "e_unusual", "e_blocked")

    run = pipeline.collect(sightings(spark, {"title": "OK!", "startDate": day(3), "url": "http://s/77"}), first, DAY, NOW + 9, enrich, details=details, failed=("gone",))
    (row,) = run.records.collect()
    assert asked == [row.id] and row.enriched and row.categories == ["music"] and row.rawDescription == "a long body" and row.free and row.addedAt == NOW
    assert sorted(map(tuple, run.stats.collect())) == [("gone", 0, 0, 0, True), ("s", 1, 0, 1, False)]
    log = spark.createDataFrame([(NOW,)], "at long")
    assert pipeline.elapsed(log, NOW + 6 * 3600) and not pipeline.elapsed(log, NOW + 3600) and pipeline.elapsed(log.limit(0), NOW)


def test_shared_artwork_belongs_to_the_earliest(spark):
    from eventloom.operators.dedupe import artwork_owners

    rows = [("1", day(3), "i1", "Teatro"), ("2", day(2), "i2", " teatro "), ("3", day(1), "i3", "Teatro"), ("4", day(1), "i1", "Altrove"), ("5", day(1), None, "Teatro"), ("6", day(1), "i1", None)]
    index = spark.createDataFrame(rows, "id string, s date, img string, v string")
    asked = []

    def hashes(df):
        asked.extend(r.id for r in df.collect())
        return df.withColumn("hash", F.lit("same"))

    lost = artwork_owners(index, lambda df: df.withColumn("bytes", F.when(F.col("img") != "i3", 10).otherwise(11)), hashes)
    assert [r.id for r in lost.collect()] == ["1"] and sorted(asked) == ["1", "2"]


def test_merging_patching_and_repair(spark):
    base = pipeline.collect(sightings(spark, {"title": "A", "startDate": day(3), "categoryHint": "art"}, {"title": "B", "startDate": day(3), "venue": "V", "image": "i", "categoryHint": "music"}), spark.createDataFrame([], RECORDS), DAY, NOW).records.cache()
    ids = {r.title: r.id for r in base.collect()}
    merged = pipeline.merge_groups(base, spark.createDataFrame([(ids["A"], ids["B"])], "keep string, drop string"))
    (row,) = merged.collect()
    assert (row.title, row.venue, row.categories, [x.url for x in row.altLinks]) == ("A", "V", ["art", "music"], ["http://s/1"])
    patched = pipeline.apply_patch(base, spark.createDataFrame([(ids["A"], "Piazza")], "id string, venue string"))
    assert {r.title: r.venue for r in patched.collect()} == {"A": "Piazza", "B": "V"}
    assert pipeline.repaired(base).count() == 0


def test_addresses_are_looked_up_once_and_checked(spark):
    index = spark.createDataFrame([("1", "Città Vecchia, Genova", None, "genova"), ("2", "città vecchia, genova ", None, None), ("3", None, "Teatro", "genova"), ("4", None, None, "genova")], "id string, a string, v string, ct string")
    gazetteer = spark.createDataFrame([("Città Vecchia, Genova", 45.65, 13.77), ("teatro, genova", 44.41, 8.93)], "q string, lat double, lng double")
    got = {r.id: (r.found, r.lat) for r in pipeline.located(index, gazetteer, geo_dim(spark)).collect()}
    assert got == {"1": (False, None), "2": (False, None), "3": (True, 44.41)}


def test_config():
    assert config.filter_from_query("cat=music,bogus&free=1") == {"categories": ["music"], "free_only": True}
    assert config.filter_from_query("cat=bogus") == {} and config.lang_from_query("lang=xx") == "en"
    assert config.fill("{n} of {m}", {"n": 3}) == "3 of {m}"
    assert [config.pages(x) for x in ("7", "99", "0", "x", None)] == [7, 10, 1, 3, 3] and config.names("@a, b,,") == ["a", "b"]
    assert [config.language(*x) for x in (("it", "ru"), ("auto", "ru-RU"), ("auto", None))] == ["it", "ru", "en"]
