"""The batch run: sightings of all sources to records and their index, and the repairs of a stored corpus.

Model-backed steps (enrichment, judging pairs), detail pages and the geocoder come in as callables from tables to
tables.  Where none is given, rows stay unenriched, and ``judged_by_score`` stands in for a judge of pairs: a stand-in, no model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.corpus import compact
from eventloom.functions.dates import as_day
from eventloom.functions.geo import misplaced
from eventloom.functions.text import free_from_price, has_cjk, significant_tokens
from eventloom.operators import dedupe, identity, merge
from eventloom.schema import LINK, SESSION, TEXTS
from eventloom.sources.feeds import lookup_details

FIELDS = ("title", "startDate", "endDate", "time", "venue", "address", "priceInfo", "rawDescription", "url", "source", "city", "lat", "lng", "categoryHint", "image")
ENRICHED = (
    f"id string, e_categories array<string>, e_titles {TEXTS}, e_descriptions {TEXTS}, e_address string, e_time string, e_durationMin int, "
    f"e_sessions array<{SESSION}>, e_kind string, e_unusual boolean, e_blocked boolean"
)
VERSION = 1
#: What detail pages can tell.
DETAILS = ("rawDescription", "venue", "time", "priceInfo")


@dataclass
class Run:
    """What one run gives: all records after it, their index, and a row of metrics for each source."""

    records: DataFrame
    index: DataFrame
    stats: DataFrame


def identified(sightings: DataFrame, index: DataFrame) -> DataFrame:
    """Sightings with their ``id``: by known URL, else by hash."""
    hashed = sightings.withColumn("id", identity.event_id(F.col("title"), F.col("startDate")))
    # of events that know one URL, the latest added, of these the one with the largest id
    known = index.select("id", "u", F.coalesce("l", F.array().cast(f"array<{LINK}>")).alias("l"), F.struct(F.coalesce("cr", F.lit(0)).alias("at"), "id").alias("pos"))
    return identity.resolve(hashed, identity.alias_map(known))


def folded(sightings: DataFrame) -> DataFrame:
    """One sighting for each id: first known values; the other sightings' links stay as alternatives."""
    first = {c: merge.first_known(c).alias(c) for c in FIELDS}
    # the dates are those of the first sighting, not a mixture of several
    first["endDate"] = F.min_by("endDate", "seq").alias("endDate")
    out = sightings.groupBy("id").agg(*first.values())
    links = merge.unite_links(sightings.select("id", "seq", "source", "url", "image"), "id").withColumnRenamed("id", "_id")
    out = out.join(links, F.col("id") == F.col("_id"), "left")
    return out.withColumn("altLinks", merge.fold_links(F.col("links"), F.col("url"))).drop("_id", "links")


def to_records(fresh: DataFrame, enriched: DataFrame, now_seconds: int) -> DataFrame:
    """New records: what the source said wins; enrichment, the hint or the title fill the rest."""
    rows = fresh.join(enriched, "id", "left")
    base = F.coalesce("rawDescription", "title")
    texts = F.struct(*(base.alias(x) for x in ("en", "it", "ru")))
    done = F.col("e_categories").isNotNull()
    categories = F.coalesce("e_categories", F.when(F.col("categoryHint").isNotNull(), F.array("categoryHint")), F.array(F.lit("other")))
    out = rows.select(
        "id", "title", "startDate", "endDate", F.when(F.col("e_kind") == "container", "container").alias("kind"), F.col("e_sessions").alias("sessions"),
        F.coalesce("time", "e_time").alias("time"), F.col("e_durationMin").alias("durationMin"), "venue", F.coalesce("address", "e_address").alias("address"), "lat", "lng",
        categories.alias("categories"), F.col("e_titles").alias("titles"), F.coalesce("e_descriptions", texts).alias("descriptions"), "image",
        F.when(F.size("altLinks") > 0, F.col("altLinks")).alias("altLinks"), "rawDescription", "priceInfo", F.when(free_from_price(F.col("priceInfo")), True).alias("free"),
        F.when(F.col("e_unusual"), True).alias("unusual"), "url", "source", "city", done.alias("enriched"), F.when(done, F.lit(VERSION)).alias("enrichVersion"), F.lit(now_seconds).cast("long").alias("addedAt"),
    )
    return merge.with_derived_span(out)


def needs_enrichment(version: int = VERSION) -> Column:
    d = F.col("descriptions")
    return ~F.col("enriched") | (F.coalesce(F.col("enrichVersion"), F.lit(0)) < version) | has_cjk(d["en"], d["it"], d["ru"])


def pending(rows: DataFrame, *priority, most: int = 24) -> DataFrame:
    """The first ``most`` rows to enrich."""
    return rows.orderBy(*priority, "id").limit(most)


def detailed(rows: DataFrame, details: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Rows with the gaps that their detail pages fill: ``details`` gives ``id`` and any of ``DETAILS``."""
    if details is None:
        return rows
    found = details(rows)
    told = [c for c in DETAILS if c in found.columns]
    filled = lookup_details(rows, found.select("id", *told), "id", told)
    if "free" in filled.columns and "priceInfo" in told:
        filled = filled.withColumn("free", F.coalesce("free", F.when(free_from_price(F.col("priceInfo")), True)))
    return filled


def re_enriched(records: DataFrame, enriched: DataFrame) -> DataFrame:
    """Stored records with a new enrichment: texts, categories, kind and programme are read anew, gaps are filled."""
    rows = records.join(enriched, "id", "left")
    done = F.col("e_categories").isNotNull()
    new = {
        "categories": F.when(done, F.col("e_categories")),
        "descriptions": F.when(done, F.col("e_descriptions")),
        "titles": F.col("e_titles"),
        "sessions": F.col("e_sessions"),
        "enrichVersion": F.when(done, F.lit(VERSION)),
    }
    out = {c: F.coalesce(value, F.col(c)) for c, value in new.items()}
    out |= {c: F.coalesce(F.col(c), F.col(f"e_{c}")) for c in ("time", "durationMin", "address")}
    out["kind"] = F.when(done, F.when(F.col("e_kind") == "container", "container")).otherwise(F.col("kind"))
    out["enriched"] = F.col("enriched") | done
    out["unusual"] = F.when(F.col("e_unusual"), True).otherwise(F.col("unusual"))
    return merge.with_derived_span(rows.select(*(out.get(c, F.col(c)).alias(c) for c in records.columns)))


def judged_by_score(pairs: DataFrame, least: float = dedupe.THRESHOLD) -> DataFrame:
    """A stand-in for a judge: pairs with a score of ``least`` or more are one event."""
    return pairs.where(F.col("score") >= least).select("a", "b")


def duplicates(index: DataFrame, judge: Callable[[DataFrame], DataFrame] | None, most_pairs: int = 60) -> list[tuple]:
    """(kept, dropped) ids: entries that share a URL, then judged pairs in order of their score; the older one is kept.

    Greedy, so on the driver, over the entries that share a URL and ``most_pairs`` judged pairs only.
    """
    urls = F.array_distinct(F.concat(F.array("u"), F.coalesce(F.transform("l", lambda x: x["url"]), F.array().cast("array<string>"))))
    known = index.select("id", F.explode(urls).alias("url")).where("url is not null")
    certain = dedupe.url_duplicates(known)
    likely = dedupe.candidate_pairs(index.select("id", "s", "e", "v", significant_tokens(F.col("t")).alias("tokens")), venue=True)
    likely = likely.join(certain, ["a", "b"], "left_anti").orderBy(F.desc("score"), "a", "b").limit(most_pairs)
    agreed = (judge or judged_by_score)(likely).select("a", "b").join(likely, ["a", "b"])
    both = certain.withColumn("score", F.lit(float("inf"))).unionByName(agreed)
    age = index.select("id", F.coalesce("cr", F.lit(0)).alias("cr"))
    aged = both.join(age.withColumnsRenamed({"id": "a", "cr": "cr_a"}), "a").join(age.withColumnsRenamed({"id": "b", "cr": "cr_b"}), "b")
    older = F.col("cr_a") <= F.col("cr_b")
    ordered = aged.select(F.when(older, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(older, F.col("b")).otherwise(F.col("a")).alias("drop"), "score").orderBy(F.desc("score"), "keep", "drop")
    return dedupe.greedy_merges([(r.keep, r.drop) for r in ordered.collect()])


def held(df: DataFrame) -> DataFrame:
    """``df`` evaluated once: a checkpoint where the cluster names a folder for them, else kept in memory or on disk."""
    spark = df.sparkSession
    return df.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else df.persist()


def collect(
    sightings: DataFrame,
    records: DataFrame,
    today,
    now_seconds: int,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    regions: DataFrame | None = None,
    details: Callable[[DataFrame], DataFrame] | None = None,
    judge: Callable[[DataFrame], DataFrame] | None = None,
    failed: tuple = (),
    most_enriched: int = 24,
) -> Run:
    """One run over ``sightings`` (with ``seq``) and the stored ``records``.

    Fresh sightings become records; known ones fill gaps of theirs.  Of the fresh ones, then of the known ones whose
    enrichment failed or is old, ``most_enriched`` are enriched, after their detail pages were read.  Blocked events go.
    Then entries that are one event are merged.  ``failed`` names the sources that gave nothing this time.
    """
    spark = records.sparkSession
    index = compact(records, regions)
    live = sightings.where(F.coalesce("endDate", "startDate") >= as_day(today))
    seen = held(folded(identified(live, index)).join(identified(live, index).groupBy("id").agg(F.min("seq").alias("_seq")), "id"))
    known, fresh = identity.split_known(seen, records)
    merged = merge.upsert(records, known.drop("_seq"))
    changed = merged.where("changed").select("id")
    updated = merge.with_derived_span(merged.drop("changed"))
    retried = updated.where(needs_enrichment()).join(known.select("id", "_seq"), "id")
    fresh, retried = held(detailed(fresh, details)), held(detailed(retried, details))
    asked = fresh.select("id", F.lit(0).alias("turn"), "_seq").unionByName(retried.select("id", F.lit(1).alias("turn"), "_seq"))
    asked = pending(asked, "turn", "_seq", most=most_enriched).select("id")
    both = [df.join(asked, "id", "left_semi").select("id", "title", "startDate", "endDate", "venue", "rawDescription", "categoryHint" if "categoryHint" in df.columns else F.lit(None).cast("string").alias("categoryHint")) for df in (fresh, retried)]
    enriched = held(enrich(both[0].unionByName(both[1]))) if enrich else spark.createDataFrame([], ENRICHED)
    blocked = enriched.where("e_blocked").select("id")
    new = to_records(fresh.drop("_seq"), enriched, now_seconds)
    again = re_enriched(retried.drop("_seq"), enriched)
    rest = updated.join(again.select("id"), "id", "left_anti")
    every = held(rest.unionByName(again).unionByName(new).join(blocked, "id", "left_anti"))
    pairs = duplicates(compact(every, regions).where(F.coalesce("e", "s") >= as_day(today)), judge)
    if pairs:
        every = held(merge_groups(every, spark.createDataFrame(pairs, "keep string, drop string")))
    after = compact(every, regions).where(F.coalesce("e", "s") >= as_day(today))
    return Run(every, after, source_stats(live, fresh.select("id"), changed, failed))


def source_stats(live: DataFrame, fresh: DataFrame, changed: DataFrame, failed: tuple = ()) -> DataFrame:
    """For each source: sightings fetched, of them with the id of a fresh and of a changed event, and whether it failed."""
    spark = live.sparkSession
    own = live.select("source", identity.event_id(F.col("title"), F.col("startDate")).alias("id"))
    marked = own.join(fresh.select("id", F.lit(True).alias("_fresh")), "id", "left").join(changed.select("id", F.lit(True).alias("_changed")), "id", "left")
    stats = marked.groupBy("source").agg(F.count("*").alias("fetched"), F.count_if(F.col("_fresh")).alias("fresh"), F.count_if(F.col("_changed")).alias("merged"), F.lit(False).alias("failed"))
    lost = spark.createDataFrame([(s, 0, 0, 0, True) for s in failed], "source string, fetched long, fresh long, merged long, failed boolean")
    return stats.join(lost.select("source"), "source", "left_anti").unionByName(lost)


def elapsed(log: DataFrame, now_seconds: int, hours: float = 6) -> bool:
    """Whether a run is due: the last one in ``log(at)`` began ``hours`` ago or more."""
    last = log.agg(F.max("at")).first()[0]
    return last is None or now_seconds - last >= hours * 3600


def merge_groups(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records with each (``keep``, ``drop``) pair as one: the kept one's values, gaps filled, links and flags united."""
    dropped = records.join(pairs.select(F.col("drop").alias("id"), "keep"), "id")
    none = F.array().cast(f"array<{LINK}>")
    own = F.array(F.struct("source", "url", "image"))
    gains = dropped.groupBy(F.col("keep").alias("id")).agg(
        *(merge.first_known(c, "addedAt").alias(f"_{c}") for c in ("titles", "endDate", "time", "venue", "address", "priceInfo", "rawDescription", "image")),
        F.flatten(F.collect_list("categories")).alias("_categories"),
        F.flatten(F.collect_list(F.concat(own, F.coalesce("altLinks", none)))).alias("_links"),
        F.bool_or(F.coalesce("free", F.lit(False))).alias("_free"),
        F.bool_or(F.coalesce("unusual", F.lit(False))).alias("_unusual"),
    )
    rest = records.join(pairs.select(F.col("drop").alias("id")), "id", "left_anti").join(gains, "id", "left")
    links = merge.fold_links(F.concat(F.coalesce("altLinks", none), F.coalesce("_links", none)), F.col("url"))
    new = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in ("titles", "endDate", "time", "venue", "address", "priceInfo", "rawDescription", "image")}
    new["categories"] = F.slice(F.array_union("categories", F.coalesce("_categories", F.array().cast("array<string>"))), 1, 3)
    new["altLinks"] = F.when(F.size(links) > 0, links)
    new |= {c: F.when(F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"_{c}"), F.lit(False)), True).otherwise(F.col(c)) for c in ("free", "unusual")}
    return rest.select(*(new.get(c, F.col(c)).alias(c) for c in records.columns))


def apply_patch(records: DataFrame, patch: DataFrame) -> DataFrame:
    """Records with the patch's values where it has one."""
    columns = [c for c in patch.columns if c != "id"]
    named = patch.select("id", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = records.join(named, "id", "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in records.columns))


def repaired(records: DataFrame) -> DataFrame:
    """The records whose span, derived anew, differs from the stored one."""
    new = merge.with_derived_span(records)
    old = records.select("id", F.col("startDate").alias("_s"), F.col("endDate").alias("_e"))
    return new.join(old, "id").where(~F.col("startDate").eqNullSafe(F.col("_s")) | ~F.col("endDate").eqNullSafe(F.col("_e"))).drop("_s", "_e")


#: Degrees around a city's centre in which a bounded question looks.
BOX = 0.7


def located(index: DataFrame, gazetteer: DataFrame, dim: DataFrame, home: str = "genova", cache: DataFrame | None = None, now_seconds: int = 0, keep_misses: int = 7 * 86400) -> DataFrame:
    """``id, lat, lng, found`` of entries with an address: looked up once for each city and address.

    ``gazetteer(q, lat, lng)`` answers questions; four are asked, and the first that is answered counts: the address in a
    box around its city, the address anywhere, and what stands before its first comma with the city's name and with the
    country's.  But for the first, a point too far from the city is refused.  ``cache(city, q, lat, lng, expires_at)`` says
    what was found before (``answered`` gives its next contents): misses, without a point, until they expire.
    """
    asked, best = _answers(index, gazetteer, dim, home, cache, now_seconds)
    return asked.join(best, ["city", "q"], "left").select("id", F.col("p.g_lat").alias("lat"), F.col("p.g_lng").alias("lng"), F.col("p.g_lat").isNotNull().alias("found"))


def answered(index: DataFrame, gazetteer: DataFrame, dim: DataFrame, home: str = "genova", cache: DataFrame | None = None, now_seconds: int = 0, keep_misses: int = 7 * 86400) -> DataFrame:
    """The cache after ``located``: hits without an end, misses until ``keep_misses`` seconds from when they were asked."""
    asked, best = _answers(index, gazetteer, dim, home, cache, now_seconds)
    jobs = asked.select("city", "q").distinct().join(best, ["city", "q"], "left")
    hit = F.col("p.g_lat").isNotNull()
    until = F.when(~hit, F.coalesce("until", F.lit(now_seconds + keep_misses).cast("long")))
    return jobs.select("city", "q", F.col("p.g_lat").alias("lat"), F.col("p.g_lng").alias("lng"), until.alias("expires_at"))


def _answers(index: DataFrame, gazetteer: DataFrame, dim: DataFrame, home: str, cache: DataFrame | None, now_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(entries with ``city`` and question ``q``; ``city, q, p, until`` of those that were answered or are known misses)."""
    centres = dim.select(F.col("city_slug").alias("city"), "city_name", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    rows = index.withColumn("city", F.coalesce("ct", F.lit(home))).join(F.broadcast(centres), "city", "left")
    rows = rows.withColumn("address", F.coalesce("a", F.when(F.col("v").isNotNull() & F.col("city_name").isNotNull(), F.concat_ws(", ", "v", "city_name", F.lit("Italia")))))
    asked = rows.where("address is not null").withColumn("q", F.lower(F.trim("address")))
    jobs = asked.groupBy("city", "q").agg(F.min("c_lat").alias("c_lat"), F.min("c_lng").alias("c_lng"))
    point = "struct<g_lat:double,g_lng:double>"
    known = jobs.select("city", "q").limit(0).select("city", "q", F.lit(None).cast(point).alias("p"), F.lit(None).cast("long").alias("until"))
    if cache is not None:
        live = cache.where((F.col("lat").isNotNull()) | (F.col("expires_at") > now_seconds))
        known = live.groupBy("city", "q").agg(F.min(F.struct(F.col("lat").cast("double").alias("g_lat"), F.col("lng").cast("double").alias("g_lng"))).alias("p"), F.max("expires_at").alias("until"))
        jobs = jobs.join(known, ["city", "q"], "left_anti")
    answers = gazetteer.select(F.lower(F.trim("q")).alias("_q"), F.struct(F.col("lat").alias("g_lat"), F.col("lng").alias("g_lng")).alias("p"))
    venue = F.trim(F.split_part("q", F.lit(","), F.lit(1)))
    short = F.when((venue != "") & (venue != F.col("q")), venue)
    tries = F.array(*(F.struct(F.lit(k).alias("rank"), question.alias("_q")) for k, question in enumerate((F.col("q"), F.col("q"), F.concat(short, F.lit(", "), "city"), F.concat(short, F.lit(", italia"))))))
    hits = jobs.select("city", "q", "c_lat", "c_lng", F.inline(tries)).join(answers, "_q")
    boxed = F.coalesce((F.abs(F.col("p.g_lat") - F.col("c_lat")) <= BOX) & (F.abs(F.col("p.g_lng") - F.col("c_lng")) <= BOX), F.lit(False))
    # outside the box, the gazetteer's first answer is the only one that is looked at
    first = hits.groupBy("city", "q", "rank").agg(F.min("p").alias("_any"), F.min(F.when(boxed, F.col("p"))).alias("_boxed"), F.min("c_lat").alias("c_lat"), F.min("c_lng").alias("c_lng"))
    p = F.when(F.col("rank") == 0, F.col("_boxed")).otherwise(F.when(~misplaced(F.col("_any.g_lat"), F.col("_any.g_lng"), F.col("c_lat"), F.col("c_lng")), F.col("_any")))
    found = first.withColumn("p", p).where("p is not null").groupBy("city", "q").agg(F.min_by("p", "rank").cast(point).alias("p"))
    return asked, found.withColumn("until", F.lit(None).cast("long")).unionByName(known)
