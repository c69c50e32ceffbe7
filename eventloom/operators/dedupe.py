"""Pairs of index entries that may be one event, and merging them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import contained, jaccard

THRESHOLD = 2.0


def overlap(a: str, b: str) -> Column:
    """The days of two events meet."""
    end = lambda p: F.coalesce(F.col(f"{p}e"), F.col(f"{p}s"))
    return (F.col(f"{a}s") <= end(b)) & (F.col(f"{b}s") <= end(a))


def pair_score(a: str, b: str, venue: bool = True) -> Column:
    end = lambda p: F.coalesce(F.col(f"{p}e"), F.col(f"{p}s"))
    as_int = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    score = (
        4 * jaccard(F.col(f"{a}tokens"), F.col(f"{b}tokens"))
        + 2 * as_int(F.col(f"{a}s") == F.col(f"{b}s"))
        + as_int(end(a) == end(b))
        + 2 * as_int(contained(F.col(f"{a}tokens"), F.col(f"{b}tokens")))
    )
    return score + as_int(F.col(f"{a}v") == F.col(f"{b}v")) if venue else score


#: Days of a bucket of time.
BUCKET = 16


def overlapping_pairs(index: DataFrame, key: str = "id", venue: bool = False) -> DataFrame:
    """Pairs a < b, columns ``a_*`` and ``b_*``, that share a title token and a day.

    Pairs meet in an equality join on (token, bucket of days), so a common word is as many keys as there are
    buckets.  A pair counts once: at the smallest token that both have, in the bucket in which the later one begins.
    """
    kept = [key, "s", "e", "tokens", *(["v"] if venue else [])]
    rows = index.select(*kept)
    number = lambda day: F.floor(F.unix_date(day) / BUCKET)
    last = F.greatest(number(F.coalesce("e", "s")), number(F.col("s")))
    spread = rows.withColumn("_from", number(F.col("s"))).withColumn("bucket", F.explode(F.sequence(F.col("_from"), last)))
    keyed = spread.select(*kept, "_from", "bucket", F.explode("tokens").alias("token"))
    left = keyed.select("token", "bucket", *(F.col(c).alias(f"a_{c}") for c in (*kept, "_from")))
    right = keyed.select("token", "bucket", *(F.col(c).alias(f"b_{c}") for c in (*kept, "_from")))
    first = F.array_min(F.array_intersect("a_tokens", "b_tokens")) == F.col("token")
    once = F.col("bucket") == F.greatest("a__from", "b__from")
    return left.join(right, ["token", "bucket"]).where((F.col(f"a_{key}") < F.col(f"b_{key}")) & once & overlap("a_", "b_") & first)


def candidate_pairs(index: DataFrame, key: str = "id", least: float = THRESHOLD, venue: bool = False) -> DataFrame:
    """``a, b, score`` of pairs a < b that share a title token and a day, with a score of ``least`` or more."""
    pairs = overlapping_pairs(index, key, venue)
    scored = pairs.select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), pair_score("a_", "b_", venue).alias("score"))
    return scored.where(F.col("score") >= least)


def url_duplicates(urls: DataFrame, key: str = "id", url: str = "url") -> DataFrame:
    """``a, b``: entries that share a URL; each with the smallest of its URL."""
    known = urls.select(key, url).distinct()
    firsts = known.groupBy(url).agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1")
    return known.join(firsts, url).where(F.col(key) > F.col("a")).select("a", F.col(key).alias("b")).distinct()


def greedy_merges(pairs: list[tuple]) -> list[tuple]:
    """Judged pairs in order, as (kept, dropped); a pair that touches a dropped entry waits for the next run.

    Order-dependent, so it runs on the driver, over the capped list of judged pairs only.
    """
    dropped, out = set(), []
    for keep, lose in pairs:
        if keep not in dropped and lose not in dropped:
            dropped.add(lose)
            out.append((keep, lose))
    return out


def shared_artwork(df: DataFrame, key: str, venue: str, image_hash: str, order: list) -> DataFrame:
    """``key`` of entries that lose their image: the same image at the same venue belongs to the earliest."""
    owner = df.where(F.col(venue).isNotNull() & F.col(image_hash).isNotNull()).groupBy(venue, image_hash)
    owner = owner.agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return df.join(owner, [venue, image_hash]).where(F.struct(*order) > F.col("_first")).select(key)


def artwork_owners(index: DataFrame, sizes, hashes) -> DataFrame:
    """``id`` of index entries that lose their image, in three stages, each of which asks for less than the one before.

    Only venues with several pictures are looked at; ``sizes(df)`` says the ``bytes`` of each picture's ``img``,
    and ``hashes(df)`` the ``hash`` of those that share their size with another at the venue.  Unknown ones stay.
    """
    place = F.lower(F.trim("v"))
    shown = index.where("img is not null").select("id", "s", "img", place.alias("venue")).where("venue <> ''")
    several = shown.groupBy("venue").agg(F.count("*").alias("n")).where("n > 1").select("venue")
    sized = sizes(shown.join(several, "venue", "left_semi")).where("bytes is not null")
    alike = sized.groupBy("venue", "bytes").agg(F.count("*").alias("n")).where("n > 1").select("venue", "bytes")
    return shared_artwork(hashes(sized.join(alike, ["venue", "bytes"], "left_semi")), "id", "venue", "hash", ["s", "id"])
