"""Folding sightings of one event into one record.

"First" always means the smallest ``seq``; nothing depends on the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import free_from_price

LINKS = "array<struct<source:string,url:string,image:string>>"
FILLED = ("time", "venue", "address", "priceInfo", "rawDescription", "image", "city")


def first_known(column: str, order: str = "seq") -> Column:
    """The first value that isn't null."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def within_run(sightings: DataFrame, key: str, columns: list[str], order: str = "seq") -> DataFrame:
    """One row for each key: of each column the first known value.  Partial sums come before the shuffle."""
    return sightings.groupBy(key).agg(*(first_known(c, order).alias(c) for c in columns))


def fold_links(links: Column, own_url: Column) -> Column:
    """Links by URL in order of first sight, without the event's own: first source, first known image."""
    links = F.coalesce(links, F.array().cast(LINKS))
    urls = F.array_distinct(F.transform(F.filter(links, lambda x: ~x["url"].eqNullSafe(own_url)), lambda x: x["url"]))

    def folded(url: Column) -> Column:
        same = F.filter(links, lambda x: x["url"] == url)
        images = F.filter(same, lambda x: x["image"].isNotNull())
        return F.struct(F.get(same, 0)["source"].alias("source"), url.alias("url"), F.get(images, 0)["image"].alias("image"))

    return F.transform(urls, folded)


def unite_links(links: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """``key, links`` of rows ``key, order, source, url, image``: a link for each URL, in order of first sight.

    Each URL is summed before the shuffle, so a key with many sightings gathers its distinct URLs only.
    """
    once = links.where("url is not null").groupBy(key, "url").agg(F.min(order).alias("at"), F.min_by("source", order).alias("source"), first_known("image", order).alias("image"))
    kept = F.transform(F.array_sort(F.collect_list(F.struct("at", "source", "url", "image"))), lambda x: F.struct(x["source"].alias("source"), x["url"].alias("url"), x["image"].alias("image")))
    return once.groupBy(key).agg(kept.alias("links"))


def filled(stored: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored and new rows as one for each key: what is stored stays, gaps are filled, a range of days widens."""
    theirs = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    both = stored.select(key, *columns).join(theirs, key, "full")
    out = {c: F.coalesce(c, f"_{c}") for c in columns}
    if {"startDate", "endDate"} <= set(columns):
        start = F.least("startDate", "_startDate")
        last = F.greatest(F.coalesce("endDate", "startDate"), F.coalesce("_endDate", "_startDate"))
        out |= {"startDate": start, "endDate": F.when(last != start, last)}
    return both.select(key, *(out[c].alias(c) for c in columns))


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "id", filled: tuple = FILLED) -> DataFrame:
    """Stored records with what a new sighting adds: gaps filled, the range widened, links united.

    Columns: ``startDate, endDate``; ``filled``, ``lat, lng``, ``free`` and ``altLinks`` where both have them.
    ``changed`` says whether anything is new.  Records without a sighting come back as they are.
    """
    new = incoming.select(key, *(F.col(c).alias(f"_{c}") for c in incoming.columns if c != key))
    both = stored.join(new, key, "left").withColumn("_seen", F.col("_startDate").isNotNull())
    start = F.least("startDate", "_startDate")
    end = F.greatest(F.coalesce("endDate", "startDate"), F.coalesce("_endDate", "_startDate"))
    out = {"startDate": start, "endDate": F.when(F.col("_seen"), F.when(end != start, end)).otherwise(F.col("endDate"))}
    out |= {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in filled if {c} <= set(stored.columns) & set(incoming.columns)}
    if "free" in stored.columns:
        filling = F.col("priceInfo").isNull() & F.col("_priceInfo").isNotNull()
        out["free"] = F.when(filling, free_from_price(F.col("_priceInfo"))).otherwise(F.col("free"))
    if {"lat", "lng"} <= set(stored.columns) & set(incoming.columns):
        pair = F.col("lat").isNull() & F.col("_lat").isNotNull() & F.col("_lng").isNotNull()
        out |= {c: F.when(pair, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("lat", "lng")}
    if "altLinks" in stored.columns:
        none = F.array().cast(LINKS)
        seen = F.array(F.struct(F.col("_source").alias("source"), F.col("_url").alias("url"), F.col("_image").alias("image")))
        theirs = F.coalesce("_altLinks", none) if "altLinks" in incoming.columns else none
        out["altLinks"] = F.when(F.col("_seen"), fold_links(F.concat(F.coalesce("altLinks", none), theirs, seen), F.col("url"))).otherwise(F.col("altLinks"))
    watched = [c for c in out if c != "free"]
    changed = F.lit(False)
    for c in watched:
        if c == "altLinks":
            changed = changed | (F.coalesce(out[c], F.array().cast(LINKS)) != F.coalesce(F.col(c), F.array().cast(LINKS)))
        else:
            changed = changed | ~out[c].eqNullSafe(F.col(c))
    merged = both.select(key, *(out.get(c, F.col(c)).alias(c) for c in stored.columns if c != key), changed.alias("changed"))
    return merged


def merge_pairs(primary: str, secondary: str, columns: tuple, most_categories: int = 3) -> dict[str, Column]:
    """Columns of two joined records (prefixes) as one: the older one's values, gaps filled, categories united."""
    out = {c: F.coalesce(F.col(primary + c), F.col(secondary + c)) for c in columns}
    out["c"] = F.slice(F.array_union(F.col(primary + "c"), F.col(secondary + "c")), 1, most_categories)
    for flag in ("f", "x"):
        out[flag] = F.coalesce(F.col(primary + flag), F.lit(False)) | F.coalesce(F.col(secondary + flag), F.lit(False))
    return out


def collapse_runs(df: DataFrame, key: str, start: str, end: str, order: str = "seq", first: tuple = ()) -> DataFrame:
    """One row for each key with the whole span; ``end`` is null for one day."""
    low = F.min(start)
    high = F.max(F.coalesce(F.col(end), F.col(start)))
    return df.groupBy(key).agg(low.alias(start), F.when(high != low, high).alias(end), *(F.min_by(c, order).alias(c) for c in first))


def url_stem(url: Column) -> Column:
    """A URL without the number of its repeat: ``/paganini_2/`` is ``/paganini/``."""
    return F.regexp_replace(url, r"_[0-9]+(/?)$", "$1")


def container_span(sessions: Column) -> Column:
    """struct(start, end) of a programme; the end is null for one day."""
    days = F.transform(sessions, lambda x: x["date"])
    low, high = F.array_min(days), F.array_max(days)
    return F.struct(low.alias("start"), F.when(high != low, high).alias("end"))


def with_derived_span(df: DataFrame) -> DataFrame:
    """A container's days are those of its sessions, whatever was announced."""
    derived = F.col("kind").eqNullSafe("container") & (F.size(F.coalesce(F.col("sessions"), F.array())) > 0)
    span = container_span(F.col("sessions"))
    return df.withColumns({"startDate": F.when(derived, span["start"]).otherwise(F.col("startDate")), "endDate": F.when(derived, span["end"]).otherwise(F.col("endDate"))})


def unique_sessions(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each day and time (``keys``)."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")


def last_wins(parts: list[DataFrame], key: str, order: str | None = None) -> DataFrame:
    """Union by key; a later part's row replaces an earlier one's."""
    rows = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r, allowMissingColumns=True)
    by = F.struct("_part", order) if order else F.col("_part")
    values = [c for c in union.columns if c not in (key, "_part")]
    return union.groupBy(key).agg(F.max_by(F.struct(*values), by).alias("_v")).select(key, "_v.*")
