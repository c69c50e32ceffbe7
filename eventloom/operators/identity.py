"""Which event a sighting is: hash identity, URL aliases, fresh or known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import normalize_title


def event_id(title: Column, day: Column) -> Column:
    """First 12 hex digits of the SHA-256 of normalised title and first day."""
    return F.substring(F.sha2(F.concat(normalize_title(title), F.lit("|"), day.cast("string")), 256), 1, 12)


def alias_map(index: DataFrame, key: str = "id", url: str = "u", links: str = "l", position: str = "pos") -> DataFrame:
    """``url, alias``: of the events that know a URL, the one latest in the index."""
    urls = F.array_union(F.array(F.col(url)), F.coalesce(F.transform(links, lambda x: x["url"]), F.array().cast("array<string>")))
    known = index.select(F.explode(urls).alias("url"), key, position).where("url is not null")
    return known.groupBy("url").agg(F.max_by(key, position).alias("alias"))


def resolve(sightings: DataFrame, aliases: DataFrame, url: str = "url", own: str = "id") -> DataFrame:
    """``id`` by URL where the URL is known, else by hash."""
    return sightings.join(aliases.select(F.col("url").alias("_url"), "alias"), F.col(url) == F.col("_url"), "left").withColumn(own, F.coalesce("alias", own)).drop("_url", "alias")


def split_known(sightings: DataFrame, index: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(known, fresh) sightings."""
    ids = index.select(key)
    return sightings.join(ids, key, "left_semi"), sightings.join(ids, key, "left_anti")
