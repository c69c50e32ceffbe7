"""A lazy view of an event index: each method narrows it and returns a new one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.dates import upcoming_window, weekend_window
from eventloom.functions.text import strip_accents
from eventloom.operators import windows
from eventloom.schema import primary_category, venue_of


def compact(records: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """The index projection of ``records``: short names, derived venue and region, defaults left out as null."""
    flag = lambda c: F.when(F.col(c), True)
    both = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    some = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.col(c))
    out = records.select(
        "id", F.col("title").alias("t"), F.col("titles").alias("tl"), F.col("startDate").alias("s"), F.col("endDate").alias("e"), F.col("categories").alias("c"),
        flag("free").alias("f"), venue_of(F.col("venue"), F.col("address")).alias("v"), F.col("address").alias("a"), F.when(both, F.struct("lat", "lng")).alias("g"),
        F.col("city").alias("ct"), F.col("time").alias("h"), F.col("durationMin").alias("du"), some("sessions").alias("p"), F.when(F.col("kind") == "container", True).alias("k"),
        F.col("url").alias("u"), F.col("image").alias("img"), F.when(F.col("descriptions.en") != "", F.col("descriptions")).alias("d"), some("altLinks").alias("l"),
        flag("unusual").alias("x"), F.col("addedAt").alias("cr"),
    )
    if regions is None:
        return out.withColumn("rg", F.lit(None).cast("string"))
    return out.join(F.broadcast(regions.select(F.col("city_slug").alias("ct"), F.col("region_slug").alias("rg"))), "ct", "left")


class Corpus:
    """``Corpus(index, today).weekend().category("music").events()`` is one lazy DataFrame."""

    def __init__(self, index: DataFrame, today: dt.date):
        self.index, self.today = index, today

    def _with(self, index: DataFrame) -> Corpus:
        return Corpus(index, self.today)

    def window(self, start, end) -> Corpus:
        return self._with(self.index.where(windows.in_window(start, end)))

    def day(self) -> Corpus:
        return self.window(self.today, self.today)

    def tomorrow(self) -> Corpus:
        day = self.today + dt.timedelta(days=1)
        return self.window(day, day)

    def weekend(self) -> Corpus:
        return self.window(*weekend_window(self.today))

    def upcoming(self, days: int) -> Corpus:
        return self.window(*upcoming_window(self.today, days))

    def tonight(self) -> Corpus:
        return self._with(windows.tonight(self.index, self.today))

    def free(self, days: int = 30) -> Corpus:
        return self._with(windows.free(self.index, self.today, days))

    def gems(self, days: int = 30) -> Corpus:
        return self._with(windows.gems(self.index, self.today, days))

    def category(self, *names: str) -> Corpus:
        return self._with(self.index.where(windows.has_category(*names)))

    def feed(self, categories: list[str] | None = None, free_only: bool = False) -> Corpus:
        return self._with(windows.feed_filter(self.index, categories, free_only))

    def pruned(self) -> Corpus:
        return self._with(windows.upcoming(self.index, self.today))

    def search(self, text: str) -> Corpus:
        """Titles that have ``text``, whatever its case and accents."""
        return self._with(self.index.where(strip_accents(F.lower("t")).contains(strip_accents(F.lower(F.lit(text))))))

    def pick(self, preferred: list[str], roll: float, exclude: str | None = None, days: int = 14) -> DataFrame:
        """One event, those of preferred categories three times as likely; ``roll`` is in [0, 1)."""
        rows = self.upcoming(days).index
        rows = rows if exclude is None else rows.where(F.col("id") != exclude)
        weight = F.when(windows.has_category(*preferred), 3).otherwise(1) if preferred else F.lit(1)
        return windows.weighted_pick(rows, ["s", F.collate("t", "UNICODE"), "id"], weight, roll)

    def events(self) -> DataFrame:
        return windows.listing_order(self.index)

    def by_category(self) -> DataFrame:
        return self.index.groupBy(primary_category(F.col("c")).alias("category")).agg(F.count("*").alias("n"))
