"""Saved events, reminders and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.dates import as_day, weekday, weekend_from, weekend_to

LANGUAGES = ("auto", "en", "it", "ru")
DIGESTS = ("off", "daily", "weekly")


def toggled(clicks: DataFrame, keys: list[str]) -> DataFrame:
    """What is on after toggles: the keys with an odd number of them."""
    return clicks.groupBy(*keys).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def due_reminders(saved: DataFrame, index: DataFrame, sent: DataFrame, today) -> DataFrame:
    """Saved events that start tomorrow, if no reminder for that day was sent."""
    tomorrow = F.date_add(as_day(today), 1)
    starting = index.where(F.col("s") == tomorrow)
    return saved.join(starting, "event_id").join(sent, ["user_id", "event_id"], "left_anti")


def live_entries(saved: DataFrame, index: DataFrame, today) -> DataFrame:
    """Saved entries whose event still is in the index and isn't over."""
    alive = index.where(F.coalesce("e", "s") >= as_day(today)).select("event_id")
    return saved.join(alive, "event_id", "left_semi")


def settings_defaults(df: DataFrame) -> DataFrame:
    """Each setting, or its default where it is missing or not allowed."""
    hour = F.col("digestHour")
    return df.withColumns(
        {
            "language": F.when(F.col("language").isin(*LANGUAGES), F.col("language")).otherwise("auto"),
            "digest": F.when(F.col("digest").isin(*DIGESTS), F.col("digest")).otherwise("off"),
            "digestHour": F.when((hour >= 0) & (hour <= 23) & (hour == F.floor(hour)), hour).otherwise(9).cast("int"),
        }
    )


def digest_window(digest: Column, digest_hour: Column, today: Column, hour: Column) -> Column:
    """struct(start, end) of the days that a digest covers now; null if none is due."""
    due = (digest != "off") & (hour == digest_hour)
    daily = F.struct(F.date_add(today, 1).alias("start"), F.date_add(today, 1).alias("end"))
    weekly = F.struct(weekend_from(today).alias("start"), weekend_to(today).alias("end"))
    return F.when(due & (digest == "daily"), daily).when(due & (digest == "weekly") & (weekday(today) == 5), weekly)


def known_users(chats: DataFrame) -> DataFrame:
    """Users that ever wrote, once each, in order."""
    return chats.where("user_id is not null").select("user_id").distinct().orderBy("user_id")
