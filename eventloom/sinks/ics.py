"""iCalendar text as columns: one row for each event, lines folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import localized
from eventloom.schema import CATEGORY_SIGNS, primary_category

FIRST, NEXT = 74, 73
HOURS = 2
ZONE = "Europe/Rome"

# The lines that describe the time zone.
ROME = [
    "BEGIN:VTIMEZONE",
    "TZID:Europe/Rome",
    "BEGIN:DAYLIGHT",
    "TZOFFSETFROM:+0100",
    "TZOFFSETTO:+0200",
    "TZNAME:CEST",
    "DTSTART:19700329T020000",
    "RRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=-1SU",
    "END:DAYLIGHT",
    "BEGIN:STANDARD",
    "TZOFFSETFROM:+0200",
    "TZOFFSETTO:+0100",
    "TZNAME:CET",
    "DTSTART:19701025T030000",
    "RRULE:FREQ=YEARLY;BYMONTH=10;BYDAY=-1SU",
    "END:STANDARD",
    "END:VTIMEZONE",
]


def escape(text: Column) -> Column:
    for raw, out in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(out))
    return text


def fold(line: Column) -> Column:
    """The pieces of a line; all but the first begin with a space."""
    more = F.ceil((F.length(line) - FIRST) / NEXT).cast("int")
    rest = F.transform(F.sequence(F.lit(0), more - 1), lambda i: F.concat(F.lit(" "), F.substring(line, i * NEXT + FIRST + 1, F.lit(NEXT))))
    return F.when(F.length(line) <= FIRST, F.array(line)).otherwise(F.concat(F.array(F.substring(line, 1, FIRST)), rest))


def day_value(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def timed_value(day: Column, time: Column, hours: int = 0) -> Column:
    """Local day and time some hours on; past midnight it is the next day."""
    hour = F.split_part(time, F.lit(":"), F.lit(1)).cast("int") + hours
    minutes = F.coalesce(F.nullif(F.split_part(time, F.lit(":"), F.lit(2)), F.lit("")), F.lit("00"))
    return F.concat(day_value(F.date_add(day, F.floor(hour / 24).cast("int"))), F.lit("T"), F.lpad((hour % 24).cast("string"), 2, "0"), minutes, F.lit("00"))


def timing(s: Column, e: Column, h: Column) -> Column:
    """The two lines of start and end: the end is exclusive for whole days, two hours on for a time."""
    whole = F.array(F.concat(F.lit("DTSTART;VALUE=DATE:"), day_value(s)), F.concat(F.lit("DTEND;VALUE=DATE:"), day_value(F.date_add(F.coalesce(e, s), 1))))
    timed = F.array(F.concat(F.lit(f"DTSTART;TZID={ZONE}:"), timed_value(s, h)), F.concat(F.lit(f"DTEND;TZID={ZONE}:"), timed_value(s, h, HOURS)))
    return F.when(h.isNull(), whole).otherwise(timed)


def event_lines(stamp: str, lang: str = "en", domain: str = "eventloom") -> Column:
    """An array of the unfolded lines of one event of the index."""
    col = F.col
    labels = F.transform("c", F.initcap)
    sign = F.lit(None).cast("string")
    for name, mark in CATEGORY_SIGNS.items():
        sign = F.when(primary_category(col("c")) == name, mark).otherwise(sign)
    title = F.coalesce(F.nullif(col("tl")[lang], F.lit("")), col("t"))
    summary = F.nullif(localized(col("d"), lang), F.lit(""))
    about = F.concat_ws(" · ", summary, F.array_join(labels, "/"), F.when(col("f").eqNullSafe(True), "free entry"), col("u"))
    lines = F.concat(
        F.array(F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), col("id"), F.lit(f"@{domain}")), F.lit(f"DTSTAMP:{stamp}")),
        timing(col("s"), col("e"), col("h")),
        F.array(
            F.concat(F.lit("SUMMARY:"), escape(F.concat_ws(" ", sign, title))),
            F.concat(F.lit("LOCATION:"), escape(col("v"))),
            F.concat(F.lit("DESCRIPTION:"), escape(about)),
            F.concat(F.lit("URL:"), col("u")),
            F.concat(F.lit("CATEGORIES:"), F.array_join(F.transform(labels, F.upper), ",")),
            F.lit("END:VEVENT"),
        ),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def calendar(index: DataFrame, stamp: str, lang: str = "en") -> DataFrame:
    """``id, text``: the folded event of each row; a feed is header, these in order, and footer."""
    folded = F.flatten(F.transform(event_lines(stamp, lang), fold))
    return index.select("id", F.concat(F.array_join(folded, "\r\n"), F.lit("\r\n")).alias("text"))


def header(name: str = "Events") -> str:
    top = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//eventloom//Events//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"X-WR-CALNAME:{name}", f"X-WR-TIMEZONE:{ZONE}"]
    return "\r\n".join([*top, *ROME]) + "\r\n"


FOOTER = "END:VCALENDAR\r\n"
