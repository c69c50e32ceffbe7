"""Calendar days, windows and Italian date grammars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.binding import let

ZONE = "Europe/Rome"
# First three letters of the Italian months, in order.
MONTHS = "gen feb mar apr mag giu lug ago set ott nov dic".split()
#: A day in figures.
FIGURES = "[0-9]{2}/[0-9]{2}/[0-9]{4}"


def as_day(value) -> Column:
    """A date column from a column, a date or an ISO string."""
    return value.cast("date") if isinstance(value, Column) else F.lit(str(value)).cast("date")


def local_day(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, ZONE))


def local_hour(instant: Column) -> Column:
    return F.hour(F.from_utc_timestamp(instant, ZONE))


def weekday(day: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(day) - 1


def weekend_from(day: Column) -> Column:
    """First day of the weekend that lasts or comes."""
    return F.when(weekday(day).isin(0, 6), day).otherwise(F.date_add(day, 6 - weekday(day)))


def weekend_to(day: Column) -> Column:
    return F.when(weekday(day) == 0, day).otherwise(F.date_add(weekend_from(day), 1))


def weekend_window(today: dt.date) -> tuple[dt.date, dt.date]:
    number = (today.weekday() + 1) % 7
    if number == 0:
        return today, today
    saturday = today + dt.timedelta(days=(6 - number) % 7)
    return saturday, saturday + dt.timedelta(days=1)


def upcoming_window(today: dt.date, days: int) -> tuple[dt.date, dt.date]:
    return today, today + dt.timedelta(days=days)


def is_iso_day(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.when(end != start, end).alias("end"))


def _from_figures(day: Column) -> Column:
    return F.when(day != "", F.array_join(F.reverse(F.split(day, "/")), "-"))


def numeric_range(text: Column) -> Column:
    """The first day in figures, and the one that a hyphen or ``al`` ties to it, as struct(start, end) of ISO strings."""

    def read(whole: Column, first: Column) -> Column:
        behind = F.ltrim(F.substr(whole, F.instr(whole, first) + F.lit(10)))
        tied = lambda b: F.when(b.startswith("-"), F.substr(b, F.lit(2))).when(b.startswith("al"), F.substr(b, F.lit(3)))
        second = F.substring(F.ltrim(let(behind, tied)), 1, 10)
        ending = let(second, lambda d: F.when((first != "") & d.rlike(f"^{FIGURES}$"), _from_figures(d)))
        return let(ending, lambda end: _span(_from_figures(first), end))

    return let(text, lambda whole: let(F.regexp_extract(whole, FIGURES, 0), lambda first: read(whole, first)))


def days_in_figures(text: Column) -> Column:
    """All days in figures of a text, as ISO strings."""
    return F.transform(F.regexp_extract_all(text, F.lit(FIGURES), F.lit(0)), _from_figures)


def _words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _month(word: Column) -> Column:
    """Number of the month that a word starts with, 0 for other words."""
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(word, F.lit(3))))
    return F.when(word.rlike(r"^\w+\.?$"), number).otherwise(0)


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.left(year, F.lit(4)), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))


def _first_place(words: Column, length: int, holds) -> Column:
    """The first place (from 0) of ``length`` words that ``holds`` says yes to; null if there is none."""
    places = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length))
    return F.get(F.filter(places, lambda i: F.coalesce(holds(i), F.lit(False))), 0)


def _named_at(words: Column) -> Column:
    """Where a day, a month's name and a year stand one after another."""
    word = lambda i: F.get(words, i)
    return _first_place(words, 3, lambda i: word(i).rlike("[0-9]$") & (_month(word(i + 1)) > 0) & word(i + 2).rlike("^[0-9]{4}"))


def _named_day(words: Column, at: Column) -> Column:
    day = F.regexp_extract(F.get(words, at), "[0-9]{1,2}$", 0)
    return F.when(at.isNotNull(), _iso(F.get(words, at + 2), _month(F.get(words, at + 1)), day))


def italian_dates(text: Column) -> Column:
    """struct(start, end, time, prefix) of the first and second ``6 lug 2026`` in a text, told by its words."""
    clock = "^([0-9]{1,2})[:.]([0-9]{2})"

    def read(words: Column, at: Column) -> Column:
        # what is left of the year's word may be the next day
        rest = F.concat(F.array(F.substr(F.get(words, at + 2), F.lit(5))), F.slice(words, at + 4, F.greatest(F.size(words), F.lit(1))))
        end = let(rest, lambda r: let(_named_at(r), lambda k: _named_day(r, k)))
        hour_at = _first_place(words, 2, lambda i: F.lower(F.get(words, i)).endswith("ore") & F.get(words, i + 1).rlike(clock))
        said = let(hour_at, lambda k: F.get(words, k + 1))
        time = let(said, lambda w: F.concat(F.lpad(F.regexp_extract(w, clock, 1), 2, "0"), F.lit(":"), F.regexp_extract(w, clock, 2)))
        before = F.array_append(F.slice(words, 1, at), F.regexp_replace(F.get(words, at), "[0-9]{1,2}$", ""))
        prefix = F.coalesce(F.trim(F.array_join(before, " ")), F.lit(""))
        both = F.struct(_named_day(words, at).alias("start"), end.alias("end"))
        return let(both, lambda d: F.struct(d["start"].alias("start"), F.when(d["end"] != d["start"], d["end"]).alias("end"), time.alias("time"), prefix.alias("prefix")))

    return let(_words(text), lambda words: let(_named_at(words), lambda at: read(words, at)))


def season_date(text: Column) -> Column:
    """``Dal 16 al 25 ottobre 2026``, else the dates of ``italian_dates``, as struct(start, end)."""

    def place(words: Column) -> Column:
        word = lambda i: F.get(words, i)
        is_day = lambda i: word(i).rlike("^[0-9]{1,2}$")
        return _first_place(words, 6, lambda i: word(i).endswith("dal") & is_day(i + 1) & (word(i + 2) == "al") & is_day(i + 3) & (_month(word(i + 4)) > 0) & word(i + 5).rlike("^[0-9]{4}"))

    def shared(words: Column, at: Column) -> Column:
        day = lambda i: _iso(F.get(words, at + 5), _month(F.get(words, at + 4)), F.get(words, at + i))
        return F.when(at.isNotNull(), _span(day(1), day(3)))

    # dall'11, dal11 and dal 11 are one wording
    spaced = F.regexp_replace(F.lower(text), "(dal|al)(?:l['’])?\\s*(?=[0-9])", "$1 ")
    found = let(_words(spaced), lambda words: let(place(words), lambda at: shared(words, at)))
    return F.coalesce(found, let(italian_dates(text), lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"))))


def ttl_seconds(last_day: Column, now_seconds: Column) -> Column:
    """Until three days after the end of the last day, one hour at least."""
    expires = F.unix_timestamp(F.to_timestamp(last_day)) + 86399 + 3 * 86400
    return F.greatest(F.lit(3600).cast("long"), expires - now_seconds)
