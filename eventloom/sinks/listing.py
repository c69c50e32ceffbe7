"""Listings grouped by category, and the JSON feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import escape_html, localized
from eventloom.schema import CATEGORY_SIGNS, category_order, primary_category


def short_day(day: Column) -> Column:
    return F.date_format(day, "dd.MM")


def day_span(s: Column, e: Column, h: Column) -> Column:
    """``04.07–05.07, 21:00``."""
    return F.concat_ws(", ", F.concat_ws("–", short_day(s), short_day(e)), h)


def event_line() -> Column:
    gem = F.when(F.col("x").eqNullSafe(True), "💎 ").otherwise("")
    facts = F.concat_ws(", ", day_span(F.col("s"), F.col("e"), F.col("h")), escape_html(F.col("v")), F.when(F.col("f").eqNullSafe(True), "free"))
    return F.concat(F.lit("• "), gem, F.lit('<a href="'), F.col("u"), F.lit('">'), escape_html(F.col("t")), F.lit("</a> — "), facts)


def grouped(index: DataFrame) -> DataFrame:
    """``ord, category, n, body``: each category's lines in listing order; categories in taxonomy order.

    A listing is read by people: give it a window of an index, not a whole one.
    """
    lines = index.select(primary_category(F.col("c")).alias("category"), F.struct("s", "t", "id", event_line().alias("line")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    out = lines.groupBy("category").agg(F.count("*").alias("n"), body.alias("body"))
    return out.select(category_order(F.col("category")).cast("int").alias("ord"), "category", "n", "body").orderBy("ord")


def json_feed(index: DataFrame, *columns: str) -> DataFrame:
    """``id, json``: one object for each event, null fields left out."""
    return index.select("id", F.to_json(F.struct(*columns)).alias("json"))


def feed_document(index: DataFrame, generated_at: str, *columns: str) -> DataFrame:
    """One row: ``{"generatedAt", "events"}`` with the index's events in listing order.  For a window of an index, as a listing is."""
    events = F.transform(F.array_sort(F.collect_list(F.struct("s", "t", "id", F.struct(*columns).alias("event")))), lambda x: x["event"])
    return index.agg(F.to_json(F.struct(F.lit(generated_at).alias("generatedAt"), events.alias("events"))).alias("json"))


def card(lang: str, labels: dict[str, str]) -> Column:
    """One record in full: title, categories and days, place, price, description and source, a line each."""
    signs = F.create_map(*(F.lit(x) for pair in CATEGORY_SIGNS.items() for x in pair))
    names = F.create_map(*(F.lit(x) for c in CATEGORY_SIGNS for x in (c, labels.get(c, c))))
    days = day_span(F.col("startDate"), F.col("endDate"), F.col("time"))
    title = F.coalesce(F.nullif(F.col(f"titles.{lang}"), F.lit("")), F.col("title"))
    head = F.concat(F.when(F.col("unusual").eqNullSafe(True), "💎 ").otherwise(""), F.lit("<b>"), escape_html(title), F.lit("</b>"))
    kinds = F.array_join(F.transform("categories", lambda c: F.element_at(names, c)), " · ")
    place = F.nullif(F.concat_ws(", ", "venue", "address"), F.lit(""))
    lines = F.array(
        head,
        F.concat(F.element_at(signs, primary_category(F.col("categories"))), F.lit(" "), escape_html(kinds), F.lit(" · "), days),
        F.concat(F.lit("📍 "), escape_html(place)),
        F.coalesce(F.concat(F.lit("💶 "), escape_html(F.col("priceInfo"))), F.when(F.col("free").eqNullSafe(True), "💶 free")),
        F.lit(""), escape_html(localized(F.col("descriptions"), lang)), F.lit(""),
        F.concat(F.lit('<a href="'), F.col("url"), F.lit('">→ '), escape_html(F.col("source")), F.lit("</a>")),
    )
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
