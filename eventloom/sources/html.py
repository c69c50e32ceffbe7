"""Listing pages to sightings: one regular card grammar, told by parameters where a card begins and how fields look."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.dates import italian_dates, numeric_range, season_date
from eventloom.functions.text import category_hint, strip_tags

GRAMMARS = {"numeric": numeric_range, "named": italian_dates, "season": season_date}


@dataclass(frozen=True)
class CardGrammar:
    """How one kind of listing writes its cards.  Patterns have one group, but ``card``, which splits a page."""

    source: str
    card: str
    title: str = r"(?is)<h[1-4][^>]*>(.*?)</h[1-4]>"
    href: str = r"(?is)<a[^>]+href=[\"']([^\"']+)"
    image: str = r"(?is)<img[^>]+(?:data-src|src)=[\"'](https?://[^\"']+)"
    labels: str = r"(?is)class=[\"'][^\"']*categor[^\"']*[\"'][^>]*>(.*?)<"
    dates: str = "numeric"
    base: str = ""
    hint: str | None = None


def cards(html: Column, grammar: CardGrammar) -> Column:
    """The html of each card of a page."""
    return F.slice(F.split(html, grammar.card), 2, 1_000_000)


def page_facts(html: Column) -> dict[str, Column]:
    """Headline, first link and number of links of a page."""
    return {
        "headline": strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)),
        "first_href": F.regexp_extract(html, r"<a[^>]+href=\"([^\"]*)\"", 1),
        "n_links": F.regexp_count(html, F.lit(r"<a[^>]+href=")),
    }


def read_cards(pages: DataFrame, grammar: CardGrammar, html: str = "html") -> DataFrame:
    """Sightings of ``pages``; a card without title, link or first day is dropped."""
    one = lambda pattern: F.nullif(F.trim(F.regexp_extract("card", pattern, 1)), F.lit(""))
    found = pages.select(*[c for c in pages.columns if c != html], F.posexplode(cards(F.col(html), grammar)).alias("at", "card"))
    text = strip_tags(F.col("card"))
    dates = GRAMMARS[grammar.dates](text)
    href = one(grammar.href)
    rows = found.select(
        *[c for c in found.columns if c != "card"],
        F.nullif(strip_tags(one(grammar.title)), F.lit("")).alias("title"),
        F.when(href.startswith("/"), F.concat(F.lit(grammar.base), href)).otherwise(href).alias("url"),
        one(grammar.image).alias("image"),
        dates["start"].try_cast("date").alias("startDate"),
        dates["end"].try_cast("date").alias("endDate"),
        F.coalesce(F.lit(grammar.hint), category_hint(F.coalesce(one(grammar.labels), F.lit("")))).alias("categoryHint"),
        F.lit(grammar.source).alias("source"),
    )
    return rows.where(F.col("title").isNotNull() & F.col("url").isNotNull() & F.col("startDate").isNotNull())


def page_count(html: Column, most: int = 10) -> Column:
    """Pages of a listing that says ``Pagina 1 di 7``, from 1 to ``most``."""
    said = F.regexp_extract(html, r"(?i)pagina\s+\d+\s+di\s+(\d+)", 1).try_cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(said, F.lit(1))))
