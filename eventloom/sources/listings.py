"""Seven kinds of sources as sightings: six listing pages and two JSON interfaces, each told by what its markup says.

Every parser takes pages (``html`` or ``body``, other columns ride along), the name that its sightings carry as
``source`` and, where links are relative, the site's ``base``.  A card without title, link or first day is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.dates import FIGURES, days_in_figures, italian_dates, numeric_range, season_date
from eventloom.functions.geo import nearest
from eventloom.functions.text import category_hint, decode_entities, first_image, slug, strip_tags
from eventloom.operators.merge import collapse_runs, url_stem
from eventloom.schema import LINK
from eventloom.sources.feeds import place_and_province, post_id, price_range, widest

#: Columns of a parsed sighting, and their types.
FIELDS = {
    "title": "string", "startDate": "date", "endDate": "date", "time": "string", "venue": "string", "address": "string", "priceInfo": "string", "rawDescription": "string",
    "url": "string", "source": "string", "city": "string", "lat": "double", "lng": "double", "categoryHint": "string", "image": "string", "altLinks": f"array<{LINK}>",
}
# Words of the palace's labels, in order of precedence, and the category that each hints at.
PALACE_TYPES = (
    ("mostra", "art"), ("arte", "art"), ("musica", "music"), ("concert", "music"), ("cinema", "culture"), ("letteratura", "culture"), ("incontro", "culture"),
    ("convegno", "workshop"), ("didattica", "workshop"), ("laborator", "workshop"), ("bambin", "family"), ("famigli", "family"),
)
# The ticket interface's segments and the category that each hints at.
SEGMENTS = {"Music": "music", "Arts & Theatre": "theatre", "Sports": "sport", "Film": "culture", "Miscellaneous": "other"}
# Where the palace is.
PALACE = (44.40758, 8.93436)


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _opening(tag: str, cls: str) -> str:
    """An opening tag of a class, up to its attributes."""
    return rf"(?i)<{tag}(?=\s[^>]*class=[\"'](?:[^\"']*\s)?{cls}[\s\"'])"


def _cards(pages: DataFrame, tag: str, cls: str, html: str = "html") -> DataFrame:
    """Each card with its place on the page; a card lasts until the next."""
    return pages.select(*(c for c in pages.columns if c != html), F.posexplode(F.slice(F.split(html, _opening(tag, cls)), 2, 1 << 20)).alias("at", "card"))


def _inside(tag: str, cls: str) -> Column:
    """What the card's first element of a class has, markup included; null if there is none."""
    return _some(F.regexp_extract("card", rf"(?s){_opening(tag, cls)}[^>]*>(.*?)</{tag}>", 1))


def _attribute(tag: str, name: str, value: str = "[^\"']+") -> Column:
    return _some(F.regexp_extract("card", rf"(?is)<{tag}\s(?:[^>]*\s)?{name}=[\"']({value})[\"']", 1))


def _own_attribute(name: str) -> Column:
    """Of the tag that opens the card."""
    return _some(F.regexp_extract("card", rf"(?is)^[^>]*\s{name}=[\"']([^\"']+)[\"']", 1))


def _absolute(link: Column, base: str) -> Column:
    site = base.rstrip("/")
    return F.when(link.rlike("(?i)^https?:"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(F.lit(site), link)).otherwise(F.concat(F.lit(site + "/"), link))


def _sightings(rows: DataFrame, source: str, **columns) -> DataFrame:
    """The parsed columns behind those that rode along."""
    own = {"source": F.lit(source), **columns}
    kept = [c for c in rows.columns if c not in (*FIELDS, "card", "v", "body")]
    out = rows.select(*kept, *(own.get(name, F.lit(None)).try_cast(kind).alias(name) if kind != f"array<{LINK}>" else own.get(name, F.lit(None).cast(kind)).alias(name) for name, kind in FIELDS.items()))
    return out.where("title is not null and startDate is not null and url is not null")


def _later(start: Column, end: Column) -> Column:
    """The end, if it isn't before the start."""
    return F.when(end >= start, end)


def dated_headings(pages: DataFrame, source: str, base: str, city: str) -> DataFrame:
    """Listing A: a grid of links whose heading has the days in figures, then the title."""
    rows = _cards(pages, "div", "grid-item")
    heading = decode_entities(F.regexp_replace(F.regexp_extract("card", r"(?is)<h4[^>]*>(.*?)</h4>", 1), "<[^>]*>", ""))
    days = numeric_range(heading)
    title = _some(F.regexp_replace(heading, rf"{FIGURES}(\s*(-|al)\s*{FIGURES})?", " "))
    labels = F.coalesce(strip_tags(_inside("div", "category_event")), F.lit(""))
    return _sightings(
        rows, source, title=F.regexp_replace(title, r"\s+", " "), startDate=days["start"], endDate=days["end"], url=_absolute(_attribute("a", "href"), base),
        city=F.lit(city), categoryHint=category_hint(labels), image=_absolute(_attribute("img", "src"), base),
    )


def city_agenda(pages: DataFrame, source: str, base: str) -> DataFrame:
    """Listing B: a city's agenda (``city`` of each page); the first link of the site itself is the event's."""
    rows = _cards(pages, "div", "Evento")
    days = numeric_range(strip_tags(_inside("span", "Date")))
    return _sightings(
        rows, source, title=_some(strip_tags(_inside("span", "Titolo"))), startDate=days["start"], endDate=days["end"], url=_absolute(_attribute("a", "href", "/[^\"']*"), base),
        city=F.col("city"), image=_absolute(F.coalesce(_attribute("img", "data-src"), _attribute("img", "src")), base),
    )


def national_search(pages: DataFrame, source: str, base: str, provinces: DataFrame) -> DataFrame:
    """A search over the country: ``Lovere (BG)`` files an event under its province's capital; unknown provinces are dropped."""
    rows = _cards(pages, "div", "risultatoEvento")
    days = days_in_figures(strip_tags(F.col("card")))
    start, end = F.get(days, 0), F.get(days, 1)
    place, province = place_and_province(strip_tags(F.coalesce(_inside("span", "corsivo"), F.lit(""))))
    rows = rows.withColumns({"_place": place, "_province": province})
    rows = rows.join(F.broadcast(provinces.select(F.col("province").alias("_province"), F.col("city_slug").alias("_city"))), "_province")
    out = _sightings(
        rows, source, title=_some(strip_tags(_inside("h3", "titolo"))), startDate=start, endDate=_later(start, end), url=_absolute(_attribute("a", "href"), base),
        city=F.col("_city"), venue=F.col("_place"), image=_absolute(_attribute("img", "src"), base),
    )
    return out.drop("_place", "_province", "_city")


def theatre_cards(pages: DataFrame, source: str, base: str, city: str) -> DataFrame:
    """A theatre agenda: as listing B, of one city, with an abstract that describes the show."""
    rows = _cards(pages, "div", "Evento")
    days = numeric_range(strip_tags(_inside("span", "Date")))
    return _sightings(
        rows, source, title=_some(strip_tags(_inside("span", "Title"))), startDate=days["start"], endDate=days["end"], url=_absolute(_attribute("a", "href", "/[^\"']*"), base),
        city=F.lit(city), categoryHint=F.lit("theatre"), rawDescription=_some(strip_tags(_inside("span", "Abstract"))), image=_absolute(_attribute("img", "src"), base),
    )


def palace_type(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, category in reversed(PALACE_TYPES):
        out = F.when(F.lower(label).contains(word), category).otherwise(out)
    return out


def palace_cards(pages: DataFrame, source: str, base: str, city: str, own: str = "palazzo ducale", point: tuple = PALACE) -> DataFrame:
    """The palace's programme: what stands before the first day is the venue; events in the palace have its point."""
    rows = _cards(pages, "article", "exhibition-item")
    info = italian_dates(strip_tags(_inside("p", "exhibition-info")))
    link = F.coalesce(_inside("h2", "exhibition-title"), F.lit(""))
    at_home = (info["prefix"] == "") | F.regexp_replace(F.lower(info["prefix"]), r"\s+", "").contains(own.replace(" ", ""))
    return _sightings(
        rows, source, title=_some(strip_tags(link)), startDate=info["start"], endDate=info["end"], time=info["time"], venue=_some(info["prefix"]),
        url=_absolute(_some(F.regexp_extract(link, r"(?is)<a\s[^>]*href=[\"']([^\"']+)", 1)), base), city=F.lit(city),
        lat=F.when(at_home, point[0]), lng=F.when(at_home, point[1]), categoryHint=palace_type(F.coalesce(strip_tags(_inside("p", "exhibition-type")), F.lit(""))), image=_absolute(_attribute("img", "src"), base),
    )


def season_slides(pages: DataFrame, source: str, base: str, city: str, venue: str, path: str = "/spettacolo/") -> DataFrame:
    """A theatre's season: slides repeat, and one production has several dated pages, which become one sighting.

    The first page is the sighting's, the others are its ``altLinks``; its days are those of all.
    """
    rows = _cards(pages, "a", "swiper-slide-inner").withColumn("_page", F.monotonically_increasing_id())
    days = season_date(strip_tags(F.coalesce(_inside("div", "elementor-slide-description"), F.lit(""))))
    title = _some(F.regexp_replace(strip_tags(F.coalesce(_inside("div", "elementor-slide-heading"), F.lit(""))), "_[0-9]+$", ""))
    link = _own_attribute("href")
    parsed = rows.select(title.alias("title"), days["start"].alias("s"), days["end"].alias("e"), _absolute(link, base).alias("url"), F.struct("_page", "at").alias("seq")).where(link.contains(path))
    parsed = parsed.where("title is not null and s is not null")
    once = parsed.groupBy("url").agg(*(F.min_by(c, "seq").alias(c) for c in ("title", "s", "e")), F.min("seq").alias("seq"))
    once = once.withColumn("stem", F.regexp_replace(url_stem(F.col("url")), "/$", ""))
    shows = collapse_runs(once, "stem", "s", "e", "seq", ("title", "url"))
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("seq"))
    more = once.withColumn("nth", nth).where("nth > 1").groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("nth", "url"))).alias("more"))
    links = F.transform("more", lambda x: F.struct(F.lit(source).alias("source"), x["url"].alias("url"), F.lit(None).cast("string").alias("image")))
    shows = shows.join(more, "stem", "left").withColumnsRenamed({"title": "_title", "url": "_url"})
    out = _sightings(shows, source, title=F.col("_title"), startDate=F.col("s"), endDate=F.col("e"), url=F.col("_url"), city=F.lit(city), venue=F.lit(venue), categoryHint=F.lit("music"), altLinks=links.cast(f"array<{LINK}>"))
    return out.drop("stem", "s", "e", "more", "_title", "_url")


def _text(path: str, v: str = "v") -> Column:
    return _some(F.try_variant_get(v, path, "string"))


def _items(pages: DataFrame, body: str, path: str) -> DataFrame:
    """The elements of a JSON list, as variants."""
    items = F.try_variant_get(F.try_parse_json(body), path, "array<variant>")
    return pages.select(*(c for c in pages.columns if c != body), F.posexplode(F.coalesce(items, F.array().cast("array<variant>"))).alias("at", "v"))


def rest_posts(pages: DataFrame, terms: DataFrame, source: str, city: str, most_chars: int = 400) -> DataFrame:
    """Posts of a REST interface; the first day in a post's text is the event's, its place a term looked up by number.

    ``terms(body)`` are the pages of terms; posts without a day in their text are none of an event.
    """
    places = _items(terms, "body", "$").select(F.try_variant_get("v", "$.id", "long").alias("_term"), decode_entities(_text("$.name")).alias("_venue"))
    places = places.where("_term is not null and _venue is not null").groupBy("_term").agg(F.min("_venue").alias("_venue"))
    rows = _items(pages, "body", "$").withColumns({"_term": F.try_variant_get("v", "$['location-eventi'][0]", "long"), "_html": _text("$.content.rendered")})
    rows = rows.join(places, "_term", "left").withColumn("_text", strip_tags(F.col("_html")))
    info = italian_dates(F.col("_text"))
    out = _sightings(
        rows, source, title=_some(decode_entities(_text("$.title.rendered"))), startDate=info["start"], endDate=info["end"], time=info["time"], url=_text("$.link"), city=F.lit(city),
        venue=F.col("_venue"), rawDescription=_some(F.left("_text", F.lit(most_chars))), image=first_image(F.col("_html")),
    )
    return out.drop("_term", "_html", "_text", "_venue")


def ticket_events(pages: DataFrame, source: str, centres: DataFrame) -> DataFrame:
    """Events of a ticket interface: filed by their point's nearest centre, else by the name of their town.

    ``centres(city_slug, lat, lng)``; (0, 0) is no point; an event that can't be filed is dropped.
    """
    rows = _items(pages, "body", "$._embedded.events").withColumn("_id", F.monotonically_increasing_id())
    venue = "$._embedded.venues[0]"
    lat, lng = (_text(f"{venue}.location.{x}").try_cast("double") for x in ("latitude", "longitude"))
    placed = lat.isNotNull() & lng.isNotNull() & ~((lat == 0) & (lng == 0))
    town = _text(f"{venue}.city.name")
    rows = rows.withColumns({"_lat": F.when(placed, lat), "_lng": F.when(placed, lng), "_town": town, "_slug": slug(town)})
    known = centres.select("city_slug", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    near = nearest(rows.where("_lat is not null").select("_id", F.col("_lat").alias("lat"), F.col("_lng").alias("lng")), known, "_id", "city_slug").withColumnRenamed("city_slug", "_near")
    named = known.select(F.col("city_slug").alias("_slug"), F.col("city_slug").alias("_named")).distinct()
    rows = rows.join(near, "_id", "left").join(F.broadcast(named), "_slug", "left").withColumn("_city", F.when(F.col("_lat").isNotNull(), F.col("_near")).otherwise(F.col("_named"))).where("_city is not null")
    start, end = _text("$.dates.start.localDate"), _text("$.dates.end.localDate")
    images = F.transform(F.try_variant_get("v", "$.images", "array<variant>"), lambda i: F.struct(F.try_variant_get(i, "$.width", "double").alias("width"), _some(F.try_variant_get(i, "$.url", "string")).alias("url")))
    price = [F.try_variant_get("v", f"$.priceRanges[0].{x}", "double") for x in ("min", "max")]
    segments = F.create_map(*(F.lit(x) for pair in SEGMENTS.items() for x in pair))
    name, line = _text(f"{venue}.name"), _text(f"{venue}.address.line1")
    out = _sightings(
        rows, source, title=_text("$.name"), startDate=start, endDate=_later(start, end), time=F.left(_text("$.dates.start.localTime"), F.lit(5)), url=_text("$.url"), venue=name,
        city=F.col("_city"), lat=F.col("_lat"), lng=F.col("_lng"), address=F.when(name.isNotNull() & F.col("_town").isNotNull(), F.concat_ws(", ", name, line, F.col("_town"))),
        categoryHint=F.element_at(segments, F.coalesce(_text("$.classifications[0].segment.name"), F.lit(""))), image=widest(F.filter(images, lambda i: i["url"].isNotNull())),
        priceInfo=price_range(price[0], price[1], _text("$.priceRanges[0].currency")),
    )
    return out.drop("_id", "_lat", "_lng", "_town", "_slug", "_near", "_named", "_city")


def channel_posts(pages: DataFrame, now_seconds: int, most_days: int = 180) -> DataFrame:
    """``channel, message_id, date, text`` of the posts with text on channel pages (``channel, html``) that are young enough."""
    rows = _cards(pages, "div", "tgme_widget_message")
    text = _some(strip_tags(F.regexp_replace(F.coalesce(_inside("div", "tgme_widget_message_text"), F.lit("")), "(?i)<br[^>]*>", " ")))
    at = F.try_to_timestamp(F.regexp_extract("card", r"(?is)<time\s[^>]*datetime=[\"']([^\"']+)", 1))
    posts = rows.select("channel", post_id(_own_attribute("data-post")).alias("message_id"), F.coalesce(F.unix_timestamp(at), F.lit(0)).alias("date"), text.alias("text"))
    return posts.where((F.col("date") >= now_seconds - most_days * 86400) & F.col("message_id").isNotNull() & F.col("text").isNotNull())


def outcome(source: str, sightings: DataFrame | None) -> dict:
    """What a collector gives: its source, its sightings and whether it failed (none came back)."""
    return {"source": source, "sightings": sightings, "failed": sightings is None}
