"""Models' answers, checked: enrichments, events found in posts, verdicts on pairs; and the stored index, read back.

Answers come as a table of texts, one for each batch that was asked; one that doesn't parse answers nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.dates import as_day, is_iso_day
from eventloom.functions.text import has_cjk, strip_tags, tolerant_json
from eventloom.schema import LINK, parse_categories, parse_texts
from eventloom.sources.feeds import sessions_of

#: Times of day and durations that can be.
_CLOCK = "^([01][0-9]|2[0-3]):[0-5][0-9]$"
SHORTEST, LONGEST = 15, 1440


def _text(path: str, v: str = "v") -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def _texts(path: str, older: Column | None = None, v: str = "v") -> Column:
    return parse_texts(F.struct(*(_text(f"{path}.{lang}", v).alias(lang) for lang in ("en", "it", "ru"))), older if older is not None else F.lit(None).cast("string"))


def _list(path: str, v: str = "v") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _sessions(path: str) -> Column:
    raw = F.transform(_list(path), lambda x: F.struct(*(F.nullif(F.try_variant_get(x, f"$.{f}", "string"), F.lit("")).alias(f) for f in ("date", "time", "title"))))
    found = sessions_of(raw)
    return F.when(F.size(found) > 0, found)


def _items(answers: DataFrame, body: str, name: str) -> DataFrame:
    items = F.try_variant_get(tolerant_json(F.col(body)), f"$.{name}", "array<variant>")
    return answers.select(F.posexplode(F.coalesce(items, F.array().cast("array<variant>"))).alias("at", "v"))


def _categories(v: str = "v") -> Column:
    """Known categories, three at most; null where none is known."""
    many = F.transform(_list("$.categories", v), lambda x: F.try_variant_get(x, "$", "string"))
    known = parse_categories(many, _text("$.category", v))
    said = F.concat(F.coalesce(many, F.array().cast("array<string>")), F.array(_text("$.category", v)))
    return F.when(F.exists(known, lambda c: F.array_contains(said, c)), known)


def enrichments(answers: DataFrame, body: str = "body") -> DataFrame:
    """The enrichments of ``answers``, as ``pipeline.collect`` takes them; ``answers(body)``.

    One without id, description or known category is dropped, as is one with a letter that its languages lack.
    A container needs a programme; times and durations that can't be are left out.  Of several for one id, any alike, the least stays.
    """
    descriptions, titles = _texts("$.descriptions", _text("$.description")), _texts("$.titles")
    rows = _items(answers, body, "events").select(
        _text("$.id").alias("id"), _categories().alias("e_categories"), titles.alias("e_titles"), descriptions.alias("e_descriptions"), _text("$.address").alias("e_address"),
        F.when(_text("$.time").rlike(_CLOCK), _text("$.time")).alias("e_time"), F.try_variant_get("v", "$.durationMin", "double").alias("_minutes"), _sessions("$.sessions").alias("e_sessions"),
        _text("$.kind").alias("_kind"), F.coalesce(F.try_variant_get("v", "$.unusual", "boolean"), F.lit(False)).alias("e_unusual"), F.coalesce(F.try_variant_get("v", "$.blocked", "boolean"), F.lit(False)).alias("e_blocked"),
    )
    rows = rows.where("id is not null and e_categories is not null and e_descriptions is not null")
    wrong = has_cjk(*(F.col(f"e_descriptions.{x}") for x in ("en", "it", "ru")), *(F.col(f"e_titles.{x}") for x in ("en", "it", "ru")))
    rows = rows.where(~wrong)
    rows = rows.withColumn("e_durationMin", F.when(F.col("_minutes").between(SHORTEST, LONGEST), F.floor(F.col("_minutes") + 0.5).cast("int")))
    rows = rows.withColumn("e_kind", F.when((F.col("_kind") == "container") & F.col("e_sessions").isNotNull(), "container"))
    columns = ["id", "e_categories", "e_titles", "e_descriptions", "e_address", "e_time", "e_durationMin", "e_sessions", "e_kind", "e_unusual", "e_blocked"]
    one = rows.groupBy("id").agg(F.min(F.struct(*columns[1:])).alias("x"))
    return one.select("id", *(F.col(f"x.{c}").alias(c) for c in columns[1:]))


def extracted(answers: DataFrame, today, link: str, body: str = "body") -> DataFrame:
    """Sightings that a model found in posts (``channel/number``); ``link`` is what stands before that in a post's address.

    An event needs a title, a day that exists and its post; one that is over, or whose last day is none, is dropped.
    """
    start, end, post = _text("$.startDate"), _text("$.endDate"), _text("$.post")
    channel, number = F.regexp_extract(post, "^([A-Za-z0-9_]+)/[0-9]+$", 1), F.regexp_extract(post, "^[A-Za-z0-9_]+/([0-9]+)$", 1)
    rows = _items(answers, body, "events").where(_text("$.title").isNotNull() & F.coalesce(is_iso_day(start), F.lit(False)) & (number != "") & (end.isNull() | F.coalesce(is_iso_day(end), F.lit(False))))
    rows = rows.where(F.coalesce(end, start).try_cast("date") >= as_day(today))
    return rows.select(
        _text("$.title").alias("title"), start.try_cast("date").alias("startDate"), end.try_cast("date").alias("endDate"),
        *(_text(f"$.{c}").alias(c) for c in ("time", "venue", "address", "priceInfo")), _text("$.description").alias("rawDescription"),
        F.concat(F.lit(link), channel, F.lit("/"), number).alias("url"), F.concat(F.lit("tg:"), channel).alias("source"),
    )


def judged(pairs: DataFrame, answers: DataFrame, body: str = "body") -> DataFrame:
    """The ``pairs(i, ...)`` that an answer calls the same; numbers of no pair, and what doesn't parse, confirm none."""
    said = _items(answers, body, "pairs").select(F.try_variant_get("v", "$.i", "long").alias("i"), F.try_variant_get("v", "$.same", "boolean").alias("same"))
    return pairs.join(said.where("same and i is not null").select("i").distinct(), "i", "left_semi")


def stored_index(text: DataFrame, body: str = "body") -> DataFrame:
    """A stored index as rows; entries without id, title, first day or address are dropped, other bad fields are null."""
    items = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    rows = text.select(F.posexplode(F.coalesce(items, F.array().cast("array<variant>"))).alias("at", "v"))
    flag = lambda path: F.when(F.try_variant_get("v", path, "boolean"), True)
    lat, lng = F.try_variant_get("v", "$.g[0]", "double"), F.try_variant_get("v", "$.g[1]", "double")
    many = F.transform(_list("$.c"), lambda x: F.try_variant_get(x, "$", "string"))
    links = F.transform(_list("$.l"), lambda x: F.struct(*(F.nullif(F.try_variant_get(x, f"$.{f}", "string"), F.lit("")).alias(f) for f in ("source", "url", "image"))))
    links = F.filter(links, lambda x: x["source"].isNotNull() & x["url"].isNotNull()).cast(f"array<{LINK}>")
    out = rows.select(
        _text("$.id").alias("id"), _text("$.t").alias("t"), _texts("$.tl").alias("tl"), _text("$.s").try_cast("date").alias("s"), _text("$.e").try_cast("date").alias("e"),
        parse_categories(many, _text("$.c"), None).alias("c"), flag("$.f").alias("f"), *(_text(f"$.{c}").alias(c) for c in ("v", "a", "ct", "rg", "h", "u", "img")),
        F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng"))).alias("g"), F.try_variant_get("v", "$.du", "int").alias("du"), _sessions("$.p").alias("p"),
        flag("$.k").alias("k"), _texts("$.d", _text("$.d")).alias("d"), F.when(F.size(links) > 0, links).alias("l"), flag("$.x").alias("x"), F.try_variant_get("v", "$.cr", "long").alias("cr"),
    )
    return out.where("id is not null and t is not null and s is not null and u is not null")


def page_image(html: Column) -> Column:
    """The picture that a page names for sharing, however its tag is written."""
    tag = F.regexp_extract(html, r"(?is)(<meta\s[^>]*property=[\"']og:image[\"'][^>]*>)", 1)
    return F.nullif(F.regexp_extract(tag, r"(?is)\scontent=[\"']([^\"']+)", 1), F.lit(""))


def with_link_images(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Records whose alternative links have the pictures of their pages (``url, html``); known ones stay."""
    found = pages.select("url", page_image(F.col("html")).alias("image")).where("image is not null").groupBy("url").agg(F.min("image").alias("_image"))
    links = records.where("altLinks is not null").select("id", F.posexplode("altLinks").alias("at", "link")).withColumn("url", F.col("link.url"))
    filled = links.join(found, "url", "left").select("id", "at", F.struct("link.source", "link.url", F.coalesce("link.image", "_image").alias("image")).alias("link"))
    one = filled.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "link"))).alias("_links"))
    joined = records.join(one, "id", "left")
    links = F.transform("_links", lambda x: x["link"])
    return joined.select(*(F.coalesce(links, F.col("altLinks")).alias(c) if c == "altLinks" else F.col(c) for c in records.columns))


def post_text(channel: Column, number: Column, text: Column) -> Column:
    """A post as a model is shown it."""
    return F.concat(F.lit("["), channel, F.lit("/"), number.cast("string"), F.lit("]\n"), strip_tags(text))
