"""Column types of the corpus tables, and the category taxonomy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categories in order, their labels and signs.
CATEGORIES = "music theatre art food sport family market nightlife culture workshop other".split()
CATEGORY_SIGNS = dict(zip(CATEGORIES, "🎵 🎭 🎨 🍝 ⚽ 👨‍👩‍👧 🛍 🌙 🏛 🛠 ✨".split()))

LINK = "struct<source:string,url:string,image:string>"
SESSION = "struct<date:date,time:string,title:string>"
TEXTS = "struct<en:string,it:string,ru:string>"
SIGHTINGS = (
    "seq long, title string, startDate date, endDate date, time string, venue string, address string, priceInfo string, "
    f"rawDescription string, url string, source string, city string, lat double, lng double, categoryHint string, image string, altLinks array<{LINK}>"
)
RECORDS = (
    f"id string, title string, startDate date, endDate date, kind string, sessions array<{SESSION}>, time string, durationMin int, venue string, "
    f"address string, lat double, lng double, categories array<string>, titles {TEXTS}, descriptions {TEXTS}, image string, altLinks array<{LINK}>, "
    "rawDescription string, priceInfo string, free boolean, unusual boolean, url string, source string, city string, enriched boolean, enrichVersion int, addedAt long"
)


def category_order(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category)


def primary_category(categories: Column) -> Column:
    return F.coalesce(F.get(categories, 0), F.lit("other"))


def venue_of(venue: Column, address: Column) -> Column:
    """The venue, else the address up to its first comma unless that is empty or the home city."""
    head = F.trim(F.split_part(address, F.lit(","), F.lit(1)))
    return F.coalesce(venue, F.when((head != "") & ~head.rlike("(?i)^gen[oa]va$"), head))


def parse_categories(many: Column, single: Column, most: int | None = 3) -> Column:
    """Known categories of the list and the older single field; ``other`` if there are none."""
    known = F.array(*map(F.lit, CATEGORIES))
    found = F.filter(F.concat(F.coalesce(many, F.array().cast("array<string>")), F.array(single)), lambda c: F.coalesce(F.array_contains(known, c), F.lit(False)))
    out = F.when(F.size(found) == 0, F.array(F.lit("other"))).otherwise(found)
    return F.slice(out, 1, most) if most else out


def parse_texts(texts: Column, older: Column) -> Column:
    """Texts in all languages: English, or the older plain string, stands in for the missing; null without either."""
    given = lambda c: F.nullif(c, F.lit(""))
    english = F.coalesce(given(texts["en"]), older)
    return F.when(english.isNotNull(), F.struct(english.alias("en"), F.coalesce(given(texts["it"]), english).alias("it"), F.coalesce(given(texts["ru"]), english).alias("ru")))
