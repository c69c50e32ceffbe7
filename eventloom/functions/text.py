"""Titles, slugs, tokens and text facts as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.binding import let

# Words that make event titles look alike without telling events apart.
TITLE_STOPWORDS = (
    "festival genova teatro mostra estate edizione stagione estiva estivo evento eventi internazionale della dello delle "
    "sagra festa feste musica concerto concerti spettacolo spettacoli gastronomia gastronomici gastronomico degustazione "
    "cinema aperto rassegna appuntamento programma biglietti notte danza porto antico palazzo ducale piazza centro storico"
).split()

# Wording of free admission.
FREE_PATTERN = "(?iu)gratuit|ingresso libero|free entry|free admission|бесплатно"

# Blocks of kana, CJK ideographs, Hangul and compatibility ideographs.
CJK_PATTERN = "[\\u3040-\\u30FF\\u3400-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF]"

# Label patterns, in order of precedence, and the category that each hints at.
CATEGORY_HINTS = (
    ("MOSTR", "art"),
    ("MUSICA", "music"),
    ("CONCERT", "music"),
    ("TEATR|SPETTACOL", "theatre"),
    ("BAMBIN|FAMIGLI", "family"),
    ("SPORT", "sport"),
    ("SAGR|GASTRONOM|FOOD", "food"),
    ("FIER|MERCAT", "market"),
    ("LABORATOR|WORKSHOP|CORS", "workshop"),
    ("TOUR|VISIT|PASSEGGIAT", "culture"),
    ("CULTURA|LIBR|INCONTRI|RASSEGN|CONGRESS", "culture"),
)

# The named character references that listings use.
ENTITIES = {
    "amp": "&", "quot": '"', "lt": "<", "gt": ">", "nbsp": " ",
    "agrave": "à", "egrave": "è", "igrave": "ì", "ograve": "ò", "ugrave": "ù",
    "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú",
    "Agrave": "À", "Egrave": "È", "Igrave": "Ì", "Ograve": "Ò", "Ugrave": "Ù",
    "ccedil": "ç", "Ccedil": "Ç",
    "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "sbquo": "‚", "bdquo": "„",
    "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»",
    "deg": "°", "euro": "€", "apos": "'", "middot": "·",
}


@lru_cache(maxsize=1)
def _latin_bases() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    letters, bases = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii():
            letters.append(chr(code))
            bases.append(base)
    return "".join(letters), "".join(bases)


def strip_accents(text: Column) -> Column:
    """Base letters of accented Latin ones, without leaving the JVM; combining marks go."""
    letters, bases = _latin_bases()
    return F.regexp_replace(F.translate(text, letters, bases), "[\\u0300-\\u036F]", "")


def normalize_title(title: Column, any_script: bool = False) -> Column:
    """Lower case, no accents, words joined by one space.  Only a-z and 0-9 stay, or letters of ``any_script``."""
    kept = r"[^\p{L}\p{N}]+" if any_script else "[^a-z0-9]+"
    return F.trim(F.regexp_replace(strip_accents(F.lower(title)), kept, " "))


def slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip_accents(name)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def significant_tokens(title: Column, least: int = 5, stopwords=TITLE_STOPWORDS) -> Column:
    """Distinct words of a title that say which event it is."""
    words = F.array_distinct(F.split(normalize_title(title), " "))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stopwords) & ~w.rlike("^[0-9]+$"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def contained(a: Column, b: Column) -> Column:
    """The smaller of two sets isn't empty and lies in the larger."""
    small = F.least(F.size(a), F.size(b))
    return (small > 0) & (F.size(F.array_intersect(a, b)) == small)


def free_from_price(price: Column) -> Column:
    return F.coalesce(price.rlike(FREE_PATTERN), F.lit(False))


def has_cjk(*texts: Column) -> Column:
    out = F.lit(False)
    for text in texts:
        out = out | F.coalesce(text.rlike(CJK_PATTERN), F.lit(False))
    return out


def detect_language(text: Column) -> Column:
    return F.when(text.rlike("[\\u0400-\\u04FF]"), "ru").otherwise("en")


def category_hint(labels: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, category in reversed(CATEGORY_HINTS):
        out = F.when(labels.rlike(f"(?i){pattern}"), category).otherwise(out)
    return out


def strip_tags(html: Column) -> Column:
    """Visible text: no scripts, styles or tags, character references read, runs of white space as one space."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " ")
    return decode_entities(bare)


def first_image(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, "<img[^>]+src=[\"'](https?://[^\"']+)", 1), F.lit(""))


def time_fact(text: Column) -> Column:
    """``HH:MM`` of the first ``ore 9.30`` or ``h 21:00``."""
    hours = F.regexp_extract(text, r"(?i)\b(?:ore|h)\.?\s*([0-9]{1,2})[:.]([0-9]{2})", 1)
    minutes = F.regexp_extract(text, r"(?i)\b(?:ore|h)\.?\s*([0-9]{1,2})[:.]([0-9]{2})", 2)
    return F.when(hours != "", F.concat(F.lpad(hours, 2, "0"), F.lit(":"), minutes))


def price_fact(text: Column) -> Column:
    """The first amount in euros, as written."""
    found = F.regexp_extract(text, r"(?i)((?:€|euro)\s*[0-9]+(?:[.,][0-9]{2})?|[0-9]+(?:[.,][0-9]{2})?\s*(?:€|euro))", 1)
    return F.nullif(found, F.lit(""))


def localized(texts: Column, lang: str) -> Column:
    """The text in ``lang`` of a struct of languages, else the English one, else empty."""
    missing = F.lit("")
    return F.coalesce(F.nullif(texts[lang], missing), F.nullif(texts["en"], missing), missing)


def tolerant_json(text: Column) -> Column:
    """The JSON object in a model's answer: fences off, outermost braces; a variant, null if it doesn't parse."""
    bare = F.regexp_replace(text, "(?i)```(?:json)?", "")
    return F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))


def decode_entities(text: Column) -> Column:
    """Character references as characters, runs of white space as one space; references to no character go."""

    def numbered(piece: Column, at: Column) -> Column:
        def read(said: Column) -> Column:
            code = F.when(said.startswith("x"), F.conv(F.substr(said, F.lit(2)), 16, 10)).otherwise(said).try_cast("long")
            char = F.when(code.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")
            return F.when(said == "", F.concat(F.lit("&#"), piece)).otherwise(F.concat(char, F.substr(piece, F.length(said) + 2)))

        return F.when(at == 0, piece).otherwise(let(F.regexp_extract(piece, "^(x[0-9a-fA-F]+|[0-9]+);", 1), read))

    def read_all(whole: Column) -> Column:
        out = F.array_join(F.transform(F.split(whole, "&#"), numbered), "")
        # the ampersand comes last: what it makes is no reference
        for name in [*(n for n in ENTITIES if n != "amp"), "amp"]:
            out = F.replace(out, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
        return F.when(whole.contains("&"), out).otherwise(whole)

    return F.trim(F.regexp_replace(let(text, read_all), "[\\s\u00A0]+", " "))


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text
