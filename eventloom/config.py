"""Query strings, templates and settings: plain Python on the driver."""

from __future__ import annotations

import re
from urllib.parse import parse_qs

from eventloom.schema import CATEGORIES

LANGS = ("en", "it", "ru")


def filter_from_query(query: str) -> dict:
    """``cat=music,bogus&free=1`` as arguments of a feed; unknown words are ignored."""
    given = parse_qs(query)
    wanted = [c for c in (x.strip() for x in given.get("cat", [""])[0].split(",")) if c in CATEGORIES]
    out: dict = {"categories": wanted} if wanted else {}
    return out | ({"free_only": True} if given.get("free", [""])[0] == "1" else {})


def lang_from_query(query: str) -> str:
    lang = parse_qs(query).get("lang", ["en"])[0]
    return lang if lang in LANGS else "en"


def language(choice: str, hint: str | None) -> str:
    """An explicit choice beats the client's hint."""
    if choice != "auto":
        return choice
    return next((x for x in ("ru", "it") if (hint or "").startswith(x)), "en")


def fill(template: str, values: dict) -> str:
    """``{name}`` by its value; names without one stay."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), template)


def pages(text: str | None) -> int:
    """A number of pages from 1 to 10, else 3."""
    return min(10, max(1, int(text))) if text and re.fullmatch(r"\d+", text) else 3


def names(text: str | None) -> list[str]:
    return [x for x in (y.strip().lstrip("@") for y in (text or "").split(",")) if x]


def is_operator(owner: str, chat: int) -> bool:
    """Whether a chat is the owner's; no one's is where none is named."""
    return owner != "" and str(chat) == owner
