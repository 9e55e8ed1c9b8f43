"""Web pages to records: what every page has, and films described by JSON-LD."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shorter pages are no pages.
LEAST_CHARS = 500
BLOCKED = "captcha|access denied"
_SCRIPT = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.S | re.I)
_KINDS = {"Movie", "TVSeries"}


def page_metadata(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    valid = (F.length(F.trim(html)) >= LEAST_CHARS) & ~F.lower(html).rlike(BLOCKED)
    return pages.select(
        "page_id",
        F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"),
        F.nullif(F.regexp_extract(html, r'<html[^>]* lang="([^"]*)"', 1), F.lit("")).alias("lang"),
        valid.alias("valid"),
    )


def _objects(value) -> Iterator[dict]:
    if isinstance(value, list):
        for item in value:
            yield from _objects(item)
    elif isinstance(value, dict):
        yield value
        yield from _objects(value.get("@graph"))


def _names(value) -> list[str]:
    found = value if isinstance(value, list) else [value]
    names = [(v.get("name") if isinstance(v, dict) else v) for v in found if v]
    return list(dict.fromkeys(" ".join(unescape(str(n)).split()) for n in names if n))


def _count(value) -> int | None:
    digits = re.sub(r"[,\s]", "", str(value if value is not None else ""))
    return int(digits) if re.fullmatch(r"\d{1,18}", digits) else None


def parse_film(html: str) -> dict | None:
    """The first film of a page's JSON-LD as a flat record; None where there is none."""
    for block in _SCRIPT.findall(html):
        try:
            found = [o for o in _objects(json.loads(block)) if set(_names(o.get("@type"))) & _KINDS]
        except ValueError:
            continue
        if found:
            film = found[0]
            rating = film.get("aggregateRating") or {}
            score = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*", str(rating.get("ratingValue", "")))
            return {
                "title": unescape(str(film.get("name") or "")) or None, "alternate_title": unescape(str(film.get("alternateName") or "")) or None,
                "description": " ".join(unescape(str(film.get("description") or "")).split()) or None, "date_published": film.get("datePublished"),
                "duration": film.get("duration"), "genres": _names(film.get("genre")), "directors": _names(film.get("director")),
                "writers": _names(film.get("creator")), "cast": _names(film.get("actor")),
                "keywords": [k.strip() for k in str(film.get("keywords") or "").split(",") if k.strip()],
                "rating": float(score[1]) if score else None, "rating_count": _count(rating.get("ratingCount")),
            }
    return None


_FILM = (
    "title string, alternate_title string, description string, date_published string, duration string, genres array<string>, "
    "directors array<string>, writers array<string>, cast array<string>, keywords array<string>, rating double, rating_count long"
)


def films(pages: DataFrame) -> DataFrame:
    """(page_id, url, the film's fields, error): pages without a film have an error instead."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse_film(h or "") for h in batch["html"]]
            yield pd.DataFrame({
                "page_id": batch["page_id"], "url": batch["url"], "error": [None if r else "missing_json_ld" for r in rows],
                **{c.split(" ")[0]: [r[c.split(" ")[0]] if r else None for r in rows] for c in _FILM.split(", ")},
            })

    return pages.select("page_id", "url", "html").mapInPandas(parse, f"page_id long, url string, error string, {_FILM}")
