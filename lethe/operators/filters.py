"""Predicates over hits: plausibility, context, protection, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lethe.functions import catalog as C
from lethe.functions.text import around, contains_any, strip


def plausible(text: Column) -> Column:
    """Three characters or more without the space around them, one of them a letter or digit."""
    s = strip(text)
    return (F.length(s) >= 3) & F.regexp_like(s, F.lit(r"[\p{L}\p{N}]"))


def out_of_scope_country(text: Column, kind: Column, start: Column, page: Column) -> Column:
    before = F.lower(around(page, start, start, 60, 0))
    return (kind == "LOCATION") & F.lower(strip(text)).isin(*C.COUNTRIES) & contains_any(before, C.SCOPE_WORDS)


def legend_entry(text: Column, start: Column, end: Column, page: Column) -> Column:
    return F.regexp_like(strip(text), F.lit(r"^[A-Z]{2,4}$")) & contains_any(F.lower(around(page, start, end, 60, 60)), C.LEGEND_WORDS)


def region_code(text: Column, start: Column, end: Column, page: Column) -> Column:
    return F.regexp_like(strip(text), F.lit(r"(?U)^[A-Z]{1,2}\s?\d{1,2}$")) & contains_any(F.lower(around(page, start, end, 40, 40)), C.REGION_WORDS)


def contextual_false_positive(text: Column, kind: Column, start: Column, end: Column, page: Column) -> Column:
    return out_of_scope_country(text, kind, start, page) | legend_entry(text, start, end, page) | region_code(text, start, end, page)


def generic_street(text: Column) -> Column:
    """A street's name without a house number: a public place."""
    low = F.lower(strip(text))
    named = reduce(lambda a, b: a | b, [low.endswith(w) | low.startswith(w) for w in C.STREET_WORDS])
    return named & ~F.regexp_like(text, F.lit(r"(?U)\d"))


def protected(source: Column, kind: Column, score: Column) -> Column:
    """Never put to a model's verdict."""
    return (F.lower(source) == "regex") | kind.isin(*C.ALWAYS_PROTECTED) | ((kind == "PERSON") & (score >= 0.85))


def band(score: Column) -> Column:
    return F.when(score >= 0.90, "High").when(score >= 0.70, "Medium").otherwise("Low")


def badge(analysis: Column) -> Column:
    low = F.lower(analysis)
    return F.when(low.contains("review"), "review").when(low.contains("verified"), "verified").otherwise("raw")


def passphrase_state(p: Column) -> Column:
    return F.when(F.length(p) == 0, "empty").when(F.length(strip(p)) < 8, "too short").when(strip(p) != p, "edge spaces").otherwise("ok")


def without_paths(message: Column) -> Column:
    """Messages that leave the system name no folders."""
    return F.regexp_replace(message, r"(?U)(/[^\s:]+/|[A-Z]:\\[^\s:]+\\)", "<path>/")


def without_tags(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(C.CONTENT_TAGS[0]), F.lit("")), F.lit(C.CONTENT_TAGS[1]), F.lit(""))
