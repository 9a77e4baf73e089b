"""Confidence of a hit. Rounding is half up, as Spark's round; a binary half may differ by 0.01 elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lethe.functions import catalog as C
from lethe.functions.text import around, contains_any, looked_up, occurrences, strip


def words(text: Column) -> Column:
    s = strip(text)
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(F.size(F.split(s, r"(?U)\s+")))


def repetitions(text: Column, page: Column) -> Column:
    return occurrences(F.lower(page), F.lower(strip(text)))


def confidence(text: Column, kind: Column, source: Column, score: Column, start: Column, end: Column, page: Column) -> Column:
    """1 for pattern hits; else the type's floor, raised by length, context and repetition."""
    add = lambda c, cond, x: F.when(cond, F.least(c + x, F.lit(1.0))).otherwise(c)
    s = F.greatest(F.coalesce(score, F.lit(0.5)), looked_up(C.TYPE_FLOORS, kind, C.TYPE_FLOOR))
    n = words(text)
    s = F.when(n >= 3, F.least(s + 0.15, F.lit(1.0))).when(n == 2, F.least(s + 0.10, F.lit(1.0))).otherwise(s)
    s = add(s, contains_any(F.lower(around(page, start, end, 80, 80)), C.CONFIDENCE_WORDS), 0.10)
    s = add(s, repetitions(text, page) >= 3, 0.10)
    return F.when(source == "regex", F.lit(1.0)).otherwise(F.round(s, 2))
