"""Column functions on text: Python's notion of white space, offsets in code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Python's strings that a Unicode \s does not name.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^[\\s{ODD_SPACE}]+|[\\s{ODD_SPACE}]+$", "")


def around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The text from `before` code points ahead of start to `after` past end, clamped."""
    first = F.greatest(start - before, F.lit(0))
    return F.substring(text, first + 1, end + after - first)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def looked_up(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(values), key), F.lit(default))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of needle; of an empty one, one more than the characters."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) == 0, F.length(text) + 1).otherwise((gone / F.length(needle)).cast("int"))


#: Elements of a block.
BLOCK = 256


def bound(x: Column, f) -> Column:
    """f of x, where x is computed once: a lambda's variable is, an expression that is named in one is not."""
    return F.get(F.transform(F.array(x), f), 0)


def blocks(a: Column) -> Column:
    """An array in blocks. A fold copies what it carries at every step, so one that gathers elements is for a block only."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(a, b * BLOCK + 1, BLOCK))


def before(values: Column, zero: Column, add) -> Column:
    """What add gathers of all values ahead of each, one for each block of an array: values has few elements."""
    def step(acc: Column, v: Column) -> Column:
        return F.struct(F.concat(acc["all"], F.array(acc["now"])).alias("all"), add(acc["now"], v).alias("now"))

    return F.aggregate(values, F.struct(F.array().cast("array<int>").alias("all"), zero.alias("now")), step, lambda acc: acc["all"])
