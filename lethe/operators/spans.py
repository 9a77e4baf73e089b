"""Spans with offsets, in the JVM: matches are marked by one replacement, then positions are added up in blocks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions.catalog import LEAST_LENGTH, PATTERNS, STEMS, Pattern
from lethe.functions.text import ODD_SPACE, before, blocks, bound, contains_any, strip

HIT = "struct<neg:int,rank:int,start:int,seq:int,end:int,text:string,type:string,priority:int,source:string,score:double>"
#: The marks and the separators that Unicode \s leaves out become characters of the same length.
_FROM, _TO = "\u0001\u0002" + ODD_SPACE, "\u0003\u0003" + " " * len(ODD_SPACE)


def scannable(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit("[\u0001\u0002\u001c-\u001f]")), F.translate(text, _FROM, _TO)).otherwise(text)


#: What ignoring case takes for an ASCII letter though lower-casing does not make it one.
_FOLDED = ("ſ", "ı", "İ", "\u212a")


def guards(scan: Column) -> dict[str, Column]:
    """Columns that cost one pass each and tell which patterns a text can match: digit, at, hyphen, odd, low."""
    return {
        "digit": F.regexp_like(scan, F.lit(r"(?U)\d")), "at": scan.contains("@"), "hyphen": scan.contains("-"),
        "odd": contains_any(scan, _FOLDED), "low": F.lower(scan),
    }


def possible(pattern: Pattern, g: dict[str, Column]) -> Column:
    """Whether a text can match: every pattern but those of the first two lines needs a digit or a label's word."""
    if pattern.id == "r18_email":
        return g["at"]
    if pattern.id == "r04_ch_access_code":
        return g["hyphen"]
    stems = STEMS.get(pattern.id)
    return g["odd"] | contains_any(g["low"], stems) if stems else g["digit"]


def find(scan: Column, pattern: Pattern, guard: Column | None = None) -> Column:
    """array<struct<start, end, tok>> of a pattern's matches in a scannable text."""
    kind = "struct<start:int,end:int,tok:string>"
    none = F.array().cast(f"array<{kind}>")
    cut = F.split(F.regexp_replace(scan, pattern.java, "$1\u0001$2\u0002"), "\u0001", -1)

    def local(parts: Column) -> Column:
        """spans of a block, counted from the first match of the block, and the block's length."""
        def step(acc: Column, part: Column) -> Column:
            tok = F.substring_index(part, "\u0002", 1)
            span = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(tok)).alias("end"), tok.alias("tok"))
            return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def placed(ahead: Column, done: Column) -> Column:
        starts = before(F.transform(done, lambda b: b["at"]), ahead, lambda x, y: x + y)
        move = lambda at: lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["tok"].alias("tok"))
        return bound(starts, lambda at: F.flatten(F.transform(done, lambda b, i: F.transform(b["spans"], move(F.get(at, i))))))

    rest = lambda parts: F.transform(blocks(F.slice(parts, F.lit(2), F.size(parts))), local)
    found = bound(cut, lambda parts: bound(rest(parts), lambda done: placed(F.length(F.get(parts, 0)), done)))
    can = possible(pattern, guards(scan)) if guard is None else guard
    return F.when(can, F.when(F.regexp_like(scan, F.lit(pattern.java)), found).otherwise(none)).otherwise(none)


def luhn_ok(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def hits_of(text: Column, scan: Column, pattern: Pattern, seq: int, guard: Column | None = None) -> Column:
    """array<HIT> of one pattern: values of label tiers are stripped, their offsets are not."""

    def hit(x: Column) -> Column:
        # a substring is counted from the page's beginning: only where the match may differ from the text
        odd = x["tok"].contains("\u0003") | x["tok"].contains(" ")
        raw = F.when(odd, F.substring(text, x["start"] + 1, x["end"] - x["start"])).otherwise(x["tok"])
        value = raw if pattern.tier == "core" else strip(raw)
        cols = (F.lit(-pattern.priority), F.lit(0), x["start"], F.lit(seq), x["end"], value, F.lit(pattern.type), F.lit(pattern.priority), F.lit("regex"), F.lit(None).cast("double"))
        names = ("neg", "rank", "start", "seq", "end", "text", "type", "priority", "source", "score")
        return F.struct(*(c.alias(n) for c, n in zip(cols, names, strict=True)))

    hits = F.transform(find(scan, pattern, guard), hit)
    if least := LEAST_LENGTH[pattern.tier]:
        hits = F.filter(hits, lambda h: F.length(h["text"]) >= least)
    return F.filter(hits, lambda h: luhn_ok(h["text"])) if pattern.type == "CREDIT_CARD" else hits


GUARDS = ("digit", "at", "hyphen", "odd", "low")


@functools.lru_cache(maxsize=4)
def _regex_hits(app: str) -> Column:
    g = {n: F.col(f"_{n}") for n in GUARDS}
    return F.concat(*(hits_of(F.col("text"), F.col("_scan"), p, i, possible(p, g)) for i, p in enumerate(PATTERNS)))


def with_regex_hits(pages: DataFrame) -> DataFrame:
    """Adds hits: those of all patterns in `text`, in registry order. Guards are columns of their own, so that
    they are computed once; the expression is built once a session."""
    x = pages.withColumn("_scan", scannable(F.col("text")))
    x = x.withColumns({f"_{n}": c for n, c in guards(F.col("_scan")).items()})
    return x.withColumn("hits", _regex_hits(pages.sparkSession.sparkContext.applicationId)).drop("_scan", *(f"_{n}" for n in GUARDS))
