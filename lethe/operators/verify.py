"""A language model's verdicts: prompt parts, parsing, rules and additions. The model itself is a provider.

Verdicts are advisory: they change an entity's analysis, never its score or approval. Additions carry an offset
in their page (not in the combined text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions import catalog as C
from lethe.functions.text import strip
from lethe.operators.filters import generic_street, without_tags
from lethe.operators.resolve import merged
from lethe.operators.spans import HIT

LINES = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def doc_type(raw: Column) -> Column:
    low = F.lower(raw)
    return F.coalesce(*(F.when(low.contains(t), F.lit(t)) for t in C.DOC_TYPES), F.lit("general"))


def classify_text(pages: DataFrame) -> DataFrame:
    """doc_id, text: what a classifier reads; the second page helps where the first holds little."""
    w = Window.partitionBy("doc_id").orderBy("page_num")
    x = pages.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy("doc_id").agg(F.max(F.when(F.col("k") == 1, F.coalesce("text", F.lit("")))).alias("a"), F.max(F.when(F.col("k") == 2, F.coalesce("text", F.lit("")))).alias("b"))
    a = F.substring("a", 1, C.CLASSIFY_CHARS)
    both = F.substring(F.concat(a, F.lit("\n"), F.col("b")), 1, C.CLASSIFY_CHARS)
    return x.select("doc_id", without_tags(F.when((F.length(strip(a)) < 100) & F.col("b").isNotNull(), both).otherwise(a)).alias("text"))


def combined_text(pages: DataFrame, most: int = C.BATCH_CHARS) -> DataFrame:
    """doc_id, combined: pages in order up to `most` characters, each under its header."""
    w = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    x = pages.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).filter(F.col("before") < most)
    part = F.concat(F.lit("--- Page "), (F.col("page_num") + 1).cast("string"), F.lit(" ---\n"), F.substring(F.col("text"), F.lit(1), (F.lit(most) - F.col("before")).cast("int")))
    per = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_num"), part.alias("part")))).alias("p"))
    return per.select("doc_id", without_tags(F.array_join(F.transform("p", lambda p: p["part"]), "\n\n")).alias("combined"))


def entity_lines(ents: DataFrame) -> DataFrame:
    """doc_id, lines: the entities that a model is asked about, pages counted from one."""
    line = F.format_string('- [p%d] [%s] "%s"', F.col("page_num") + 1, F.col("entity_type"), F.col("text"))
    per = ents.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_num"), F.col("start"), line.alias("line")))).alias("l"))
    return per.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))


def _lines(answers: DataFrame) -> DataFrame:
    rows = answers.select("doc_id", F.posexplode(F.split("raw", LINES)).alias("ord", "line"))
    return rows.withColumn("line", strip(F.col("line"))).filter("line <> ''")


def _part(limit: int, i: int) -> Column:
    return strip(F.get(F.split("line", "-", limit), i))


def verdicts(answers: DataFrame) -> DataFrame:
    """doc_id, key, verdict, reason from lines of answers (doc_id, raw); of one key the last line counts."""
    up = F.upper(F.col("line"))
    confirmed, disputed = up.startswith("CONFIRMED"), ~up.startswith("CONFIRMED") & up.startswith("FALSE_POSITIVE")
    x = _lines(answers).select(
        "doc_id", "ord", F.when(confirmed, "confirmed").when(disputed, "false_positive").alias("verdict"),
        F.lower(F.when(confirmed, _part(2, 1)).otherwise(_part(3, 1))).alias("key"), F.when(disputed, _part(3, 2)).alias("reason"),
    )
    x = x.filter("verdict IS NOT NULL AND key <> ''")
    return x.groupBy("doc_id", "key").agg(F.max_by(F.struct("verdict", "reason"), "ord").alias("v")).select("doc_id", "key", "v.verdict", "v.reason")


def new_entities(answers: DataFrame) -> DataFrame:
    """doc_id, ord, entity_type, text from lines NEW - type - text."""
    x = _lines(answers).filter(F.upper("line").startswith("NEW") & (F.size(F.split("line", "-", 3)) == 3))
    return x.select("doc_id", "ord", F.upper(_part(3, 1)).alias("entity_type"), _part(3, 2).alias("text")).filter(F.length("text") >= 2)


def whole_json(raw: Column, pattern: str) -> Column:
    """What the pattern finds, if it is JSON from end to end."""
    found = F.regexp_extract(raw, pattern, 0)
    return F.when((found != "") & (F.json_array_length(F.concat(F.lit("["), found, F.lit("]"))) == 1), found)


VERIFY_JSON = "verified array<struct<text:string,verdict:string,reason:string>>, additional array<struct<text:string,type:string,start:int>>"


def json_answer(raw: Column) -> Column:
    """The object between the first and last brace; empty lists where it is missing or broken."""
    found = F.from_json(whole_json(raw, r"(?s)\{.*\}"), VERIFY_JSON)
    return F.struct(F.coalesce(found["verified"], F.array().cast("array<struct<text:string,verdict:string,reason:string>>")).alias("verified"), F.coalesce(found["additional"], F.array().cast("array<struct<text:string,type:string,start:int>>")).alias("additional"))


DETECTED = "array<struct<text:string,type:string>>"


def json_detected(raw: Column) -> Column:
    """Entities of an object, else of a bare array."""
    obj = F.from_json(whole_json(raw, r"(?s)\{.*\}"), f"entities {DETECTED}")["entities"]
    arr = F.from_json(whole_json(raw, r"(?s)\[.*\]"), DETECTED)
    return F.coalesce(F.filter(F.coalesce(obj, arr), lambda e: e.isNotNull()), F.array().cast(DETECTED))


def verdict_status(verdict: Column, reason: Column, kind: Column, source: Column) -> Column:
    """A dispute counts only with a reason, and never against a pattern or a protected type."""
    stands = (F.upper(verdict) == "FALSE_POSITIVE") & ~kind.isin(*C.NEVER_DISPUTED) & (F.lower(source) != "regex") & (F.length(strip(F.coalesce(reason, F.lit("")))) > 0)
    return F.when(stands, "false_positive").otherwise("confirmed")


def verified(ents: DataFrame, said: DataFrame) -> DataFrame:
    """ents with the analysis that verdicts (doc_id, key, verdict, reason) give; entities not named are confirmed."""
    x = ents.withColumn("key", F.lower(strip(F.col("text")))).join(said, ["doc_id", "key"], "left")
    status = verdict_status(F.coalesce("verdict", F.lit("confirmed")), F.col("reason"), F.col("entity_type"), F.col("source"))
    return x.withColumn("analysis", F.when(status == "false_positive", F.concat(F.lit("review: "), F.col("reason"))).otherwise("LLM verified")).select(*ents.columns)


def nearest(text: Column, needle: Column, reported: Column) -> Column:
    """Start of the occurrence nearest to reported, the first of equally near ones; -1 without any. Overlapping
    occurrences count."""
    places = F.sequence(F.lit(0), F.greatest(F.length(text) - F.length(needle), F.lit(0)))
    found = F.filter(places, lambda i: F.substring(text, i + 1, F.length(needle)) == needle)
    best = F.array_min(F.transform(found, lambda i: F.struct(F.abs(i - reported).alias("d"), i.alias("i"))))["i"]
    return F.when(text.contains(needle), F.coalesce(best, F.lit(-1))).otherwise(F.lit(-1))


def additions(new: DataFrame, pages: DataFrame, ents: DataFrame) -> DataFrame:
    """Entities that only the model named: they occur in the document, are not yet known by their text, and are
    no street without a number. The first page that holds the text is theirs."""
    key = F.lower(strip(F.col("text")))
    w = Window.partitionBy("doc_id", "key").orderBy("ord")
    x = new.withColumn("key", key).withColumn("k", F.row_number().over(w)).filter("k = 1")
    x = x.join(ents.select("doc_id", key.alias("key")).distinct(), ["doc_id", "key"], "left_anti")
    x = x.filter(~(F.col("entity_type").isin("LOCATION", "ADDRESS") & generic_street(F.col("text"))))
    p = pages.select("doc_id", "page_num", F.col("text").alias("page"))
    held = x.join(p, "doc_id").filter(F.col("page").contains(F.col("text")))
    held = held.groupBy("doc_id", "key").agg(F.min(F.struct("page_num", F.col("entity_type"), F.col("text"), F.expr("locate(text, page) - 1").alias("start"))).alias("h"))
    return held.select("doc_id", "h.page_num", "h.entity_type", "h.text", "h.start", (F.col("h.start") + F.length("h.text")).alias("end"), F.lit(0.3).alias("score"), F.lit("LLM").alias("source"), F.lit("Found by LLM only").alias("analysis"))


def page_additions(answers: DataFrame, pages: DataFrame, ents: DataFrame, most: int = C.PAGE_CHARS) -> DataFrame:
    """Entities that a model named in JSON for one page: doc_id, page_num, raw.

    Each is placed at the occurrence nearest to where the model said, within the part of the page that it read.
    They meet the page's own entities in the resolution with the lowest priority, and stay if their text and their
    start are among the survivors'.
    """
    on = ["doc_id", "page_num"]
    read = pages.select(*on, without_tags(F.substring("text", 1, most)).alias("page"))
    named = answers.select(*on, F.posexplode(json_answer(F.col("raw"))["additional"]).alias("ord", "x")).join(read, on)
    kind, text = F.coalesce("x.type", F.lit("UNKNOWN")), F.coalesce("x.text", F.lit(""))
    named = named.select(*on, "ord", kind.alias("entity_type"), text.alias("text"), F.when(F.length(text) > 0, nearest(F.col("page"), text, F.coalesce("x.start", F.lit(0)))).otherwise(-1).alias("start"))
    named = named.filter((F.col("start") >= 0) & ~(F.col("entity_type").isin("LOCATION", "ADDRESS") & generic_street(F.col("text"))))
    named = named.withColumn("end", F.col("start") + F.length("text"))

    def hit(priority: Column, rank: Column, seq: Column, source: str) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(-priority, rank, F.col("start"), seq, F.col("end"), F.col("text"), F.col("entity_type"), priority, F.lit(source), none).cast(HIT).alias("h")

    sure = F.floor(F.round(F.col("score") * 10, 6)).cast("int")
    own = ents.select(*on, hit(sure, F.when(F.lower("source") == "regex", 0).otherwise(1), F.col("start"), "own"))
    both = own.union(named.select(*on, hit(F.lit(3), F.lit(2), F.lit(1 << 20) + F.col("ord"), "llm")))
    left = both.groupBy(*on).agg(F.collect_list("h").alias("l")).select(*on, F.filter(merged(F.col("l")), lambda h: h["source"] == "llm").alias("l"))
    left = left.select(*on, F.transform("l", lambda h: F.lower(strip(h["text"]))).alias("keys"), F.transform("l", lambda h: h["start"]).alias("starts"))
    kept = named.join(left, on).filter(F.array_contains("keys", F.lower(strip(F.col("text")))) & F.array_contains("starts", F.col("start")))
    return kept.select(*on, "entity_type", "text", "start", "end", F.lit(0.3).alias("score"), F.lit("LLM").alias("source"), F.lit("Found by LLM only").alias("analysis"))
