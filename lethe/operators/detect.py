"""Detection: a page row in, its entities out, without a shuffle.

Patterns, model hits, resolution, filters and confidence are one projection over the row's array of hits; the
filters come after the resolution, so a winner that they drop does not bring back a hit it beat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions import catalog as C
from lethe.operators.filters import contextual_false_positive, plausible
from lethe.operators.resolve import merged, ner_priority
from lethe.operators.score import confidence
from lethe.operators.spans import HIT, with_regex_hits

NER_HIT = "array<struct<text:string,start:int,end:int,type:string,score:double>>"
#: Model hits follow the patterns' in the stable order.
NER_SEQ, LLM_SEQ = 1000, 2000


def model_hits(ner: Column, source: str = "ner", rank: int = 1, seq: int = NER_SEQ) -> Column:
    """Hits of a model, array<struct<text, start, end, type, score>>, with the default priority of their type."""

    def hit(x: Column, i: Column) -> Column:
        p = ner_priority(x["type"])
        cols = (-p, F.lit(rank), x["start"], (i + seq).cast("int"), x["end"], x["text"], x["type"], p, F.lit(source), x["score"])
        names = ("neg", "rank", "start", "seq", "end", "text", "type", "priority", "source", "score")
        return F.struct(*(c.alias(n) for c, n in zip(cols, names, strict=True)))

    return F.coalesce(F.transform(ner, hit), F.array()).cast(f"array<{HIT}>")


def with_hits(pages: DataFrame) -> DataFrame:
    """Adds hits: all pattern hits of a page, then those of a column `ner`, if there is one."""
    found = with_regex_hits(pages.withColumn("text", F.coalesce("text", F.lit(""))))
    return found.withColumn("hits", F.concat("hits", model_hits(F.col("ner")))) if "ner" in pages.columns else found


def kept_hits(hits: Column, page: Column) -> Column:
    """The hits of a page that stay: resolved, then without those that context or form rules out."""
    ok = lambda h: ~contextual_false_positive(h["text"], h["type"], h["start"], h["end"], page) & plausible(h["text"])
    return F.filter(merged(hits), ok)


def entities(pages: DataFrame) -> DataFrame:
    """A row per entity: doc_id, page_num, entity_type, text, start, end, score, source, analysis."""
    # an outer explode has no filter inferred below it, which would compute the hits and their guards again
    rows = with_hits(pages).select("doc_id", "page_num", F.col("text").alias("page"), F.explode_outer(merged(F.col("hits"))).alias("h"))
    h = {n: F.col(f"h.{n}") for n in ("text", "type", "start", "end", "source", "score")}
    rows = rows.filter(~contextual_false_positive(h["text"], h["type"], h["start"], h["end"], F.col("page")) & plausible(h["text"]))
    score = confidence(h["text"], h["type"], h["source"], h["score"], h["start"], h["end"], F.col("page"))
    return rows.select(
        "doc_id", "page_num", h["type"].alias("entity_type"), h["text"].alias("text"), h["start"].alias("start"), h["end"].alias("end"),
        score.alias("score"), h["source"].alias("source"), F.concat_ws(" | ", h["source"], h["type"]).alias("analysis"),
    )


def token_windows(text: Column, size: int = C.WINDOW_TOKENS, overlap: int = C.OVERLAP_TOKENS) -> Column:
    """array<struct<token_start, char_start, char_end, text>>: windows of white-space tokens, `overlap` shared.

    Tokens are runs of visible characters; a model's own tokenizer takes their place in a provider.
    """
    scan = F.translate(text, "\u0001\u0002", "\u0003\u0003")
    parts = F.split(F.regexp_replace(scan, r"(?U)(\S+)", "\u0001$1\u0002"), "\u0001", -1)
    step = max(1, size - overlap)
    none = F.array().cast("array<int>")

    def fold(acc: Column, part: Column) -> Column:
        """Only the offsets where windows begin and end are kept, so a long text costs its length."""
        i, at = acc["i"], acc["at"]
        end = at + F.length(F.substring_index(part, "\u0002", 1))
        starts = F.when(i % step == 0, F.concat(acc["starts"], F.array(at))).otherwise(acc["starts"])
        ends = F.when((i >= size - 1) & ((i - (size - 1)) % step == 0), F.concat(acc["ends"], F.array(end))).otherwise(acc["ends"])
        return F.struct((i + 1).alias("i"), (at + F.length(part) - 1).alias("at"), end.alias("last"), starts.alias("starts"), ends.alias("ends"))

    def windows(acc: Column) -> Column:
        n = F.when(acc["i"] == 0, 0).when(acc["i"] <= size, 1).otherwise(F.ceil((acc["i"] - size) / step).cast("int") + 1)

        def window(s: Column, i: Column) -> Column:
            e = F.coalesce(F.get(acc["ends"], i), acc["last"])
            return F.struct((i * step).cast("int").alias("token_start"), s.alias("char_start"), e.alias("char_end"), F.substring(text, s + 1, e - s).alias("text"))

        return F.transform(F.slice(acc["starts"], F.lit(1), n), window)

    first = F.struct(F.lit(0).alias("i"), F.length(F.element_at(parts, 1)).alias("at"), F.lit(0).alias("last"), none.alias("starts"), none.alias("ends"))
    return F.aggregate(F.slice(parts, 2, F.size(parts)), first, fold, windows)


def model_label(label: Column) -> Column:
    """A tagger's label without B- or I-, in this engine's terms; unknown ones pass."""
    bare = F.regexp_replace(label, "^[BI]-", "")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in C.NER_LABELS.items() for x in kv)), bare), bare)
