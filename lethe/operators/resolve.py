"""Resolution of overlapping and repeated hits, as folds over a page's sorted array: no shuffle.

Acceptance depends on what was accepted before, so these are folds, not windows. Hits are first parted into clusters
that overlap, so each is held against the few of its cluster; equal texts are found by sorting. Hits of overlapping
model windows (chunks_merged) are compared with all kept of their page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions.catalog import NER_PRIORITIES, NER_PRIORITY
from lethe.functions.text import before, blocks, bound, looked_up, strip
from lethe.operators.spans import HIT


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def key(text: Column) -> Column:
    return F.lower(strip(text))


def ner_priority(kind: Column) -> Column:
    return looked_up(NER_PRIORITIES, kind, NER_PRIORITY)


def accepted(hits: Column, clashes, kind: str = HIT) -> Column:
    """The hits, in order, that clash with none accepted before."""
    return F.aggregate(hits, F.array().cast(f"array<{kind}>"), lambda acc, x: F.when(F.exists(acc, lambda y: clashes(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def by_start(hits: Column) -> Column:
    """Stable by start: the order of equal starts is kept."""
    indexed = F.transform(hits, lambda x, i: F.struct(x["start"].alias("at"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(indexed), lambda e: e["x"])


def spans_merged(hits: Column) -> Column:
    """Higher priority first, then regex, ner, llm, then the earlier start; overlapping hits lose.

    Only hits of one cluster can overlap: in the order of starts, a cluster ends where a hit begins at or after all ends.
    """
    best = lambda some: F.when(F.size(some) < 2, some).otherwise(accepted(F.array_sort(some), overlap))

    def firsts(ends: Column, by: Column) -> Column:
        """The places where a cluster begins: the start is at or after the ends of all blocks before and of the block so far."""
        tops = before(F.transform(ends, lambda e: F.array_max(e)), F.lit(0), lambda x, y: F.greatest(x, y))
        within = lambda e, k: F.when(k == 0, 0).otherwise(F.array_max(F.slice(e, F.lit(1), F.greatest(k, F.lit(1)))))
        last = lambda top, e: F.transform(e, lambda x, k: F.greatest(F.get(top[0], top[1]), within(e, k)))
        lasts = bound(tops, lambda top: F.flatten(F.transform(ends, lambda e, i: last((top, i), e))))
        return bound(lasts, lambda m: F.filter(F.sequence(F.lit(0), F.size(by) - 1), lambda i: (i == 0) | (F.get(by, i)["start"] >= F.get(m, i))))

    def clusters(by: Column) -> Column:
        at = bound(F.transform(blocks(by), lambda b: F.transform(b, lambda x: x["end"])), lambda ends: firsts(ends, by))
        until = lambda at, i: F.coalesce(F.get(at, i + 1), F.size(by))
        return bound(at, lambda at: F.transform(at, lambda s, i: F.slice(by, s + 1, until(at, i) - s)))

    some = bound(by_start(hits), lambda by: F.flatten(F.transform(clusters(by), best)))
    return F.when(F.size(hits) < 2, hits).otherwise(F.array_sort(some))


def texts_merged(hits: Column) -> Column:
    """Of equal texts (lower case, stripped) the first stays; ordered by start."""
    keyed = F.array_sort(F.transform(hits, lambda x, i: F.struct(key(x["text"]).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = lambda a: F.filter(a, lambda e, i: (i == 0) | (F.get(a, i - 1)["k"] != e["k"]))
    # the sorted array is bound to a name: an expression would be sorted again for each element
    kept = bound(keyed, firsts)
    order = F.array_sort(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.when(F.size(hits) < 2, hits).otherwise(by_start(F.transform(order, lambda e: e["x"])))


def merged(hits: Column) -> Column:
    return texts_merged(spans_merged(hits))


SCORED = "struct<start:int,neg_score:double,i:int,end:int,entity_type:string,text:string,score:double,source:string>"


def score_merged(ents: Column) -> Column:
    """By (start, score descending); each is compared with the last kept only, which a higher score replaces."""
    none = F.array().cast(f"array<{SCORED}>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when(F.size(acc) == 0, F.array(x)).when(x["start"] >= last["end"], F.concat(acc, F.array(x)))
            .when(x["score"] > last["score"], F.concat(rest, F.array(x))).otherwise(acc)
        )

    return F.aggregate(F.array_sort(ents), none, step)


def lists_merged(*lists: DataFrame) -> DataFrame:
    """Lists of entities (doc_id, page_num, entity_type, text, start, end, score, source) as one, by page: overlapping
    ones are merged by score, and an earlier list goes first where start and score tie. One list is returned as it is."""
    if len(lists) == 1:
        return lists[0]
    names = ["doc_id", "page_num", "entity_type", "text", "start", "end", "score", "source"]
    both = reduce(DataFrame.union, [x.select(*names, F.lit(i).alias("i")) for i, x in enumerate(lists)])
    one = F.struct("start", (-F.col("score")).alias("neg_score"), "i", "end", "entity_type", "text", "score", "source").cast(SCORED)
    per = both.groupBy("doc_id", "page_num").agg(F.collect_list(one).alias("l"))
    return per.select("doc_id", "page_num", F.explode(score_merged(F.col("l"))).alias("e")).select("doc_id", "page_num", *(f"e.{n}" for n in names[2:]))


CHUNKED = "struct<neg_score:double,i:int,start:int,end:int,text:string,type:string,score:double>"


def chunks_merged(ents: Column) -> Column:
    """Hits of overlapping windows, best score first; overlaps and equal texts are the same hit."""
    same = lambda x, y: overlap(x, y) | (key(x["text"]) == key(y["text"]))
    return by_start(accepted(F.array_sort(ents), same, CHUNKED))
