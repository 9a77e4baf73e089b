"""Personal data by fixed patterns, and more of it by bootstrapped contextual extraction.

One pass finds the base spans of each whole text and, as candidates, every other token that holds a digit, of any
length. Each base span and candidate is an instance in up to four lexical patterns: the one or two words before it,
alone or with the word after it, digits masked (of a word that begins or ends more than REACH code points away, the
part within counts). The distinct (pattern, instance) pairs are a bipartite graph; base instances are its seeds, with
confidence 1. In each of ROUNDS rounds Spark scores a pattern by the mean confidence of its distinct instances
(two unknown instances are added to each mean, so rare patterns score low) and a candidate by the noisy-or
of its patterns above half a point. An instance of confidence KNOWN or more is a seed of the next round, so that
identifiers found in one context make others known, up to ROUNDS - 1 contexts away from a base span; candidates with
fewer than SEED_DIGITS digits, as page numbers, are found in trusted patterns but seed none. A pattern with
at least LEAST_SEEDS distinct seeds and a final score of LEAST_SCORE is trusted: the candidates it holds become spans
of kind `context`.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Very long texts are scanned whole, in
one pass over their digits. Rows are scanned each, repeated or not; instances that tie count alike. Joins on patterns
and instances are of distinct pairs, split by adaptive execution where a pattern is hot.
An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import map_rows, stored, texts

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The email pattern from its @ on; a match begins at the first of the characters before it that may stand there.
#: The ip pattern, tried once for each run of digits: a match can only begin at one, and a run is never given back.
_IP_RUN = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")

_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._/#:-")
_TOKEN_REST, _TOKEN_ENDS = re.compile(r"[A-Za-z0-9._/#:-]+"), "._/#:-"
#: Digits from which a candidate that is found may seed further patterns.
SEED_DIGITS = 5
ROUNDS, LEAST_SEEDS, LEAST_SCORE = 3, 3, 0.7
#: Confidence from which an instance counts as a seed.
KNOWN = 0.7
_WORD = re.compile(r"\S+")
#: Code points of context on either side that a pattern's words are looked for in.
REACH = 80


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order; leftmost and not overlapping within a kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP_RUN.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


_DIGIT_RUN = re.compile(r"[0-9]")


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that overlap no base span, wherever they stand in a run without white space."""
    out, starts, ends = [], [], []  # the union of the base spans
    for s, _, e in sorted(base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    seen = 0
    for d in _DIGIT_RUN.finditer(text):
        if d.start() < seen:
            continue
        left, right = d.start(), _TOKEN_REST.match(text, d.start()).end()
        while left > seen and text[left - 1] in _TOKEN:
            left -= 1
        seen = right
        word = text[left:right].lstrip(_TOKEN_ENDS)
        s = right - len(word)
        e = s + len(word.rstrip(_TOKEN_ENDS))
        i = bisect_left(starts, e) - 1
        if i < 0 or ends[i] <= s:
            out.append((s, e))
    return out


def plain(word: str) -> str:
    return re.sub(r"[0-9]", "0", word.lower()).strip(".,;!?\"'")


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span; each holds a word with a letter before it."""
    before = [w for x in _WORD.findall(text[max(0, start - REACH) : start])[-2:] if (w := plain(x))]
    after = [w for x in _WORD.findall(text[end : end + REACH])[:1] if (w := plain(x))]
    if not before or not any(c.isalpha() for c in before[-1]):
        return []
    out = [before[-1] + " _"]
    if len(before) > 1:
        out.append(" ".join(before) + " _")
    return out + [f"{p} {after[0]}" for p in out if after]


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)



def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, uid, base array<struct<start, kind, end>>, seen array<struct<start, end, seed, able, instance, patterns>>)."""
    schema = "base array<struct<start:long,kind:int,end:long>>, seen array<struct<start:long,end:long,seed:boolean,able:boolean,instance:long,patterns:array<long>>>"
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    seen_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("able", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, seen = [], []
            for t in texts(b):
                found = base_spans(t)
                rows = []
                for s, e, seed in [(s, e, True) for s, _, e in found] + [(s, e, False) for s, e in candidates(t, found)]:
                    if p := patterns(t, s, e):
                        rows.append({"start": s, "end": e, "seed": seed, "able": seed or len(_NOT_DIGIT.sub("", t[s:e])) >= SEED_DIGITS, "instance": _hash(t[s:e]), "patterns": [_hash(x) for x in p]})
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                seen.append(rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, base_type), pa.array(seen, seen_type)], ["doc_id", "base", "seen"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, run, f"doc_id {kind}, {schema}").withColumn("uid", F.monotonically_increasing_id())


def trusted_patterns(seen: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE, known: float = KNOWN) -> DataFrame:
    """The patterns (p) that the bootstrap trusts, from rows (p, instance, seed, able)."""
    edges = stored(seen.groupBy("p", "instance").agg(F.max("seed").alias("seed"), F.max("able").alias("able")), "edges")
    sizes = stored(edges.groupBy("p").agg(F.count("*").alias("n")), "sizes")
    base = stored(edges.filter("seed").select("instance").distinct().withColumn("conf", F.lit(1.0)), "base")
    conf = base
    for i in range(rounds):
        # instances without confidence count in n only, and patterns that hold none with some score 0
        held = edges.join(conf, "instance").groupBy("p").agg(F.sum(F.when(F.col("able"), F.col("conf")).otherwise(0.0)).alias("total"), F.sum(((F.col("conf") >= known) & F.col("able")).cast("int")).alias("seeds"))
        score = stored(held.join(sizes, "p").select("p", (F.col("total") / (F.col("n") + 2)).alias("score"), "seeds"), "score")
        if i == rounds - 1:
            return score.filter((F.col("score") >= least_score) & (F.col("seeds") >= least_seeds)).select("p")
        miss = F.sum(F.log1p(-(F.least(F.col("score"), F.lit(0.99)) * 2 - 1)))
        found = edges.join(score.filter("score > 0.5").select("p", "score"), "p").groupBy("instance").agg((1 - F.exp(miss)).alias("found"))
        conf = stored(found.join(base, "instance", "full").select("instance", F.coalesce("conf", "found").alias("conf")), "conf")
    raise ValueError("rounds must be at least 1")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans."""
    rows = stored(scan(docs, id_col, text_col), "scan")
    seen = rows.select("uid", F.explode("seen").alias("x")).select("uid", "x.start", "x.end", "x.seed", "x.able", "x.instance", F.explode("x.patterns").alias("p"))
    trusted = trusted_patterns(seen.select("p", "instance", "seed", "able"))
    more = seen.filter(~F.col("seed")).join(trusted, "p").groupBy("uid").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("more"))
    out = rows.select("doc_id", "uid", "base").join(more, "uid", "left")
    names = F.array(*map(F.lit, (*KINDS, "context")))
    said = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        F.col("doc_id").alias(id_col), *(count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_context"),
        F.sha2(F.array_join(F.transform("base", said), ","), 256).alias("base_sha256"), F.array_join(F.transform(every, said), ",").alias("spans"),
    )
