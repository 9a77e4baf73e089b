"""Language identification by bit-sliced Bloom filters over character n-grams.

Each slot of the filter holds a bitmask of languages, so one lookup (the AND of the slots that an n-gram
hashes to) returns all languages that contain it. A document's n-grams are counted per language by the masks'
bits, each count is corrected for the language's rate of false positives, and the largest decides.

An n-gram belongs to a language whose relative frequency of it is at least a share of the highest relative
frequency in any language, so texts of mixed languages in the training rows do not make filters alike. The
training rows are a bounded sample per language (by hash of the id); counts and lookups use whole texts.

A letter is what Unicode calls alphabetic; numerals, superscripts and fractions are none. Null texts and texts without
a letter are `und` with score 0, and so is every text where nothing was learned. Ties go to the language that sorts
first. Very long texts are counted in parts that share their n-grams' overlap, so memory does not grow with a text.
Repeated rows are scored each. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import CHUNK_CHARS, held_out, map_rows

#: Documents per language that the filters learn from, about; a rarer language gives all of its documents.
SAMPLE_DOCS = 1500
#: n-grams kept per language, by frequency; share of the highest relative frequency that admits one.
GRAMS, SHARE = 20_000, 0.35
SIZES = (3, 4)
#: log2 of the filter's slots, and hashes per n-gram.
SLOT_BITS, HASHES = 18, 3
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def code_points(text: str, first: bool = True, last: bool = True, after_letter: bool = True) -> np.ndarray:
    """Lower-case letters; a run of anything else is one space, and so are both ends of a text."""
    x = np.frombuffer((" " * first + text.lower() + " " * last).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(x)
    keep = letter | np.concatenate([[first or after_letter], letter[:-1]])[: len(x)]
    return np.where(letter, x, 32)[keep].astype(np.uint64)


def parts(text: str, size: int = CHUNK_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A text's code points in parts, each with the last ones before it."""
    before = np.zeros(0, np.uint64)
    for i in range(0, max(len(text), 1), size):
        x = code_points(text[i : i + size], i == 0, i + size >= len(text), not len(before) or before[-1] != 32)
        yield before, x
        before = np.concatenate([before, x])[-(max(SIZES) - 1) :]


def _is_letter(x: np.ndarray) -> np.ndarray:
    out = (x >= 97) & (x <= 122)
    high = np.flatnonzero(x >= 128)
    if len(high):
        u, inverse = np.unique(x[high], return_inverse=True)
        out[high] = np.array([c < 0x110000 and chr(c).isalpha() for c in u.tolist()], bool)[inverse]
    return out


def grams(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of each n-gram; those of one size over three code points below 2**21 are exact."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x2127599BF4325C37) + x[j : j + n]
        h ^= h >> np.uint64(29)
    return h


def slots(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    return ((h * _MULTIPLIERS[k]) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # slots x words of 64 languages
    false_rates: np.ndarray
    bits: int

    def lookup(self, h: np.ndarray) -> np.ndarray:
        out = self.masks[slots(h, 0, self.bits)]
        for k in range(1, HASHES):
            out &= self.masks[slots(h, k, self.bits)]
        return out

    def counts(self, docs: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of parts (document, before, code points): (documents x languages) n-grams that each language contains, and
        n-grams per document."""
        total, hits = np.zeros(n), np.zeros((n, len(self.languages)))
        owner = np.array([i for i, _, _ in docs], np.int64)
        for size in SIZES:
            found = [grams(np.concatenate([before[-(size - 1) :], x]), size) for _, before, x in docs]
            lengths = np.array([len(g) for g in found], np.int64)
            np.add.at(total, owner, lengths)
            masks = self.lookup(np.concatenate(found)) if len(found) else np.zeros((0, self.masks.shape[1]), np.uint64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for i in range(len(self.languages)):
                bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                sums = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
                np.add.at(hits[:, i], owner, sums[starts[1:]] - sums[starts[:-1]])
        return hits, total

    def predict(self, found: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(found), [0.0] * len(found)
        if not self.languages:
            return names, scores
        hits, total, known = np.zeros((len(found), len(self.languages))), np.zeros(len(found)), set()
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def count() -> None:
            nonlocal hits, total
            more = self.counts(held, len(found))
            hits, total = hits + more[0], total + more[1]
            held.clear()

        for i, text in enumerate(found):
            for before, x in parts(text or ""):
                if (x != 32).any():
                    known.add(i)
                held.append((i, before, x))
                size += len(x)
                if size >= CHUNK_CHARS:
                    count()
                    size = 0
        if held:
            count()
        n = np.maximum(total, 1)[:, None]
        share = np.clip((hits / n - self.false_rates) / (1 - self.false_rates), 0, 1)
        best = share.argmax(1)
        sharp = (share + 1e-6) ** 4
        p = sharp[np.arange(len(found)), best] / sharp.sum(1)
        for i in known:
            names[i], scores[i] = self.languages[best[i]], float(min(1.0, p[i]))
        return names, scores


def train(docs: DataFrame, sample: int = SAMPLE_DOCS, most: int = GRAMS, bits: int = SLOT_BITS, fold: int = 4, rest: int = 2, least_share: float = SHARE) -> Filters:
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", fold, rest))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Filters([], np.zeros((1 << bits, 1), np.uint64), np.zeros(0), bits)
    share = F.create_map(*(x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, sample / n)))))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # repeated ids count once

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                for before, x in parts(text):
                    for size in SIZES:
                        h, n = np.unique(grams(np.concatenate([before[-(size - 1) :], x]), size), return_counts=True)
                        out.setdefault(lang, Counter()).update(dict(zip(h.view(np.int64).tolist(), n.tolist(), strict=True)))
        for lang, c in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], ["lang", "h", "n"])

    per = map_rows(rows.select("text", "lang"), counted, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    per = per.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    top = per.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))).filter(F.col("k") <= most).select("lang", "h", "f").toPandas()
    languages = sorted(sizes)
    masks = np.zeros((1 << bits, (len(languages) + 63) // 64), np.uint64)
    highest = top.groupby("h")["f"].transform("max")
    top = top[top["f"] >= least_share * highest]
    for i, lang in enumerate(languages):
        h = top.loc[top["lang"] == lang, "h"].to_numpy(np.int64).view(np.uint64)
        for k in range(HASHES):
            masks[slots(h, k, bits), i // 64] |= np.uint64(1) << np.uint64(i % 64)
    filled = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filters(languages, masks, np.minimum(filled**HASHES, 0.99), bits)


def language_id(docs: DataFrame, model: Filters, fold: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id", fold, rest).alias("held_out"), "lang_pred", "score")
