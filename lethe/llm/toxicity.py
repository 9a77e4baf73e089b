"""Toxicity by cumulative-link ordinal regression over sparse counts of words and word beginnings.

Severity has the grades 0 to 3. Labels say only whether a document is toxic, so the grade of a toxic training
document comes from the other half of the sample: words that mark toxic documents there (log odds over a bound) are
counted in it, up to 2, up to 5, more. A document's own words never decide which words count for its grade.
P(grade >= k) = sigmoid(w.x - b_k): a feature met c times has the value 1 + log c, the weights are shared by the
ordered thresholds b_1 < b_2 < b_3, and a document's score is its expected severity, the sum of the probabilities.
Documents whose crc32(doc_id as text) mod 5 is 0 are held out: no word, weight or threshold is learnt from them.

Null and empty texts have no words and get the score of the thresholds alone. Very long texts are counted whole, by
one pass over their words. Features that tie in chi-square are taken by name. Without labels of both classes, or from
an empty table, the score is 0; an empty table to score gives an empty result. Rows with repeated ids are scored each;
a repeated training id counts once. Other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import held_out, map_rows, texts
from lethe.llm.training import SAMPLE_ROWS, labelled_sample

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the proper beginnings of a word that count beside the word: they find unseen derived words.
BEGINNINGS = (5, 6, 7, 8)
#: Features that the model weighs at most, and documents that one of them must occur in.
VOCABULARY, LEAST_DOCS = 1000, 3
#: Words whose features a worker remembers.
MEMO = 1 << 19
#: Log odds from which a word marks toxic documents, and marks up to which a toxic document has grade 1, 2.
MARK_LOG_ODDS, GRADE_MARKS = 3.0, (2, 5)
#: Documents that hold a word, by half of the sample and label.
CELLS = ("n00", "n01", "n10", "n11")
PENALTY, STEPS, RATE = 1e-4, 500, 0.05


@dataclass
class Ordinal:
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bounds: np.ndarray = field(default_factory=lambda: np.full(3, 30.0))

    def probabilities(self, counts: list[dict[int, int]]) -> np.ndarray:
        """P(grade >= 1, 2, 3) of each document."""
        z = np.array([sum(self.weights[i] * (1 + np.log(c)) for i, c in d.items()) for d in counts]).reshape(-1, 1)
        return 1 / (1 + np.exp(np.clip(self.bounds - z, -30, 30)))

    def counts(self, text: str, memo: dict[str, tuple[int, ...]]) -> dict[int, int]:
        """Occurrences of each weighed feature in the whole text."""
        out: Counter = Counter()
        for w in WORD.findall(text.lower()):
            if (found := memo.get(w)) is None:
                if len(memo) >= MEMO:
                    memo.clear()
                found = memo[w] = tuple(self.words[f] for f in features(w) if f in self.words)
            if found:
                out.update(found)
        return out


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in BEGINNINGS if len(word) > k)]


def fit(x: np.ndarray, grades: np.ndarray, penalty: float = PENALTY, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean negative log-likelihood with an L2 penalty.

    The thresholds are b_1 and the logs of the gaps above it, so they stay in order.
    """
    n, k = x.shape
    x = x.astype(np.float32)
    w, t = np.zeros(k), np.array([2.0, 0.0, 0.0])
    first, second = np.zeros(k + 3), np.zeros(k + 3)
    at = np.arange(n)
    for step in range(1, steps + 1):
        gaps = np.exp(t[1:])
        b = t[0] + np.array([0.0, gaps[0], gaps.sum()])
        p = 1 / (1 + np.exp(np.clip(b - (x @ w.astype(np.float32))[:, None], -30, 30)))
        edge = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))])
        mass = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-12)
        low, high = slope[at, grades] / mass, slope[at, grades + 1] / mass
        to_b = np.zeros((n, 5))
        to_b[at, grades] = low
        to_b[at, grades + 1] = -high
        gb = to_b[:, 1:4].mean(0)
        g = np.concatenate([x.T @ (high - low).astype(np.float32) / n + penalty * w, [gb.sum(), gb[1:].sum() * gaps[0], gb[2] * gaps[1]]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        move = rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:k]
        t = np.clip(t - move[k:], [-20, -4, -4], [20, 3, 3])
    gaps = np.exp(t[1:])
    return w, t[0] + np.array([0.0, gaps[0], gaps.sum()])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY, fold: int = 5) -> Ordinal:
    """Choose the words by their chi-square with the label, then fit, on at most `rows` labelled ids not held out."""
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    sample = labelled_sample(docs, labels, "toxic", ~held_out("doc_id", fold, 0), rows).withColumn("half", half)

    def word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: tuple[Counter, ...] = tuple(Counter() for _ in range(4))
            for t, y, h in zip(texts(b), b.column("y").to_pylist(), b.column("half").to_pylist(), strict=True):
                found[2 * h + (y > 0)].update({f for w in set(WORD.findall(t.lower())) for f in features(w)})
            words = list(set().union(*found))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in found)], ["word", *CELLS])

    sizes = {(r.half, r.toxic): r.n for r in sample.groupBy("half", (F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    a, c = (sum(sizes.get((h, y), 0) for h in (0, 1)) for y in (True, False))
    if not (a and c):
        return Ordinal()
    by_word = map_rows(sample, word_sets, "word string, " + ", ".join(f"{n} long" for n in CELLS)).groupBy("word").agg(*(F.sum(n).alias(n) for n in CELLS))
    n0, n1 = F.col("n00") + F.col("n10"), F.col("n01") + F.col("n11")

    def odds(h: int):
        """Log odds of a word in toxic documents against others, in one half of the sample."""
        said = [(F.col(f"n{h}{y}") + 0.5) / (sizes.get((h, bool(y)), 0) - F.col(f"n{h}{y}") + 0.5) for y in (0, 1)]
        return (F.log(said[1]) - F.log(said[0])).alias(f"odds{h}")

    cross = n1 * F.lit(float(c)) - n0 * F.lit(float(a))
    chi = cross * cross / ((n0 + n1) * (a + c - n0 - n1 + 1.0))
    chosen = by_word.filter(n0 + n1 >= LEAST_DOCS).select("word", odds(0), odds(1), chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(vocabulary).collect()
    model = Ordinal({r.word: i for i, r in enumerate(chosen)})
    # the marks that grade a half are those of the other
    marks = np.array([[r.odds1 >= MARK_LOG_ODDS for r in chosen], [r.odds0 >= MARK_LOG_ODDS for r in chosen]]).reshape(2, len(chosen))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            found = [model.counts(t, memo) for t in texts(b)]
            cols = [pa.array([list(f(d)) for d in found], pa.list_(pa.int32())) for f in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("half"), *cols], ["doc_id", "y", "half", "i", "c"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = map_rows(sample, counted, f"doc_id {kind}, y int, half int, i array<int>, c array<int>").collect()
    found.sort(key=lambda r: r.doc_id)
    x = np.zeros((len(found), len(chosen)), np.float32)
    hits = np.zeros(len(found))
    for j, r in enumerate(found):
        x[j, r.i] = 1 + np.log(r.c)
        hits[j] = sum(n for i, n in zip(r.i, r.c, strict=True) if marks[r.half][i])
    toxic = np.array([r.y > 0 for r in found])
    grades = np.where(toxic, 1 + np.searchsorted(GRADE_MARKS, hits, side="left"), 0)
    model.weights, model.bounds = fit(x, grades)
    return model


def toxicity(docs: DataFrame, model: Ordinal, fold: int = 5) -> DataFrame:
    """(doc_id, held_out, severity 0 to 3, p_toxic, grade, toxic) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            p = model.probabilities([model.counts(t, memo) for t in texts(b)])
            cols = [pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, severity double, p_toxic double, grade int, toxic boolean")
    return out.select("doc_id", held_out("doc_id", fold, 0).alias("held_out"), "severity", "p_toxic", "grade", "toxic")
