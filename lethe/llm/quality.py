"""Quality by regularised quadratic discriminant analysis over transformed statistics of a document.

Two Gaussian classes are fitted to a bounded sample of labelled rows; each covariance is shrunk towards the
pooled one and that towards its diagonal. A score is the posterior of the good class, from the difference
of Mahalanobis log densities with the Cholesky factors that the fit cached.

Null and empty texts have the statistics of no characters and get a score like any other. Without labels of
both classes the score is the share of good labels (1 without labels). Rows with repeated ids are scored each;
a repeated training id counts once. Very long texts are measured whole, their words held beside them. A score that ties
with the cutoff counts as good. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lethe.llm.common import held_out, map_rows, texts
from lethe.llm.training import SAMPLE_ROWS, labelled_sample

CUTOFF = 0.3
#: Shares of each class covariance that come from the pooled one, and of that from its diagonal.
TO_POOLED, TO_DIAGONAL = 0.2, 0.2
#: Least standard deviation of a transformed statistic.
LEAST_SD = 0.25

NAMES = ("upper", "symbol", "exclaim", "bar", "digit", "word_length", "distinct_words", "distinct_runs", "distinct_lines")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?|'\"()\-]")
_DIGIT = re.compile(r"[0-9]")


def _logit(part: float, whole: float) -> float:
    """Log odds of a share, with half a case added to either side of twenty."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 19.5)))


def statistics(text: str) -> list[float]:
    """Log odds of shares, and the log of the mean word length; of an empty text those of no cases."""
    words = text.split()
    n, chars = len(words), len(text) - text.count(" ")
    lines = [x for x in text.split("\n") if x]
    runs = list(zip(words, words[1:], words[2:], strict=False))
    return [
        _logit(len(_UPPER.findall(text)), chars),
        _logit(len(_SYMBOL.findall(text)), chars),
        _logit(text.count("!") + text.count("?"), chars),
        _logit(text.count("|"), n),
        _logit(len(_DIGIT.findall(text)), chars),
        float(np.log((chars + 30) / (n + 5))),
        _logit(n**0.5 * (1 - len(set(words)) / n) if n else 0, n**0.5),
        _logit(len(runs) - len(set(runs)), len(runs)),
        _logit(len(lines) - len(set(lines)), len(lines)),
    ]


@dataclass
class Discriminant:
    """means, and inverse Cholesky factors with their log determinants, of the classes 0 and 1."""

    means: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray
    log_prior: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        d = [-0.5 * (((x - m) @ inv.T) ** 2).sum(1) - ld for m, inv, ld in zip(self.means, self.inverses, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.log_prior + d[1] - d[0], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    k = len(NAMES)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant(np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2), 0.0, float(y.mean()) if len(y) else 1.0)
    groups = [x[y == c] for c in (0, 1)]
    means = np.array([g.mean(0) for g in groups])
    covs = [np.cov(g.T) for g in groups]
    pooled = sum(c * (len(g) - 1) for c, g in zip(covs, groups, strict=True)) / (len(x) - 2)
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
    inverses, dets = [], []
    for c in covs:
        low = np.linalg.cholesky((1 - TO_POOLED) * c + TO_POOLED * pooled + LEAST_SD**2 * np.eye(k))
        inverses.append(np.linalg.inv(low))
        dets.append(np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(inverses), np.array(dets), float(np.log(len(groups[1]) / len(groups[0]))))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fold: int = 5) -> Discriminant:
    """Fit on at most `rows` labelled ids whose crc32 mod `fold` is not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([statistics(t) for t in texts(b)], pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, "quality", ~held_out("doc_id", fold, 0), rows)
    kind = sample.schema["doc_id"].dataType.simpleString()
    found = map_rows(sample, run, f"doc_id {kind}, y int, x array<double>").collect()
    found.sort(key=lambda r: r.doc_id)
    x = np.array([r.x for r in found]).reshape(len(found), len(NAMES))
    return fit(x, np.array([r.y for r in found], int))


def quality_scores(docs: DataFrame, model: Discriminant, cutoff: float = CUTOFF, fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array([statistics(t) for t in texts(b)]).reshape(b.num_rows, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= cutoff).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", held_out("doc_id", fold, 0).alias("held_out"), "score", "predicted")


def quality_kept(docs: DataFrame, model: Discriminant, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array([statistics(t) for t in texts(b)]).reshape(b.num_rows, len(NAMES)))
            yield b.filter(pa.array(s >= cutoff))

    return map_rows(docs, run, docs.schema)
