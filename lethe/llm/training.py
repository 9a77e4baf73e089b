"""Bounded, documented samples of labelled rows for the operators that fit a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import stored

#: Labelled rows that a model is fitted on at most: those whose ids hash lowest.
SAMPLE_ROWS = 8000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, keep: Column | None = None, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled ids; of an id's labels the largest counts.

    The labels are reduced to `rows` ids before they meet the texts, so what is broadcast is bounded. Of rows that
    repeat an id, the least text counts, chosen before anything is shuffled. The sample is stored: one scan.
    """
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(target).cast("int").alias("y")).dropna()
    y = y.filter(keep) if keep is not None else y
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(d.join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample")
