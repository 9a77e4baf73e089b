"""What the training-data operators share: shared folders, tables, bounded Bloom filters, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.plans.shipping import ensure_shipped
from lethe.sources.shared import clean, delete, shared_dir, stored  # noqa: F401
from lethe.sources.tables import read

#: Characters of text that one numpy pass holds at a time, and bytes of rows that a function is handed at once.
CHUNK_CHARS, BATCH_BYTES = 400_000, 1 << 20
#: Rows in an Arrow batch at most: with long texts the usual ten thousand would not fit beside each other.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from stored() that nothing reads any more."""
    location = df._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    delete(df.sparkSession, location.rootPaths().head().toString())


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, row_hash) is not in gone; null ids are compared like others."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (row_hash() == gone["gone_hash"]), "left_anti")


#: A key is a hub if it has more rows than this and more than one in HUB_SHARE of all: there are HUB_SHARE at most.
HUB_ROWS, HUB_SHARE = 2000, 200


def joined_by_hubs(rows: DataFrame, keys: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined with keys, one row for each key with the `count` of its rows among `total`. The few hubs are broadcast
    and the others shuffled, so no task gets all rows of one key."""
    hub = F.col(count) > max(HUB_ROWS, total // HUB_SHARE)
    hubs, others = F.broadcast(keys.filter(hub).drop(count)), keys.filter(~hub).drop(count)
    rest = rows.join(F.broadcast(keys.filter(hub).select(*on)), on, "left_anti").join(others, on)
    return rows.join(hubs, on).unionByName(rest)


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow that hands f batches of about BATCH_BYTES, or one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(small(batches))

    spark = df.sparkSession
    ensure_shipped(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(run, schema)


def small(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by the bytes of their rows; a row is never cut."""
    for b in batches:
        if b.num_rows < 2 or b.nbytes <= most:
            yield b
            continue
        step = max(1, int(b.num_rows * most / b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """crc32 of the id as text, mod a number; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(True))


# Bloom filter of bounded size over 64-bit hashes that are already random ---------------------------------

BLOOM_MOST_BITS = 26


def bloom(df: DataFrame, key: str, count: int) -> tuple[np.ndarray, int]:
    """Bits of a filter of at most 2**26 bits (8 MB), gathered as at most 2**20 words. Beyond that size its
    false positives grow, which costs later joins time but loses nothing."""
    b = min(BLOOM_MOST_BITS, max(16, int(np.ceil(np.log2(16 * max(count, 1))))))
    mask, k = F.lit((1 << b) - 1).cast("long"), F.col(key)
    at = F.explode(F.array(*(F.shiftrightunsigned(k, s).bitwiseAND(mask) for s in (0, 19, 38))))
    word = F.shiftrightunsigned(F.col("at"), 6).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")
    rows = df.select(at.alias("at")).select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(1 << (b - 6), np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return words, b


def in_bloom(words: np.ndarray, b: int, keys: np.ndarray) -> np.ndarray:
    keys, mask = keys.astype(np.uint64, copy=False), np.uint64((1 << b) - 1)
    out = np.ones(len(keys), bool)
    for s in (0, 19, 38):
        at = (keys >> np.uint64(s)) & mask
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out
