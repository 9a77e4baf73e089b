"""Exact duplicates by an extendible-hash index on shared files.

1. Every row becomes a small entry (hash, SHA-256, row number); texts stay where they are.
2. Entries of equal digests are combined before they are moved, so a group of copies of any size is one index row.
   Rows are dealt out by key ranges, the hash's leading OWNER_BITS: an owner task takes whole ranges, one at a time.
3. In each range the owner builds a directory over the bits that follow: a bucket with more rows than its capacity is
   split by one more bit, and the directory doubles when a bucket's depth exceeds its own. Rows of one hash cannot be
   split; they overflow into a chain. The index rows, in key order with their bucket and place in the chain, are
   written to shared files. No directory is brought to the driver.
4. Texts whose index row counts several are read again (a Bloom filter of bounded size passes the others
   by), copies met by one task are combined, and the owner of the range compares bytes along each chain.

Two rows are equal when their texts are identical after lower-casing A-Z only; a null text counts as empty,
so null and empty texts are one group. Very long texts are hashed and compared whole. Of equal texts the row with the
largest id stays; of repeated rows with that id, exactly one, the last by the order of the input's partitions. Null
ids order first. An empty table gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import ARROW_ROWS, bloom, dropped, in_bloom, joined_by_hubs, map_rows, row_hash, stored, without

#: Index rows that a bucket holds before it is split; leading bits of a hash that name its key range.
BUCKET_ROWS, OWNER_BITS = 50_000, 16
#: Bytes of distinct texts that a task combines before it passes them on.
COMBINE_BYTES = 8 << 20


@dataclass
class Directory:
    """Buckets of a key range by the bits that follow its own: leaves are (prefix, depth), in key order."""

    leaves: list[tuple[int, int]]
    #: Rows of each leaf.
    rows: list[int]

    @classmethod
    def of(cls, keys: np.ndarray, capacity: int, skip: int = 0) -> Directory:
        """The directory of ascending 64-bit keys whose first `skip` bits are equal."""
        keys = keys << np.uint64(skip) if skip else keys
        leaves, rows = [], []

        def split(prefix: int, depth: int, lo: int, hi: int) -> None:
            if hi - lo <= capacity or keys[lo] == keys[hi - 1]:
                leaves.append((prefix, depth))
                rows.append(hi - lo)
                return
            middle = np.uint64((2 * prefix + 1) << (63 - depth))
            mid = lo + int(np.searchsorted(keys[lo:hi], middle))
            split(2 * prefix, depth + 1, lo, mid)
            split(2 * prefix + 1, depth + 1, mid, hi)

        split(0, 0, 0, len(keys))
        return cls(leaves, rows)

    @property
    def depth(self) -> int:
        return max((d for _, d in self.leaves), default=0)

    def slots(self) -> list[tuple[int, int]]:
        """(slot, bucket) for each of the 2**depth slots."""
        out, g = [], self.depth
        for bucket, (prefix, d) in enumerate(self.leaves):
            first = prefix << (g - d)
            out += [(s, bucket) for s in range(first, first + (1 << (g - d)))]
        return out


def owner() -> Column:
    """The key range of a hash."""
    return F.shiftrightunsigned("h", 64 - OWNER_BITS)


def indexed(groups: DataFrame, capacity: int) -> DataFrame:
    """Owner tasks: groups with bucket (its number in its range, by key) and chain_no, the place among rows of one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy().view(np.uint64)
            d = Directory.of(h, capacity, OWNER_BITS)
            first = np.concatenate([[True], h[1:] != h[:-1]])
            chain = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0)) + 1
            t = t.append_column("chain_no", pa.array(chain.astype(np.int32))).append_column("bucket", pa.array(np.repeat(np.arange(len(d.rows), dtype=np.int32), d.rows)))
            yield from t.to_batches(max_chunksize=ARROW_ROWS * 10)

        for b in batches:
            ranges = b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - OWNER_BITS)
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if hi == lo:
                    continue
                if held and ranges[lo] != at:
                    yield from flush()
                    held.clear()
                at = ranges[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from flush()

    kind = groups.schema["last"].dataType.simpleString()
    # within a range all hashes have one sign, so their order is that of their bits
    rows = groups.select("h", "sha", "n", "last").repartition(owner()).sortWithinPartitions(owner(), "h", "sha")
    return map_rows(rows, run, f"h long, sha binary, n long, last {kind}, chain_no int, bucket int")


def normalised(b: pa.RecordBatch) -> list[bytes]:
    return [(t or b"").lower() for t in b.column("body").to_pylist()]


def hashes(shas: list[bytes], bits: int) -> np.ndarray:
    """The digest's leading bits, left-aligned in 64."""
    h = np.frombuffer(b"".join(x[:8] for x in shas), ">u8").astype(np.uint64)
    return h if bits == 64 else h >> np.uint64(64 - bits) << np.uint64(64 - bits)


def entries(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shas = [hashlib.sha256(t).digest() for t in normalised(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_hash"), pa.array(hashes(shas, bits).view(np.int64)), pa.array(shas, pa.binary())], ["doc_id", "row_hash", "h", "sha"])

    rows = docs.select(F.col(id_col).alias("doc_id"), row_hash(id_col, text_col).alias("row_hash"), F.col(text_col).cast("binary").alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, run, f"doc_id {kind}, row_hash long, h long, sha binary").withColumn("uid", F.monotonically_increasing_id())


def repeated_texts(docs: DataFrame, text_col: str, bits: int, words: np.ndarray, b: int) -> DataFrame:
    """(h, sha, body, n) of texts that the filter passes; copies that one task meets are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            at = list(held.values())
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.binary()), pa.array(list(held), pa.binary()), pa.array([x[2] for x in at], pa.int64())], ["h", "sha", "body", "n"])

        for batch in batches:
            bodies = normalised(batch)
            shas = [hashlib.sha256(t).digest() for t in bodies]
            hs = hashes(shas, bits)
            for i in np.flatnonzero(in_bloom(words, b, hs)):
                if x := held.get(bodies[i]):
                    x[2] += 1
                else:
                    held[bodies[i]] = [int(hs.view(np.int64)[i]), shas[i], 1]
                    size += len(bodies[i])
            if size > COMBINE_BYTES:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return map_rows(docs.selectExpr(f"cast(`{text_col}` AS binary) AS body"), run, "h long, sha binary, body binary, n long")


def compared(rows: DataFrame) -> DataFrame:
    """Owner tasks: along each chain, bytes are compared with the heads so far. (h, sha, text_no, n)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []

        def out() -> list[tuple]:
            return [(*at, k, n) for k, (_, n) in enumerate(heads)] if at else []

        for batch in batches:
            made = []
            for h, sha, body, n in zip(*(batch.column(c).to_pylist() for c in ("h", "sha", "body", "n")), strict=True):
                if (h, sha) != at:
                    made += out()
                    at, heads = (h, sha), []
                for head in heads:
                    if head[0] == body:
                        head[1] += n
                        break
                else:
                    heads.append([body, n])
            if made:
                yield batch_of(made)
        if rest := out():
            yield batch_of(rest)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*made, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["h", "sha", "text_no", "n_same"])

    return map_rows(rows, run, "h long, sha binary, text_no int, n_same long")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ROWS, hash_bits: int = 64
) -> DataFrame:
    """A row for each row of docs: id, keep_id, group_size, kept, text_sha256, the bucket of its
    index row in its key range and row_hash, the hash of id and text."""
    rows = stored(entries(docs, id_col, text_col, hash_bits), "entries")
    groups = rows.groupBy("h", "sha").agg(F.count("*").alias("n"), F.max(F.struct(F.col("doc_id"), F.col("uid"))).alias("last"))
    groups = stored(groups, "groups")
    index = stored(indexed(groups, capacity), "index")

    again = index.filter("n > 1")
    if count := again.count():
        words, b = bloom(again, "h", count)
        same = repeated_texts(docs, text_col, hash_bits, words, b)
        same = compared(same.repartition(owner()).sortWithinPartitions("h", "sha").select("h", "sha", "body", "n"))
        checked = again.join(same.groupBy("h", "sha").agg(F.max("text_no").alias("text_no"), F.sum("n_same").alias("n_same")), ["h", "sha"], "left")
        wrong = F.raise_error(F.lit("rows of one digest do not hold the same bytes"))
        proved = stored(checked.select("h", "sha", F.when(F.expr("text_no = 0 AND n_same = n"), F.col("n")).otherwise(wrong.cast("long")).alias("proved")), "proved")
        index = index.join(proved, ["h", "sha"], "left").withColumn("n", F.coalesce("proved", "n"))
    dropped(groups)
    keys = index.select("h", "sha", "n", "last", "bucket", F.col("n").alias("members"))
    found = joined_by_hubs(rows, keys, ["h", "sha"], "members", rows.count())
    return found.select(
        F.col("doc_id").alias(id_col), F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("uid") == F.col("last.uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "row_hash",
    )


def exact_kept(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps."""
    found = exact_dedup(docs).groupBy("doc_id", "row_hash").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    found = stored(found.filter("NOT kept OR n > 1"), "gone")
    out = without(docs, found)
    again = found.filter("kept")
    if again.limit(1).count():  # rows of one id and text, of which one stays
        key = row_hash()
        a, b = (f"{n}_{uuid.uuid4().hex}" for n in ("id", "hash"))  # names that no caller's column has
        again = again.select(F.col("doc_id").alias(a), F.col("row_hash").alias(b))
        same = docs.join(again, docs["doc_id"].eqNullSafe(again[a]) & (key == again[b])).dropDuplicates([a, b])
        out = out.unionByName(same.drop(a, b))
    return out
