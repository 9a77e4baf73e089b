"""Token ids in binary files whose document boundaries are Elias-Fano sequences.

A file holds documents in ascending id: the magic, the width of an id in bytes, the number of leading null
document ids, the Elias-Fano sequence of the other document ids, that of the documents' ends in the id array
(its last value is the array's length), then all ids as little-endian unsigned integers of 2 or 4 bytes.
select(i) of the ends gives any document's offset.

Texts are encoded with the tokenizers library: each text is cut where no match of the byte-level pattern spans
and none looks across, before a white space that follows a visible character and between a word and other
visible characters; a worker remembers the ids of the pieces. Texts with an apostrophe (which may begin a
contraction) or underscore are cut at white space only, and those with the control characters that libraries
take for white space or not are encoded whole.

Tasks own ranges of (document id, hash of the text); each writes its files under a name of the attempt and
renames them when whole, and only files that a finished task reports are read, so lost executors leave no trace
in the result. A table of the files, with the task and place of each, is stored beside them; the driver adds up one
length for each task, and windows within a task do the rest. Readers take many files each, and a file's documents in
blocks whose places are selected in the Elias-Fano ends.

Document ids are integers of 64 bits (strings that hold none are an error). Null and empty texts hold the end id alone;
very long texts are a document in one file, which is then larger than FILE_BYTES. Null document ids come first; rows
with equal ids are ordered by their hash, and those that tie in both have equal texts. An empty table writes no file and
gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import map_rows, shared_dir, stored
from lethe.llm.elias_fano import EliasFano

MAGIC = b"LETHEEF1"
#: Bytes of ids at which a task closes a file and begins the next.
FILE_BYTES = 32 << 20
#: Documents that a reader selects at a time.
BLOCK_DOCS = 4096
#: Pieces that a worker remembers.
MEMO = 1 << 20
COARSE = re.compile(r"\s*\S+|\s+")
FINE = re.compile(r"\s*\w+|\s*[^\w\s]+|\s+")
ODD = re.compile("[\x1c-\x1f]")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker, so tasks share what it remembers."""
    return Encoder(path)


class Encoder:
    """Ids of texts as bytes, with a memory of pieces."""

    def __init__(self, path: str, memo: int = MEMO):
        self.tokenizer, self.most, self.memo = tokenizer(path), memo, {}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if ODD.search(t) else (COARSE if "'" in t or "_" in t else FINE).findall(t) for t in texts]
        if len(self.memo) > self.most:  # the pieces of this batch are the likeliest to come again
            self.memo = {p: self.memo[p] for c in cut if c for p in c if p in self.memo}
        memo = self.memo
        new = list(set().union(*(c for c in cut if c)).difference(memo))
        # a space and letters are one match wherever they stand, so such pieces are encoded as one text
        plain = [p for p in new if p[0] == " " and p[1:].isalpha()]
        if len(plain) < len(new):
            self.learn(list(set(new).difference(plain)), True)
        self.learn(plain, False)
        return [self.whole(t) if c is None else b"".join(map(memo.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]

    def learn(self, new: list[str], listed: bool) -> None:
        memo = self.memo
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            e = self.tokenizer.encode(part if listed else "".join(part), is_pretokenized=listed, add_special_tokens=False)
            ids = np.array(e.ids, self.kind)
            ends = np.searchsorted(np.array(e.word_ids), np.arange(len(part)), side="right") * self.kind.itemsize
            raw, start = ids.tobytes(), 0
            for p, end in zip(part, ends.tolist(), strict=True):
                memo[p] = raw[start:end]
                start = end

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


def pack(doc_ids: list[int | None], parts: list[bytes], width: int) -> bytes:
    nulls = sum(x is None for x in doc_ids)
    ends = np.cumsum([len(p) // width for p in parts])
    head = MAGIC + width.to_bytes(1, "little") + nulls.to_bytes(8, "little")
    return b"".join([head, EliasFano.of(np.array(doc_ids[nulls:], np.int64)).to_bytes(), EliasFano.of(ends).to_bytes(), *parts])


class TokenFile:
    """A file's documents, each found by select without reading those before it."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(content)
        self.width, self.nulls = content[8], int.from_bytes(content[9:17], "little")
        self.ids, n = EliasFano.from_bytes(view[17:])
        self.ends, m = EliasFano.from_bytes(view[17 + n :])
        self.array = np.frombuffer(view[17 + n + m :], f"<u{self.width}")

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        return self.array[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def ends_from(self, first: int, last: int) -> np.ndarray:
        """Where documents first - 1 (0 for the first) to last - 1 end in the array, by select."""
        ends = self.ends.selects(max(first - 1, 0), last)
        return ends if first else np.concatenate([[0], ends])

    def doc_ids(self, first: int = 0, last: int | None = None) -> list[int | None]:
        last = len(self) if last is None else last
        nulls = max(0, min(last, self.nulls) - first)
        return [None] * nulls + self.ids.selects(max(first - self.nulls, 0), max(last - self.nulls, 0)).tolist()


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files; a stored table has a row for each: name, task (in order of the ids), place in it, n_docs, n_tokens."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        enc = encoder(path)
        end = np.array([end_id], enc.kind).tobytes()
        ids: list = []
        parts: list[bytes] = []
        size, place, task = 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            name = f"{at}/{uuid.uuid4().hex}"
            with store.open_output_stream(name + ".tmp") as f:
                f.write(pack(ids, parts, enc.kind.itemsize))
            store.move(name + ".tmp", name + ".ids")
            row = [name.rsplit("/", 1)[1] + ".ids", task, place, len(ids), size // enc.kind.itemsize]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["name", "task", "place", "n_docs", "n_tokens"])

        for b in batches:
            found = [x + end for x in enc.encode([t or "" for t in b.column("text").to_pylist()])]
            for i, x in zip(b.column("doc_id").to_pylist(), found, strict=True):
                if size + len(x) > file_bytes and ids:
                    yield flush()
                    ids, parts, size, place = [], [], 0, place + 1
                ids.append(i)
                parts.append(x)
                size += len(x)
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("h"))
    return stored(map_rows(rows.select("doc_id", "text"), run, "name string, task int, place int, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32.

    The driver gets one row a task of the writers; files are dealt out again to as many readers as there are cores, or
    shuffle partitions, not more.
    """
    spark = files.sparkSession
    tasks = files.groupBy("task").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("files")).orderBy("task").collect()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not tasks:
        return spark.createDataFrame([], schema)
    before = np.concatenate([[0], np.cumsum([r.n for r in tasks])])[:-1].tolist()
    before = spark.createDataFrame([(r.task, n) for r, n in zip(tasks, before, strict=True)], "task int, before long")
    within = Window.partitionBy("task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed = placed.join(F.broadcast(before), "task").select("name", (F.col("before") + F.col("within")).alias("start"))
    readers = min(sum(r.files for r in tasks), max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{name}") as opened:
                    f = TokenFile(opened.read())
                for first in range(0, len(f), BLOCK_DOCS):
                    last = min(first + BLOCK_DOCS, len(f))
                    ends = f.ends_from(first, last)
                    begins, ends = ends[:-1], ends[1:]
                    crc = [zlib.crc32(f.array[s:e].astype("<u4").tobytes()) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids(first, last), pa.int64()), pa.array(begins + start, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_rows(placed.repartition(readers), run, schema)


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs' ids to files in the shared folder and return what the files hold."""
    folder = shared_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, path, end_id, file_bytes), folder)
