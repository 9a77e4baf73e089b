"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts beyond a length are cut before a white space that follows a visible character: no match of the
pattern spans such a place and no look-ahead sees across it, so the pieces' ids joined are the text's ids.
Decoding joins the tokens' raw bytes and never goes through text.

Null and empty texts have no ids. Repeated rows are each encoded; other columns are left alone, and of
columns with clashing names only the two that are named are read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lethe.llm.common import map_rows, texts

#: Texts are cut into pieces of about this many characters.
PIECE_CHARS = 1 << 16
#: A visible character by every definition of white space that the libraries use, then a space or line feed.
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The library's encoder, built once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """text, cut at the first safe boundary after each `size` characters."""
    start = 0
    while len(text) - start > size and (m := SAFE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(enc, text: str, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, size):
        ids += enc.encode_ordinary(piece)
    return ids


def bpe_encode(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col and token_ids ARRAY<INT> of each row's whole text."""
    path, pattern = path or rank_file(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            ids = [encode(enc, t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "token_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, f"id {kind}, token_ids array<int>")
    return out.withColumnRenamed("id", id_col)


def bpe_decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id_col and raw BINARY: the bytes that token_ids stand for. Null ids give no bytes."""
    path, pattern = path or rank_file(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(x or []) for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(raw, pa.binary())], ["id", "raw"])

    kind = tokens.schema[id_col].dataType.simpleString()
    out = map_rows(tokens.selectExpr(f"`{id_col}` AS id", "token_ids"), run, f"id {kind}, raw binary")
    return out.withColumnRenamed("id", id_col)


def bpe_digests(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, decode the ids again, and return per row: id_col, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = path or rank_file(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            n, ids_sha, raw_sha = [], [], []
            for t in texts(b):
                ids = encode(enc, t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = map_rows(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, schema)
    return out.withColumnRenamed("id", id_col)
