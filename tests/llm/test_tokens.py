from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from lethe.llm import bpe, token_files
from lethe.llm.elias_fano import EliasFano


def test_bpe_matches_the_library_and_round_trips(odd, documents):
    enc = bpe.encoding(bpe.rank_file(), bpe.split_pattern())
    for docs in (odd, documents):
        found = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(docs).collect()), key=str)
        want = []
        for r in docs.collect():
            ids = enc.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert found == sorted(want, key=str)


def test_bpe_pieces_keep_every_id():
    enc = bpe.encoding(bpe.rank_file(), bpe.split_pattern())
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc ", " ", "  \n", "\n", "'s", "!", "1", " ", "\x1c", "\x85", "é", "😀", "\t"]) for _ in range(60))
        assert bpe.encode(enc, text, size=7) == enc.encode_ordinary(text)


def test_bpe_encode_and_decode_frames(odd, empty):
    back = bpe.bpe_decode(bpe.bpe_encode(odd)).collect()
    assert sorted((r.raw.decode() for r in back)) == sorted((r.text or "") for r in odd.collect())
    assert bpe.bpe_digests(empty).count() == 0 and bpe.bpe_encode(empty).count() == 0


def test_elias_fano():
    for n, high in ((0, 1), (1, 9), (300, 300), (1000, 10**6), (700, 2**62)):
        v = np.sort(np.random.default_rng(n).integers(-(high // 3), high, n))
        f, size = EliasFano.from_bytes((b := EliasFano.of(v).to_bytes()) + b"more")
        assert size == len(b) and (f.values() == v).all()
        assert [f.select(i) for i in range(n)] == v.tolist()
        for first, last in ((0, n), (0, n // 2), (n // 3, n), (n // 2, n // 2 + (n > 1)), (min(n, 256), n), (n, n)):
            assert f.selects(first, last).tolist() == v[first:last].tolist()
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.of(np.array([1])).select(1)
    ends = np.cumsum(np.full(10_000, 500))
    assert len(EliasFano.of(ends).to_bytes()) < 10_000 * 2


def test_pieces_of_words_keep_every_id():
    enc = token_files.Encoder(token_files.tokenizer_file(), memo=50)
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", " ", "\n", "'s", "'", "_", ".", "!", "1", "é", " ", "\x1d", "  ", "😀", "²", "<|endoftext|>"]) for _ in range(25))
        assert enc.encode([text])[0] == enc.whole(text)


def test_token_files_hold_what_the_library_returns(odd, documents, empty):
    t = token_files.tokenizer(token_files.tokenizer_file())
    for docs in (odd.filter("doc_id <> 7 OR doc_id IS NULL"), documents):
        found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files(docs, file_bytes=50_000).collect()}
        at = 0
        for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
            ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
            assert found[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    assert token_files.token_files(empty).count() == 0
    sevens = sorted((r.start, r.n_tokens) for r in token_files.token_files(odd.filter("doc_id = 7")).collect())
    assert len(sevens) == 3 and all(a + n == b for (a, n), (b, _) in zip(sevens, sevens[1:]))


def test_many_files_are_read_by_few_tasks(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text of ', id) AS text")
    folder = token_files.shared_dir(spark, "many")
    files = token_files.write_token_files(docs, folder, file_bytes=20)
    assert files.count() > 1000 and files.select("task").distinct().count() <= 4
    rows = token_files.read_token_files(files, folder)
    assert rows.rdd.getNumPartitions() <= 16
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in rows.collect())
    assert [d for d, _, _ in got] == list(range(3000)) and all(a + n == b for (_, a, n), (_, b, _) in zip(got, got[1:]))


def test_select_finds_a_document():
    parts = [np.arange(n, dtype="<u2").tobytes() for n in (3, 0, 700, 1)]
    f = token_files.TokenFile(token_files.pack([None, 5, 5, 9], parts, 2))
    assert [f.doc_ids(i, i + 2) for i in range(3)] == [[None, 5], [5, 5], [5, 9]] and f.ends_from(1, 3).tolist() == [3, 3, 703]
    assert f.doc_ids() == [None, 5, 5, 9] and [f.document(i).tobytes() for i in range(len(f))] == parts
