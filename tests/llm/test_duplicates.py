from __future__ import annotations

import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from lethe.llm import decontaminate, exact, near_dup
from lethe.llm.common import clean, stored
from lethe.llm.graph import components
from lethe.llm.shingles import PASS_BYTES, shingle_sets
from lethe.llm.signature_tree import overlap, similar


def lower(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingles(t: str | None, k: int) -> set:
    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(n: int, links) -> list[int]:
    p = list(range(n))

    def root(x: int) -> int:
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        p[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize(("bits", "capacity"), [(64, 50_000), (64, 3), (4, 3)])
def test_exact_dedup(odd, documents, bits, capacity, monkeypatch):
    monkeypatch.setattr("lethe.llm.common.HUB_ROWS", 2)
    for docs in (odd, documents):
        rows = exact.exact_dedup(docs, capacity=capacity, hash_bits=bits).collect()
        groups: dict[str, list] = {}
        for r in docs.collect():
            groups.setdefault(lower(r.text), []).append(r.doc_id)
        want = sorted((str(i), str(max(g, key=lambda x: (x is not None, x or 0))), len(g)) for g in groups.values() for i in g)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == want
        assert sum(r.kept for r in rows) == len(groups)
        assert exact.exact_kept(docs).count() == len(groups) and exact.exact_kept(docs).columns == docs.columns


def test_exact_dedup_of_nothing(empty):
    assert exact.exact_dedup(empty).count() == 0 and exact.exact_kept(empty).count() == 0


def test_directory_doubles_where_buckets_overflow():
    rng = np.random.default_rng(4)
    keys = np.sort(np.concatenate([rng.integers(0, 1 << 64, 3000, dtype=np.uint64) >> np.uint64(16), np.full(300, 7, np.uint64)]))
    d = exact.Directory.of(keys, 120, 16)
    assert d.depth > 4 and len(d.slots()) == 1 << d.depth and sum(d.rows) == len(keys)
    assert sorted({b for _, b in d.slots()}) == list(range(len(d.leaves))) and [s for s, _ in d.slots()] == list(range(1 << d.depth))
    at = 0
    for (prefix, depth), n in zip(d.leaves, d.rows, strict=True):
        own = keys[at : at + n]
        assert n <= 120 or len(set(own.tolist())) == 1
        assert not depth or all((k << 16 & (1 << 64) - 1) >> 64 - depth == prefix for k in own.tolist())
        at += n


def test_index_is_in_key_order_with_chains(spark, monkeypatch):
    rng = random.Random(3)
    hs = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(400)] + [11] * 6
    frame = spark.createDataFrame([(h, bytes([i % 256, i // 256]), 1, (i, i)) for i, h in enumerate(hs)], "h long, sha binary, n long, last struct<doc_id:long,uid:long>").repartition(5)
    monkeypatch.setattr(exact, "OWNER_BITS", 4)
    rows = exact.indexed(frame, 10).collect()
    assert sorted(r.h for r in rows) == sorted(hs) and sorted(r.chain_no for r in rows if r.h == 11) == [1, 2, 3, 4, 5, 6]
    ranges: dict[int, list] = {}
    for r in rows:
        ranges.setdefault(r.h % (1 << 64) >> 60, []).append(r)
    assert len(ranges) == 16
    for part in ranges.values():
        part.sort(key=lambda r: (r.h % (1 << 64)))
        assert [r.bucket for r in part] == sorted(r.bucket for r in part) and max(Counter(r.bucket for r in part).values()) <= 10


def test_exact_dedup_at_many_owners_collects_little(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('text ', cast(id % 20000 AS string)) AS text")
    rows = exact.exact_dedup(docs, capacity=2)
    assert rows.filter("kept").count() == 20_000 and rows.agg({"group_size": "max"}).first()[0] == 2
    index = [f for f in rows.inputFiles() if "lethe-index" in f]
    assert 0 < len(index) < 100


def test_callers_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6), (1, "a", 5, 6), (2, "b", 7, 8)], "doc_id long, text string, again_id int, again_hash int")
    assert sorted(tuple(r) for r in exact.exact_kept(docs).collect()) == [(1, "a", 5, 6), (2, "b", 7, 8)]


def test_shingle_sets():
    rng = random.Random(2)
    texts = [b"", b"  ", b"A", b"A b", b"the the THE the the", "é ü\x0b x\x1cy z \xa0 q".encode()] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))).encode() for _ in range(200)]
    assert [len(s) for s in shingle_sets(texts, 4)] == [len(shingles(t.decode(), 4)) for t in texts]
    long = b" ".join([b"aa", b"bb", b"c"] * (PASS_BYTES // 7))
    assert len(long) > PASS_BYTES and len(next(shingle_sets([long], 4))) == 3


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(1)
    for _ in range(25):
        n, sets = int(rng.integers(2, 90)), []
        while len(sets) < n:
            if sets and rng.random() < 0.7:
                b = sets[rng.integers(len(sets))]
                k = max(1, int(len(b) * rng.random() * 0.12))
                sets.append(np.unique(np.concatenate([rng.permutation(b)[k:], rng.integers(0, 2**63, k, dtype=np.uint64)])))
            else:
                sets.append(np.unique(rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64)))
        links = [(i, j) for i in range(n) for j in range(i + 1, n) if 100 * (o := overlap(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]) - o)]
        assert classes(n, similar(sets, 85, 100)) == classes(n, links)
        cut = int(rng.integers(0, n + 1))
        assert classes(n, similar(sets, 85, 100, split=cut)) == classes(n, [(i, j) for i, j in links if i < cut <= j])


@pytest.mark.parametrize("n", [4000, 16_000])
def test_short_sets_that_share_one_token_cost_little(n):
    rng = np.random.default_rng(0)
    sets = [np.unique(np.append(rng.integers(0, 2**63, 11, dtype=np.uint64), np.uint64(5))) for _ in range(n)]
    sets[n // 2] = sets[7].copy()
    start = time.monotonic()
    assert similar(sets, 85, 100) == [(7, n // 2)] and time.monotonic() - start < 3 * n / 4000


def test_hubs_are_done_apart(spark, monkeypatch):
    monkeypatch.setattr("lethe.llm.common.HUB_ROWS", 5)
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 300)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(700, edges)
    assert all(want[n] == label for n, label in got.items()) and len(got) >= 360


def test_names_that_clash_are_replaced(spark, monkeypatch):
    right = near_dup.names
    monkeypatch.setattr(near_dup, "names", lambda sets, seed=0: right(sets, seed) if seed else (np.zeros(len(sets), np.int64), right(sets)[1]))
    docs = spark.createDataFrame([(i, f"text number {i} of a few words that are not like others {i * 7}") for i in range(6)] + [(9, "text number 3 of a few words that are not like others 21")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.shingle_join(docs, 4, 85, 100).collect()}
    assert got == {**{i: i for i in range(6)}, 9: 3}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, 400 + i) for i in range(50)] + [(i, i + 1) for i in range(500, 540)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(600, edges)
    assert all(want[n] == label for n, label in got.items()) and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def near(rng: random.Random) -> list[tuple[int, str]]:
    """Families of edited copies with a shared passage, among other texts."""
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 150))] + passage.split() * rng.randrange(2)
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate([*out, out[0].upper(), "", " "]))


@pytest.mark.parametrize(("k", "num", "unit", "group"), [(4, 85, 2_000_000, 2_000_000), (5, 80, 400, 500), (4, 85, 3000, 5000)])
def test_jaccard_join(spark, documents, k, num, unit, group, monkeypatch):
    monkeypatch.setattr("lethe.llm.common.HUB_ROWS", 2000 if unit > 10_000 else 2)
    for docs in (spark.createDataFrame(near(random.Random(9)), "doc_id long, text string").repartition(5), documents):
        texts = {r.doc_id: shingles(r.text, k) for r in docs.collect()}
        ids = sorted(texts)
        links = [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if texts[ids[i]] and 100 * len(texts[ids[i]] & texts[ids[j]]) >= num * len(texts[ids[i]] | texts[ids[j]])]
        label = classes(len(ids), links)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.shingle_join(docs, k, num, 100, unit_tokens=unit, group_tokens=group).collect()}
        assert got == {d: (len(texts[d]), ids[label[i]]) for i, d in enumerate(ids)}


def test_jaccard_join_on_odd_tables(odd, empty):
    rows = near_dup.shingle_join(odd).collect()
    assert len(rows) == 10 and sum(r.n_shingles == 0 for r in rows) == 3
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert near_dup.shingle_join(empty).count() == 0
    assert near_dup.near_dup_kept(odd.dropDuplicates(["doc_id", "text"])).count() == 8


def test_edit_distance_of_the_best_substring():
    def brute(p: bytes, t: bytes) -> int:
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            prev, row = row, [i] + [0] * len(t)
            for j in range(1, len(t) + 1):
                row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1]))
        return min(row)

    rng = random.Random(8)
    for _ in range(300):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in "pt")
        assert decontaminate.best_match(p, t)[0] == brute(p, t)


def test_decontamination(spark, documents, sf_dir, odd, empty):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(documents, bench).collect()}
    items = {r.item_id: decontaminate.normalised(r.text) for r in bench.collect()}
    held = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if t in decontaminate.normalised(r.text)}
    assert held and held <= hits and {d for d, _ in hits} == {d for d, _ in held}
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(documents, bench, block_bytes=2000).collect()} == hits
    assert decontaminate.without_hits(documents, bench).count() == documents.count() - len({d for d, _ in hits})
    assert decontaminate.benchmark_hits(odd, bench).count() == 0 == decontaminate.benchmark_hits(empty, bench).count()
    none = bench.filter("false").union(spark.createDataFrame([(1, None), (2, ""), (3, "short")], bench.schema))
    assert decontaminate.benchmark_hits(documents, none).count() == 0 and decontaminate.without_hits(odd, none).count() == 10


def edited(rng: random.Random, s: bytes, edits: int) -> bytes:
    out = bytearray(s)
    for _ in range(edits):
        p, way = rng.randrange(len(out)), rng.random()
        if way < 0.5:
            out[p] = rng.choice(b"abcdefghijklmnopqrstuvwxyz ")
        elif way < 0.75:
            del out[p]
        else:
            out.insert(p, rng.choice(b"abcdefghijklmnopqrstuvwxyz "))
    return bytes(out)


@pytest.mark.parametrize("length", [20, 40, 60, 80, 150, 400])
@pytest.mark.parametrize("share", [0.0, 0.05, 0.1, 0.15])
def test_recall_by_length_and_edits(length, share):
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n // 2)).encode()[:n]
    bodies = [draw(length - 2).replace(b"  ", b" z").strip().ljust(length, b"y") for _ in range(100)]
    items = decontaminate.Items(list(range(100)), bodies)
    texts = [draw(rng.randrange(200)) + b" " + edited(rng, b, int(share * len(b))) + b" " + draw(rng.randrange(200)) for b in bodies]
    hits = items.search([*texts, draw(5000)])
    if length >= decontaminate.LEAST_ITEM or not share:
        assert sum(i in h for i, h in enumerate(hits[:-1])) >= (100 if not share else 95) and not hits[-1]
    for i, h in enumerate(hits[:-1]):
        for j, (places, _, _, distance) in h.items():
            assert distance == decontaminate.best_match(bodies[j], texts[i])[0] <= items.allowed(j) and (j != i or places == 1)


def test_places_of_exact_and_edited_copies():
    rng = random.Random(5)
    for length in (45, 90, 300):
        item = bytes(rng.choice(b"abcdefghijklmnop    ") for _ in range(length)).strip()
        other = lambda: bytes(rng.choice(b"abcdefghijklmnop    ") for _ in range(300))
        near = edited(rng, item, int(0.05 * length))
        items = decontaminate.Items([7], [item])
        for parts, n in (([item, near], 2), ([near, near], 2), ([item, item, near], 3), ([item], 1)):
            text = other() + b" " + b"".join(p + b" " + other() + b" " for p in parts)
            for body in (text, b"".join(p + b" " for p in parts)):
                assert items.search([b"x", body])[1][0][0] == n


def test_hits_against_brute_force(spark):
    rng = random.Random(12)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnop   ") for _ in range(n))
    bench = [(f"q{i}", draw(n).strip() or "a") for i, n in enumerate((45, 62, 90, 130, 260))] + [("none", None), ("empty", ""), ("twice", "same item as another " * 3), ("again", "SAME item  as another " * 3)]
    said = [edited(rng, (bench[i % 5][1]).encode(), int(0.11 * len(bench[i % 5][1]))).decode("utf-8", "replace") for i in range(20)]
    texts = [draw(80) + " " + t + " " + draw(80) for t in said] + [said[0], said[1] + said[2], "x same ITEM as another same item as another same item\nas another", "", None, draw(3000), "-" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(bench, "item_id string, text string")
    rows = decontaminate.benchmark_hits(docs, frame)
    assert dict(rows.dtypes)["item_id"] == "string"
    got = {(r.doc_id, r.item_id): r.distance for r in rows.collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, b in ((i, decontaminate.normalised(b)) for i, b in bench):
            if b and (x := decontaminate.best_match(b, decontaminate.normalised(t))[0]) <= int(decontaminate.EDITS * len(b)):
                want[d, i] = x
    assert got == want and len(want) > 20
    assert sorted(r.doc_id for r in decontaminate.without_hits(docs, frame).collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})


def test_texts_of_one_symbol_and_very_long_ones():
    items = decontaminate.Items([1, 2], [b"-" * 100, b"the item that stands in the middle of a very long text, at a place of which no more is known than that it is there"])
    body = b"-" * 200_000 + b" " + items.bodies[1] + b" " + b"word " * 400_000
    found = items.search([body, b"- " * 5000])
    assert set(found[0]) == {0, 1} and found[0][1][3] == 0 and found[0][1][1] == 200_001 and not found[1]


def test_a_block_travels_as_its_text():
    import pickle

    items = decontaminate.Items(list(range(1000)), [b"%d " % i * 30 for i in range(1000)])
    items.build()
    assert len(pickle.dumps(items)) < 1.3 * sum(map(len, items.bodies))


def test_short_items_are_found_exactly(spark):
    bench = spark.createDataFrame([(1, "What is  the capital of France?"), (2, "Paris"), (3, "法国的首都"), (4, "Él come"), (5, "is"), (6, ""), (7, "x" * 39)], "item_id long, text string")
    texts = ["Q: what is the\ncapital of france? A: (paris).", "a parish, comparison; unisparis", "今天法国的首都是", "Pues él come.", "miél come él comen", "x" * 39 + " " + "x" * 39, "x" * 40, "paris paris", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.places, r.start, r.length, r.distance) for r in decontaminate.benchmark_hits(docs, bench).collect()}
    assert found == {
        (0, 1): (1, 3, 31 - 1, 0), (0, 2): (1, 38, 5, 0), (0, 5): (1, 8, 2, 0), (2, 3): (1, 6, 15, 0), (3, 4): (1, 5, 8, 0), (5, 7): (2, 0, 39, 0), (7, 2): (2, 0, 5, 0),
    }
    assert sorted(r.doc_id for r in decontaminate.without_hits(docs, bench).collect()) == [1, 4, 6, 8, 9]


def test_windows_are_compared_exactly():
    rng = random.Random(9)
    for n in (1, 13, 63, 64):
        p, r = (rng.randbytes(n).translate(bytes(b"abc"[i % 3] for i in range(256))) for n in (n, 90))
        row = lambda x: np.frombuffer(x, np.uint8)[None] % 64
        assert decontaminate.least_distances(row(p), np.array([n]), row(r))[0] == decontaminate.best_match(p, r)[0]


def test_clean_deletes_what_operators_left(spark, odd):
    out = stored(odd.select("doc_id"), "kept")
    folder = out.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.exists(folder)
    clean(spark)
    assert not os.path.exists(folder)
