from __future__ import annotations

import hashlib
import hmac
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lethe.functions.catalog import LEAST_LENGTH, PATTERNS
from lethe.operators import deid, detect, providers, report, resolve, spans, vault, verify
from lethe.plans import fixtures
from lethe.sources import sinks, tables
from lethe.streaming.detect import entity_stream, page_stream


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return len(digits) >= 13 and total % 10 == 0


def by_re(text: str) -> list[tuple]:
    out = []
    for i, p in enumerate(PATTERNS):
        for m in re.finditer(f"({p.before})({p.value})" + (f"(?={p.after})" if p.after else ""), text, re.I if p.ignore_case else 0):
            value = m.group(2) if p.tier == "core" else m.group(2).strip()
            if len(value) >= LEAST_LENGTH[p.tier] and (p.type != "CREDIT_CARD" or luhn(value)):
                out.append((i, m.start(2), m.end(2), value))
    return out


def test_patterns_match_python(spark, sf_dir):
    odd = [(-1000, 0, "é756.1234.5678.90 100\x1c452\x1c956 x\x01a@b.com\x02 😀 Ärztin: Anna Muster ſ"), (-1001, 0, "Name:\n\nAnna\tMuster\r\nDOB: 1/2/90\r\nAllergies: nuts"), (-1002, 0, "4111 1111 1111 1111 é")]
    pages = fixtures.pages(spark, sf_dir).union(spark.createDataFrame(odd, "doc_id long, page_num int, text string"))
    rows = detect.with_hits(pages).collect()
    seen = set()
    for r in rows:
        found = [(h.seq, h.start, h.end, h.text) for h in r.hits]
        assert found == by_re(r.text), r.doc_id
        seen |= {f[0] for f in found}
    assert seen == set(range(len(PATTERNS)))


def test_entities_do_not_overlap_or_repeat(spark, sf_dir):
    per: dict = {}
    for e in detect.entities(fixtures.pages(spark, sf_dir)).collect():
        per.setdefault(e.doc_id, []).append(e)
    for es in per.values():
        es.sort(key=lambda e: e.start)
        assert all(a.end <= b.start for a, b in zip(es, es[1:]))
        assert len({e.text.strip().lower() for e in es}) == len(es)
        assert all(e.score == 1.0 and e.source == "regex" for e in es)


def test_detection_needs_no_shuffle(spark, sf_dir):
    plan = detect.entities(tables.document_pages(spark.read.parquet(f"{sf_dir}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_model_hits_lose_ties_and_gain_confidence(spark):
    text = "Charles Muster wrote to info@example.com. Charles Muster and Charles Muster."
    pages = spark.createDataFrame([(1, 0, text)], "doc_id long, page_num int, text string")

    def tagger():
        return lambda t: [{"label": "B-PER", "score": 0.5, "start": m.start(), "end": m.end()} for m in re.finditer("Charles Muster", t)] + [{"label": "ORG", "score": 0.2, "start": 0, "end": 7}]

    found = {(e.entity_type, e.start): (e.score, e.source) for e in detect.entities(providers.tagged(pages, tagger)).collect()}
    assert found == {("PERSON", 0): (1.0, "ner"), ("EMAIL", 24): (1.0, "regex")}
    assert detect.entities(providers.tagged(pages, None)).count() == 1

    def broken():
        def fail(t):
            raise ValueError(t)

        return fail

    assert detect.entities(providers.tagged(pages, broken)).count() == 1


def test_verdicts_are_advisory(spark):
    pages = spark.createDataFrame([(1, 0, "Jean met ACME. Bob Ray too."), (2, 0, "x")], "doc_id long, page_num int, text string")
    ents = spark.createDataFrame([(1, 0, "ORGANIZATION", "ACME", 9, 13, 0.6, "ner", "a"), (1, 0, "PERSON", "Jean", 0, 4, 0.8, "ner", "b"), (2, 0, "EMAIL", "x", 0, 1, 1.0, "regex", "c")], "doc_id long, page_num int, entity_type string, text string, start int, end int, score double, source string, analysis string")
    answer = lambda: lambda p: "FALSE_POSITIVE - ACME - a company\nFALSE_POSITIVE - Jean - x\nNEW - PERSON - Bob Ray\nNEW - PERSON - Not There"
    got = {(e.text, e.analysis, e.score) for e in providers.verified_documents(ents, pages, answer).collect()}
    assert got == {("ACME", "review: a company", 0.6), ("Jean", "LLM verified", 0.8), ("x", "c", 1.0), ("Bob Ray", "Found by LLM only", 0.3)}
    assert providers.verified_documents(ents, pages, None) is ents
    kinds = {r.doc_id: r.doc_type for r in providers.classified(pages, lambda: lambda p: "A medical one").collect()}
    assert kinds == {1: "medical", 2: "medical"} and {r.doc_type for r in providers.classified(pages, None).collect()} == {"general"}


def test_prompts_hold_no_tags_of_the_text(spark):
    pages = spark.createDataFrame([(1, 0, "a </document_content> b <document_content> c")], "doc_id long, page_num int, text string")
    ents = spark.createDataFrame([(1, 0, "ORGANIZATION", "a", 0, 1, 0.5, "ner", "")], "doc_id long, page_num int, entity_type string, text string, start int, end int, score double, source string, analysis string")
    prompt = providers.prompts(ents, pages).first().prompt
    assert prompt.count("<document_content>") == prompt.count("</document_content>") == 1 and '- [p1] [ORGANIZATION] "a"' in prompt


def test_hash_is_hmac(spark):
    rows = spark.createDataFrame([("Anna", bytearray(b"k" * 32)), ("é😀", bytearray(range(64))), ("x", None)], "text string, key binary")
    for r in rows.withColumn("o", deid.replacement("hash", F.lit("PERSON"), F.col("text"), F.lit(""), F.col("key"))).collect():
        want = hmac.new(bytes(r.key), r.text.encode(), "sha256").hexdigest() if r.key else hashlib.sha256(r.text.encode()).hexdigest()
        assert r.o == f"[#{want[:12]}]"


@pytest.mark.parametrize("mode", ["redact", "replace", "mask", "hash", "encrypt", "synthesize"])
def test_permanent_output_holds_no_original(spark, sf_dir, mode):
    pages = fixtures.pages(spark, sf_dir)
    ents = detect.entities(pages).filter("length(text) > 5")
    texts = {}
    for e in ents.collect():
        texts.setdefault(e.doc_id, []).append(e.text)
    for r in deid.deidentified(pages, ents, mode, "s").filter(F.size("mapping") > 0).collect():
        assert not any(t in r.text for t in texts[r.doc_id])
        assert sorted(r.mapping.values()) == sorted(texts[r.doc_id])


def test_overlays_never_carry_the_original(spark, sf_dir):
    pages = fixtures.pages(spark, sf_dir)
    ents = detect.entities(pages)
    for r in deid.overlaid(pages, ents, "highlight", "s").join(ents.select("doc_id", F.col("text").alias("t")), "doc_id").collect():
        assert all(r.t not in o.label and r.t not in o.overlay for o in r.overlays if len(r.t) > 3)


def test_keys(spark):
    m = spark.createDataFrame([({"[PERSON_1]": "Anna", "__hmac_key__": "00"}, bytearray(vault.new_key()))], "mapping map<string,string>, key binary")
    r = m.withColumn("c", vault.sealed(F.col("mapping"), F.col("key"))).select("mapping", vault.opened(F.col("c"), F.col("key")).alias("same"), vault.opened(F.substring("c", 1, 20), F.col("key")).alias("cut"), vault.opened(F.col("c"), F.unhex(F.lit("00"))).alias("short"), deid.labels_of(F.col("mapping")).alias("labels")).first()
    assert r.same == r.mapping and r.cut is None and r.short is None and r.labels == ["[PERSON_1]"]
    assert vault.derived_key("p", b"s", 1000) == hashlib.pbkdf2_hmac("sha256", b"p", b"s", 1000, 32)


def test_parsers_and_gates(spark):
    files = spark.createDataFrame([("a.pdf", 10, bytearray(b"one|two")), ("b.PDF", 10**9, bytearray(b"x")), ("c.txt", 1, bytearray(b"x"))], "path string, length long, content binary")
    taken, refused = tables.uploads(files)
    assert [r.path for r in taken.collect()] == ["a.pdf"] and {r.reason for r in refused.collect()} == {"too large", "not a PDF"}
    assert [(r.page_num, r.text) for r in tables.parsed_pages(taken, lambda c: c.decode().split("|")).collect()] == [(0, "one"), (1, "two")]
    with pytest.raises(RuntimeError):
        tables.parsed_pages(taken, None)
    with pytest.raises(Exception, match="at most 1"):
        tables.parsed_pages(taken, lambda c: c.decode().split("|"), cap=1).count()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    entity_stream(page_stream(spark, str(tmp_path / "in"), files_at_a_time=1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = detect.entities(tables.document_pages(docs))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 0


def test_sinks(spark, sf_dir, tmp_path):
    pages = fixtures.pages(spark, sf_dir)
    ents = detect.entities(pages)
    out = deid.deidentified(pages, ents, "replace", "s")
    sinks.write_deidentified(out, str(tmp_path))
    sinks.write_vault(out.select("doc_id", "mapping").withColumn("key", F.lit(bytearray(32))), str(tmp_path))
    names = pages.select("doc_id", F.lit("a.pdf").alias("filename"))
    sinks.write_audit(report.audit(ents, names, "replace", "patterns", False), str(tmp_path))
    sinks.write_benchmark({"models": names.limit(2)}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "redacted")).columns == ["doc_id", "page_num", "text"]
    files = spark.read.parquet(str(tmp_path / "redaction_key")).withColumn("passphrase", F.lit(None).cast("string"))
    assert vault.read_key_files(files).filter("error IS NOT NULL").count() == 0 < files.count()
    assert "a.pdf" not in "".join(r.record for r in spark.read.parquet(str(tmp_path / "audit")).collect())


def test_nearest_occurrence(spark):
    cases = [("aXaXa", "a", 3, 2), ("abc", "z", 1, -1), ("", "a", 0, -1)]
    rows = spark.createDataFrame(cases, "t string, n string, r int, w int").withColumn("g", verify.nearest(F.col("t"), F.col("n"), F.col("r"))).collect()
    assert all(r.g == r.w for r in rows)


def test_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, 0, None), (None, 0, ""), (2, None, "a@b.com")], "doc_id long, page_num int, text string")
    assert [e.entity_type for e in detect.entities(pages).collect()] == ["EMAIL"]
    none = pages.filter("false")
    assert detect.entities(none).count() == 0 and deid.deidentified(none, detect.entities(none)).count() == 0


def test_page_additions(spark):
    pages = spark.createDataFrame([(1, 0, "Anna met Bob and Bob at Bahnhofstrasse near info@x.org")], "doc_id long, page_num int, text string")
    ents = spark.createDataFrame([(1, 0, "EMAIL", "info@x.org", 44, 54, 1.0, "regex"), (1, 0, "PERSON", "Anna", 0, 4, 0.8, "ner")], "doc_id long, page_num int, entity_type string, text string, start int, end int, score double, source string")
    raw = '{"additional": [{"text": "Bob", "type": "PERSON", "start": 16}, {"text": "x.org", "type": "ORG", "start": 0}, {"text": "anna", "type": "PERSON"}, {"text": "Bahnhofstrasse", "type": "ADDRESS"}, {"text": "Nobody", "type": "PERSON"}, {"text": ""}]}'
    answers = spark.createDataFrame([(1, 0, raw)], "doc_id long, page_num int, raw string")
    got = [(r.entity_type, r.text, r.start, r.end) for r in verify.page_additions(answers, pages, ents).collect()]
    assert got == [("PERSON", "Bob", 17, 20)]


def test_other_providers(spark):
    models = providers.Registry()
    assert models.loader() is None
    models.add("a", lambda: str)
    models.add("b", lambda: repr)
    models.use("c")
    assert models.active == "a" and models.available() == ["a", "b"]
    pages = spark.createDataFrame([(1, 0, "short"), (1, 1, "ein langer Text mit vielen Wörtern"), (2, 0, None)], "doc_id long, page_num int, text string")
    assert sorted((r.doc_id, r.page_num, r.lang) for r in providers.language(pages, lambda: lambda t: "de").collect()) == [(1, 0, "en"), (1, 1, "de"), (2, 0, "en")]
    images = spark.createDataFrame([(1, 0, "has text", bytearray(b"")), (1, 1, " ", bytearray(b"seen")), (1, 2, None, bytearray(b""))], "doc_id long, page_num int, text string, content binary")

    def broken():
        return lambda c: 1 / 0

    read = providers.read_pages(images, [broken, lambda: lambda c: bytes(c).decode()])
    assert sorted((r.page_num, r.text, r.is_ocr) for r in read.collect()) == [(0, "has text", False), (1, "seen", True), (2, "", True)]
    boxed = spark.createDataFrame([(1, 0, True, [1]), (1, 1, True, [2]), (1, 2, False, [3])], "doc_id long, page_num int, is_ocr boolean, word_boxes array<int>")
    flat = deid.flattened(boxed, boxed.filter("page_num <> 1").select("doc_id", "page_num"))
    assert sorted((r.page_num, r.word_boxes) for r in flat.collect()) == [(0, None), (1, [2]), (2, [3])]


def hit_frame(spark, lists: dict[int, list[tuple]]):
    rows = [(d, i, s, e, p, f"t{s % 3}") for d, hits in lists.items() for i, (s, e, p) in enumerate(hits)]
    x = spark.createDataFrame(rows, "doc_id long, seq int, start int, end int, priority int, text string")
    one = F.struct((-F.col("priority")).alias("neg"), F.lit(0).alias("rank"), "start", "seq", "end", "text", F.lit("T").alias("type"), "priority", F.lit("regex").alias("source"), F.lit(None).cast("double").alias("score"))
    return x.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).cast(f"array<{spans.HIT}>").alias("hits"))


def test_span_merge_in_clusters_is_the_greedy_one(spark, monkeypatch):
    monkeypatch.setattr("lethe.functions.text.BLOCK", 4)
    rng = random.Random(7)
    lists = {d: [((s := rng.randrange(60)), s + rng.randrange(0, 9), rng.randrange(1, 5)) for _ in range(rng.randrange(1, 30))] for d in range(150)}
    for r in hit_frame(spark, lists).select("doc_id", resolve.spans_merged(F.col("hits")).alias("kept"), resolve.merged(F.col("hits")).alias("merged")).collect():
        order = sorted((-p, 0, s, i, e) for i, (s, e, p) in enumerate(lists[r.doc_id]))
        kept: list[tuple] = []
        for x in order:
            if not any(x[2] < y[4] and y[2] < x[4] for y in kept):
                kept.append(x)
        assert [(h.start, h.seq) for h in r.kept] == [(x[2], x[3]) for x in kept]
        first = {}
        for x in kept:
            first.setdefault(x[2] % 3, x)
        assert sorted(h.seq for h in r.merged) == sorted(x[3] for x in first.values()) and [h.start for h in r.merged] == sorted(h.start for h in r.merged)


def test_a_page_of_very_many_hits_takes_linear_time(spark):
    text = " ".join(f"a{i}@example.com" for i in range(20_000))
    pages = spark.createDataFrame([(1, 0, text)], "doc_id long, page_num int, text string")
    detect.entities(pages.limit(0)).count()
    start = time.monotonic()
    assert detect.entities(pages).count() == 20_000 and time.monotonic() - start < 20


def test_pages_are_rewritten_without_an_exchange(spark, sf_dir):
    pages = fixtures.pages(spark, sf_dir)
    for one, other, column in ((deid.deidentified_pages(pages, "mask", "s"), deid.deidentified(pages, detect.entities(pages), "mask", "s"), "mapping"), (deid.overlaid_pages(pages, "replace", "s"), deid.overlaid(pages, detect.entities(pages), "replace", "s"), "overlays")):
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.replace("RoundRobinPartitioning", "") or plan.count("Exchange") == plan.count("RoundRobinPartitioning")
        say = lambda df: sorted((r.doc_id, r.text, str(sorted(r[column].items()) if column == "mapping" else r[column])) for r in df.select("doc_id", "text", column).collect())  # noqa: E731, B023
        assert say(one) == say(other)


def test_hash_keys_are_stored_once(spark):
    keys = deid.document_keys(spark.range(5).select(F.col("id").alias("doc_id")))
    first = {r.doc_id: bytes(r.key) for r in keys.collect()}
    assert first == {r.doc_id: bytes(r.key) for r in keys.collect()} and len(set(first.values())) == 5 and all(len(k) == 32 for k in first.values())


def test_lists_are_merged_by_page(spark):
    names = "doc_id long, page_num int, entity_type string, text string, start int, end int, score double, source string"
    a = spark.createDataFrame([(1, 1, "A", "a", 5, 9, 0.5, "x"), (1, 0, "A", "b", 0, 4, 0.9, "x")], names)
    b = spark.createDataFrame([(1, 1, "B", "c", 7, 12, 0.8, "y"), (1, 1, "B", "d", 20, 22, 0.1, "y"), (1, 0, "B", "e", 0, 4, 0.9, "y")], names)
    assert [r.text for r in resolve.lists_merged(a, b).orderBy("page_num", "start").collect()] == ["b", "c", "d"]
    assert resolve.lists_merged(a) is a


def test_benchmark_tables(spark, tmp_path):
    ents = spark.createDataFrame([(1, "EMAIL"), (1, "EMAIL"), (2, "PERSON")], "doc_id long, entity_type string")
    docs = spark.createDataFrame([(1, 2, 3.0), (2, 1, 1.0), (3, 0, 0.5)], "document long, pages long, seconds double")
    runs = report.model_runs(ents, docs, "m")
    got = {r.document: (r.ord, r.entities, r.types, r.seconds_per_page) for r in runs.collect()}
    assert got == {1: (0, 2, {"EMAIL": 2}, 1.5), 2: (1, 1, {"PERSON": 1}, 1.0), 3: (1, 0, {}, 0.5)}
    sinks.write_benchmark(report.bench_tables(runs, ("EMAIL", "PERSON")), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/types.json").first().EMAIL == 2 and spark.read.option("header", True).csv(f"{tmp_path}/documents.csv").count() == 3


def test_failed_windows_are_a_column(spark):
    pages = spark.createDataFrame([(1, 0, "fine Anna"), (2, 0, "bad"), (3, 0, "")], "doc_id long, page_num int, text string")

    def tagger():
        def tag(t):
            if "bad" in t:
                raise RuntimeError
            return [{"label": "B-PER", "score": 0.9, "start": 5, "end": 9}, {"label": "B-PER", "score": 0.1, "start": 0, "end": 4}]

        return tag

    got = {r.doc_id: ([h.text for h in r.ner], r.ner_warnings) for r in providers.tagged(pages, tagger).collect()}
    assert got == {1: (["Anna"], []), 2: ([], ["a window was not tagged: RuntimeError"]), 3: ([], [])}


def test_a_document_that_cannot_be_read_has_an_error(spark):
    found = spark.createDataFrame([("a", bytearray(b" x \f y")), ("b", bytearray(b"\xff")), ("c", bytearray(b"\f\f\f"))], "path string, content binary")
    rows = {r.path: (r.pages, r.error) for r in tables.parsed_documents(found, lambda c: c.decode().split("\f"), 3).collect()}
    assert rows == {"a": (["x", "y"], None), "b": ([], "a document was not read: UnicodeDecodeError"), "c": ([], "a document has 4 pages; at most 3 are read")}


def test_a_folder_of_part_files_is_one_dataset(spark, tmp_path):
    top = tmp_path / "in.parquet"  # the folder's own name does not count
    for at, n in {"a.parquet": 1, "b.parquet/part-0.parquet": 2, "b.parquet/k=1/part-1": 3, "b.parquet/_SUCCESS": 9, "sub/c.parquet": 4, "sub/d.parquet/x.parquet/y": 5, "e.txt": 6}.items():
        (top / at).parent.mkdir(parents=True, exist_ok=True)
        (top / at).write_bytes(b"x" * n)
    listed = lambda *a: {r.path.removeprefix(f"file:{top}/"): r.length for r in tables.datasets(spark, f"{top}/", *a).collect()}
    assert listed() == {"a.parquet": 1, "b.parquet": 5, "sub/c.parquet": 4, "sub/d.parquet": 5}
    assert listed("*.parquet", False) == {"a.parquet": 1, "b.parquet": 5}
    assert listed("{c,e}.*") == {"sub/c.parquet": 4, "e.txt": 6} and listed("none*") == {}


def test_a_flat_scan_takes_no_file_of_a_subfolder(spark, tmp_path):
    for at in ("a b%2F.pdf", "k=1/b.pdf", "k=1/l=2/c.pdf", "sub/d.pdf", "e.txt"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(at.encode())
    found = tables.files(spark, str(tmp_path), recursive=False)
    assert [(r.path, bytes(r.content)) for r in found.collect()] == [(f"file:{tmp_path}/a b%2F.pdf", b"a b%2F.pdf")]
    assert sorted(bytes(r.content) for r in tables.files(spark, str(tmp_path)).collect()) == [b"a b%2F.pdf", b"k=1/b.pdf", b"k=1/l=2/c.pdf", b"sub/d.pdf"]
