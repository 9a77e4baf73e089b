from __future__ import annotations

import hashlib

import numpy as np

import corpus_pipeline
from lethe.llm import bpe, quality
from lethe.llm.decontaminate import normalised
from tests.llm.test_duplicates import classes, lower, shingles


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(frame, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = {d: r.text or "" for d, r in docs.items() if model.score(np.array([quality.statistics(r.text or "")]))[0] >= quality.CUTOFF}
    groups: dict[str, int] = {}
    for d, t in left.items():
        groups[lower(t)] = max(d, groups.get(lower(t), d))
    left = {d: left[d] for d in groups.values()}
    ids = sorted(left)
    sets = [shingles(left[d], 5) for d in ids]
    label = classes(len(ids), [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    items = [t for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(t := normalised(r.text)) >= 40]
    left = {d: left[d] for i, d in enumerate(ids) if label[i] == i and not any(t in normalised(left[d]) for t in items)}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == set(left) and len(rows) > 100
    enc = bpe.encoding(bpe.rank_file(), bpe.split_pattern())
    for d, r in rows.items():
        ids = enc.encode_ordinary(left[d])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(left[d].encode()).hexdigest()


def test_stages_keep_the_columns(spark, odd, sf_dir):
    docs = odd.dropDuplicates(["doc_id", "text"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]
