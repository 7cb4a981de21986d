import re
from fractions import Fraction

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rastermill.llm import language_id, mixing, queries

from . import fixture
from .test_ngram_join import naive


def test_stages_by_brute_force(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = fixture.frame(spark, [r for r in fixture.documents() if r[0] in (0, 1, 2, 110)]).select(*source.columns)
    docs = source.unionAll(odd.withColumn("doc_id", odd.doc_id + 10_000))
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "redact_secrets", "mix_sources", "pack_sequences"]
    stages = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, None).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        stages.append(docs.collect())
        assert k == 4 or docs.columns == columns
    # language: whole rows stay, und goes, and those kept are those the operator scores
    first = {r.doc_id: r for r in stages[0]}
    assert all(before[i] == r for i, r in first.items()) and not {10_000, 10_001, 10_002} & set(first) and len(first) > 0.9 * len(before)
    # one of each component
    parts = naive([(i, r.text) for i, r in first.items()], 5, 80)
    assert sorted(r.doc_id for r in stages[1]) == sorted({c for _, _, c in parts})
    assert all(first[r.doc_id] == r for r in stages[1])
    # redaction
    kept = {r.doc_id: r for r in stages[1]}
    for r in stages[2]:
        assert r.n_chars == len(r.text) and (r.text == kept[r.doc_id].text or "[SECRET]" in r.text)
        assert not [m for m in re.finditer(r"[0-9a-f]+", r.text) if len(m[0]) >= 32]
    assert len(stages[2]) == len(kept) and any("[SECRET]" in r.text for r in stages[2])
    # mixing
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in stages[2]}
    of = {r.doc_id: r.source for r in stages[2]}
    totals = {}
    for i, n in size.items():
        totals[of[i]] = totals.get(of[i], 0) + n
    aims = dict(zip(totals, mixing.targets(list(totals.items()), (3, 1, 2), Fraction(3, 2), 2), strict=True))
    times, taken = {}, dict.fromkeys(totals, 0)
    for r in stages[3]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        taken[r.source] += size[r.doc_id]
    assert max(times.values()) <= 2
    for s, (target, *_) in aims.items():
        assert abs(taken[s] - target) <= max(n for i, n in size.items() if of[i] == s)
    # packing
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[3])
    assert sum(r.length for r in stages[4]) == tokens
    assert len({r.sequence_id for r in stages[4]}) <= 1.02 * tokens / 4096 + 1


def test_run_returns_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns) and rows.count() > 0


def test_rejection_follows_the_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    field = language_id.fit(docs, queries.language_fold() != 1)
    good = {r.doc_id for r in language_id.predict(docs, field).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in language_id.keep_identified(docs, field, 0.5).collect()} == good
    assert np.isfinite(field.weights).all()
