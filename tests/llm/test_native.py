from fractions import Fraction

import numpy as np

import corpus_pipeline
from rastermill.llm import mixing, queries, secret_scan, url_reputation

from . import fixture

DOCS = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR"


def same(got, want):
    return sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def unique_ids():
    seen, out = set(), []
    for r in fixture.documents():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def test_mixing_as_sql(spark, tmp_path):
    rows = fixture.documents()
    d = fixture.stored(tmp_path, documents=fixture.frame(spark, rows))
    names = "doc_id, size, source_size, target, source_blocks, taken"
    got = queries.op7_source_mixing(spark, d).select(*names.split(", ")).collect()
    want = fixture.duck(documents=(rows, DOCS)).sql(f"SELECT {names} FROM ({queries.OP7_SQL})").fetchall()
    assert same(got, want)
    assert queries.op7_source_mixing(spark, d).exceptAll(queries.op7_source_mixing(spark, d)).count() == 0


def test_mixing_deals_exact_disjoint_copies(spark):
    docs = fixture.frame(spark)
    rows = mixing.mix(docs, shards=8).collect()
    drawn = mixing.draw(docs, shards=8)
    assert drawn.columns == docs.columns
    count = {}
    for r in drawn.collect():
        count[r.doc_id, r.text] = count.get((r.doc_id, r.text), 0) + 1
    assert sum(count.values()) == sum(len(r.shards) for r in rows)
    assert all(0 <= s < 8 for r in rows for s in r.shards)
    assert mixing.mix(fixture.frame(spark, [])).count() == 0 and mixing.draw(fixture.frame(spark, [])).count() == 0


def test_shards_hold_disjoint_exact_runs_of_blocks(spark):
    """A source's blocks, pass by pass, are cut into runs, one a shard, whose lengths add up to its quota."""
    rows = mixing.mix(fixture.frame(spark), shards=8).collect()
    slots, ends = 16**mixing.BLOCK_DIGITS, {}
    for r in rows:
        place = [t * slots + int(r.key[: mixing.BLOCK_DIGITS], 16) for t in range(len(r.shards))]
        assert all(p < r.source_blocks for p in place) and r.shards == sorted(r.shards)
        ends.setdefault(r.source, []).extend(zip(place, r.shards, strict=True))
    for held in ends.values():
        assert [s for _, s in sorted(held)] == sorted(s for _, s in held)  # later blocks are never in an earlier shard
        assert len({p for p, _ in held}) == len(set(held))  # a block is in one shard


def test_draws_beyond_the_library(monkeypatch):
    rng = np.random.default_rng(2)
    big = [mixing.hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(30)]
    assert abs(np.mean(big) - 750_000) < 5 * 433 / 30**0.5 and all(0 <= x <= 10**6 for x in big)
    monkeypatch.setattr(mixing, "LIBRARY", 50)
    draws = np.array([mixing.draw_of_each(rng, np.array([30, 20, 50, 0, 100]), 60) for _ in range(3000)])
    assert (draws.sum(1) == 60).all() and (draws <= [30, 20, 50, 0, 100]).all()
    assert np.abs(draws.mean(0) - np.array([9, 6, 15, 0, 30])).max() < 0.3
    assert abs(draws[:, 4].var() - 60 * 0.25 * 140 / 199) < 1.5
    assert mixing.hypergeometric(rng, 40, 40, 0) == 0 and mixing.hypergeometric(rng, 40, 0, 7) == 7 and mixing.hypergeometric(rng, 40, 30, 70) == 40


def test_targets_reshare_until_none_is_above():
    got = mixing.targets([("a", 100), ("b", 1000), (None, 10), ("c", 0)], (3, 1, 2), Fraction(3, 2), 2)
    assert got[0][0] == 200 and got[2][0] == 20 and got[3][0] == 0
    assert abs(sum(t for t, _, _ in got) - 1665) < 1e-9 and got[1][:2] == (1445.0, 1)


def test_tree_keeps_quotas():
    ends = np.array(mixing.split_quotas([1000, 5, 0, 333], 16, 7))
    assert ends[:, -1].tolist() == [1000, 5, 0, 333] and (np.diff(ends, axis=1) >= 0).all()
    totals = np.diff(np.c_[np.zeros(4, int), ends], axis=1).sum(0)
    assert totals.max() - totals.min() <= 1


def test_secrets_as_sql(spark, tmp_path):
    rows = unique_ids()
    d = fixture.stored(tmp_path, documents=fixture.frame(spark, rows))
    names = "doc_id, n_assign, n_access, n_hex, base_sha256, spans"
    got = queries.op9_secret_scan(spark, d).select(*names.split(", ")).collect()
    assert same(got, fixture.duck(documents=(rows, DOCS)).sql(f"SELECT {names} FROM ({queries.OP9_SQL})").fetchall())
    spans = {r.doc_id: r.spans for r in got}
    assert spans[110].count("owned") == 1 and spans[113] == "" and "assign" in spans[112]
    assert spans[114].count("assign") == 1


def test_secrets_of_odd_rows_and_redaction(spark):
    docs = fixture.frame(spark)
    assert secret_scan.scan(docs).count() == docs.count()
    out = {(r.doc_id, r.text) for r in secret_scan.redact_documents(docs).collect()}
    assert (110, "[SECRET] [SECRET] [SECRET] [SECRET]".replace("[SECRET] [SECRET]", '[SECRET]" [SECRET]', 1)) in out
    assert (0, None) in out and len(out) == docs.distinct().count()
    assert secret_scan.scan(fixture.frame(spark, [])).count() == 0


def test_pipeline_redacts_keys_of_one_source_in_many_documents(spark):
    hot, mirrored, common = "hot_Qw12Er34Ty56Ui78Op90As", "mir_Zx98Cv76Bn54Mq32Lk10Jh", "all_Pl09Ok87Ij65Uh43Yg21Tf"
    rows = [(i, f"text {i} {hot} end", "en", "s1") for i in range(6)] + [(10 + i, f"copy {mirrored} end", "en", f"s{i}") for i in range(2)]
    rows += [(20 + i, f"example {i} {common} end", "en", f"s{i}") for i in range(2)] + [(30 + i, f"none {i} {hot[:-1]}x end", "en", None) for i in range(5)]
    out = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, fixture.frame(spark, rows), None).collect()}
    assert all(out[i] == f"text {i} [SECRET] end" for i in range(6)) and out[10] == out[11] == "copy [SECRET] end"
    assert all(out[20 + i] == f"example {i} {common} end" and out[30 + i] == f"none {i} [SECRET] end" for i in range(2))


PAGES = [(1, "http://A.Example.org/es/x?q#f"), (2, "https://sub.example.org/en/12"), (3, "no scheme"), (4, None), (5, "x://y.com/fr/7"), (6, "x://y.com/de/7"), (7, "http://bad.host.co.uk/en/3"), (8, "http://bad.host.co.uk"), (9, "a://b://c/d"), (10, "http://notexample.org/es/"), (11, "http://org"), (12, "http://É.COM/fr/")]


def test_urls_as_sql(spark, tmp_path):
    pages = PAGES + [(100 + i, f"http://spam.net/en/{i}") for i in range(40)] + [(200 + i, f"http://fine.net/en/{50 + i}") for i in range(40)]
    labels = [(i, int(i >= 50), None if i == 3 else int(i == 4)) for i in range(90)] + [(None, 1, 0)]
    frames = {"pages": spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, host string, by_host string"), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int")}
    d = fixture.stored(tmp_path, **frames)
    got = queries.op3_url_reputation(spark, d).select("page_id", "host", "path", "rule", "verdict").collect()
    con = fixture.duck(pages=(pages, "page_id BIGINT, url VARCHAR"), labels=([(a, b, c) for a, b, c in labels], "doc_id BIGINT, quality INT, toxic INT"))
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP3_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    by = {r.page_id: r for r in got}
    assert by[1].rule == "example.org/es/" and by[2].rule == "example.org/en/1" and by[3].host == by[4].host == "" and by[8].path == ""
    assert by[10].rule == "org/" and by[11].rule is None and by[12].host == "É.com" and by[9].host == "b:"
    assert by[100].verdict == "block" and by[200].verdict == "allow"


def test_urls_without_outcomes_or_rows(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    none = spark.createDataFrame([], "url string, good int")
    assert {r.verdict for r in url_reputation.judge(pages, none, []).collect()} == {"allow"}
    assert url_reputation.judge(pages.limit(0), none, queries.URL_RULES).count() == 0
