import gzip
import hashlib
import io
import itertools
import re
import zlib

import numpy as np

from rastermill.llm import language_id, quality, queries, syncmers, warc

from . import fixture


def test_anchors_by_brute_force():
    text = fixture.text(4, 200) + "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" + "日本語" * 20
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at, h = syncmers.text_anchors(text)
    inner = syncmers._grams(code.astype(np.uint64), syncmers.S)
    w = syncmers.K - syncmers.S + 1
    assert at.tolist() == [i for i in range(len(text) - syncmers.K + 1) if min(inner[i : i + w]) in (inner[i], inner[i + w - 1])]
    by_gram = {}
    for p, x in zip(at.tolist(), h.tolist(), strict=True):
        assert by_gram.setdefault(text[p : p + syncmers.K], x) == x
    assert len(set(by_gram.values())) == len(by_gram)


def test_long_texts_are_read_whole_and_alike(monkeypatch):
    text = fixture.text(9, 3000)
    whole = syncmers.text_anchors(text)
    monkeypatch.setattr(syncmers, "PIECE", 777)
    again = syncmers.text_anchors(text)
    assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()
    odd = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 5000)))
    assert [(b - a, n > 4900) for a, b, n in syncmers.match(odd, "xyz " * 10 + odd)] == [(40, True)]


def covered(a, b):
    """Share of a's code points in runs with b, one by one."""
    found = {p for x, _, n in syncmers.match(a, b) for p in range(x, min(x + n, len(a)))}
    return len(found) / len(a) if a else 1.0


def test_runs_are_found_at_every_place():
    r = np.random.default_rng(3)
    one, two = ("".join(map(chr, r.integers(97, 123, 400))) for _ in range(2))
    places = {(x, y) for x, y, n in syncmers.match(one, two + one + two + one) if n > 300}
    assert {(y - x) for x, y in places} == {400, 1200}
    assert {(y - x) for x, y, n in syncmers.match(two + one + one, one) if n > 300} == {-400, -800}
    assert syncmers.match("", one) == [] and syncmers.aligned(syncmers.text_anchors(one), syncmers.text_anchors(one), 400) > 0.95
    assert len(syncmers.match("a" * 20_000, "a" * 20_000)) == 1


def test_op1_contract(spark, tmp_path):
    rows = fixture.documents()
    d = fixture.stored(tmp_path, documents=fixture.frame(spark, rows).repartition(5))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        f, e, n = map(syncmers.fingerprint, (text, edited, after))
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), syncmers.written(f), syncmers.written(e), syncmers.likeness(f, e), syncmers.likeness(f, n), covered(text, edited)))
    got = [tuple(x) for x in queries.op1_syncmers(spark, d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert syncmers.compare_with_edits(fixture.frame(spark, [])).count() == 0
    assert syncmers.fingerprints(fixture.frame(spark)).count() == len(rows)
    alone = syncmers.compare_with_edits(fixture.frame(spark, [(7, "just one text of some length", "en", "s")])).collect()
    assert alone[0].near_next == 1.0


def test_likeness_follows_true_similarity():
    a, b = fixture.text(1, 3000), fixture.text(2, 3000)
    grams = lambda t: set(syncmers.text_anchors(t)[1].tolist())
    for other in (a, a[:9000] + b[:3000], a[:4000] + b, b):
        true = len(grams(a) & grams(other)) / len(grams(a) | grams(other))
        assert abs(syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(other)) - true) < 0.15


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    move, score = rng.random((3, 3)) + 0.1, rng.random((7, 3)) + 0.1
    want = np.zeros_like(score)
    for path in itertools.product(range(3), repeat=7):
        p = (np.full(3, 1 / 3) @ move)[path[0]] * score[0, path[0]]
        for a, b, s in zip(path, path[1:], score[1:], strict=False):
            p *= move[a, b] * s[b]
        for t, y in enumerate(path):
            want[t, y] += p
    assert np.allclose(language_id.forward_backward(score, np.array([7]), move), want / want.sum(1, keepdims=True))


def test_blocks_do_not_change_marginals(monkeypatch):
    rng = np.random.default_rng(2)
    lengths = np.array([1, 0, 32, 33, 500, 64, 2])
    move, score = rng.random((4, 4)) + 0.05, rng.random((lengths.sum(), 4)) + 0.01
    a = language_id.forward_backward(score, lengths, move)
    monkeypatch.setattr(language_id, "BLOCK", 10_000)
    assert np.allclose(a, language_id.forward_backward(score, lengths, move))


def test_switches_of_language_are_found():
    texts = {"aa": "the house and the garden with water over there", "bb": "das Haus und der Garten mit Wasser über dort"}
    field = language_id.train([((t + " ") * 8, y) for y, t in texts.items()], rounds=25)
    got = language_id.Reader(field).label("the house and the garden 12 das Haus und der Garten")
    assert [y for _, y, _ in got] == ["aa"] * 5 + ["bb"] * 5


def test_language_query_is_accurate_on_held_out(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op4_language_field(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [x for x in docs if zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert all(rows[x.doc_id].held_out == (x in held) for x in docs)
    assert np.mean([rows[x.doc_id].lang_pred == x.lang for x in held]) > 0.95


def test_language_of_odd_rows(spark):
    docs = fixture.frame(spark)
    field = language_id.fit(docs, queries.language_fold() != 1)
    got = language_id.predict(docs, field).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == "und" and by[0].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    empty = fixture.frame(spark, [])
    none = language_id.fit(empty, queries.language_fold() != 1)
    assert language_id.predict(empty, none).count() == 0 and {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.keep_identified(docs, field).columns == docs.columns


def test_rare_languages_are_sampled_in_full(spark, monkeypatch):
    """300,000 rows of one language, 300 of a second and 5 of a third: the bound is each language's own."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(language_id, "train", lambda sample: sample)
    lang = F.when(F.col("id") % 1000 == 7, "bb").when(F.col("id") % 60_000 == 11, "cc").otherwise("aa")
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"), lang.alias("lang"))
    got = language_id.fit(docs, F.lit(True), 30)
    assert {k: sum(y == k for _, y in got) for k in ("aa", "bb", "cc")} == {"aa": 10, "bb": 10, "cc": 5} and len(set(got)) == len(got)


def test_sample_is_the_first_rows_by_hash_of_the_id(spark):
    """Against all rows ranked; one id stands on many rows, some texts can't be used."""
    from pyspark.sql import functions as F

    rows = [(i if i % 3 else 0, f"text {i}" if i % 7 else "12 34", "ab"[i % 5 == 0]) for i in range(900)] + [(5000 + i, "x" * 20_001, "c") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ranked = sorted((r for r in docs.select("*", F.expr("pmod(xxhash64(doc_id), 1 << 30)").alias("draw")).collect() if r.text.startswith("text")), key=lambda r: (r.draw, r.doc_id, r.text))
    want = [(r.text, k) for k in "ab" for r in [r for r in ranked if r.lang == k][:20]]
    assert language_id.sample(docs, F.lit(True), 40) == want


def naive_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_op6_contract(spark, tmp_path):
    rows = fixture.documents() + [(200, "a b c d e f g h " * 5 + "\n\nx\n\nx\u2003y ##|", "en", "s"), (201, "w " * 9, "en", "s")]
    d = fixture.stored(tmp_path, documents=fixture.frame(spark, rows))
    got = queries.op6_weak_supervision(spark, d).collect()
    want = [(r[0], *naive_quality(r[1] or "")) for r in rows]
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert {r.doc_id: r.kept for r in got}[110 - 80]
    assert quality.judge(fixture.frame(spark, [])).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    truth, right = rng.random(40_000) < 0.7, np.array([[0.6, 0.99], [0.8, 0.8], [0.5, 0.9], [0.9, 0.95], [0.02, 0.99]])
    hit = rng.random((len(truth), 5)) < right[:, truth.astype(int)].T
    vote = np.where(hit == truth[:, None], 2, 1)
    vote[rng.random(vote.shape) < 0.3] = 0
    codes, counts = np.unique(vote @ 3 ** np.arange(4, -1, -1), return_counts=True)
    prior, rates = quality.estimate(dict(zip(codes.tolist(), counts.tolist(), strict=True)), 5)
    assert abs(prior - 0.7) < 0.05 and np.allclose(rates, right, atol=0.06)


PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "u\r\nX: y", "öther\r\n\r\n" * 300), (4, None, None), (5, "http://e", ""), (6, "http://a/1", "same"), (6, "http://a/1", "same"), (None, "http://n", "same"), (7, "big", "x" * 700_000)]


def naive_warc(rows, least):
    out = []
    for page_id, _, html in rows:
        b = (html or "").encode()
        peers = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        revisit = len(b) >= least and peers and page_id != max(peers)
        out.append((page_id, len(b), warc.digest(b), "revisit" if revisit else "response", max(peers) if revisit else None))
    return sorted(out, key=str)


def test_op5_contract(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "k", "z") for p in PAGES], "page_id long, url string, html string, kind string, path string")
    d = fixture.stored(tmp_path, pages=pages)
    assert sorted(map(tuple, queries.op5_warc_members(spark, d).collect()), key=str) == naive_warc(PAGES, 0)
    assert sorted(map(tuple, warc.archive(pages, least=3).collect()), key=str) == naive_warc(PAGES, 3)
    assert warc.archive(pages.limit(0)).count() == 0


def test_repeats_by_shuffle_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.archive(pages).collect()), key=str) == naive_warc(PAGES, 0)


def test_normaliser_cuts_members(tmp_path):
    from pyarrow import fs

    raw = [warc.record([("WARC-Type", "response")], bytes([i]) * (1 << i)) for i in range(20)]
    for stream in (gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw))):
        (tmp_path / "a.gz").write_bytes(stream)
        assert warc.normalise_file(fs.LocalFileSystem(), f"{tmp_path}/a.gz", f"{tmp_path}/b.gz") == 20
        index = np.frombuffer((tmp_path / "b.gz.idx").read_bytes()[16:], "<u8").reshape(-1, 2)
        data = (tmp_path / "b.gz").read_bytes()
        assert [gzip.decompress(data[a : a + n]) for a, n in index.tolist()] == raw
        assert gzip.GzipFile(fileobj=io.BytesIO(data)).read() == b"".join(raw)


def test_broken_archives_are_refused(tmp_path):
    import pytest
    from pyarrow import fs

    whole = gzip.compress(warc.record([("WARC-Type", "response")], b"x" * 5000))
    for bad in (whole[:-20], gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"), gzip.compress(b"junk\r\n\r\n")):
        (tmp_path / "a.gz").write_bytes(bad)
        with pytest.raises(ValueError):
            warc.normalise_file(fs.LocalFileSystem(), f"{tmp_path}/a.gz", f"{tmp_path}/b.gz")
