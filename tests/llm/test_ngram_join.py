import random
import re
import time

import numpy as np
import pytest

from rastermill.llm import ngram_join

from . import fixture


def naive(rows, n, percent):
    """(doc_id, size, component) by testing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                head[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(s), least[find(i)]) for i, s in enumerate(sets)), key=str)


def corpus(seed):
    r = random.Random(seed)
    rows, shared = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "oNE"), (5, "a b"), (6, "a b"), (7, "ÉA b"), (8, "éA b"), (None, "null id text one two"), (None, "null id text one two")], fixture.text(99, 60)
    at = 20
    for size in (4, 9, 12, 14, 20, 25, 33, 60, 150, 600):
        for _ in range(3):
            words = [f"{r.choice(fixture.WORDS)}{r.randrange(60)}" for _ in range(size)]
            for _ in range(6):
                new = list(words)
                for _ in range(r.randrange(0, max(2, size // 18))):
                    new[r.randrange(len(new))] = f"new{r.randrange(9999)}"
                if r.random() < 0.3:
                    new = new[: -max(1, size // 20)]
                text = " ".join(new)
                rows.append((at, text.upper() if r.random() < 0.2 else f"{shared} {text}" if r.random() < 0.2 else text))
                at += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,percent,block", [(3, 90, 1500), (5, 80, 7)])
def test_components_by_all_pairs(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    if block < 100:
        monkeypatch.setattr(ngram_join.fold, "__defaults__", (0,))
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = corpus(n)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, size int, node int").repartition(3)
    got = ngram_join.join_components(docs, n, percent).collect()
    assert sorted(map(tuple, got), key=str) == naive(rows, n, percent)


def test_one_of_each_component_stays(spark):
    docs = fixture.frame(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {3, 15, 102, None}.issubset(ids) and not {100, 101} & set(ids)
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_light_subsets_and_boundary():
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 19).astype(np.uint64))
    assert len(ngram_join.subset_signatures(a, 90)) == ngram_join.n_subsets(19, 90) == 20
    assert set(ngram_join.subset_signatures(a, 90).tolist()) & set(ngram_join.subset_signatures(a[1:], 90).tolist())
    sizes = {s: 100 for s in range(1, 200)}
    assert ngram_join.boundary_by_cost(sizes, 1.0, 90) < ngram_join.boundary_by_cost(sizes, 50.0, 90)


def joined(links):
    head = list(range(400))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in links:
        head[find(a)] = find(b)
    return [find(i) for i in range(400)]


@pytest.mark.parametrize("keep,step", [(4, 16), (0, 1), (2, 400)])
def test_lists_keep_every_possible_link(keep, step):
    rng = np.random.default_rng(4)
    p = np.zeros(400, ngram_join.POSTING)
    p["sig"], p["node"] = rng.integers(0, 20, 400), np.arange(400)
    p["low"] = p["high"] = rng.integers(5, 400, 400)
    halves = [ngram_join.fold(x, 80, keep) for x in (p[:150], p[150:])]
    sent = np.sort(np.concatenate([h[0] for h in halves]), order=("sig", "low"))
    links = [*ngram_join.scan((sent[i : i + step] for i in range(0, len(sent), step)), 80), *(h[1] for h in halves)]
    assert sum(map(len, links)) <= 2 * len(p)
    label = joined(np.concatenate(links).tolist())
    for i in range(400):
        for j in range(i):
            a, b = sorted((int(p["low"][i]), int(p["low"][j])))
            assert p["sig"][i] != p["sig"][j] or 100 * a < 80 * b or label[i] == label[j]


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_posted_block(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        size = int(rng.integers(1, 600))
        apart = ngram_join.most_apart(2 * size, percent)
        a = rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2)
        new = rng.integers(0, 1 << 63, int(rng.integers(0, apart + 1))).astype(np.uint64)
        b = np.unique(np.concatenate([a[int(rng.integers(0, max(1, apart - len(new) + 1))) :], new]))
        a = np.unique(a)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= percent * (len(a) + len(b) - shared):
            assert set(ngram_join.block_signatures(a, percent).tolist()) & set(ngram_join.block_signatures(b, percent).tolist())


def test_an_id_with_several_texts_loses_only_copies(spark):
    copy, own = fixture.text(1, 60), fixture.text(2, 60)
    rows = [(1, copy), (2, copy), (2, own), (3, own), (None, own), (4, ""), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, copy), (2, own), (None, own), (4, ""), (5, None)], key=str)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 8)
    r, base = random.Random(3), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.randrange(3)):
            words[r.randrange(120)] = f"x{r.randrange(999)}"
        for _ in range(7 if i % 9 == 0 else 0):
            words[r.randrange(120)] = f"far{r.randrange(999)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.join_components(docs, 3, 90).collect()), key=str) == naive(rows, 3, 90)


def chained_corpus():
    """Different texts of which most share some lines, so that lists chain them, with some near copies among them."""
    r, line = random.Random(8), [" ".join(f"line{k}word{i}" for i in range(14)) for k in range(6)]
    rows = []
    for i in range(160):
        words = [f"{i}own{r.randrange(9999)}" for _ in range(60)]
        parts = [" ".join(words[:30]), *r.sample(line, 4), " ".join(words[30:])]
        rows.append((2 * i, "\n".join(parts)))
        if i % 8 == 0:
            rows.append((2 * i + 1, rows[-1][1].replace(words[7], "another")))
    return rows


def test_texts_chained_by_shared_lines_are_not_all_tested_against_all(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 8)
    monkeypatch.setattr(ngram_join, "SKETCH_LEAST", 16)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows, read, tested = chained_corpus(), [], ngram_join._tested

    def counted(texts, *rest):
        read.append(texts.count())
        return tested(texts, *rest)

    monkeypatch.setattr(ngram_join, "_tested", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.join_components(docs, 5, 80).collect()), key=str) == naive(rows, 5, 80)
    assert 40 <= sum(read) <= 2 * len(rows)  # by blocks against blocks: 40 times the rows


def test_sketches_never_part_what_links():
    rng = np.random.default_rng(6)
    for _ in range(200):
        size = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[int(rng.integers(0, size // 4 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, size // 4 + 1))).astype(np.uint64)]))
        sets = [a, b, np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))]
        bits = np.frombuffer(b"".join(map(ngram_join.sketch, sets)), np.uint8).reshape(3, -1)
        apart = len(np.setxor1d(a, b))
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= apart
        shared = len(np.intersect1d(a, b))
        for one, other in (([0, 1, 2], [0, 1, 2]), ([0, 2], [1]), ([1], [0, 2])):
            label = ngram_join.alike(bits, np.array(list(map(len, sets))), np.array(one), np.array(other), 80)
            assert label[0] == label[1] or 100 * shared < 80 * (len(a) + len(b) - shared)


def test_a_filter_marks_all_that_is_sought_and_little_else(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 500)
    all_rows = spark.range(20_000).selectExpr("xxhash64(id) as key", "id")
    got = ngram_join._marked(all_rows, "key", all_rows.filter("id % 20 = 0"), "key")
    assert got.columns == ["key", "id", "__may"] and got.count() == 20_000
    assert got.filter("id % 20 = 0 and __may").count() == 1000 and got.filter("__may").count() < 1300


def test_candidates_are_dealt_in_parts_and_their_shuffles_freed(spark, monkeypatch):
    rows = chained_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("text")
    plan = ngram_join.Plan(5, 80, 0)

    def posted(part, parts):
        rounds = ngram_join._links_of_part(docs, plan, part, parts)
        return {tuple(r) for r in rounds.collect()}

    links, freed, manager = [posted(k, 3) for k in range(3)], [], spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def on_disk():
        return sum(f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_"))

    release = ngram_join.release

    def counted(session):
        freed.append(on_disk())
        release(session)

    monkeypatch.setattr(ngram_join, "release", counted)
    release(spark)
    time.sleep(2)
    before = on_disk()
    monkeypatch.setattr(ngram_join, "PASSES", 1)
    ngram_join.candidate_links(docs, plan)
    time.sleep(2)
    whole, left = freed.pop() - before, on_disk() - before
    monkeypatch.setattr(ngram_join, "PASSES", 3)
    got = {tuple(r) for r in ngram_join.candidate_links(docs, plan).collect()}
    assert all(links) and got == set().union(*links) and len(freed) == 3
    assert left < 0.2 * whole and freed[0] - before < 0.6 * whole
    assert {frozenset(v) for v in _groups(got)} == {frozenset(v) for v in _groups(posted(0, 1))}


def _groups(links):
    label = {}
    for a, b in links:
        one, other = label.setdefault(a, {a}), label.setdefault(b, {b})
        if one is not other:
            one |= other
            for x in other:
                label[x] = one
    return label.values()
