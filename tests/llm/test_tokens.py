import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rastermill.llm import packing, queries, token_files, tokens

ODD = ["", " ", "a  b", "a\tb  c", "\n\nx", "x \n y", " lead", "trail ", "a b c", "á ́b", "Don't WE'LL it's", "été", "<|endoftext|> x", "x<|endoftext|>y", "　日本 語", "ΑΣ ΑΣ.", "\0null \0", "\x1cfs x", "12 345\r\nq", "The the THE, tHe. the### ###", "a\0b \0. x\0.", "İ. ß# ǰ.", None]
DOCS = [(i, t) for i, t in enumerate(ODD)] + [(100, "word " * 9000), (101, "dup text"), (101, "dup text"), (None, "no id")]


def plain(name):
    """The library's own plain call."""
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def encoded(enc, texts):
    ids, size = enc(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] if len(size) else []


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts_as_the_library(name):
    texts = [t for _, t in DOCS]
    enc = tokens.Encoder(public_tokenizers.path(name))
    assert enc.known
    assert encoded(enc, texts) == encoded(enc, texts) == [plain(name)(t) for t in texts]
    assert encoded(enc, []) == [] and encoded(enc, [None, ""]) == [[], []]


@pytest.mark.parametrize("name", NAMES)
def test_special_strings_as_text(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    text = "a <|endoftext|> b<|startoftext|>"
    assert encoded(tokens.Encoder(public_tokenizers.path(name), special_as_text=True), [text]) == [t.encode(text, add_special_tokens=False).ids]
    assert encoded(tokens.Encoder(public_tokenizers.path(name)), [text]) == [plain(name)(text)]


@pytest.mark.parametrize("name", NAMES)
def test_small_slices_and_a_small_memory_change_nothing(name, monkeypatch):
    r = random.Random(7)
    texts = ["".join(r.choice(["word", "Été", "x1", " ", "  ", "\n", "\u00a0", "\u3000", "###", "it's", ".", "ß"]) for _ in range(r.randrange(80))) for _ in range(300)]
    for k, v in (("SLICE_BYTES", 500), ("SLICE_WORDS", 7), ("CACHE_BYTES", 3000)):
        monkeypatch.setattr(tokens, k, v)
    assert encoded(tokens.Encoder(public_tokenizers.path(name)), texts) == [plain(name)(t) for t in texts]


def test_other_tokenizers_are_read_text_by_text(tmp_path):
    with open(public_tokenizers.path(NAMES[1]), encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(said))
    enc, t = tokens.Encoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not enc.known
    assert encoded(enc, ["a b", "", "c  d"]) == [t.encode(x, add_special_tokens=False).ids for x in ("a b", "", "c  d")]


#: Letters below U+0250, each alone, behind and before others, and in words of all kinds of them.
LETTERS = [chr(c) for c in range(0x250) if chr(c).isalpha()]
WORDS = [w for c in LETTERS for w in (c, "ab" + c, c + "ba", c + c)] + ["".join(random.Random(k).choices(LETTERS, k=1 + k % 17)) for k in range(3000)]


@pytest.mark.parametrize("name", NAMES)
def test_words_of_latin_letters_as_the_library(name):
    texts = [" " + w for w in WORDS] + [" ".join(WORDS)]
    assert encoded(tokens.Encoder(public_tokenizers.path(name)), texts) == list(map(plain(name), texts))


class Counted:
    """Counts the texts that the whole tokenizer, not the model alone, is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("name", NAMES)
def test_latin_words_are_given_to_the_model_alone(name):
    enc = tokens.Encoder(public_tokenizers.path(name))
    enc.tokenizer = Counted(enc.tokenizer)
    texts = [" " + " ".join(w for w in WORDS if "\u0130" not in w), " \u0130x 12"]
    assert encoded(enc, texts) == list(map(plain(name), texts))
    assert sorted(x.strip() for x in enc.tokenizer.texts) == ["12", "\u0130x"]


_both = {c: (tokens.Encoder(public_tokenizers.path(c)), plain(c)) for c in NAMES}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sStTabcX1.#\u00e9 \u0301\u00a0\u2003\u3000\u0085\x1c\u180e"), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_any_text_as_the_library(texts):
    for enc, ids in _both.values():
        assert encoded(enc, texts) == list(map(ids, texts))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 210])
def test_range_buckets_by_bisection(spark, n):
    from bisect import bisect_right

    from rastermill.llm import common

    bounds = sorted(random.Random(n).sample(range(-500, 500), n))
    rows = spark.range(-600, 600).unionAll(spark.sql("SELECT CAST(NULL AS LONG) AS id")).select("id", common.range_bucket("id", bounds).alias("b")).collect()
    assert all(r.b == (0 if r.id is None else bisect_right(bounds, r.id)) for r in rows)
    cut = common.order_bounds(spark.range(1000), "id", n) if n else []
    assert len(cut) == max(0, n - 1) and cut == sorted(set(cut))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def frame(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, bucket int, path string")


def test_token_files_round_trip(spark):
    ids, at, want = plain("byte_bpe_50k.json"), 0, []
    for key, text in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        got = ids(text) + [0]
        want.append((key, at, len(got), crc(got)))
        at += len(got)
    rows = token_files.token_files(frame(spark), public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert token_files.token_files(frame(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_is_whole_and_gapless(spark, score):
    ids = plain("word_bpe_49k.json")
    rows = packing.pack_documents(frame(spark), public_tokenizers.path("word_bpe_49k.json"), score=score).collect()
    want = []
    for key, text in DOCS:
        got = ids(text) + [1]
        want += [(key, k, a, len(got[a : a + 4096]), crc(got[a : a + 4096])) for k, a in enumerate(range(0, len(got), 4096))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in rows) // 4096)
    assert packing.pack_documents(frame(spark).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_second_packing_keeps_limits_that_bind(spark, tmp_path):
    rows = [(i, "word " * (i * 37 % 2000), 1, "x") for i in range(400)] + [(500, "word " * 9000, 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, bucket int, path string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_best_fit_packing(spark, str(tmp_path)).collect()
    for name, most, attention in (("", 4096, 4096**2), ("bounded_", queries.BOUNDED["max_docs"], queries.BOUNDED["max_attention"])):
        bins = {}
        for r in got:
            bins.setdefault(r[f"{name}sequence_id"], []).append((r[f"{name}offset"], r.length))
        loads = []
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            cost = sum(n * n for _, n in parts)
            assert at <= 4096 and len(parts) <= most and (cost <= attention or len(parts) == 1)
            loads.append((at, len(parts), cost))
        if name:  # each limit stops some sequence that the others would let grow
            assert any(n == most and t < 3000 and c < attention * 0.9 for t, n, c in loads)
            assert any(attention * 0.8 < c <= attention and n < most and t < 4000 for t, n, c in loads)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(score):
    rng = np.random.default_rng(5)
    need = np.stack([rng.integers(1, 4096, 600), np.ones(600), rng.integers(1, 900, 600)], 1).astype(float)
    cap = np.array([4096.0, 3, 1000])
    bins = packing.best_fit(need, cap, np.array([1, 0.3, 0.5]), score)
    used = np.zeros((bins.max() + 1, 3))
    np.add.at(used, bins, need)
    assert (used <= cap + 1e-6).all() and len(np.unique(bins)) == bins.max() + 1
    with pytest.raises(ValueError):
        packing.best_fit(need * 2, cap, np.ones(3))


def test_best_fit_is_near_the_bound():
    random.seed(3)
    size = np.array([random.randint(1, 3000) for _ in range(4000)], float)
    bins = packing.best_fit(np.stack([size, np.ones_like(size), size**2], 1), np.array([4096.0, 4096, 4096**2]), np.array([1, 0.05, 0.05]))
    assert bins.max() + 1 <= 1.01 * np.ceil(size.sum() / 4096) + 1
