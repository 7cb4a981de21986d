"""Language of words in code-switched text: a linear-chain conditional random field read by forward-backward.

A word's features are its affixes, character n-grams and lexicon entries, hashed into one table; the transitions between the
languages of neighbouring words are learned with them.  The field is trained on sequences spliced from documents of different
languages out of a bounded sample; prediction reads whole texts of any length, exactly.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare
from .tokens import text_slices

#: The training sample's bounds: documents in all, and code points of a document (longer ones are not sampled).
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20_000
#: More languages than this are refused (the field has FEATURES weights for each).
MOST_LANGUAGES = 512
#: Spliced training sequences and their length in words.
SEQUENCES, SEQUENCE_WORDS = 4000, 40
FEATURES = 1 << 17
#: Bytes (about) of words and scores that a task remembers.
CACHE_BYTES = 64 << 20
#: Words of a text that are read one after another; such blocks of all texts are read side by side.
BLOCK = 32


def core(word: str) -> str:
    """Lower-case letters of a word; empty if it has none."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    names = [f"^{word[:n]}" for n in (1, 2, 3)] + [f"{word[-n:]}$" for n in (1, 2, 3, 4)]
    held = f"<{word}>"
    names += [held[i : i + n] for n in (2, 3) for i in range(len(held) - n + 1)]
    if word in lexicon:
        names += [f"lexicon={lexicon[word]}", f"word={word}"]
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def forward_backward(score: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Marginals of every word.  score: exp of the words' scores (words x labels), texts one after another; transition: its exp.

    Exact for texts of any length: each block's transfer matrix is a product over its words, the matrices carry the state from
    block to block, then all blocks are read forward and backward side by side.
    """
    n_labels = score.shape[1]
    lengths = lengths[lengths > 0]
    per_text = -(-lengths // BLOCK)
    first = np.cumsum(per_text) - per_text
    n = int(per_text.sum())
    text = np.repeat(np.arange(len(lengths)), per_text)
    place = np.arange(n) - first[text]
    begin = (np.cumsum(lengths) - lengths)[text] + place * BLOCK
    size = np.minimum(BLOCK, lengths[text] - place * BLOCK)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    active = [int(np.searchsorted(-size, -j, "left")) for j in range(BLOCK)]  # blocks of more than j words

    def scaled(x):
        return x / x.sum(-1, keepdims=True)

    move = np.tile(np.eye(n_labels), (n, 1, 1))
    for j, k in enumerate(active):
        if k:
            step = (move[:k].reshape(-1, n_labels) @ transition).reshape(k, n_labels, n_labels) * score[begin[:k] + j, None, :]
            move[:k] = step / step.max((1, 2), keepdims=True)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    ahead, behind = np.full((n, n_labels), 1.0 / n_labels), np.ones((n, n_labels))
    for r in range(1, int(per_text.max(initial=0))):
        b = first[per_text > r] + r
        ahead[where[b]] = scaled(np.einsum("bi,bij->bj", ahead[where[b - 1]], move[where[b - 1]]))
    for r in range(int(per_text.max(initial=0)) - 1, 0, -1):
        b = first[per_text > r] + r
        behind[where[b - 1]] = scaled(np.einsum("bij,bj->bi", move[where[b]], behind[where[b]]))
    out = np.empty_like(score)
    for j, k in enumerate(active):
        if k:
            ahead[:k] = scaled(ahead[:k] @ transition * score[begin[:k] + j])
            out[begin[:k] + j] = ahead[:k]
    for j in range(BLOCK - 1, -1, -1):
        if k := active[j]:
            at = begin[:k] + j
            out[at] = scaled(out[at] * behind[:k])
            behind[:k] = scaled((score[at] * behind[:k]) @ transition.T)
    return out


@dataclass
class Field:
    """A trained field: labels, feature weights (FEATURES x labels), transitions (labels x labels), lexicon (word to label)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]

    def word_scores(self, words: list[str]) -> np.ndarray:
        listed = [features(w, self.lexicon) for w in words]
        flat = np.fromiter(itertools.chain.from_iterable(listed), np.int64)
        sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, 0) if len(listed) else np.zeros((0, len(self.labels)))


def _lexicon(words: list[tuple[str, int]], n_labels: int, least: int = 3, share: float = 0.8, most: int = 20_000) -> dict[str, int]:
    """Words seen often enough and nearly only in one language; the most frequent ones first."""
    seen: dict[str, list[int]] = {}
    for w, y in words:
        seen.setdefault(w, [0] * n_labels)[y] += 1
    fit = [(sum(c), w, c.index(max(c))) for w, c in seen.items() if sum(c) >= least and max(c) >= share * sum(c)]
    return {w: y for _, w, y in sorted(fit, key=lambda x: (-x[0], x[1]))[:most]}


def train(sample: list[tuple[str, str]], rounds: int = 40, seed: int = 4, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """sample: (text, language).  Maximises the sequences' conditional likelihood by AdaGrad on the whole sample."""
    labels = sorted({y for _, y in sample})
    n_labels = len(labels)
    number = {y: i for i, y in enumerate(labels)}
    by_label: list[list[list[str]]] = [[] for _ in labels]
    for text, y in sample:
        if words := [c for c in map(core, text.split()) if c]:
            by_label[number[y]].append(words)
    lexicon = _lexicon([(w, i) for i, texts in enumerate(by_label) for t in texts for w in t], n_labels)
    usable = [i for i in range(n_labels) if by_label[i]]
    field = Field(labels, np.zeros((FEATURES, n_labels)), np.zeros((n_labels, n_labels)), lexicon)
    if len(usable) < 2:
        return field
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    words = np.empty((SEQUENCES, SEQUENCE_WORDS), np.int64)
    gold = np.empty_like(words)
    for row in range(SEQUENCES):
        at = 0
        while at < SEQUENCE_WORDS:
            y = usable[rng.integers(len(usable))]
            text = by_label[y][rng.integers(len(by_label[y]))]
            n = min(int(rng.integers(8, SEQUENCE_WORDS + 1)), SEQUENCE_WORDS - at, len(text))
            start = rng.integers(len(text) - n + 1)
            words[row, at : at + n] = [vocabulary.setdefault(w, len(vocabulary)) for w in text[start : start + n]]
            gold[row, at : at + n] = y
            at += n
    listed = [features(w, lexicon) for w in vocabulary]
    flat = np.fromiter(itertools.chain.from_iterable(listed), np.int64)
    sizes = np.fromiter(map(len, listed), np.int64, len(listed))
    begins, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    one_hot = np.eye(n_labels)[gold]
    pairs = np.bincount((gold[:, :-1] * n_labels + gold[:, 1:]).ravel(), minlength=n_labels**2).reshape(n_labels, n_labels)
    gw, gt = np.full_like(field.weights, 1e-6), np.full_like(field.transitions, 1e-6)
    for _ in range(rounds):
        score = np.add.reduceat(field.weights[flat], begins, 0)[words]
        score = np.exp(score - score.max(-1, keepdims=True))
        move = np.exp(field.transitions)
        ahead, behind = np.empty_like(score), np.ones_like(score)
        state = np.full((SEQUENCES, n_labels), 1.0 / n_labels)
        for j in range(SEQUENCE_WORDS):
            state = state @ move * score[:, j]
            state /= state.sum(1, keepdims=True)
            ahead[:, j] = state
        for j in range(SEQUENCE_WORDS - 1, 0, -1):
            back = (score[:, j] * behind[:, j]) @ move.T
            behind[:, j - 1] = back / back.sum(1, keepdims=True)
        marginal = ahead * behind
        marginal /= marginal.sum(-1, keepdims=True)
        expected = np.zeros_like(move)
        for j in range(1, SEQUENCE_WORDS):
            both = ahead[:, j - 1, :, None] * move * (score[:, j] * behind[:, j])[:, None, :]
            expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        miss = (one_hot - marginal).reshape(-1, n_labels)
        of_word = np.stack([np.bincount(words.ravel(), miss[:, y], len(sizes)) for y in range(n_labels)], 1)
        up = np.stack([np.bincount(flat, of_word[owner, y], FEATURES) for y in range(n_labels)], 1) / SEQUENCES - decay * field.weights
        gw += up**2
        field.weights += rate * up / np.sqrt(gw)
        up = (pairs - expected) / SEQUENCES - decay * field.transitions
        gt += up**2
        field.transitions += rate * up / np.sqrt(gt)
    field.weights = field.weights.astype(np.float32)
    return field


class Reader:
    """Scores the letters of words once and remembers them; one for each task."""

    def __init__(self, field: Field):
        self.field, self.move = field, np.exp(field.transitions)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}  # of words, -1 without a letter
        self.of_core: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.field.labels)))
        self.n = self.bytes = 0

    def _learn(self, words: list[str]) -> None:
        cores = list(map(core, words))
        new = [c for c in dict.fromkeys(cores) if c and c not in self.of_core]
        got = self.field.word_scores(new).astype(float)
        got = np.exp(np.maximum(got - got.max(1, keepdims=True), -60)) if len(got) else got
        if self.n + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty((max(len(new), len(self.scores)), self.scores.shape[1]))])
        self.scores[self.n : self.n + len(new)] = got
        self.of_core.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.of_core[""] = -1
        self.number.update(zip(words, map(self.of_core.__getitem__, cores), strict=True))
        self.n += len(new)
        self.bytes += sum(map(len, words)) + sum(map(len, new)) + 150 * (len(words) + len(new)) + 16 * got.size

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(labelled words of each text, marginals of those words); words without a letter are passed over."""
        parts = [t.split() for t in texts]
        if self.bytes > CACHE_BYTES:
            self._forget()
        if missing := set(itertools.chain.from_iterable(parts)).difference(self.number):
            self._learn(list(missing))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(parts)), sizes)[ids >= 0]
        lengths = np.bincount(text, minlength=len(parts))
        return lengths, forward_backward(self.scores[ids[ids >= 0]], lengths, self.move)

    def label(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, probability) of each word with a letter."""
        _, m = self.marginals([text])
        words = [w for w in text.split() if core(w)]
        return [(w, self.field.labels[i], float(p)) for w, i, p in zip(words, m.argmax(1), m.max(1), strict=True)]


def sample(docs: DataFrame, learn, sample_docs: int = SAMPLE_DOCS, id_col="doc_id", text_col="text", lang_col="lang") -> list[tuple[str, str]]:
    """(text, language) of rows for which the column learn holds and the language is known: of each language its first
    sample_docs // languages usable rows (one at least) by a hash of the id, or all if it has fewer, whatever the table's
    size and the language's share.  More than MOST_LANGUAGES languages are an error.  Usable are texts with a letter and at most SAMPLE_CHARS code points.

    A draw bound of each language lets about twice the wanted rows pass, so that few rows are ranked; a language that falls short
    (many rows of one id) is read again with a wider bound.
    """
    usable = (F.length(text_col) <= SAMPLE_CHARS) & F.regexp_like(F.col(text_col), F.lit(r"\p{L}"))
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & usable)
    known = {k[0]: k[1] for k in rows.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = max(1, sample_docs // max(1, len(known)))
    span, wide = 1 << 30, 2 * each + 64
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(span))
    first = Window.partitionBy("lang").orderBy("draw", "key", "text")
    found: dict[str, list[str]] = {}
    while short := [k for k, n in known.items() if len(found.get(k, ())) < min(each, n)]:
        limit = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(min(span, span * wide // known[k] + 1))) for k in short], F.lit(0))
        picked = rows.filter(draw < limit).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(id_col).alias("key"))
        ranked = picked.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= each).collect()
        found |= {k: [r.text for r in sorted((r for r in ranked if r.lang == k), key=lambda r: r.place)] for k in short}
        wide *= 16
    # languages in turn by the order of their names, so that the sample doesn't depend on how rows arrive
    return [(text, k) for k in sorted(found) for text in found[k]]


def fit(docs: DataFrame, learn, sample_docs: int = SAMPLE_DOCS, id_col="doc_id", text_col="text", lang_col="lang") -> Field:
    """Trains on a sample of the labelled rows, of every language alike (see sample)."""
    return train(sample(docs, learn, sample_docs, id_col, text_col, lang_col))


def predict(docs: DataFrame, field: Field, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score of every row: the language with the largest share of the words' marginals, and that share.

    A text that is null or has no letter is und with score 0; null ids and repeated rows are predicted like others; other columns
    are ignored; no rows, no result.  Texts are read whole and not shuffled.  The model has a fixed size bound (FEATURES x
    languages weights and a bounded lexicon) and travels with the tasks.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(field)

    def run(batches):
        import pyarrow as pa

        model = held.value
        reader = Reader(model)
        for batch in batches:
            for keys, texts in text_slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, m = reader.marginals(texts) if model.labels else (np.zeros(len(texts), np.int64), np.zeros((0, 1)))
                doc = np.repeat(np.arange(len(texts)), n)
                mass = np.stack([np.bincount(doc, m[:, y], len(texts)) for y in range(m.shape[1])], 1)
                best = mass.argmax(1)
                score = np.clip(mass[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
                lang = [model.labels[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """documents (all their columns) of a known language and at least this score; the text is read once, in place.

    Null texts and texts without a letter go.  Where no language could be learned (no row with a language) all texts with a letter
    stay.  Rows are judged one by one, so ids, repeated rows and names of other columns don't matter; an empty table stays empty.
    """
    spark = docs.sparkSession
    prepare(spark)
    held, names = spark.sparkContext.broadcast(field), docs.columns

    def run(batches):
        import pyarrow as pa

        model = held.value
        reader = Reader(model)
        for batch in batches:
            keep = []
            for _, texts in text_slices(range(batch.num_rows), batch.column(names.index("text")).to_pylist()):
                if not model.labels:
                    keep += [any(map(str.isalpha, t)) for t in texts]
                    continue
                n, m = reader.marginals(texts)
                doc = np.repeat(np.arange(len(texts)), n)
                mass = np.stack([np.bincount(doc, m[:, y], len(texts)) for y in range(m.shape[1])], 1)
                keep += ((n > 0) & (mass.max(1) >= least * n)).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
