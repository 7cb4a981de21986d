"""Closed syncmers: k-mers whose least inner s-mer stands at an edge, chosen by their own content alone.

The same passage gives the same anchors wherever it stands, so anchors found in two texts can be matched by position.  A document's
fingerprint is a bottom-m sample of its distinct anchor hashes.
"""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import order_bounds, partitions, prepare, range_bucket
from .tokens import text_slices

K, S, SAMPLE = 16, 5, 128
#: Code points handled together; a longer text is read in pieces that overlap by k - 1.
PIECE = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x ^= x >> np.uint64(27)
    return x * _ODD


def _grams(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n code points, by doubling."""
    done, width, parts = np.zeros(len(code), np.uint64), 0, code
    power, size = np.array([0x100000001B3], np.uint64), 1
    at = 0
    while n:
        if n & 1:
            take = len(parts) - at
            done = done[:take] * power + parts[at : at + take] if width else parts.copy()
            width += size
            at = width
        n >>= 1
        if n:
            parts = parts[:-size] * power + parts[size:] if len(parts) > size else parts[:0]
            power, size = power * power, size * 2
    return _stir(done)


def anchors(code: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of an array of code points; equal least s-mers count at either edge."""
    if len(code) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = code.astype(np.uint64)
    inner = _grams(code, s)
    n, w = len(code) - k + 1, k - s + 1
    least, size = inner, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[w - size : w - size + n])
    at = np.flatnonzero((inner[:n] == least) | (inner[w - 1 : w - 1 + n] == least))
    return at, _grams(code, k)[at]


def text_anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a whole text of any length, piece by piece.  A text shorter than k is one anchor at 0, an empty one has none."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(code) < k:
        return np.zeros(1, np.int64), np.array([int.from_bytes(hashlib.blake2b(code.tobytes(), digest_size=8).digest(), "little")], np.uint64)
    got = [(a + at, h) for a in range(0, len(code) - k + 1, PIECE) for at, h in [anchors(code[a : a + PIECE + k - 1], k, s)]]
    return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])


def sample(hashes: np.ndarray, m: int = SAMPLE) -> np.ndarray:
    """The m least distinct values of the upper 32 bits, ascending."""
    top = (hashes >> np.uint64(32)).astype("<u4")
    if len(top) > 8 * m:  # at least m distinct ones are likely among the least few
        few = np.unique(np.partition(top, 4 * m)[: 4 * m])
        if len(few) >= m:
            return few[:m]
    return np.unique(top)[:m]


def likeness(a: np.ndarray, b: np.ndarray, m: int = SAMPLE) -> float:
    """Jaccard similarity of the anchor sets as estimated from two samples; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    union = both[np.r_[True, both[1:] != both[:-1]]][:m]
    twice = both[1:][both[1:] == both[:-1]]
    return float(np.searchsorted(twice, union[-1], "right") / len(union))


def paired(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(positions in a, positions in b) of common anchors: the r-th of a hash in a with the r-th in b, and where a has more, its others
    with the last; so a passage that either repeats is met at every place of the one that has more of it, and costs no more than both."""

    def ranked(h):
        order = np.argsort(h, kind="stable")
        new = np.r_[True, h[order][1:] != h[order][:-1]] if len(h) else np.zeros(0, bool)
        return order, np.flatnonzero(new), np.diff(np.r_[np.flatnonzero(new), len(h)])

    (pa, ha), (pb, hb) = a, b
    (oa, fa, na), (ob, fb, nb) = ranked(ha), ranked(hb)
    _, ia, ib = np.intersect1d(ha[oa][fa], hb[ob][fb], assume_unique=True, return_indices=True)
    most = np.maximum(na[ia], nb[ib])
    rank = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most)
    x = np.repeat(fa[ia], most) + np.minimum(rank, np.repeat(na[ia] - 1, most))
    y = np.repeat(fb[ib], most) + np.minimum(rank, np.repeat(nb[ib] - 1, most))
    return pa[oa[x]], pb[ob[y]]


def runs(a, b, k: int = K) -> np.ndarray:
    """Positional matching: rows (start in a, start in b, length) of maximal runs covered by common anchors on one diagonal."""
    x, y = paired(a, b)
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    if not len(x):
        return np.zeros((0, 3), np.int64)
    begin = np.flatnonzero(np.r_[True, (np.diff(y - x) != 0) | (np.diff(x) > k)])
    last = np.r_[begin[1:], len(x)] - 1
    return np.stack([x[begin], y[begin], x[last] + k - x[begin]], 1)


def match(a: str, b: str, k: int = K, s: int = S) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the passages that two texts share, by diagonal."""
    return [tuple(r) for r in runs(text_anchors(a, k, s), text_anchors(b, k, s), k).tolist()]


def aligned(a, b, n_chars: int, k: int = K) -> float:
    """Share of a text's n_chars code points that lie in runs with another text; a: the text's anchors; of an empty text all."""
    found = runs(a, b, k)
    if not n_chars:
        return 1.0
    found = found[np.argsort(found[:, 0], kind="stable")]
    end = np.minimum(found[:, 0] + found[:, 2], n_chars)
    before = np.r_[0, np.maximum.accumulate(end)[:-1]] if len(end) else end
    return float(np.maximum(end - np.maximum(found[:, 0], before), 0).sum() / n_chars)


def fingerprint(text: str) -> np.ndarray:
    return sample(text_anchors(text)[1])


def written(print_: np.ndarray) -> str:
    return base64.b64encode(print_.astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every whole text; no shuffle."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for keys, texts in text_slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([written(fingerprint(t)) for t in texts], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, borrowed, doc_id, text): each id range in a partition, sorted, and after it a copy of the document that follows.

    One range shuffle.  The only copies are of the first documents of the ranges, one for each; the document after the last is the first.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = order_bounds(kept, "doc_id", n)
    placed = kept.withColumn("bucket", range_bucket("doc_id", bounds))
    # ids alone are read for this; a row for each range
    firsts = sorted((b, i) for b, i in placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("f")).select("bucket", "f.doc_id").collect())
    ahead = {i: firsts[k - 1][0] for k, (_, i) in enumerate(firsts)}
    if not firsts:
        return placed.select("bucket", F.lit(False).alias("borrowed"), "doc_id", "text")
    # of rows that share a first id the least text comes first; the table has a row for each range, so it may be broadcast
    listed = F.from_json(F.lit(json.dumps([{"doc_id": i, "before": b} for i, b in ahead.items()])), "array<struct<doc_id:bigint,before:int>>")
    table = spark.range(1).select(F.inline(listed))
    heads = placed.alias("p").join(F.broadcast(table.alias("t")), F.col("p.doc_id").eqNullSafe(F.col("t.doc_id"))).groupBy("p.doc_id", "before").agg(F.min("text").alias("text"))
    both = placed.select("bucket", F.lit(False).alias("borrowed"), "doc_id", "text").unionAll(heads.select("before", F.lit(True), "doc_id", "text"))
    return both.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "borrowed", "doc_id", "text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against its edited form (the last quarter replaced by the head of the next document) and the next document.

    aligned_edited is the positional share: how much of the text lies in runs of anchors on one diagonal with its edited form.  Null
    texts are empty; null ids come first; rows of one id follow each other by text; the only document is its own next; other
    columns are ignored; no rows, no result.  Texts of any length are used whole.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, aligned_edited double"

    def run(batches):
        import pyarrow as pa

        held = None  # the document before, until the next is known
        rows: list[tuple] = []

        def closed(doc, text, at, mark, after, after_mark):
            cut = len(text) // 4
            edited = text[: len(text) - cut] + after[:cut]
            found = text_anchors(edited) if edited != text else at
            other = sample(found[1]) if edited != text else mark
            rows.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(mark), written(other), likeness(mark, other), likeness(mark, after_mark), aligned(at, found, len(text))))

        def flush():
            cols = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for borrowed, doc, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                at = text_anchors(text)
                mark = sample(at[1])
                if held:
                    closed(*held, text, mark)
                held = None if borrowed else (doc, text, at, mark)
                if len(rows) >= 1000:
                    yield flush()
        yield flush()

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
