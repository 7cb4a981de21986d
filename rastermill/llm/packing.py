"""Vector best-fit packing of token pieces into sequences."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .tokens import Encoder, byte_slices, starts, with_end

#: Pieces packed together by one task; a group is a hash class, so its mix of lengths is that of the corpus.
GROUP_PIECES = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, score: str = "norm") -> np.ndarray:
    """Bin of each item.  demand: items x resources; all resources of a bin stay within capacity.

    Items come in decreasing order of their weighted size (ties: as given).  Each goes to the feasible open bin of the least
    weighted norm of what would be left ("norm") or of the greatest weighted dot product of demand and residual ("dot");
    ties go to the oldest bin.  An item above a capacity is an error.
    """
    need = demand / capacity
    if len(need) and need.max() > 1 + 1e-12:
        raise ValueError("an item is larger than a bin")
    order = np.argsort(-(need * weights).sum(1), kind="stable")
    bins = np.empty(len(demand), np.int64)
    left = np.empty((64, len(capacity)))
    ids = np.empty(64, np.int64)
    opened = made = 0
    least = need.min(0) if len(need) else None
    for i in order:
        d, chosen = need[i], -1
        if opened:
            rest = left[:opened] - d
            fits = np.flatnonzero(rest.min(1) >= -1e-12)
            if len(fits):
                value = (rest[fits] ** 2 @ weights) if score == "norm" else -(left[fits] * d @ weights)
                chosen = fits[np.argmin(value)]
        if chosen < 0:
            if opened == len(left):
                left, ids = np.concatenate([left, np.empty_like(left)]), np.concatenate([ids, np.empty_like(ids)])
            chosen, opened = opened, opened + 1
            left[chosen], ids[chosen] = 1.0, made
            made += 1
        bins[i] = ids[chosen]
        left[chosen] -= d
        if (left[chosen] < least - 1e-12).any():  # closed: nothing fits any more
            opened -= 1
            left[chosen:opened], ids[chosen:opened] = left[chosen + 1 : opened + 1].copy(), ids[chosen + 1 : opened + 1].copy()
    return bins


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, max_tokens: int, special_as_text: bool = False) -> DataFrame:
    """Rows PIECES: each whole text's ids (null: none) and end_id, cut only where longer than max_tokens."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        enc = Encoder(tokenizer, special_as_text)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in byte_slices(texts):
                ids, size = with_end(*enc(texts.slice(lo, hi - lo)), end_id)
                pieces = -(-size // max_tokens)
                row = np.repeat(np.arange(lo, hi), pieces)
                piece = np.arange(len(row)) - starts(pieces)[row - lo]
                length = np.minimum(max_tokens, size[row - lo] - piece * max_tokens)
                raw = memoryview(ids.astype("<u4")).cast("B")
                at = (4 * starts(length)).tolist()
                crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * max_tokens), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, PIECES)


def assigned(size: np.ndarray, limits: tuple, weights: np.ndarray, score: str) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces that come in decreasing length; limits: tokens, pieces, attention cost (sum of squared lengths).

    A piece that alone is beyond the limit of attention stands alone.
    """
    demand = np.stack([size, np.ones_like(size), size**2], 1).astype(float)
    alone = demand[:, 2] > limits[2]
    bins = np.empty(len(size), np.int64)
    bins[~alone] = best_fit(demand[~alone], np.array(limits, float), weights, score)
    bins[alone] = (bins[~alone].max() + 1 if (~alone).any() else 0) + np.arange(alone.sum())
    place = np.lexsort((np.arange(len(bins)), bins))
    ahead = starts(size[place])
    first = np.r_[True, np.diff(bins[place]) != 0] if len(bins) else np.zeros(0, bool)
    offset = np.empty_like(size)
    offset[place] = ahead - np.repeat(ahead[first], np.diff(np.r_[np.flatnonzero(first), len(bins)]))
    return bins, offset


def pack(pieces: DataFrame, n_rows: int, max_tokens: int = 4096, max_docs: int | None = None, max_attention: int | None = None, weights: tuple = (1.0, 0.05, 0.05), score: str = "norm", bounded: dict | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows PIECES.

    Resources of a sequence: tokens, pieces, and attention cost (sum of squared lengths); the last two default to what one sequence of
    max_tokens can hold at most, so that they don't bind.  n_rows sets the number of groups that are packed apart, about GROUP_PIECES
    rows each, by a hash of the key; each leaves about one bin part filled.  bounded: max_docs and max_attention of a second packing
    of the same pieces (bounded_sequence_id, bounded_offset).  Null keys and repeated rows are packed like others.
    """
    groups = max(1, round(n_rows / GROUP_PIECES))
    limits = [(max_tokens, max_docs or max_tokens, max_attention or max_tokens**2)]
    names = ["sequence_id", "offset"]
    if bounded:
        limits.append((max_tokens, bounded["max_docs"], bounded["max_attention"]))
        names += ["bounded_sequence_id", "bounded_offset"]
    w = np.array(weights, float)

    def run(key, rows):
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").drop(columns="bin_group")
        size = rows["length"].to_numpy(np.int64)
        for k, limit in enumerate(limits):
            bins, offset = assigned(size, limit, w, score)
            rows[names[2 * k]], rows[names[2 * k + 1]] = (int(key[0]) << 32) + bins, offset
        return rows

    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("bin_group").applyInPandas(run, PIECES + "".join(f", {n} long" for n in names))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False, **limits) -> DataFrame:
    """One row per piece: PIECES, sequence_id, offset (and bounded_sequence_id, bounded_offset with bounded limits).

    Null and empty texts are end_id alone; texts of any length are used whole; other columns are ignored, whatever their names;
    no rows in, no rows out; rows of one id are separate documents.
    """
    max_tokens = limits.get("max_tokens", 4096)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pack(token_pieces(kept, tokenizer, end_id, max_tokens, special_as_text), docs.count(), **limits)
