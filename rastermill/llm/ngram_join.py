"""Size-aware heavy-light Jaccard join of word n-gram sets, and the components of its links.

Equal sets are one node.  Small (light) sets enumerate their subsets of every size that a partner may share.  Large (heavy) sets are
found by scanning inverted lists: a set is dealt into blocks by its n-grams' hashes, and as linked sets differ in few n-grams, they
must agree in one of their fullest blocks; a list holds the sets with one and the same block.  The boundary is the size with the
least estimated cost.  Lists only say which nodes may link: each gives a star, so there are never more links than entries.  Nodes that
may link are then tested exactly, side by side, behind a lower bound of their difference and union-find.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, prepare, release, scratch
from .tokens import byte_slices, text_bytes

#: Postings a map task holds before it folds and sends them.
FLUSH = 1_000_000
#: Times the texts are read for their postings, each time for another part of the lists: so much less is on disk at once.
PASSES = 3
#: Nodes and n-grams tested in one task; larger candidate groups are cut into blocks.
BLOCK_NODES, BLOCK_GRAMS = 512, 2_000_000
#: Candidate tables up to this many rows (of three numbers) are broadcast (checked), larger ones joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bits of a sketch; the most nodes of a block of sketches, and the least of one of up to SKETCH_PARTS blocks.
SKETCH_BITS = 512
SKETCH_NODES, SKETCH_LEAST, SKETCH_PARTS = 4096, 128, 16
LIGHT_SIZES = 200
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Entries of a list that a map task sends unfolded.
KEEP = 4
POSTING = np.dtype([("sig", "<i8"), ("node", "<i8"), ("low", "<i4"), ("high", "<i4")])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x ^= x >> np.uint64(27)
    return x * _ODD


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, how many words each text has); only A-Z are lower-cased; each distinct word is hashed once."""
    import pyarrow as pa

    at, data = text_bytes(texts)
    data = _LOWER[data]
    space = _SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    first = at[:-1][at[:-1] < len(data)]
    begin[first] = ~space[first]
    place = np.flatnonzero(begin)
    held = data[~space]
    start = (place - np.cumsum(space, dtype=np.int32)[place]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(np.append(start, np.int32(len(held)))), pa.py_buffer(held)]).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return hashes[words.indices.to_numpy()], np.diff(np.searchsorted(place, at))


def gram_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams; with fewer words the whole sequence is one; without words none.  texts: an
    Arrow array of strings without nulls."""
    words, sizes = word_hashes(texts)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = _stir(grams + words[k : k + len(grams)])
    out, at = [], 0
    for size in sizes.tolist():
        if size >= n:
            got = np.sort(grams[at : at + size - n + 1])
            out.append(got[np.r_[True, got[1:] != got[:-1]]])
        elif size:
            out.append(np.frombuffer(hashlib.blake2b(words[at : at + size].tobytes(), digest_size=8).digest(), "<u8").copy())
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def node_of(grams: np.ndarray) -> int:
    """64 bits of the set's own hash."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_shared(size, percent: int):
    """What a set must share with any partner."""
    return -(-percent * size // 100)


def subset_signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """A hash of each subset that a partner may share: a sum, so what is left out is subtracted."""
    mixed = _stir(grams ^ _MIX)
    whole = mixed.sum(dtype=np.uint64)
    out = [np.array([whole])]
    for leave in range(1, len(grams) - least_shared(len(grams), percent) + 1):
        chosen = np.array(list(itertools.combinations(range(len(grams)), leave)), np.int64)
        out.append(whole - mixed[chosen].sum(1, dtype=np.uint64))
    return np.concatenate(out)


def n_subsets(size: int, percent: int) -> int:
    return sum(math.comb(size, k) for k in range(size - least_shared(size, percent) + 1))


def most_apart(both, percent: int):
    """The most by which two linked sets may differ; both: the sum of their sizes."""
    return both - 2 * (-(-percent * both // (100 + percent)))


def _bound(both: int, percent: int) -> int:
    """No less than most_apart, and never less for larger sets."""
    return both * (100 - percent) // (100 + percent)


def size_class(size: int) -> int:
    """The largest size of a size's class; classes end below powers of two."""
    return (1 << int(size).bit_length()) - 1


def n_blocks(top: int, percent: int) -> int:
    """Blocks that sets of a class ending at top are dealt into: half as many again as two of its largest may differ by, and one."""
    return _bound(2 * top, percent) * 3 // 2 + 1


def posted(size: int, percent: int) -> list[tuple[int, int]]:
    """(class, how many blocks a set posts there), for its own class and for the next if a larger partner may be there.

    Linked sets differ in at most d n-grams, hence in at most d blocks of either.  In one order of block contents, the first block
    that both hold comes among the first d + 1 of each.
    """
    most, out = 100 * size // percent, []
    for top in dict.fromkeys((size_class(size), size_class(most))):
        out.append((top, min(n_blocks(top, percent), _bound(size + min(top, most), percent) + 1)))
    return out


def block_signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """A hash of each posted block: the fullest first, ties by hash.  grams: sorted, so that a block is a run of them."""
    out = []
    mixed = np.r_[np.uint64(0), np.cumsum(_stir(grams ^ _ODD), dtype=np.uint64)]
    for top, most in posted(len(grams), percent):
        m = n_blocks(top, percent)
        ends = np.searchsorted(grams >> np.uint64(32), (np.arange(1, m + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(m))
        ends[-1] = len(grams)
        upto = mixed[ends]
        count = np.diff(np.r_[0, ends])
        sig = _stir(np.diff(np.r_[np.uint64(0), upto]) + _stir(np.arange(m, dtype=np.uint64) + np.uint64(top << 32)))
        out.append(sig[np.lexsort((sig, -count))[:most]])
    return np.concatenate(out)


@dataclass
class Plan:
    n: int
    percent: int
    boundary: int

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        size, out = len(grams), []
        if 0 < size <= self.boundary:
            out.append(_stir(subset_signatures(grams, self.percent)))
        if size > 0 and 100 * size >= self.percent * (self.boundary + 1):  # may meet a heavy set
            out.append(block_signatures(grams, self.percent))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def boundary_by_cost(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """Largest light size of least cost: subsets that light sets enumerate, and blocks that heavy sets post with the lists they scan."""
    light = {s: c * n_subsets(s, percent) for s, c in sizes.items()}
    heavy = {s: c * sum(k for _, k in posted(s, percent)) * (1 + list_length) for s, c in sizes.items()}
    best, cost = 0, sum(heavy.values())
    for x in range(1, LIGHT_SIZES):
        if n_subsets(x, percent) > 100_000:
            break
        now = sum(v for s, v in light.items() if s <= x) + sum(v for s, v in heavy.items() if 100 * s >= percent * (x + 1))
        if now < cost:
            best, cost = x, now
    return best


def bucket_counts(grams: np.ndarray, bits: int = 6) -> bytes:
    """n-grams by bucket; the sum of differences of two such arrays is at most what the sets differ by."""
    return np.minimum(np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def sketch(grams: np.ndarray) -> bytes:
    """Parities of bucket counts: as each n-gram flips one bit, two sets differ by at least as many n-grams as their sketches by bits."""
    bucket = (grams >> np.uint64(65 - SKETCH_BITS.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def alike(bits: np.ndarray, size: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Label (an index) of each set's component, where sets of one and of other (indices) meet if sizes and sketches let them link."""
    label = np.arange(len(size))
    one, other = one[np.argsort(size[one], kind="stable")], other[np.argsort(size[other], kind="stable")]
    words = np.ascontiguousarray(bits.view(np.uint64).T)
    sizes = size[other]
    for at in range(0, len(one), 64):
        rows = one[at : at + 64]
        lo = np.searchsorted(sizes, -(-percent * size[rows[0]] // 100))
        hi = np.searchsorted(sizes, 100 * size[rows[-1]] // percent, "right")
        if lo == hi:
            continue
        some = other[lo:hi]
        apart = np.zeros((len(rows), hi - lo), np.int32)
        for w in words:
            apart += np.bitwise_count(w[rows][:, None] ^ w[some])
        near = apart * np.int64(100 + percent) <= (100 - percent) * (size[rows][:, None] + size[some])
        for k in np.flatnonzero(near.any(1)):
            met = np.unique(label[some[near[k]]])
            met = met[met != label[rows[k]]]
            if len(met):
                label[np.isin(label, met)] = label[rows[k]]
    return label


def runs_of(p: np.ndarray, percent: int) -> np.ndarray:
    """Where runs begin in postings sorted by list and size.

    A run ends where the next entry is too large for any before it, for no pair across can link.
    """
    if not len(p):
        return np.zeros(0, np.int64)
    new = np.r_[True, p["sig"][1:] != p["sig"][:-1]]
    number = np.cumsum(new).astype(np.int64) << 32
    top = np.maximum.accumulate(p["high"] + number) - number
    return np.flatnonzero(new | np.r_[True, percent * p["low"][1:].astype(np.int64) > 100 * top[:-1]])


def star(p: np.ndarray, begins: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Distinct links of the chosen runs' entries to their first."""
    run = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(p)]))
    links = np.stack([p["node"], p["node"][begins][run]], 1)[chosen[run]]
    return np.unique(np.sort(links[links[:, 0] != links[:, 1]], 1), axis=0)


def fold(p: np.ndarray, percent: int, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """(postings to send, links): a run of more than keep entries becomes one posting and a star."""
    p = np.unique(p)
    p = p[np.lexsort((p["node"], p["low"], p["sig"]))]
    begins = runs_of(p, percent)
    if not len(p):
        return p, np.zeros((0, 2), np.int64)
    size = np.diff(np.r_[begins, len(p)])
    many = size > keep
    folded = p[begins][many]
    folded["high"] = np.maximum.reduceat(p["high"], begins)[many]
    return np.concatenate([p[~np.repeat(many, size)], folded]), star(p, begins, many)


def scan(batches, percent: int):
    """Links of lists that come sorted by (sig, low): a star over each run.  An open run is carried to the next batch as one posting."""
    carried = np.zeros(0, POSTING)
    for p in batches:
        p = np.concatenate([carried, p])
        if not len(p):
            continue
        begins = runs_of(p, percent)
        carried = p[begins[-1:]].copy()
        carried["high"] = p["high"][begins[-1] :].max()
        yield star(p, begins, np.ones(len(begins), bool))


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """Rows doc_id, key, size, node of all documents (doc_id, key, text)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            for lo, hi in byte_slices(texts):
                sets = gram_sets(texts.slice(lo, hi - lo), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "key", "size", "node"])

    return docs.mapInArrow(run, "doc_id long, key long, size long, node long")


def candidate_links(docs: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): links of nodes that share a subset or a block, a < b: a star over each list.

    Postings are rows that Spark deals by list and sorts (on disk where they don't fit); a map task folds what it holds of long lists,
    that a list never has more than a few entries for each FLUSH of a task.  Postings take about twice the input's space, so the lists
    are made in PASSES parts; the shuffle of one is gone before the next begins.
    """
    made = scratch(docs.sparkSession, "links")
    parts = [f"{made}/{k}" for k in range(PASSES)]
    for k, path in enumerate(parts):
        _links_of_part(docs, plan, k, len(parts)).write.parquet(path)
        _freed(docs.sparkSession.read.schema("a long, b long").parquet(path))
    return docs.sparkSession.read.schema("a long, b long").parquet(*parts)


def _freed(written: DataFrame) -> DataFrame:
    """What was written, read again, when the shuffles that made it are gone (the last query run holds its own, so another is run)."""
    _some(written)
    release(written.sparkSession)
    return written


def _links_of_part(docs: DataFrame, plan: Plan, part: int, parts: int) -> DataFrame:
    """candidate_links of the lists whose signature leaves the remainder part by parts."""

    def post(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, n = [], 0

        def send():
            runs, links = fold(np.concatenate(held), plan.percent)
            link = np.zeros(len(links), POSTING)  # a link made here travels as a posting without a size
            link["sig"], link["node"] = links[:, 0], links[:, 1]
            rows = np.concatenate([runs, link])
            for lo in range(0, len(rows), 100_000):
                some = rows[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[k])) for k in POSTING.names], list(POSTING.names))

        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for lo, hi in byte_slices(texts):
                for grams in gram_sets(texts.slice(lo, hi - lo), plan.n):
                    sigs = plan.signatures(grams)
                    sigs = sigs[sigs % np.uint64(parts) == part]
                    if len(sigs):
                        p = np.empty(len(sigs), POSTING)
                        p["sig"], p["node"], p["low"], p["high"] = sigs.view(np.int64), node_of(grams), len(grams), len(grams)
                        held.append(p)
                        n += len(p)
                    if n > FLUSH:
                        yield from send()
                        held.clear()
                        n = 0
        if held:
            yield from send()

    def read(batches):
        import pyarrow as pa

        def postings():
            for batch in batches:
                p = np.empty(batch.num_rows, POSTING)
                for i, k in enumerate(POSTING.names):
                    p[k] = batch.column(i).to_numpy()
                made = p["low"] == 0
                yield p[~made], p[made]

        held = []

        def lists():
            for p, made in postings():
                held.append(np.stack([made["sig"], made["node"]], 1))
                yield p

        for links in scan(lists(), percent):
            links = np.unique(np.concatenate([links, *held]), axis=0)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])
        if held:
            links = np.concatenate(held)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    percent = plan.percent
    sent = docs.select("text").mapInArrow(post, "sig long, node long, low int, high int")
    return sent.repartition("sig").sortWithinPartitions("sig", "low").mapInArrow(read, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, head): the least node of each node's component, by alternating large-star and small-star steps with checkpoints.

    Least neighbours, at most two rows a link, are broadcast while BROADCAST_ROWS holds them (checked each round): then links are not
    shuffled by node, and a node with very many links is no task of its own.  Beyond that they are joined by a shuffle.
    """

    def state(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    def pair(u: str, v: str):
        return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    def nearer(edges: DataFrame, n: int) -> DataFrame:
        bounded = F.broadcast if 2 * n <= BROADCAST_ROWS else (lambda df: df)
        both = edges.select(F.inline(F.array(pair("u", "v"), pair("v", "u"))))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(bounded(near), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # no more rows than edges
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        return large.join(bounded(least), "u").select(F.inline(F.array(pair("v", "m"), pair("u", "m")))).filter("u != v").distinct()

    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before, now = None, state(edges)
    while now[0] and now != before:
        edges = cut_lineage(nearer(edges, now[0]))
        first, before, now = before is None, now, state(edges)
        if first:  # the links' own table is no longer held, nor the shuffles that made it
            release(links.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("head")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())


def shared_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of the others shares with one; all sorted and distinct."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


def linked(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """Label (index of a member) of each set's component under the exact condition; sets: sorted distinct hashes.

    known: labels (any indices) of sets already known to be in one component.  Only sets of possible sizes, not yet in one component,
    and within the bound of bucket counts are intersected, some at a time, so that a link found saves the tests of what it joins.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(s) for s in sets], np.int64)[order]
    counts = np.frombuffer(b"".join(bucket_counts(sets[i], 8) for i in order), np.uint8).reshape(-1, 256).astype(np.int16)
    label = np.arange(len(sets))
    if known is not None:
        _, first, back = np.unique(known[order], return_index=True, return_inverse=True)
        label = first[back]
    last = np.searchsorted(size, 100 * size // percent, "right")
    for i in range(len(sets)):
        js = np.arange(i + 1, last[i])
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        js = js[np.abs(counts[js] - counts[i]).sum(1) <= most_apart(size[i] + size[js], percent)]
        step = 1
        while len(js):
            some, js = js[:step], js[step:]
            shared = shared_counts(sets[order[i]], [sets[order[j]] for j in some])
            for j in some[100 * shared >= percent * (size[i] + size[some] - shared)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
            js, step = js[label[js] != label[i]], min(64, 2 * step)
    out = np.empty(len(sets), np.int64)
    out[order] = order[label]
    return out


def _tested(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, label, head, blocks) of rows head, blocks, x, y, node, known, text: exact components inside each (head, x, y)."""

    def run(key, table):
        import pyarrow as pa

        seen: dict[int, tuple] = {}
        table = table.combine_chunks()
        texts = table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0)
        nodes, known = table["node"].to_pylist(), table["known"].to_pylist()
        for lo, hi in byte_slices(texts):
            for i, grams in enumerate(gram_sets(texts.slice(lo, hi - lo), n), lo):
                if nodes[i] not in seen and node_of(grams) == nodes[i]:
                    seen[nodes[i]] = grams, known[i]
        ids = np.fromiter(seen, np.int64, len(seen))
        label = ids[linked([g for g, _ in seen.values()], percent, np.array([k for _, k in seen.values()], np.int64))] if len(ids) else ids
        return pa.table({"node": ids, "label": label, "head": pa.array([key[0].as_py()] * len(ids), pa.int64()), "blocks": pa.array([key[1].as_py()] * len(ids), pa.int32())})

    return texts.select("head", "blocks", "x", "y", "node", "known", "text").groupBy("head", "blocks", "x", "y").applyInArrow(run, "node long, label long, head long, blocks int")


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _closer(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): of rows head, node, text, links that connect all nodes of a head which may link by their sizes and sketches.

    Sketches, not texts, are dealt to every pair of a head's blocks: that grows with the square of a group only beyond SKETCH_PARTS *
    SKETCH_NODES nodes, by SKETCH_BITS / 8 bytes a node and block.
    """

    def drawn(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi in byte_slices(batch.column(2)):
                rows = batch.slice(lo, hi - lo)
                sets = gram_sets(rows.column(2), n)
                same = pa.array([node_of(s) == k for s, k in zip(sets, rows.column(1).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(sketch, sets), pa.binary())], ["head", "node", "size", "bits"]).filter(same)

    def run(key, table):
        import pyarrow as pa

        node, size, own = (table[k].to_numpy() for k in ("node", "size", "own"))
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8)
        label = alike(bits, size, *(np.flatnonzero(own == k.as_py()) for k in key[1:]), percent)
        met = label != np.arange(len(label))
        return pa.table({"a": node[met], "b": node[label][met]})

    drawn_once = cut_lineage(texts.select("head", "node", "text").mapInArrow(drawn, "head long, node long, size long, bits binary"))
    nodes = F.count(F.lit(1))  # heads are few, as each has more than a block; dealt by head alone, a group's pairs would be one task
    parts = F.ceil(nodes / F.least(F.lit(SKETCH_NODES), F.greatest(F.lit(SKETCH_LEAST), nodes / SKETCH_PARTS))).cast("int")
    dealt = drawn_once.join(F.broadcast(drawn_once.groupBy("head").agg(parts.alias("parts"))), "head").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    pairs = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("head", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "node", "size", "bits")
    return pairs.groupBy("head", "x", "y").applyInArrow(run, "a long, b long")


def _marked(df: DataFrame, key: str, keys: DataFrame, of: str) -> DataFrame:
    """df with __may: true for every row whose key is in keys.of, and for few others.

    A Bloom filter of at most BROADCAST_ROWS words (rows of a broadcast) with three bits a key: what it leaves out needs no shuffle.
    """

    def word(c: str):
        return F.pmod(F.xxhash64(F.col(c), F.lit(4)), F.lit(max(1, BROADCAST_ROWS)))

    def bits(c: str):
        a, b, d = (F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(F.xxhash64(F.col(c), F.lit(5)), 6 * k).bitwiseAND(63).cast("int")) for k in range(3))
        return a.bitwiseOR(b).bitwiseOR(d)

    words = keys.groupBy(word(of).alias("__word")).agg(F.bit_or(bits(of)).alias("__bits"))
    found = df.withColumn("__word", word(key)).join(F.broadcast(words), "__word", "left")
    return found.withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(bits(key)) == bits(key), F.lit(False))).drop("__word", "__bits")


def verified(docs: DataFrame, nodes: DataFrame, heads: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, label): exact components among the candidates.  docs: doc_id, key, text; nodes: node, size, first (a document's doc_id
    and key); heads: node, head.

    A group too large for one task (many texts may be chained by lines that they share) is first cut into what may link by sketches.
    What is still too large is cut into blocks.  Each is tested by itself; then one member of each cluster found, against each
    other; then, for the links still possible, all that is outside the group's largest cluster against every block.  So a group of
    near copies costs its size, and only the number of *different* texts whose sketches look alike costs more.
    """
    members = cut_lineage(heads.join(nodes, "node"))

    def grouped(rows: DataFrame) -> DataFrame:
        """rows (node, size, head, first) of heads with more than one node, with the head's blocks and the own one."""
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("size") / BLOCK_GRAMS)).cast("int")
        sized = rows.groupBy("head").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("head", "blocks")
        return cut_lineage(rows.join(sized, "head").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("node", "size", "head", "blocks", "own"))

    wanted = grouped(members)
    at = wanted.select("node").join(nodes, "node").select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"))
    if wanted.count() <= BROADCAST_ROWS:
        at = F.broadcast(at)
    else:
        docs = _marked(docs, "key", at, "key").filter("__may")
    texts = docs.alias("d").join(at.alias("w"), (F.col("d.key") == F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("node", "text").dropDuplicates(["node"])
    stored = scratch(texts.sparkSession, "texts")
    texts.write.parquet(stored)
    texts = _freed(texts.sparkSession.read.schema("node long, text string").parquet(stored))
    chained = wanted.filter("blocks > 1")
    if _some(chained):
        closer = components(_closer(texts.join(chained.select("node", "head"), "node"), n, percent)).toDF("node", "head")
        wanted = wanted.filter("blocks = 1").unionByName(grouped(chained.select("node", "size").join(closer, "node")))
    inside = cut_lineage(_tested(texts.join(wanted, "node").select("*", F.col("own").alias("x"), F.col("own").alias("y"), F.col("node").alias("known")), n, percent))
    one = inside.filter("blocks = 1").select("node", "label")
    large = inside.filter("blocks > 1")
    if not _some(large):
        return one
    heads_of = F.broadcast(wanted.filter("blocks > 1").select("head").distinct()) if wanted.filter("blocks > 1").select("head").distinct().count() <= BROADCAST_ROWS else wanted.filter("blocks > 1").select("head").distinct()
    held = cut_lineage(texts.join(wanted.join(heads_of, "head"), "node"))

    def united(clusters: DataFrame, found: DataFrame) -> DataFrame:
        """clusters (node, label, head) with the labels that found (label, label) links unite."""
        named = components(found.toDF("a", "b")).toDF("label", "united")
        return cut_lineage(clusters.join(named, "label", "left").select("node", F.coalesce("united", "label").alias("label"), "head"))

    # one member of each cluster
    some = large.filter("node = label").select("node", "head")
    dealt = some.join(some.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).cast("int").alias("n")), "head").withColumn("x", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")).cast("int"))
    first = _tested(held.join(dealt.select("node", "x"), "node").select("*", F.col("x").alias("y"), F.col("node").alias("known")), n, percent)
    clusters = united(large.select("node", "label", "head"), first.select(F.col("node"), "label"))
    # what is outside the largest cluster, against all
    largest = clusters.groupBy("head", "label").count().groupBy("head").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    rest = cut_lineage(clusters.join(largest, "head").filter("label <> largest").select("node", "head"))
    if _some(rest):
        split = rest.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).cast("int").alias("n"))
        rows = held.join(clusters.select("node", F.col("label").alias("known")), "node").join(split, "head")
        every = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("x", F.col("own"))
        apart = rows.join(rest.select("node"), "node", "left_semi").withColumn("y", F.pmod(F.xxhash64("node", F.lit(2)), F.col("n")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = _tested(every.unionByName(apart), n, percent).select("node", F.col("label").alias("met"))
        of = clusters.select(F.col("node").alias("met"), F.col("label").alias("other"))
        clusters = united(clusters, found.filter("node <> met").join(clusters, "node").join(of, "met").filter("label <> other").select("label", "other").distinct())
    return one.unionAll(clusters.select("node", "label"))


def _rows(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (hash of the text), size, node, least (doc_id and key of the component's first row) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = cut_lineage(sets_of(kept, n))
    sizes = {r[0]: r[1] for r in rows.filter(F.col("size").between(1, LIGHT_SIZES)).groupBy("size").count().collect()}  # at most LIGHT_SIZES rows
    plan = Plan(n, percent, boundary_by_cost(sizes, 1.0, percent))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = cut_lineage(rows.filter("node is not null").groupBy("node").agg(F.first("size").alias("size"), F.min(order).alias("first")))
    labels = verified(kept, nodes, components(candidate_links(kept, plan)), n, percent)
    named = nodes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    return rows.join(named.join(least, "label").select("node", "least"), "node", "left").select("doc_id", "key", "size", "node", "least")


def join_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: sets link when 100 * shared >= percent * united (percent of 50 or more).

    Null, empty and white texts have no n-grams and stand alone (their own id, null for a null id); equal sets are linked; a
    component's id is its least non-null doc_id; repeated rows are in one component; texts of any length are read whole; other
    columns are ignored; an empty table gives no rows.
    """
    rows = _rows(docs, n, percent, id_col, text_col)
    return rows.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """documents, of each component only the row of the least id (for an id with several texts, the one of the least text hash).

    Null, empty and white texts have no n-grams and all stay, but for repeated rows; of rows that repeat both id and text the first in
    order of the other columns stays.  Rows with a null id can't be told apart and all stay.  An empty table stays empty.  Names of
    other columns don't matter but for those that begin with two underscores.  The texts are not shuffled while the rows to drop fit a
    broadcast of checked size; beyond that only those that a filter of that size doesn't rule out.
    """
    found = cut_lineage(_rows(docs, n, percent, "doc_id", "text").filter("doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "least"))

    def bounded(ids: DataFrame) -> DataFrame:
        ids = cut_lineage(ids)
        return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    keyed = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__hash") == F.col("__key"))
    others = cut_lineage(found.filter("__id <> least.doc_id or __key <> least.key").select("__id", "__key").distinct())
    if others.count() <= BROADCAST_ROWS:
        kept = keyed.join(F.broadcast(others), same, "left_anti")
    else:
        marked = _marked(keyed, "__hash", others, "__key")
        kept = marked.filter("not __may").unionAll(marked.filter("__may").join(others, same, "left_anti"))
    again = found.groupBy("__id", "__key").count().filter("count > 1").select("__id", "__key")
    if not _some(again):
        return kept.select(*docs.columns)
    again = bounded(again)
    first = Window.partitionBy("doc_id", "__hash").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    repeated = kept.join(again, same, "left_semi").withColumn("__place", F.row_number().over(first)).filter("__place = 1").select(*docs.columns)
    return kept.join(again, same, "left_anti").select(*docs.columns).unionAll(repeated)
