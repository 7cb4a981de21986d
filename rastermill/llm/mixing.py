"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

Documents are permuted inside their source by a hash; the leading bits of that hash cut the permutation into blocks.  A source's
target fixes an exact quota of blocks: whole passes over the source, then a prefix of one more pass (its last block is split
between documents).  The tree halves the shards again and again and draws how many of a node's blocks of each source go left, so
every shard gets disjoint runs of permuted blocks in random but exact proportions; a shard is then shuffled by itself.
"""

from __future__ import annotations

import json
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut_lineage

#: Hex digits of the permutation key that name a block: 16**3 blocks a source.
BLOCK_DIGITS = 3
#: Words of a shard when shards are sized by the table, and numbers of a plan (shards times sources).
SHARD_WORDS, PLAN_NUMBERS = 1 << 24, 2_000_000
#: Plans of more sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000


def targets(sizes: list[tuple], weights: tuple[int, ...], share: Fraction, most: int) -> list[tuple]:
    """(target, whole passes, words of the last pass) of each (source, size), in code-point order, null last.

    What exceeds most times a source's size is shared again by weight until none is above: the fixed point is one level L with
    target = min(most * size, L * weight), found by capping sources in the order of most * size / weight.
    """
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0] is None, (sizes[i][0] or "").encode()))
    weight = {i: weights[r % len(weights)] for r, i in enumerate(order)}
    rest, left = share * sum(n for _, n in sizes), sum(weight.values())
    out: dict[int, tuple] = {}
    for i in sorted(order, key=lambda i: Fraction(most * sizes[i][1], weight[i])):
        cap = most * sizes[i][1]
        if cap * left > rest * weight[i]:
            break
        out[i] = (float(cap), most, 0.0)
        rest, left = rest - cap, left - weight[i]
    for i in order:
        if i not in out:
            n, (up, down) = sizes[i][1], (rest * weight[i] / left).as_integer_ratio()
            target = up / down
            passes = int(target // n)
            out[i] = (target, passes, target - passes * n)
    return [out[i] for i in range(len(sizes))]


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each source the cumulative block counts at the end of each shard."""
    import numpy as np

    def down(q: np.ndarray, n: int, path: int) -> list[np.ndarray]:
        if n == 1:
            return [q]
        half = n // 2
        take = int(q.sum()) * half // n
        rng = np.random.default_rng([seed, path])
        go = draw_of_each(rng, q, take)
        return down(go, half, 2 * path) + down(q - go, n - half, 2 * path + 1)

    return np.cumsum(down(np.array(quotas, np.int64), shards, 1), 0).T.tolist()


#: Blocks in all up to which the library draws by itself.
LIBRARY = 10**9


def hypergeometric(rng, good: int, bad: int, take: int) -> int:
    """How many of take blocks drawn without replacement are good, for counts of any size: two binomial draws with one rate, given
    that they make up take, have exactly this distribution."""
    import numpy as np

    if good + bad < LIBRARY:
        return int(rng.hypergeometric(good, bad, take))
    if not (0 < take < good + bad and good and bad):
        return min(good, take)
    tries = 64
    while True:
        x, y = (rng.binomial(n, take / (good + bad), tries) for n in (good, bad))
        hit = np.flatnonzero(x + y == take)
        if len(hit):
            return int(x[hit[0]])
        tries = min(2 * tries, 1 << 16)


def draw_of_each(rng, q, take: int):
    """A multivariate hypergeometric draw: halves of the sources first, until the library's range is reached."""
    import numpy as np

    if int(q.sum()) < LIBRARY:
        return rng.multivariate_hypergeometric(q, take, method="marginals")
    if len(q) == 1:
        return np.array([take], q.dtype)
    half = len(q) // 2
    go = hypergeometric(rng, int(q[:half].sum()), int(q[half:].sum()), take)
    return np.concatenate([draw_of_each(rng, q[:half], go), draw_of_each(rng, q[half:], take - go)])


def permutation_key(id_col: str, seed: str):
    return F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 16)


def plan(docs: DataFrame, weights=(3, 1, 2), share=Fraction(3, 2), most=2, shards=64, seed="mix", id_col="doc_id", text_col="text", source_col="source") -> tuple[DataFrame, DataFrame]:
    """(sized, plan): rows doc_id, source, size, key of all documents (checkpointed), and a row for each source."""
    spark = docs.sparkSession
    sized = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), permutation_key(id_col, seed).alias("key")))
    block = F.substring("key", 1, BLOCK_DIGITS)
    blocks = cut_lineage(sized.groupBy("source", block.alias("block")).agg(F.sum("size").alias("words")))
    sources = [(r[0], r[1]) for r in blocks.groupBy("source").agg(F.sum("words")).collect()]  # a row for each source
    aims = targets(sources, weights, share, most)

    def table(rows: list[dict], schema: str) -> DataFrame:
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))

    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_SOURCES else df
    aimed = table([{"source": s, "source_size": n, "target": t, "passes": p, "rest": r} for (s, n), (t, p, r) in zip(sources, aims, strict=True)], "source:string,source_size:bigint,target:double,passes:int,rest:double")
    ahead = F.sum("words").over(Window.partitionBy("b.source").orderBy("block"))
    crossing = blocks.alias("b").join(small(aimed.alias("a"), len(sources)), F.col("b.source").eqNullSafe(F.col("a.source"))).select("b.source", "block", "rest", (ahead - F.col("words")).alias("before"), ahead.alias("after")).filter("before < rest and after >= rest")
    # documents of the one block of each source that the last pass splits: at most 16**-BLOCK_DIGITS of a source
    inside = sized.alias("d").join(small(crossing.alias("c"), len(sources)), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.substring("key", 1, BLOCK_DIGITS) == F.col("block"))).groupBy("d.source", "block", "rest", "before", "key").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("key"))
    cuts = {r[0]: r[1:] for r in inside.select("source", "block", "key", (2 * upto - F.col("words") <= 2 * F.col("rest")).alias("fits")).groupBy("source").agg(F.first("block"), F.max(F.when(F.col("fits"), F.col("key")))).collect()}
    slots = 16**BLOCK_DIGITS
    quotas = [p * slots + (int(cuts[s][0], 16) + 1 if s in cuts else 0) for (s, _), (_, p, _) in zip(sources, aims, strict=True)]
    shard_ends = split_quotas(quotas, shards, int.from_bytes(seed.encode()[:8], "little")) if sources else []
    rows = [{"source": s, "source_size": n, "target": t, "passes": p, "cut": "" if s not in cuts else cuts[s][1] or cuts[s][0], "shard_ends": e} for (s, n), (t, p, _), e in zip(sources, aims, shard_ends, strict=True)]
    made = table(rows, "source:string,source_size:bigint,target:double,passes:int,cut:string,shard_ends:array<bigint>")
    return sized, small(made, len(rows))


def assign(keyed: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds source_size, target, source_blocks (the source's block quota) and shards (one for each time the document is taken, where the
    tree put that block) to rows with source and key."""
    slot = F.conv(F.substring("key", 1, BLOCK_DIGITS), 16, 10).cast("long")
    ends = F.col("p.shard_ends")

    def shard_of(at):  # shards that end at or before it, by bisection
        steps = F.lit([1 << b for b in reversed(range(16))])
        return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(ends, low + step - 1) <= at, F.lit(False)), low + step).otherwise(low))

    times = F.col("p.passes") + F.when(F.col("key") <= F.col("p.cut"), 1).otherwise(0)
    number = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    shards = F.transform(number, lambda t: shard_of(t * 16**BLOCK_DIGITS + slot))
    return keyed.alias("k").join(planned.alias("p"), F.col("k.source").eqNullSafe(F.col("p.source")), "left").select("k.*", "p.source_size", "p.target", F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)).alias("source_blocks"), shards.alias("shards"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, key, source_size, target, source_blocks, shards of every row.

    Null texts have size 0, a null source is a source of its own (last), a null id has a key of its own; rows of one id share a
    key, so they are taken alike; other columns are ignored; an empty table gives no rows.
    """
    return assign(*plan(docs, **options))


def draw(docs: DataFrame, shards: int | None = None, id_col="doc_id", text_col="text", source_col="source", seed="mix", **options) -> DataFrame:
    """The documents themselves, as often as the mix takes them, dealt into shards and shuffled within each.

    Without a number of shards there is one for every SHARD_WORDS words of the table, 16 at least, at most 2048 and PLAN_NUMBERS over
    all sources.  Nulls, repeated rows and empty tables as in mix; rows keep all their columns, whatever their names.
    """
    if shards is None:
        words, sources = docs.agg(F.sum(F.regexp_count(text_col, F.lit(WORD))), F.count_distinct(F.coalesce(F.col(source_col).cast("string"), F.lit("")))).first()
        shards = max(16, min(2048, (words or 0) // SHARD_WORDS, PLAN_NUMBERS // max(1, sources)))
    _, planned = plan(docs, shards=shards, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    held = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), permutation_key(id_col, seed).alias("key"))
    taken = assign(held, planned).select("row", "key", F.posexplode("shards").alias("time", "shard"))
    return taken.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.xxhash64("key", "time")).select("row.*")
