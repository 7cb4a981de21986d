"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Patterns with known forms are always reported.  Other long mixed runs of characters are candidates: their hashes are counted by
distinct repositories (texts, so that copies count once) and owners (sources) over the whole corpus.  What several owners hold in
texts of their own is a copied example; what belongs to one owner, in however many documents, looks live and is reported too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: The patterns' kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "owned")
#: Letter cases are spelled out so that only ASCII letters fold.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that fails its least length holds no later match, so the lengths stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"

#: Owned spans are broadcast up to this many rows and spans (about 20 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 200_000

SPAN = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,end:int,value:string>>"


def let(value, body):
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Numbers summed one after another; sums of such blocks are added before.
BLOCK = 128
#: Code points of the blocks that a text is redacted by.
TEXT_BLOCK = 1024


def sums_before(numbers):
    """For each number of an array the sum of those before it: sums of blocks first, then inside a block."""
    add = lambda a, x: a + x

    def within(held):
        ahead = F.transform(held["blocks"], lambda _, j: F.aggregate(F.slice(held["blocks"], F.lit(1), j), F.lit(0), add))
        return let(ahead, lambda upto: F.transform(held["numbers"], lambda _, i: F.get(upto, F.floor(i / BLOCK).cast("int")) + F.aggregate(F.slice(held["numbers"], i - i % BLOCK + 1, i % BLOCK), F.lit(0), add)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")), lambda j: F.aggregate(F.slice(numbers, j * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add))
    return let(F.struct(numbers.alias("numbers"), blocks.alias("blocks")), within)


def matches(text, pattern: str, group: int = 0):
    """All leftmost non-overlapping matches: array of (start, end, value of the group); code points, end exclusive.

    Splitting by the pattern gives the text between matches, so a match starts after all earlier pieces and matches.
    """
    parts = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("between"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )

    def place(s):
        def one(ahead):
            start = lambda i: F.get(ahead, i) + F.get(s["between"], i)
            return F.transform(s["values"], lambda value, i: F.struct(start(i).alias("start"), (start(i) + F.get(s["hits"], i)).alias("end"), value.alias("value")))

        return let(sums_before(F.transform(s["hits"], lambda n, i: n + F.get(s["between"], i))), one)

    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, place)).otherwise(F.array().cast(FOUND))


def _spans(found, kind: int):
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_parts(text) -> list:
    """The spans of each known form, each sorted and without overlaps."""
    assigned = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= 8)
    return [_spans(assigned, 0).cast(SPAN), _spans(matches(text, ACCESS), 1).cast(SPAN), _spans(matches(text, HEX), 2).cast(SPAN)]


def all_spans(base, live):
    return F.array_sort(F.concat(base, F.coalesce(live, F.array()).cast(SPAN)))


def last_before(spans, least):
    """The last of sorted spans without overlaps that begins before a place (NULL if none), by bisection."""
    steps = F.lit([1 << b for b in reversed(range(24))])
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(spans, low + step - 1)["start"] < least, F.lit(False)), low + step).otherwise(low))
    return F.get(spans, at - 1)


def ownership(docs: DataFrame, max_owners: int, id_col: str, text_col: str, owner_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, live): doc_id, text_hash and base of each document (checkpointed), and the owned spans of those that have any.

    Owned is what at most so many owners hold, in any number of documents, or what has an owner that holds all texts with it (so a
    copy of a text under another owner doesn't make a second one).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    mixed = F.filter(matches(F.col("text"), CANDIDATE), lambda m: F.regexp_like(m["value"], F.lit("[0-9]")) & F.regexp_like(m["value"], F.lit("[A-Za-z]")))
    found = first.select("doc_id", "owner", "text_hash", *[x.alias(f"base{k}") for k, x in enumerate(base_parts(F.col("text")))], mixed.alias("runs"))

    def free(m):
        met = [F.coalesce(last_before(F.col(f"base{k}"), m["end"])["end"] > m["start"], F.lit(False)) for k in range(3)]
        return ~(met[0] | met[1] | met[2])

    listed = F.transform(F.filter("runs", free), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.sha2(m["value"], 256).alias("hash")))
    rows = cut_lineage(found.select("doc_id", "owner", "text_hash", F.array_sort(F.concat("base0", "base1", "base2")).alias("base"), listed.alias("runs")))
    runs = rows.filter(F.size("runs") > 0).select("doc_id", "owner", "text_hash", F.inline("runs"))
    held = runs.select("hash", "owner", "text_hash").distinct()
    owners = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("texts")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.max("texts").alias("most"))
    texts = held.select("hash", "text_hash").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("texts"))
    owned = owners.join(texts, "hash").filter((F.col("owners") <= max_owners) | (F.col("most") == F.col("texts"))).select("hash")
    live = runs.join(owned, "hash").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", F.lit(3).alias("kind"), "end")).cast(SPAN).alias("live"))
    return rows.select("doc_id", "text_hash", "base"), live


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def scan(docs: DataFrame, max_owners: int = 1, id_col="doc_id", text_col="text", owner_col="source") -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end, sorted) of each row.

    Null and empty texts have no spans; texts of any length are read whole; a null owner is an owner of its own; repeated rows are each
    reported, and equal texts of one owner count once; an empty table gives no rows; other columns are ignored.  One pass over the
    texts leaves narrow rows; candidates are deduplicated by (hash, owner, text) before they are counted, so a hot hash is summed by
    partial aggregates.
    """
    rows, live = ownership(docs, max_owners, id_col, text_col, owner_col)
    return rows.alias("r").join(live.alias("l"), _same("r", "l"), "left").select("r.doc_id", "r.base", all_spans(F.col("r.base"), F.col("l.live")).alias("spans"))


def joined(spans):
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text, spans, mark: str = "[SECRET]"):
    """The text with every span (overlapping ones together) replaced by the mark.

    spans: sorted, those of one kind without overlaps.  The text is cut into blocks once, so that a piece is looked for near its place.
    """

    def piece(blocks, begin, end):
        low = F.floor(begin / TEXT_BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, low + 1, F.floor(end / TEXT_BLOCK).cast("int") - low + 1), "")
        return F.substr(near, begin - low * TEXT_BLOCK + 1, end - begin)

    def made(s):
        def ends(m):  # the farthest end among the spans listed before
            before = [F.coalesce(last_before(s[f"k{k}"], m["start"] + F.when(m["kind"] > k, 1).otherwise(0))["end"], F.lit(0)) for k in range(len(KINDS))]
            return F.greatest(*before)

        open_ = F.filter(F.transform(s["spans"], lambda m: F.struct(m["start"].alias("start"), ends(m).alias("at"))), lambda m: m["start"] >= m["at"])
        kept = F.transform(open_, lambda m: F.concat(piece(s["blocks"], m["at"], m["start"]), F.lit(mark)))
        last = F.greatest(*[F.coalesce(F.get(s[f"k{k}"], F.size(s[f"k{k}"]) - 1)["end"], F.lit(0)) for k in range(len(KINDS))])
        return F.concat(F.array_join(kept, ""), piece(s["blocks"], last, F.length(text)))

    def of_kind(k):
        return F.filter(spans, lambda m: m["kind"] == k)

    held = F.struct(spans.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)).alias("blocks"), *[of_kind(k).alias(f"k{k}") for k in range(len(KINDS))])
    return F.when(F.size(spans) == 0, text).otherwise(let(held, made))


def redact_documents(docs: DataFrame, mark: str = "[SECRET]", max_owners: int = 1) -> DataFrame:
    """documents with every span redacted and n_chars set anew; null texts stay null, empty ones empty.

    Rows are redacted one by one: repeated rows alike, rows that share an id by their own texts, rows without an id by their text; an
    empty table stays empty; names of other columns don't matter but for those that begin with two underscores.  The texts are not
    shuffled while the few owned spans fit a broadcast (rows and spans are checked); beyond that they are joined by a shuffle.
    """
    _, live = ownership(docs, max_owners, "doc_id", "text", "source")
    live = cut_lineage(live.withColumnsRenamed({"doc_id": "__doc", "text_hash": "__of", "live": "__live"}))
    n = live.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("__live")), F.lit(0))).first()[0]
    held = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    held = held.join(F.broadcast(live) if n <= BROADCAST_ROWS else live, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__of")), "left")
    spans = held.withColumn("__spans", all_spans(F.array_sort(F.concat(*base_parts(F.col("text")))), F.col("__live")))
    return spans.withColumn("text", redact(F.col("text"), F.col("__spans"), mark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
