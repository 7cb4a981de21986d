"""Weak supervision of quality: rules vote good or bad or abstain, EM estimates their accuracies, a posterior decides.

The label model needs only how often each pattern of votes occurs, at most 3 ** (number of rules) counts over the whole corpus, so
EM runs on the driver on exact corpus statistics whose size does not depend on the data.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, prepare
from .tokens import text_slices

WINDOW = 8
WHITE = b" \t\n\x0b\x0c\r"
#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
#: All symbols as one, all white space as one.
PLAIN = bytes.maketrans(SYMBOLS + WHITE, b"#" * len(SYMBOLS) + b" " * len(WHITE))
UPPER, DIGITS, HIGH = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256))
LETTERS = UPPER + bytes(range(97, 123))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_upper", "n_digits", "n_letters", "n_distinct", "n_symbol_ends")

#: name, ratio (SQL), votes bad outside these limits, votes good inside these, else abstains.
RULES = (
    ("length", "n_words", (-1, math.inf), (60, math.inf)),
    ("word_length", "word_chars / n_words", (2.0, 14.0), (2.8, 10.0)),
    ("symbols", "n_symbols / n_words", (-1, 0.25), (-1, 0.03)),
    ("duplicate_lines", "n_dup_lines / n_lines", (-1, 0.3), (-1, 0.05)),
    ("repeated_windows", "n_repeat_words / n_words", (-1, 0.25), (-1, 0.05)),
    ("closed_lines", "n_closed_lines / n_lines", (0.2, 2), (0.6, 2)),
    ("capitals", "n_upper / n_letters", (-1, 0.4), (-1, 0.15)),
    ("digits", "n_digits / word_chars", (-1, 0.3), (-1, 0.08)),
    ("letters", "n_letters / word_chars", (0.8, 9), (0.92, 9)),
    ("marked_words", "n_symbol_ends / n_words", (-1, 0.2), (-1, 0.03)),
    ("vocabulary", "n_distinct / n_words", (0.1, 2), (0.25, 2)),
)


def repeated_words(hashes: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """For each document the words inside windows that it holds twice or more; hashes: of the words, doc: their documents, ascending."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    odd = np.random.default_rng(8).integers(1, 1 << 62, window + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    code = doc[:n].astype(np.uint64) * odd[window]
    for k in range(window):
        x = hashes[k : k + n] * odd[k]
        code += x ^ (x >> np.uint64(29))
    own = np.flatnonzero(doc[:n] == doc[window - 1 :])
    order = own[np.argsort(code[own])]
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = order[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and STATS of each whole text (null: empty); words are runs of anything but the six ASCII white-space characters."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for keys, texts in text_slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, words, counts = [], [], []
                for text in texts:
                    b = text.encode()
                    w = b.split()
                    lines = [x for x in b.split(b"\n") if x.strip()]
                    closed = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
                    without = lambda drop, b=b: len(b) - len(b.translate(None, drop))
                    letters = without(LETTERS) + len(text) - len(b.translate(None, HIGH))  # beyond ASCII all count as letters
                    rows.append((len(w), len(text) - without(WHITE), without(SYMBOLS), len(lines) - len(set(lines)), 0, len(lines), closed, without(UPPER), without(DIGITS), letters, len(set(w)), (b + b" ").translate(PLAIN).count(b"# ")))
                    words += w
                    counts.append(len(w))
                doc = np.repeat(np.arange(len(texts)), counts)
                table = np.array(rows, np.int64).reshape(-1, len(STATS))
                table[:, 4] = repeated_words(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), doc, len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(table[:, i]) for i in range(len(STATS)))], ["doc_id", *STATS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def votes(rules=RULES):
    """Pattern of votes as a number in base 3: 0 abstain, 1 bad, 2 good; a ratio without a denominator abstains."""
    code = F.lit(0)
    for _, ratio, (low, high), (least, most) in rules:
        top, _, below = ratio.partition(" / ")
        x = F.col(top) / F.nullif(F.col(below), F.lit(0)) if below else F.col(top).cast("double")
        vote = F.when((x < low) | (x > high), 1).when((x >= least) & (x <= most), 2).otherwise(0)
        code = code * 3 + F.coalesce(vote, F.lit(0))
    return code.cast("long")


def estimate(patterns: dict[int, int], n_rules: int, rounds: int = 200, smooth: float = 2.0) -> tuple[float, list[tuple[float, float]]]:
    """(prior of good, per rule how often it is right on bad and on good documents when it votes) by EM over pattern counts.

    The two accuracies tell a rule that nearly always votes good from one whose rare bad votes mean something.  Starts from a
    belief that halves with every bad vote; accuracies are smoothed, and a bad vote never speaks for good.
    """
    codes, counts = np.array(list(patterns), np.int64), np.array(list(patterns.values()), float)
    vote = np.stack([codes // 3 ** (n_rules - 1 - j) % 3 for j in range(n_rules)], 1) if len(codes) else np.zeros((0, n_rules), np.int64)
    good, bad = (vote == 2).astype(float), (vote == 1).astype(float)
    belief = 0.9 * 0.4 ** bad.sum(1)
    prior, rates = 0.5, np.full((2, n_rules), 0.7)
    for _ in range(rounds):
        q, r = belief * counts, (1 - belief) * counts
        prior = (q.sum() + smooth) / (counts.sum() + 2 * smooth)
        before = rates
        on_good = (good.T @ q + 0.9 * smooth) / ((good + bad).T @ q + smooth)
        on_bad = (bad.T @ r + 0.5 * smooth) / ((good + bad).T @ r + smooth)
        on_good = np.clip(on_good, 0.001, 0.999)
        rates = np.stack([np.clip(np.maximum(on_bad, 1 - on_good), 0.001, 0.999), on_good])
        weight_good, weight_bad = np.log(rates[1] / (1 - rates[0])), np.log((1 - rates[1]) / rates[0])
        belief = 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + good @ weight_good + bad @ weight_bad, -50, 50)))
        if np.abs(rates - before).max() < 1e-9:
            break
    return float(prior), [(float(a), float(b)) for a, b in rates.T]


def posterior(pattern, prior: float, accuracy: list[tuple[float, float]]):
    """Posterior probability of good as a column of the pattern."""
    n = len(accuracy)
    score = F.lit(math.log(prior / (1 - prior)))
    for j, (on_bad, on_good) in enumerate(accuracy):
        weights = [0.0, math.log((1 - on_good) / on_bad), math.log(on_good / (1 - on_bad))]
        score = score + F.get(F.lit(weights), F.pmod(F.floor(pattern / F.lit(3 ** (n - 1 - j))), F.lit(3)).cast("int"))
    return 1 / (1 + F.exp(-score))


def judge(docs: DataFrame, threshold: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, STATS, base_failed, quality (posterior), kept of every row.

    Null and empty texts have no words and fail the base; null ids and repeated rows are judged like others; other columns are
    ignored; an empty table gives no rows.  One pass over the texts; the narrow rows are checkpointed for the second reading.
    """
    rows = cut_lineage(statistics(docs, id_col, text_col).withColumn("pattern", votes()))
    patterns = {r[0]: r[1] for r in rows.groupBy("pattern").count().collect()}  # at most 3 ** len(RULES)
    prior, accuracy = estimate(patterns, len(RULES))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("quality", posterior(F.col("pattern"), prior, accuracy)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("pattern")
