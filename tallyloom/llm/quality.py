"""Quality of texts by weak supervision.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0). How far each can be
trusted is not set by hand: expectation-maximisation over the votes of all documents estimates how
often each is right, wrong and silent on good and on bad documents, and the share of good documents, and a document's votes then give
the probability that it is good. That replaces a chain of filters that all must pass.

The driver sees one count per pattern of votes, at most 3 to the power of the number of rules.
Null texts have no words. A document on which all rules abstain has the estimated share of good
documents as its probability. Repeated rows are judged one by one, each alike.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.llm.rows import arrow_schema, slices, texts_of, utf8
from tallyloom.operators.staging import stage

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
    "n_top", "n_upper", "n_letters", "n_bangs", "n_odd_words", "n_ends")
BLANKS = b" \t\n\r\x0b\x0c"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
FEWEST_WORDS, MOST_REPEATED = 50, 0.5
KEEP_FROM = 0.5
#: Each rule as (name, SQL that is true for a bad vote, SQL that is true for a good vote).
RULES = (
    ("symbols", "n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
    ("odd_words", "n_odd_words * 5 > n_words", "n_odd_words * 25 <= n_words"),
    ("capitals", "n_upper * 2 > n_letters", None),
    ("shouts", "n_bangs * 5 > n_words", None),
    ("repeated_windows", "n_repeat_words * 10 > n_words * 3", "n_repeat_words * 20 <= n_words"),
    ("one_word", "n_top * 5 > n_words", None),
    ("few_words", "n_distinct * 4 < n_words AND n_words < 2000", "n_distinct * 5 >= n_words * 2"),
    ("repeated_lines", "n_dup_lines * 2 > n_lines", None),
    ("sentences", "n_ends * 60 < n_words", "n_ends * 25 >= n_words"),
)


def counts_of(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text; words lie between ASCII white space."""
    words = text.split()
    if not words:
        return (0,) * len(COUNTS)
    triples = list(zip(words, words[1:], words[2:]))
    seen, repeated = Counter(triples), 0
    if len(seen) < len(triples):
        reached = 0  # words before this one are counted
        for i, triple in enumerate(triples):
            if seen[triple] > 1:
                repeated += i + 3 - max(reached, i)
                reached = i + 3
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    each = Counter(words)
    without = text.translate(None, BLANKS + bytes(range(0x80, 0xC0)))  # one byte per character
    plain = without.translate(None, b"#*$%&|<>")
    letters = len(text) - len(text.translate(None, LETTERS))
    odd = sum(n for w, n in each.items() if w.strip(b"#*$%&|<>") != w)
    ends = sum(n for w, n in each.items() if w.endswith((b".", b"?", b"!")))
    return (
        len(words), len(without), len(without) - len(plain), len(lines) - len(set(lines)), repeated,
        len(lines), len(each), each.most_common(1)[0][1],
        len(text) - len(text.translate(None, LETTERS[:26])), letters, text.count(b"!"), odd, ends)


def measured(docs: DataFrame, text_column: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts of its texts as further columns."""
    schema = StructType([*docs.schema.fields, *(StructField(prefix + c, LongType()) for c in COUNTS)])
    arrow = arrow_schema(schema)

    def run(batches):
        for part in slices(batches):
            found = list(zip(*map(counts_of, utf8(part, text_column)))) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(c, pa.int64()) for c in found)], schema=arrow)

    return docs.mapInArrow(run, schema)


def votes(prefix: str = "") -> list[Column]:
    """One column per rule, named as the rule; all abstain on a text without words."""
    def named(rule: str) -> Column:
        for c in sorted(COUNTS, key=len, reverse=True):
            rule = rule.replace(c, f"`{prefix}{c}`") if prefix else rule
        return F.expr(rule)

    out = []
    for name, bad, good in RULES:
        vote = F.when(named("n_words = 0"), 0).when(named(bad), -1)
        out.append((vote.when(named(good), 1) if good else vote).otherwise(0).alias(name))
    return out


def learned(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents and how rules vote, by expectation-maximisation over patterns of
    votes (-1, 0, 1) and how many documents have each.

    ``[rule, class, vote + 1]`` is how likely a rule votes so on bad (0) and good (1) documents: how often it is
    right, wrong or silent. It starts from rules that seldom fault a good document and each see one in four
    bad ones. Rules that do not vote, and tables without rows, keep the start."""
    rules = len(RULES)
    share, start = 0.9, np.tile(np.array([[0.25, 0.5, 0.25], [0.02, 0.49, 0.49]]), (rules, 1, 1))
    likely = start
    if not len(counts) or not counts.sum():
        return share, likely
    hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, rule, vote
    for _ in range(rounds):
        odds = math.log(share / (1 - share)) + np.einsum("prv,rv->p", hot, np.log(likely[:, 1] / likely[:, 0]))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        # as if one more document of each class had voted as at the start
        sums = np.stack([np.einsum("p,prv->rv", counts * g, hot) for g in (1 - good, good)], 1) + start
        before, likely = likely, sums / sums.sum(2, keepdims=True)
        share = float(np.clip(counts @ good / counts.sum(), 0.01, 0.99))
        if np.abs(likely - before).max() < 1e-9:
            break
    return share, likely


def weights(likely: np.ndarray) -> np.ndarray:
    """Log odds for good that a vote of each kind adds: ``[rule, vote + 1]``. A bad vote never counts for
    a document, nor a good one against it."""
    out = np.log(likely[:, 1] / likely[:, 0])
    out[:, 0], out[:, 2] = np.minimum(out[:, 0], 0), np.maximum(out[:, 2], 0)
    return out


def learn(counted: DataFrame, prefix: str = "") -> tuple[float, dict[str, list[float]]]:
    """``learned`` over all rows of a table that has the counts."""
    names = [name for name, _, _ in RULES]
    rows = counted.select(*votes(prefix)).groupBy(*names).agg(F.count("*").alias("_n")).collect()
    patterns = np.array([[r[n] for n in names] for r in rows], float).reshape(len(rows), len(names))
    share, likely = learned(patterns, np.array([r["_n"] for r in rows], float))
    return share, dict(zip(names, weights(likely).tolist()))


def verdict(share: float, weight: dict[str, list[float]], prefix: str = "") -> tuple[Column, Column]:
    """``quality``, the probability that a document is good, and ``base_failed``."""
    odds = F.lit(math.log(share / (1 - share)))
    for vote, (name, _, _) in zip(votes(prefix), RULES):
        bad, silent, good = weight[name]
        odds = odds + F.when(vote == -1, bad).when(vote == 1, good).otherwise(silent)
    n, repeated = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    failed = (n < FEWEST_WORDS) | (100 * repeated > 100 * MOST_REPEATED * n)
    return F.lit(1.0) / (1 + F.exp(-odds)), failed


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``quality``, ``base_failed`` and ``kept`` of every row."""
    rows = texts_of(docs, id_column, text_column)
    counted = stage(measured(rows).drop("text"))
    quality, failed = verdict(*learn(counted))
    return counted.withColumns({"quality": quality, "base_failed": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def good_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with their own columns only. Texts are counted
    twice, once to learn and once to decide, so that they need not move."""
    prefix = "_quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    known = learn(measured(docs.select(F.col(f"`{text_column}`").alias("text")), "text", prefix), prefix)
    quality, failed = verdict(*known, prefix)
    return measured(docs, text_column, prefix).where(~failed & (quality >= KEEP_FROM)).select(
        *[F.col(f"`{c}`") for c in docs.columns])
