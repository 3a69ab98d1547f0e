"""Fingerprints of documents: the k smallest hashes of their shingles.

Fingerprints of parts merge into the one of the whole, and two of them give estimates of
resemblance, containment and the number of distinct shingles, exact up to k shingles. Words
are lower-cased (A-Z) and lie between ASCII white space; a shingle is five words, or all words of
a shorter text.

Null texts are empty: their fingerprint is empty, and two empty ones are alike (1.0). Documents
are ordered by id, then text; a null id comes first. Rows that repeat an id follow each other.
With a single row, the next document is the row itself.
"""
from __future__ import annotations

import base64
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.rows import WordHashes, arrow_schema, shingles, slices, texts_of, utf8

KEPT_HASHES = 128
WORDS = 5
#: Hashes are cut to 48 bits: six bytes each in a fingerprint's text.
BITS, FULL = 48, float(1 << 48)
FIRST = -(1 << 63)


def sketch(text: bytes, hashes: WordHashes, k: int = KEPT_HASHES, words: int = WORDS) -> np.ndarray:
    found = shingles(hashes(text.lower().split()), words) >> np.uint64(64 - BITS)
    # cutting keeps the order, so equal hashes lie side by side
    if len(found) > 1:
        found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    return found[:k].astype(np.int64)


def merged(a: np.ndarray, b: np.ndarray, k: int = KEPT_HASHES) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = KEPT_HASHES) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / FULL)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = KEPT_HASHES) -> float:
    """Estimated share of common shingles among all of both."""
    both = merged(a, b, k)
    if not len(both):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return len(np.intersect1d(both, common, assume_unique=True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = KEPT_HASHES) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1.0 for no shingles."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return len(np.intersect1d(a, b, assume_unique=True)) / len(a)
    common = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return min(1.0, common / distinct(a, k))


def as_text(a: np.ndarray) -> str:
    """Six big-endian bytes a hash, as base64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").reshape(-1).astype(np.int64)


def fingerprints(docs: DataFrame, k: int = KEPT_HASHES, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``doc_id``, ``sketch`` (sorted array of long) and ``n_distinct`` of every row."""
    schema = "doc_id long, sketch array<long>, n_distinct double"
    arrow = arrow_schema(schema)

    def run(batches):
        hashes = WordHashes()
        for part in slices(batches):
            found = [sketch(t, hashes, k) for t in utf8(part)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "sketch": found,
                "n_distinct": [distinct(s, k) for s in found]}, schema=arrow)

    return texts_of(docs, id_column, text_column).mapInArrow(run, schema)


def merge_by(parts: DataFrame, key: str, k: int = KEPT_HASHES, groups: int = 10_000) -> DataFrame:
    """One merged ``sketch`` per value of ``key`` (a column of strings). Tasks merge what they read
    first, so a value sends at most one sketch per task and ``groups`` values to its final merge."""
    schema = "_key string, sketch array<long>"
    arrow = arrow_schema(schema)

    def emit(held):
        return pa.RecordBatch.from_pydict({"_key": list(held), "sketch": list(held.values())}, schema=arrow)

    def partial(batches):
        held = {}
        for part in slices(batches):
            for name, found in zip(part.column("_key").to_pylist(), part.column("sketch").to_pylist()):
                found = np.array(found or [], np.int64)
                held[name] = merged(held[name], found, k) if name in held else found
            if len(held) > groups:
                yield emit(held)
                held = {}
        yield emit(held)

    def final(table: pa.Table) -> pa.Table:
        found = [np.array(s or [], np.int64) for s in table.column("sketch").to_pylist()]
        return pa.table({"_key": table.column("_key")[:1],
                         "sketch": [reduce(lambda a, b: merged(a, b, k), found)]}, schema=arrow)

    rows = parts.select(F.col(f"`{key}`").cast("string").alias("_key"), "sketch")
    out = rows.mapInArrow(partial, schema).groupBy("_key").applyInArrow(final, schema)
    return out.withColumnRenamed("_key", key)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows in ranges of ids, each range sorted and followed by the first row of the next one, with
    ``_guest`` set. The bounds are quantiles of the ids: at most ``ranges`` numbers."""
    spark = docs.sparkSession
    ranges = ranges or 8 * max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                               spark.sparkContext.defaultParallelism)
    rows = docs.withColumn("_key", F.coalesce("doc_id", F.lit(FIRST)))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("_key", shares, 100 * ranges).alias("c")).first().c or []
    # how many bounds are at or below the id
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>")
    place = F.size(F.filter(bounds, lambda c: c <= F.col("_key")))
    firsts = sorted((r["_range"], r["low"]) for r in rows.select("_key").withColumn("_range", place)
                    .groupBy("_range").agg(F.min("_key").alias("low")).collect())
    if not firsts:
        return rows.select("*", F.lit(0).alias("_range"), F.lit(False).alias("_guest"), F.lit(0).alias("_turn"))
    # the first row of a range is also a guest of the range before; the very first, of the last
    guests = {low: firsts[i - 1][0] for i, (_, low) in enumerate(firsts)}
    before = F.create_map(*[F.lit(x) for pair in guests.items() for x in pair])
    own = F.struct(place.alias("_range"), F.lit(False).alias("_guest"))
    guest = F.struct(F.element_at(before, F.col("_key")).alias("_range"), F.lit(True).alias("_guest"))
    placed = rows.withColumn("_places", F.when(
        F.col("_key").isin(list(guests)), F.array(own, guest)).otherwise(F.array(own)))
    out = placed.select("*", F.explode("_places").alias("_place")).select(
        "doc_id", "text", "_key", "_place._range", "_place._guest")
    return out.repartition("_range").sortWithinPartitions("_range", "_guest", "_key", "text")


def compared(docs: DataFrame, k: int = KEPT_HASHES, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """For every row: its fingerprint, that of the text whose second half is replaced by the
    beginning of the next document, and how alike it is to that and to the next document."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double, n_distinct double")
    arrow = arrow_schema(schema)
    names = arrow.names

    def run(batches):
        hashes, held, out = WordHashes(), None, []

        def row(one, two):
            text = one[2]
            half = len(text) // 2
            edited = (text[:len(text) - half] + two[2][:half]).encode()
            other = sketch(edited, hashes, k)
            return (one[1], len(text), sha256(edited).hexdigest(), as_text(one[3]), as_text(other),
                    resemblance(one[3], other, k), resemblance(one[3], two[3], k), distinct(one[3], k))

        for part in slices(batches):
            columns = [part.column(c).to_pylist() for c in ("_range", "doc_id", "text", "_guest")]
            for place, doc_id, text, guest in zip(*columns):
                text = text or ""
                if guest and (held is None or held[0] != place):
                    continue  # a later row with the id of the guest that was used
                now = (place, doc_id, text, sketch(text.encode(), hashes, k))
                if held is not None and held[0] == place:
                    out.append(row(held, now))
                held = None if guest else now
            if len(out) >= 256:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=arrow)

    return with_next(texts_of(docs, id_column, text_column)).mapInArrow(run, schema)
