"""Find equal keys across documents without a row per key.

A task packs the keys of a slice of documents into one row per bucket of keys: the documents, how many
keys each has there, and the keys in document order. Spark shuffles these rows by bucket. The answer
to a bucket is one bit per key, given back per document; the document's own keys of that bucket, in the
same order, tell what each bit means. Buckets are sized by the number of keys, so that a task holds a
bounded number however large the input is.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallyloom.llm.rows import arrow_schema, slices

#: Keys that a task packs at a time; the last document of them may have more.
AT_ONCE = 1 << 20
PACKED = "bucket long, owners binary, counts binary, keys binary"
ANSWER = "owner long, bucket long, bits binary"


def pack_rows(keys: np.ndarray, counts: np.ndarray, owners: np.ndarray, buckets: int,
              width: type = np.uint64) -> dict[str, list]:
    """Rows of ``PACKED`` for one slice: ``counts`` keys for each of ``owners``, one after the other.
    ``width`` uint32 keeps only half of each key, for tests that may err to one side."""
    of = (keys % np.uint64(buckets)).astype(np.int32)
    owner = np.repeat(np.arange(len(owners), dtype=np.int32), counts)
    order = np.argsort(of, kind="stable")
    of, owner, keys = of[order], owner[order], keys[order]
    del order
    if width is np.uint32:
        keys = keys >> np.uint64(32)
    keys = keys.astype(width)
    found, start = np.unique(of, return_index=True)
    rows = {"bucket": found.tolist(), "owners": [], "counts": [], "keys": []}
    for a, b in zip(start, np.append(start[1:], len(of))):
        who, times = np.unique(owner[a:b], return_counts=True)
        rows["owners"].append(owners[who].tobytes())
        rows["counts"].append(times.astype(np.uint32).tobytes())
        rows["keys"].append(keys[a:b].tobytes())
    return rows


def unpack(table: pa.Table, width: type = np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, and for each row of documents the owner and its number of keys."""
    def joined(name, kind):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    return joined("keys", width), joined("owners", np.int64), joined("counts", np.uint32).astype(np.int64)


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys side by side, and where each group starts in it."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    start = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.zeros(0, np.int64)
    return order, start


def answers(flags: np.ndarray, owners: np.ndarray, counts: np.ndarray, bucket: int) -> dict[str, list]:
    """Rows of ``ANSWER``, for owners with a set flag."""
    end = np.cumsum(counts)
    start = end - counts
    any_set = np.add.reduceat(flags.astype(np.int64), start) > 0 if len(start) else np.zeros(0, bool)
    rows = np.flatnonzero(any_set).tolist()
    return {"owner": owners[rows], "bucket": [bucket] * len(rows),
            "bits": [np.packbits(flags[start[i]:end[i]]).tobytes() for i in rows]}


def flags_from(keys: np.ndarray, buckets: int, answered: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """One document's flags for its keys in order, from its answers: buckets and their bits."""
    out = np.zeros(len(keys), bool)
    if not len(answered) or not len(keys):
        return out
    of = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    held = of[order]
    start = np.searchsorted(held, answered)
    count = np.searchsorted(held, answered, side="right") - start
    size = np.fromiter(map(len, bits), np.int64, len(bits)) * 8
    found = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8))
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = within + np.repeat(np.cumsum(size) - size, count)
    set_now = (within + np.repeat(start, count))[found[at] > 0]
    out[order[set_now]] = True
    return out


def lists(part: pa.RecordBatch, name: str) -> list[list]:
    """A column of arrays as Python lists; null as empty."""
    column = part.column(name)
    ends = column.offsets.to_pylist()
    values = column.values.slice(ends[0], ends[-1] - ends[0]).to_pylist()
    # a null row spans no values in what Spark sends
    return [values[a - ends[0]:b - ends[0]] for a, b in zip(ends, ends[1:])]


def bucket_count(docs: DataFrame, bytes_per_key: float, keys_per_bucket: int, least: int = 16) -> int:
    """Buckets for the keys of a table of texts."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(least, math.ceil(size / (bytes_per_key * keys_per_bucket)))


def small_texts(rows: DataFrame) -> DataFrame:
    """``text`` as zstd frames in ``_text``: they go through a shuffle in half the space."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    schema = StructType([*others, StructField("_text", BinaryType())])
    arrow = arrow_schema(schema)

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            frames = [t and pack.compress(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f.name) for f in others), pa.array(frames, pa.binary())], schema=arrow)

    return rows.mapInArrow(run, schema)


def full_texts(part: pa.RecordBatch) -> list[bytes]:
    """The texts of a slice of ``small_texts``; null as empty."""
    import zstandard

    unpack_text = zstandard.ZstdDecompressor()
    return [unpack_text.decompress(t) if t else b"" for t in part.column("_text").to_pylist()]


def exchanged(packed: DataFrame, answer, width: type) -> DataFrame:
    """Shuffle ``PACKED`` rows by bucket; ``answer`` gets keys, owners, counts, the bucket and the table."""
    arrow = arrow_schema(ANSWER)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        return pa.table(answer(*unpack(table, width), bucket, table), schema=arrow)

    return packed.groupBy("bucket").applyInArrow(run, ANSWER)


def held_by_several(keys, owners, counts, bucket, _):
    """The answer that flags keys which two different owners hold."""
    order, start = groups_of(keys)
    who = np.repeat(owners, counts)[order]
    flags = np.zeros(len(keys), bool)
    if len(start):
        several = np.minimum.reduceat(who, start) != np.maximum.reduceat(who, start)
        flags[order] = np.repeat(several, np.diff(np.append(start, len(keys))))
    return answers(flags, owners, counts, bucket)


def collected(marks: DataFrame, suffix: str) -> DataFrame:
    """One row per owner: its answers as ``_buckets`` and ``_bits`` with the suffix. An owner has
    at most as many as it has keys."""
    found = marks.groupBy("owner").agg(F.collect_list(F.struct("bucket", "bits")).alias("_all"))
    return found.select(
        "owner", F.col("_all.bucket").alias(f"_buckets{suffix}"), F.col("_all.bits").alias(f"_bits{suffix}"))
