"""Row-wise work in Arrow batches, and the words of a text."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handled at a time in a task; bounds what a task holds besides its Arrow batch.
ROWS = 512


def arrow_schema(schema: str | StructType) -> pa.Schema:
    parsed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return to_arrow_schema(parsed)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_slices(
    df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str | StructType,
    rows: int = ROWS,
) -> DataFrame:
    """``work`` gets up to ``rows`` rows and returns the columns of its result by name."""
    arrow = arrow_schema(schema)

    def run(batches):
        for part in slices(batches, rows):
            yield pa.RecordBatch.from_pydict(work(part), schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text``; others do not get in the way."""
    return docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.col(f"`{text_column}`").cast("string").alias("text"))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` is called so in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def strings(part: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in part.column(name).to_pylist()]


def utf8(part: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [t or b"" for t in part.column(name).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection (the finaliser of the public splitmix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words. None are kept: hashing takes less time than to look a word up among many."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each ``size`` consecutive words, by their order."""
    count = len(hashes) - size + 1
    total = np.zeros(max(count, 0), np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + count] if count > 0 else total
    return mix(total)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of all ``size``-word shingles; of the whole sequence if it is
    shorter; nothing for no words."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    # the length is part of the hash: a short text and a shingle of the same words differ
    return np.unique(mix(windows(hashes, size) + np.uint64(size)))
