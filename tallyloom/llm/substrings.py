"""Remove word sequences that an earlier document holds too, found by recompression.

Rounds of recompression turn a text's words into symbols: equal neighbours become a run, and a symbol
of the left class followed by one of the right class becomes a pair. A symbol's name is a hash of what
it stands for, and its class a bit of that hash, so all tasks name alike with no table of names, and
equal substrings have the same symbols but at their borders. For each symbol the span of words that its
making depended on is kept, whatever the rounds did.

A window of words that occurs in two documents makes every symbol that depends on the window alone
occur in both. So after a first exchange, which finds the symbols shared by two documents, only
windows all of whose own symbols are shared are compared, by 64-bit hashes, in a second exchange
that gives each the smallest id of a document with it. Windows without a symbol of their own (long runs)
are always compared, so nothing is missed.

Null texts have no words. Rows without an id are passed on unchanged and not compared. Rows that repeat
an id do not remove each other's words, an equal id is not smaller. Texts shorter than a window
lose nothing. Whole texts equal to one with a smaller id need no windows: all their words go.
"""
from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.llm.exchange import (
    AT_ONCE, PACKED, answers, bucket_count, collected, exchanged, flags_from, full_texts, groups_of,
    held_by_several, lists, pack_rows, small_texts)
from tallyloom.llm.rows import WordHashes, arrow_schema, mix, slices, windows
from tallyloom.operators.staging import stage

WINDOW = 13
ROUNDS = 2
#: Keys that meet in one task of an exchange.
BUCKET_KEYS = 5_000_000
#: A symbol stands for nearly two words, a word and its blank for some six bytes.
BYTES_PER_SYMBOL = 11
#: Documents whose symbols are made together.
TOGETHER = 64
RUN, PAIR, CLASS, END = (np.uint64(c) for c in (
    0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def symbols(texts: list[np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Recompress the word hashes of several texts. Returns for all symbols, text after text: names,
    first and past-the-last word they depend on, and the text they belong to. Positions count
    over all texts, with one place before each and one after the last for their ends."""
    count = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes + 1)))
    total = int(ends[-1]) + 1
    names = np.empty(total, np.uint64)
    is_end = np.zeros(total, bool)
    is_end[ends] = True
    names[is_end] = mix(np.arange(count + 1, dtype=np.uint64) + END)
    names[~is_end] = np.concatenate([*texts, np.zeros(0, np.uint64)])
    low, high = np.arange(total), np.arange(1, total + 1)
    for number in range(rounds):
        change = np.concatenate(([True], (names[1:] != names[:-1]) | is_end[1:]))
        first = np.flatnonzero(change)
        length = np.diff(np.append(first, len(names)))
        base, end = names[first], is_end[first]
        runs = np.where(length > 1, mix(base * RUN + length.astype(np.uint64)), base)
        salt = mix(CLASS + np.full(1, number, np.uint64))
        right_class = (mix(base + salt) & np.uint64(1)).astype(bool) & ~end
        left_class = ~right_class & ~end
        joins = np.concatenate((left_class[:-1] & right_class[1:], [False]))
        head = np.flatnonzero(~np.concatenate(([False], joins[:-1])))
        after = np.minimum(head + 1, len(runs) - 1)
        new = np.where(joins[head], mix(runs[head] * PAIR + mix(runs[after])), runs[head])
        # what a symbol depends on reaches to what its neighbours before this round depended on
        begin = first[head]
        stop = np.append(begin[1:], len(names))
        low, high = low[np.maximum(begin - 1, 0)], high[np.minimum(stop, len(names) - 1)]
        names, is_end = new, end[head]
    text = np.cumsum(is_end) - 1
    inside = ~is_end
    return names[inside], low[inside], high[inside], text[inside], ends


def candidates(low: np.ndarray, high: np.ndarray, shared: np.ndarray, first: int, size: int,
               window: int = WINDOW) -> np.ndarray:
    """Which windows of a text of ``size`` words, that starts at place ``first``, have no symbol of
    their own that is not shared."""
    start = np.arange(first, first + size - window + 1)
    own = np.concatenate(([0], np.cumsum(~shared)))
    a, b = np.searchsorted(low, start), np.searchsorted(high, start + window, side="right")
    return own[np.maximum(a, b)] == own[a]


def _copies(keyed: DataFrame) -> DataFrame:
    """Rows whose whole text is that of a row with a smaller id."""
    rows = keyed.where("doc_id IS NOT NULL AND text <> ''").select(
        "_row", "doc_id", F.sha2("text", 256).alias("_text"))
    least = rows.groupBy("_text").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"))
    return rows.join(least.where("_least < _most"), "_text").where("doc_id > _least").select("_row")


def _symbol_keys(part_words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple]:
    names, low, high, text, ends = symbols(part_words)
    return names, np.bincount(text, minlength=len(part_words)), (low, high, ends)


def _shared_symbols(keyed: DataFrame, buckets: int, window: int) -> DataFrame:
    schema = arrow_schema(PACKED)

    def emit(batches):
        hashes = WordHashes()
        keys, counts, owners = [], [], []

        def packed():
            rows = pack_rows(np.concatenate(keys), np.concatenate(counts),
                             np.array(owners, np.int64), buckets, np.uint32)
            for held in (keys, counts, owners):
                held.clear()
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        for part in slices(batches, TOGETHER):
            words = [hashes(t.split()) if t and i is not None else np.zeros(0, np.uint64)
                     for t, i in zip(part.column("text").cast(pa.binary()).to_pylist(),
                                     part.column("doc_id").to_pylist())]
            words = [w if len(w) >= window else w[:0] for w in words]
            names, count, _ = _symbol_keys(words)
            keys.append(names)
            counts.append(count)
            owners += part.column("_row").to_pylist()
            if sum(map(len, keys)) >= AT_ONCE:
                yield packed()
        if owners:
            yield packed()

    return exchanged(keyed.mapInArrow(emit, PACKED), held_by_several, np.uint32)


def _marked(keyed: DataFrame, copies: DataFrame, *answered: DataFrame) -> DataFrame:
    """Each row with whether it is a copy, and its answers."""
    own = copies.select("_row").distinct().withColumn("_copy", F.lit(True))
    for k, marks in enumerate(answered, 1):
        own = own.join(collected(marks, str(k)).withColumnRenamed("owner", "_row"), "_row", "full")
    return small_texts(keyed).join(own, "_row", "left")


def _compared(part: pa.RecordBatch, hashes: WordHashes, buckets: int, window: int):
    """For each row of a slice: its words, whether it is a copy, its windows that were compared (a mask)
    with their hashes, and the answers about them. Where no window has an answer, none is made anew."""
    rows, older = [], "_buckets2" in part.schema.names
    columns = [part.column("doc_id").to_pylist(), full_texts(part), part.column("_copy").to_pylist(),
               *(lists(part, c) for c in ("_buckets1", "_bits1"))]
    columns += [lists(part, c) for c in ("_buckets2", "_bits2")] if older else [[()] * part.num_rows] * 2
    for doc_id, text, copy, *marks in zip(*columns):
        words = text.split()
        compare = len(words) >= window and doc_id is not None and not copy and (not older or len(marks[2]) > 0)
        rows.append((words, bool(copy), hashes(words) if compare else np.zeros(0, np.uint64), marks))
    names, count, (low, high, ends) = _symbol_keys([r[2] for r in rows])
    at = 0
    for k, (words, copy, hashed, marks) in enumerate(rows):
        own = slice(at, at + int(count[k]))
        at = own.stop
        mask, keys = np.zeros(0, bool), np.zeros(0, np.uint64)
        if len(hashed):
            shared = flags_from(names[own], buckets, *marks[:2])
            mask = candidates(low[own], high[own], shared, int(ends[k]) + 1, len(words), window)
            keys = windows(hashed, window)[mask]
        yield words, copy, mask, keys, marks[2:]


def _older_windows(marked: DataFrame, buckets: int, window: int) -> DataFrame:
    packed_schema = PACKED + ", ids binary"
    schema = arrow_schema(packed_schema)

    def emit(batches):
        hashes = WordHashes()
        keys, owners, ids = [], [], []

        def packed():
            rows = pack_rows(np.concatenate(keys), np.array([len(k) for k in keys]),
                             np.arange(len(keys)), buckets)
            held = [np.frombuffer(o, np.int64) for o in rows["owners"]]
            row, doc = np.array(owners, np.int64), np.array(ids, np.int64)
            rows |= {"owners": [row[h].tobytes() for h in held], "ids": [doc[h].tobytes() for h in held]}
            for done in (keys, owners, ids):
                done.clear()
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        for part in slices(batches, TOGETHER):
            found = [k for _, _, _, k, _ in _compared(part, hashes, buckets, window)]
            for own, row, doc_id in zip(found, part.column("_row").to_pylist(), part.column("doc_id").to_pylist()):
                if len(own):
                    keys.append(own)
                    owners.append(row)
                    ids.append(doc_id)
            if sum(map(len, keys)) >= AT_ONCE:
                yield packed()
        if keys:
            yield packed()

    def answer(keys, owners, counts, bucket, table):
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        order, start = groups_of(keys)
        who = np.repeat(ids, counts)[order]
        flags = np.zeros(len(keys), bool)
        if len(start):
            least = np.repeat(np.minimum.reduceat(who, start), np.diff(np.append(start, len(keys))))
            flags[order] = who > least
        return answers(flags, owners, counts, bucket)

    return exchanged(marked.mapInArrow(emit, packed_schema), answer, np.uint64)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``docs`` with the words that stay as text, one space between them, and ``n_words`` and
    ``n_removed``. Null texts stay null. Columns of ``docs`` with these names are replaced."""
    others = [c for c in docs.columns if c not in (id_column, text_column, "n_words", "n_removed")]
    fields = [F.col(f"`{c}`").alias(f"_other{i}") for i, c in enumerate(others)]
    keyed = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.col(f"`{text_column}`").cast("string").alias("text"), *fields
    ).withColumn("_row", F.xxhash64("doc_id", "text"))  # rows equal in both share their answers
    slim = keyed.select("_row", "doc_id", "text")
    buckets = bucket_count(slim, BYTES_PER_SYMBOL, BUCKET_KEYS)
    copies, shared = stage(_copies(slim)), stage(_shared_symbols(slim, buckets, window))
    older = stage(_older_windows(_marked(slim, copies, shared), buckets, window))
    marked = _marked(keyed, copies, shared, older)
    kept = [f for f in keyed.schema.fields if f.name not in ("_row", "text")]
    schema = StructType([*kept, StructField("text", StringType()), StructField("n_words", LongType()),
                         StructField("n_removed", LongType())])
    arrow = arrow_schema(schema)

    def cut(batches):
        hashes = WordHashes()
        for part in slices(batches, TOGETHER):
            texts, sizes, gone = [], [], []
            for words, copy, mask, keys, marks in _compared(part, hashes, buckets, window):
                stay = np.full(len(words), not (copy and len(words) >= window))
                starts = np.flatnonzero(mask)[flags_from(keys, buckets, *marks)]
                for start in starts.tolist():
                    stay[start:start + window] = False
                left = int(stay.sum())
                texts.append(b" ".join(words if left == len(words) else [w for w, s in zip(words, stay) if s]))
                sizes.append(len(words))
                gone.append(len(words) - left)
            nulls = part.column("_text").is_valid().to_pylist()
            texts = [t if ok else None for t, ok in zip(texts, nulls)]
            yield pa.RecordBatch.from_arrays([
                *(part.column(f.name) for f in kept), pa.array(texts, pa.binary()).cast(pa.string()),
                pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], schema=arrow)

    out = marked.mapInArrow(cut, schema)
    names = {c: f"_other{i}" for i, c in enumerate(others)} | {id_column: "doc_id", text_column: "text"}
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns if c in names], "n_words", "n_removed")
