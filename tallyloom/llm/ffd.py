"""Packing by first-fit decreasing, run independently in randomised groups of pieces.

A document is its token ids (a tokenizers file, no special tokens; see ``Encoder``) followed by
``end_id``. Documents longer than ``length`` are cut into pieces of ``length`` ids, the last one
shorter; each id lies in exactly one piece. Pieces are dealt to groups by a hash of their row, so
neither a long document nor a repeated id makes a large group; the number of groups follows the
total of ids (``GROUP_IDS`` per group, at least one). Within a group, pieces are placed longest
first (ties by doc_id, then start) into the first sequence with room for them. The first such
sequence is found in a tournament tree: a complete binary tree over the sequences' free room
whose inner nodes hold the most room below them, descended from the root to the leftmost leaf
with enough room, then updated along that path - O(log n) per piece.

Returns per piece: doc_id, piece (from 0), start (ids of its document before it), length,
ids_crc32 (CRC-32 of the ids as little-endian unsigned 32-bit values), doc_tokens (ids of its
document, end id included), sequence_id, offset (place in the sequence, gapless from 0).

A null or empty text is one piece of the end id. Repeated rows are packed as separate documents.
An empty table gives no rows. Extra columns are ignored. Ids are whole numbers.
"""
from __future__ import annotations

import itertools
import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyloom.llm.rows import arrow_schema, slices
from tallyloom.operators.staging import stage

#: Parameters: sequence length, ids per group, the seed of the deal.
LENGTH = 4096
GROUP_IDS = 8 << 20
SEED = 12
#: Rows encoded at a time.
SLICE = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


class Tournament:
    """Free room of ``count`` sequences of ``length`` ids in a tournament tree."""

    def __init__(self, count: int, length: int):
        self.length, self.size = length, 1 << max(count - 1, 0).bit_length()
        self.room = np.full(2 * self.size, length, np.int64)

    def first_fit(self, need: int) -> tuple[int, int]:
        """Take ``need`` ids of room in the leftmost sequence that has them: (sequence, offset)."""
        room, node = self.room, 1
        while node < self.size:
            node = 2 * node if room[2 * node] >= need else 2 * node + 1
        place = (node - self.size, self.length - int(room[node]))
        room[node] -= need
        node //= 2
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node //= 2
        return place


def first_fit_decreasing(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed in the given order (the caller sorts)."""
    tree = Tournament(len(lengths), length)
    found = [tree.first_fit(need) for need in lengths.tolist()]
    sequences = np.array([f[0] for f in found], np.int64)
    offsets = np.array([f[1] for f in found], np.int64)
    return sequences, offsets


class Encoder:
    """Ids of a slice of texts by a tokenizers file whose pre-tokens never hold white space
    (checked against the library in the tests): Arrow splits the slice at ASCII white space and
    numbers its distinct words; only words not seen before are encoded, and all ids are gathered
    by word number in one step. At most ``KEPT`` words are remembered. Where the file lower-cases
    and cuts between letters and marks (``FOLDED``), words are cut before marks at their end, and
    words of ``PLAIN`` letters lower-cased, so that fewer differ."""

    KEPT = 500_000
    #: Normalizer and pattern of the files whose words may be folded.
    FOLDED = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Letters that no normal form changes and whose lower case is one letter.
    LETTER = "A-Za-z0-9À-ÖØ-öø-ÿА-яЁё"
    PLAIN = f"^[!-~{LETTER}]+$"
    MARKS = '[.,;:!?)"]+$'

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.folds = self._of(path) == self.FOLDED
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.last[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith(suffix)]] = True
        self._forget()

    @staticmethod
    def _of(path: str) -> tuple[list[str], str | None]:
        """The names of the normalizers and the pattern of the first cut."""
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        steps = (held.get("normalizer") or {}).get("normalizers") or []
        cut = ((held.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return [step["type"] for step in steps], (cut.get("pattern") or {}).get("Regex")

    def _parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word as its folded start and the marks at its end."""
        none = pa.array(np.full(len(words), "", object), pa.string())
        if not self.folds:
            return words, none
        starts = pc.replace_substring_regex(words, f"([{self.LETTER}]){self.MARKS}", r"\1")
        cut = pc.not_equal(pc.binary_length(starts), pc.binary_length(words))
        marks = pc.extract_regex(words.filter(cut), f"(?P<marks>{self.MARKS[:-1]})$")
        ends = pc.replace_with_mask(none, cut, pc.struct_field(marks, "marks"))
        return pc.if_else(pc.match_substring_regex(starts, self.PLAIN), pc.utf8_lower(starts), starts), ends

    def _forget(self) -> None:
        self.vocabulary = pa.array([], pa.string())   # known words, in the order of start and size
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and how many each has."""
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        lists = [e.ids for e in found]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``, for words of letters alone in a file that marks the last id of each:
        some hundred words are encoded as one text."""
        texts = [" ".join(words[a:a + 256]) for a in range(0, len(words), 256)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(words) or len(ids) and ends[-1] != len(ids) - 1:
            return self._encoded(words)
        return ids, np.diff(ends, prepend=-1)

    def _learn(self, new: pa.Array) -> None:
        if self.folds and self.last.any():
            plain = pc.match_substring_regex(new, f"^[{self.LETTER.replace('0-9', '')}]+$")
            other = new.filter(pc.invert(plain))
            new = new.filter(plain)
            found = [self._together(new.to_pylist()), self._encoded(other.to_pylist())]
            ids, sizes = (np.concatenate(x) for x in zip(*found))
            new = pa.concat_arrays([new, other])
        else:
            ids, sizes = self._encoded(new.to_pylist())
        first = len(self.vocabulary)
        while first + len(new) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.start[first:first + len(new)] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.size[first:first + len(new)] = sizes
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.vocabulary = pa.concat_arrays([self.vocabulary, new])

    def _places(self, distinct: pa.Array) -> np.ndarray:
        return pc.index_in(distinct, value_set=self.vocabulary).to_numpy(zero_copy_only=False)

    @staticmethod
    def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ragged gather: ``size`` ids from ``first`` on, one after another, and where each ends."""
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        step = np.repeat(first - (ends - size), size)
        return (flat[step + np.arange(total)] if total else np.zeros(0, np.uint32)), ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text k are ids[offsets[k]:offsets[k + 1]]."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = pc.dictionary_encode(pc.list_flatten(words))
        codes = coded.indices.to_numpy()
        parts = pc.dictionary_encode(pa.concat_arrays(self._parts(coded.dictionary)))
        distinct = parts.dictionary
        place = self._places(distinct)
        unknown = np.isnan(place)
        if unknown.any():
            if len(self.vocabulary) + int(unknown.sum()) > self.KEPT:
                self._forget()
                unknown[:] = True
            self._learn(distinct.filter(pa.array(unknown)))
            place = self._places(distinct)
        # the ids of the slice's distinct words, start and end together
        place = place.astype(np.int64)[parts.indices.to_numpy()].reshape(2, -1).T.ravel()
        flat, _ = self._gathered(self.flat, self.start[place], self.size[place])
        size = self.size[place].reshape(-1, 2).sum(axis=1)
        # every occurrence's ids, in order
        ids, ends = self._gathered(flat, (np.cumsum(size) - size)[codes], size[codes])
        # occurrences per text -> ids per text
        bounds = words.offsets.to_numpy()
        bounds = bounds - bounds[0]
        at = np.concatenate([[0], ends])
        return ids, at[bounds]


def pieces(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Every piece of every document, with its CRC (the columns of ``PIECES``)."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number")
    arrow = arrow_schema(PIECES)
    end = np.asarray([end_id], np.uint32).astype("<u4").tobytes()

    def run(batches):
        words = encoder(path)
        for part in slices(batches, SLICE):
            ids, offsets = words.encode(part.column("text"))
            raw = ids.astype("<u4", copy=False).tobytes()
            out = []
            for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                a, b = int(offsets[k]), int(offsets[k + 1])
                total = b - a + 1
                for piece, at in enumerate(range(0, total, length)):
                    upto = min(at + length, total)
                    body = raw[4 * (a + at):4 * (a + min(upto, b - a))]
                    crc = zlib.crc32(end, zlib.crc32(body)) if upto == total else zlib.crc32(body)
                    out.append((doc_id, piece, at, upto - at, crc, total))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, PIECES)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder that a worker keeps from task to task."""
    return Encoder(path)


def pack(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Every piece with its place: the columns of ``PLACED``."""
    cut = stage(pieces(docs, path, end_id, length)).withColumn("_row", F.monotonically_increasing_id())
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // GROUP_IDS))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(SEED)), F.lit(groups)))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "_row"], ascending=[False, True, True, True],
                                  na_position="first", kind="stable")
        sequences, offsets = first_fit_decreasing(group["length"].to_numpy(), length)
        number = int(group["_group"].iloc[0])
        out = group.drop(columns=["_row", "_group"])
        out["sequence_id"] = (number << 32) + sequences
        out["offset"] = offsets
        return out

    return dealt.groupBy("_group").applyInPandas(place, PLACED)
