"""Byte-level BPE, encoded by proposing tokens and testing them.

A word's tokens are proposed by greedy longest match. A row of tokens is what the merges would give
exactly if each adjacent pair is, so all adjacent pairs of a batch of words are tested at once in
NumPy. Only words with a failing pair are merged step by step.

Null texts count as empty; an empty text has no tokens. Repeated rows are encoded one by one, and a
word of any length is handled (the exact merge keeps a heap, not a scan of all pairs).
"""
from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from tallyloom.llm.rows import map_slices, strings, texts_of

#: Fixed: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Segments whose ids a worker keeps.
KEPT = 500_000
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = byte_letters(), spec["model"]
        of = {text: bytes(letters[c] for c in text) for text in model["vocab"]}
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of = [b""] * size
        for text, i in model["vocab"].items():
            self.bytes_of[i] = of[text]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.byte_id = [0] * 256
        for text, i in model["vocab"].items():
            if len(text) == 1:
                self.byte_id[letters[text]] = i
        vocab, self.merges = model["vocab"], {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        # how each token comes about: rank and halves of its last merge; bytes have rank -1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.id_of = {}
        for text, i in vocab.items():
            ids, last = self.merge(of[text])
            if ids == [i]:  # else the merges never give this token
                self.id_of[of[text]] = i
                if last:
                    self.left[i], self.right[i] = last
                    self.rank[i] = self.merges[last][0]
        self.longest = {}  # by the first byte
        for token in self.id_of:
            self.longest[token[0]] = max(self.longest.get(token[0], 1), len(token))
        pairs = np.array([a * size + b for a, b in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(pairs)
        self.size, self.pairs, self.pair_ranks = size, pairs[order], ranks[order]
        self.pattern = regex.compile(PATTERN)
        self.odd = re.compile(r"\s ")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.decimal = [str(i) for i in range(size)]
        self.segments: dict[str, bytes] = {}

    def merge(self, word: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """The exact way: the pair of lowest rank first, the leftmost of equals. Returns the ids
        and the last pair merged."""
        ids = [self.byte_id[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merges, last = self.merges, None
        heap = [(*merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heap = [(rank, i, pair) for rank, _, i, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], last = merges[pair][1], -1, pair
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (p := (ids[i], ids[k])) in merges:
                    heapq.heappush(heap, (merges[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in merges:
                heapq.heappush(heap, (merges[p][0], h, p))
        return [i for i in ids if i >= 0], last

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        ids, at, end, id_of, longest = [], 0, len(word), self.id_of, self.longest
        while at < end:
            for stop in range(min(end, at + longest[word[at]]), at, -1):
                i = id_of.get(word[at:stop])
                if i is not None:
                    ids.append(i)
                    at = stop
                    break
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether the merges would leave the border between them.

        Undoes the merges next to the border, the latest first. A merge across the border that
        would have come before the one undone shows that the border would not have stayed."""
        fine = np.ones(len(a), bool)
        rows, before = np.arange(len(a)), np.full(len(a), NEVER)
        while rows.size:
            keys = a * self.size + b
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            across = np.where(self.pairs[place] == keys, self.pair_ranks[place], NEVER)
            crossed = across < before
            fine[rows[crossed]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            on = ~crossed & ((rank_a >= 0) | (rank_b >= 0))
            rows, a, b, rank_a, rank_b = rows[on], a[on], b[on], rank_a[on], rank_b[on]
            first = rank_a > rank_b
            # of equal ranks the left merge comes first: across the border, that is before b's own
            before = np.where(first, rank_a, rank_b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return fine

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        found = [self.propose(word) for word in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(counts.sum()))
        word = np.repeat(np.arange(len(found)), counts)
        inner = np.flatnonzero(word[:-1] == word[1:])
        failed = inner[~self.compatible(flat[inner], flat[inner + 1])]
        for k in np.unique(word[failed]).tolist():
            found[k] = self.merge(words[k])[0]
        return found

    def cut(self, text: str) -> list[str]:
        """Segments that the pattern never joins: before each blank that follows no white space."""
        if self.odd.search(text) or self.specials.search(text):
            pieces = self.specials.split(text)
            return [w for i, p in enumerate(pieces)
                    for w in ([p] if i % 2 else self.pattern.findall(p))]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + s for s in rest]

    def learn(self, segments: set[str]) -> None:
        parts = {s: self.pattern.findall(s) for s in segments if s not in self.special}
        words = list({w for found in parts.values() for w in found})
        ids = dict(zip(words, self.encode_words([w.encode() for w in words])))
        for segment, found in parts.items():
            self.segments[segment] = np.array([i for w in found for i in ids[w]], "<u4").tobytes()
        for segment in segments & self.special.keys():
            self.segments[segment] = np.array([self.special[segment]], "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(text) for text in texts]
        needed = set().union(*cut)
        new = needed.difference(self.segments)
        if new:
            if len(self.segments) > KEPT:
                self.segments.clear()
                new = needed
            self.learn(new)
        get = self.segments.__getitem__
        return [np.frombuffer(b"".join(map(get, segments)), "<u4") for segments in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every text."""
    def work(part):
        bpe = load(path)
        return {"doc_id": part.column("doc_id"),
                "ids": [ids.astype(np.int32) for ids in bpe.encode_batch(strings(part))]}

    return map_slices(texts_of(docs, id_column, text_column), work, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``ids``; bytes that are not UTF-8 become U+FFFD, null ids none."""
    def work(part):
        bpe = load(path)
        return {"doc_id": part.column("doc_id"),
                "text": [bpe.decode(ids or []) for ids in part.column("ids").to_pylist()]}

    return map_slices(tokens.select("doc_id", "ids"), work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of the ids and of what they decode to, without moving the ids between steps."""
    from hashlib import sha256

    def work(part):
        bpe = load(path)
        out = {"doc_id": part.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in bpe.encode_batch(strings(part)):
            ids = ids.tolist()
            out["n_tokens"].append(len(ids))
            text = ",".join(map(bpe.decimal.__getitem__, ids))
            out["ids_sha256"].append(sha256(text.encode()).hexdigest())
            out["decoded_sha256"].append(sha256(bpe.decode(ids).encode()).hexdigest())
        return out

    return map_slices(
        texts_of(docs, id_column, text_column), work,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
