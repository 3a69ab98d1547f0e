"""Toxicity by the nearest labelled examples.

Texts are vectors over all terms that the examples of the index hold. A term weighs its TF-IDF, times one
more than the evidence that it tells toxic texts from others (twice the log-likelihood ratio of its share
among both), so every term counts and those that tell count most. An index of labelled examples keeps
equal vectors once. A search scores many texts together, the frequent terms by one matrix product in single
precision and the others by their postings; the greatest score in each of some groups bounds the cosine of
the last neighbour from below, and what may reach that bound is scored anew in double precision, so the
nearest by cosine are exact. They vote with the square of their cosine, and a logistic curve fitted to the
labelled texts, each without itself, makes votes into probabilities.

Document frequencies, evidence and the curve come from all labelled rows that may be learned from; the index
holds up to ``EXAMPLES`` of them, chosen by a hash of their id. Null and empty texts, and texts without
any of the terms, get the share of toxic ones among labelled texts without the terms. Without any
labels that is 0. Rows that repeat are scored alike; of several labels of one id the greatest counts.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.exchange import full_texts, small_texts
from tallyloom.llm.rows import arrow_schema, map_slices, slices, strings, texts_of
from tallyloom.operators.staging import stage

#: Examples in the index, neighbours that vote.
EXAMPLES, NEIGHBOURS = 20_000, 25
#: Terms scored by a matrix product, and texts scored together.
FREQUENT, TOGETHER = 512, 128
#: Groups of vectors whose greatest scores bound the last neighbour's; more than neighbours.
GROUPS = 256
#: Sums of ``FREQUENT`` products in single precision are off by less than half of it.
MARGIN = 2e-4
TRIM = ".,;:!?\"'()[]{}<>|#*$%&-_"


def words_of(text: str) -> Counter:
    return Counter(w.strip(TRIM) for w in text.lower().split())


@dataclass
class Postings:
    """For each term the vectors that hold it and their weights in single precision, one term after the other."""

    start: np.ndarray
    vector: np.ndarray
    weight: np.ndarray


@dataclass
class Vectors:
    """The distinct vectors of an index: their terms (ascending) and weights, one vector after the other,
    the examples that have them, and weights by frequent (single precision; ``column`` of each term, -1 if it is
    not frequent) and by other terms (None without any)."""

    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    places: np.ndarray
    column: np.ndarray
    dense: np.ndarray
    others: Postings | None


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@dataclass
class Index:
    """Examples as unit vectors over ``terms``, which weigh ``idf`` each."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    #: number of terms of each example, terms (ascending) and counts, one example after the other; or per term
    #: the examples in order and weights
    rows: tuple[np.ndarray, np.ndarray, np.ndarray] | list[tuple[np.ndarray, np.ndarray]]
    base: float = 0.0
    share: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        self.kept: dict[bytes, tuple] = {}
        found, times = np.unique(self.ids, return_counts=True)
        self.repeated = dict(zip(found[times > 1].tolist(), times[times > 1].tolist()))

    def __getstate__(self) -> dict:
        """Without what a search keeps, and small: each executor writes it to its disk."""
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        state = {k: v for k, v in self.__dict__.items() if k not in ("kept", "vectors")}
        state["terms"] = pack("\n".join(sorted(self.terms, key=self.terms.get)).encode())
        if isinstance(self.rows, tuple):
            state["rows"] = tuple((r.dtype.str, pack(r.tobytes())) for r in self.rows)
        return state

    def __setstate__(self, state: dict) -> None:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        words = unpack(state["terms"]).decode().split("\n")
        self.__dict__ |= state | {"terms": {w: i for i, w in enumerate(words)} if len(state["idf"]) else {}, "kept": {}}
        if isinstance(self.rows, tuple):
            self.rows = tuple(np.frombuffer(unpack(r), kind) for kind, r in self.rows)

    def counted(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text, ascending, and their counts."""
        place = self.terms.get
        terms = np.array([place(w, -1) for w in words], np.int64)
        counts = np.fromiter(words.values(), np.int64, len(words))
        order = np.argsort(terms)[np.count_nonzero(terms < 0):]
        return terms[order], counts[order]

    def vector(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        terms, counts = self.counted(words)
        weights = (1 + np.log(counts)) * self.idf[terms]
        return terms, weights / (math.sqrt(float(weights @ weights)) if len(terms) else 1.0)

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Examples, terms and weights, by example and term."""
        if isinstance(self.rows, tuple):
            size, term, counts = self.rows
            where = np.repeat(np.arange(len(size), dtype=np.int32), size)
            held = (1 + np.log(counts.astype(float))) * self.idf[term]
            return where, term, held / np.sqrt(np.bincount(where, held * held, len(size)))[where]
        where = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in self.rows)])
        term = np.repeat(np.arange(len(self.rows)), [len(w) for w, _ in self.rows])
        order = np.lexsort((term, where))
        return where[order], term[order], np.concatenate([np.zeros(0), *(h for _, h in self.rows)])[order]

    @cached_property
    def vectors(self) -> Vectors:
        where, term, held = self._flat()
        bounds = np.searchsorted(where, np.arange(len(self.ids) + 1))
        places: dict[tuple, list[int]] = {}
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            places.setdefault((term[a:b].tobytes(), held[a:b].tobytes()), []).append(i)
        one = [p[0] for p in places.values()]
        size = (bounds[1:] - bounds[:-1])[one]
        start = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(start[-1]) + np.repeat(bounds[one] - start[:-1], size)
        term, weight, vector = term[at], held[at], np.repeat(np.arange(len(one)), size)
        count = np.bincount(term, minlength=len(self.idf))
        frequent = np.argsort(-count, kind="stable")[:FREQUENT]
        column = np.full(len(self.idf), -1, np.int32)
        column[frequent] = np.arange(len(frequent))
        dense = np.zeros((len(frequent), -(-max(len(one), 1) // GROUPS) * GROUPS), np.float32)
        is_frequent = column[term] >= 0
        dense[column[term[is_frequent]], vector[is_frequent]] = weight[is_frequent]
        count[frequent] = 0
        other = np.flatnonzero(~is_frequent)
        other = other[np.argsort(term[other], kind="stable")]
        others = Postings(np.concatenate(([0], np.cumsum(count))), vector[other].astype(np.int32),
                          weight[other].astype(np.float32)) if len(other) else None
        return Vectors(start, term, weight, np.concatenate(([0], np.cumsum([len(p) for p in places.values()]))),
                       np.array([i for p in places.values() for i in p], np.int64), column, dense, others)

    def search(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int):
        """For each vector the places and cosines of the k nearest examples, larger cosine and then smaller
        place first. Up to ``TOGETHER`` vectors at a time."""
        if not len(self.ids) or not asked:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in asked]
        own = self.vectors
        single = np.zeros((len(asked), len(own.dense)), np.float32)
        for q, (terms, weights) in enumerate(asked):
            frequent = own.column[terms] >= 0
            single[q, own.column[terms[frequent]]] = weights[frequent]
        used = np.flatnonzero(single.any(axis=0))
        scores = single[:, used] @ own.dense[used]
        for q, (terms, weights) in enumerate(asked if own.others else ()):
            rest = own.column[terms] < 0
            terms, weights = terms[rest], weights[rest]
            first, size = own.others.start[terms], own.others.start[terms + 1] - own.others.start[terms]
            at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            held = own.others.weight[at] * np.repeat(weights, size)
            scores[q] += np.bincount(own.others.vector[at], held, scores.shape[1])
        least = np.full(len(asked), np.finfo(np.float32).tiny)
        if k <= GROUPS:  # k vectors reach the k-th greatest of the groups
            tops = scores.reshape(len(asked), -1, GROUPS).max(axis=1)
            least = np.maximum(least, np.partition(tops, GROUPS - k, axis=1)[:, GROUPS - k] - np.float32(MARGIN))
        exact, found = np.zeros(len(self.idf)), []
        for (terms, weights), row, low in zip(asked, scores, least):
            vector = np.flatnonzero(row >= low)
            size = own.start[vector + 1] - own.start[vector]
            at = np.arange(size.sum()) + np.repeat(own.start[vector] - (np.cumsum(size) - size), size)
            exact[terms] = weights
            # sums run in the order of the terms; terms that a text does not hold add 0
            cosine = np.bincount(np.repeat(np.arange(len(vector)), size), exact[own.term[at]] * own.weight[at], len(vector))
            exact[terms] = 0
            held = np.minimum(own.first[vector + 1] - own.first[vector], k)
            at = np.arange(held.sum()) + np.repeat(own.first[vector] - (np.cumsum(held) - held), held)
            place, cosine = own.places[at], np.repeat(cosine, held)
            place, cosine = place[cosine > 0], cosine[cosine > 0]
            order = np.lexsort((place, -cosine))[:k]
            found.append((place[order], cosine[order]))
        return found

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None):
        """``search`` for one vector, leaving out the examples of one id."""
        if without is None:
            return self.search([(terms, weights)], k)[0]
        at, cosine = self.search([(terms, weights)], k + self.repeated.get(without, 1))[0]
        fine = self.ids[at] != without
        return at[fine][:k], cosine[fine][:k]

    @staticmethod
    def _key(terms: np.ndarray, weights: np.ndarray) -> bytes:
        return blake2b(terms.tobytes() + weights.tobytes(), digest_size=16).digest()

    def votes(self, bags: list[Counter], without: list[int | None] | None = None) -> list[tuple]:
        """``vote`` for several texts, whose searches are made together."""
        if len(self.kept) > 50_000:
            self.kept.clear()
        vectors = [self.vector(words) for words in bags]
        new = {self._key(*v): v for v in vectors}
        new = {key: v for key, v in new.items() if key not in self.kept}
        # texts with the same most frequent term share many others
        lead = {key: int(self.vectors.column[v[0]].view(np.uint32).min(initial=FREQUENT)) for key, v in new.items()}
        keys = sorted(new, key=lead.get)
        for at in range(0, len(keys), TOGETHER):
            some = keys[at:at + TOGETHER]
            self.kept.update(zip(some, self.search([new[key] for key in some], NEIGHBOURS + 1)))
        return [self._vote(*v, i) for v, i in zip(vectors, without or [None] * len(bags))]

    def vote(self, words: Counter, without: int | None = None) -> tuple[float | None, list[dict]]:
        """Share of toxic votes, None without a neighbour, and the three nearest as evidence. Equal
        bags share one search for one neighbour more than vote; ``without`` drops its own of them."""
        return self._vote(*self.vector(words), without)

    def _vote(self, terms: np.ndarray, weights: np.ndarray, without: int | None) -> tuple[float | None, list[dict]]:
        key = self._key(terms, weights)
        if without in self.repeated:  # several examples of one id
            at, cosine = self.nearest(terms, weights, NEIGHBOURS, without)
        else:
            if key not in self.kept:
                if len(self.kept) > 50_000:
                    self.kept.clear()
                self.kept[key] = self.nearest(terms, weights, NEIGHBOURS + 1)
            at, cosine = self.kept[key]
            if without is not None:
                fine = self.ids[at] != without
                at, cosine = at[fine], cosine[fine]
            at, cosine = at[:NEIGHBOURS], cosine[:NEIGHBOURS]
        power = cosine ** 2
        share = float((power @ self.toxic[at] + self.share) / (power.sum() + 1)) if len(at) else None
        evidence = [{"doc_id": int(self.ids[i]), "cosine": float(c), "toxic": int(self.toxic[i])}
                    for i, c in zip(at[:3], cosine[:3])]
        return share, evidence

    def score(self, share: float | None) -> float:
        if share is None:
            return self.base
        share = min(max(share, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.offset + self.slope * math.log(share / (1 - share)))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``toxic`` and ``_text`` of the rows that may be learned from. Labels grow with the
    texts, so they are not broadcast, however few."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        "toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return small_texts(docs).join(known.hint("merge"), "doc_id").select("doc_id", "toxic", "_text")


def least_hashes(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of the least hashes of ``doc_id``. Rows above a hash that some more than ``most``
    stay below are dropped first, else each task would send ``most`` rows to the driver."""
    place, n = F.xxhash64("doc_id"), rows.count()
    share, below = 1.1 * most / max(n, 1), rows
    while share < 1:
        below = rows.where(place <= int((share - 0.5) * 2.0 ** 64))
        if below.count() >= most:
            break
        share, below = 2 * share, rows
    return below.orderBy(place, "doc_id").limit(most)


def bags_of(examples: DataFrame) -> DataFrame:
    """``doc_id``, ``toxic`` and the bag of terms of each example: compressed ``words`` and ``counts``, null for none."""
    def work(part):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        out = {"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "words": [], "counts": []}
        for text in full_texts(part):
            found = words_of(text.decode())
            found.pop("", None)
            out["words"].append(pack.compress("\n".join(found).encode()) if found else None)
            out["counts"].append(pack.compress(np.array(list(found.values()), "<u4").tobytes()) if found else None)
        return out

    return map_slices(examples, work, "doc_id long, toxic int, words binary, counts binary")


def unpacked(part: pa.RecordBatch | pa.Table) -> Iterator[tuple[list[str], list[int]]]:
    """Words and counts of a slice of ``bags_of``."""
    import zstandard

    open_frame = zstandard.ZstdDecompressor().decompress
    for words, counts in zip(part.column("words").to_pylist(), part.column("counts").to_pylist()):
        if words is None:
            yield [], []
        else:
            yield open_frame(words).decode().split("\n"), np.frombuffer(open_frame(counts), "<u4").tolist()


def telling_terms(bags: DataFrame, last: int) -> tuple[list[str], np.ndarray, np.ndarray, int, int]:
    """All terms held by the examples up to the hash ``last``, frequent ones first, with their document frequency and
    the evidence that they tell toxic texts, of all labelled texts; how many of these there are, and how many toxic."""
    schema = "term string, n long, toxic long, held boolean"
    arrow = arrow_schema(schema)

    def count(batches):
        for part in slices(batches, 4096):
            every, bad, held = Counter(), Counter(), set()
            for (words, _), toxic, near in zip(
                    unpacked(part), part.column("toxic").to_pylist(), part.column("held").to_pylist()):
                every.update(words)
                if toxic:
                    bad.update(words)
                if near:
                    held.update(words)
            yield pa.RecordBatch.from_pydict({
                "term": list(every), "n": list(every.values()), "toxic": [bad[w] for w in every],
                "held": [w in held for w in every]}, schema=arrow)

    total = bags.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total.n, total.t or 0
    found = (bags.withColumn("held", F.xxhash64("doc_id") <= last).mapInArrow(count, schema).groupBy("term")
             .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.max("held").alias("held")).where("held")
             .select("term", "n", "toxic").toArrow().sort_by([("n", "descending"), ("term", "ascending")]))
    df, a = (found.column(c).to_numpy().astype(float) for c in ("n", "toxic"))

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1)), 0.0)

    share = df / max(n, 1)
    evidence = 2 * (part(a, share * t) + part(df - a, share * (n - t)) + part(t - a, (1 - share) * t)
                    + part((n - t) - (df - a), (1 - share) * (n - t)))
    return found.column("term").to_pylist(), df, np.maximum(evidence, 0), n, t


def learned(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Index:
    """Terms, index and calibration. What the driver holds is bounded by the texts of ``most`` examples."""
    return _learned(docs, labels, most)[0]


def _learned(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> tuple[Index, Broadcast]:
    """``learned``, and the index as it was sent for the calibration: complete but for slope and offset. It is
    large, so the scoring uses what the workers hold of it already."""
    context = docs.sparkSession.sparkContext
    bags = stage(bags_of(labelled(docs, labels)))
    some, place = bags.where("words IS NOT NULL"), F.xxhash64("doc_id")
    last = least_hashes(some.select("doc_id"), most).agg(F.max(place)).first()[0]
    if last is None or most < 1:
        known = bags.agg(F.avg("toxic")).first()[0]
        index = Index({}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0), [], base=float(known or 0))
        return index, context.broadcast(index)
    terms, df, evidence, n, toxic = telling_terms(bags, last)
    idf = (np.log((1 + n) / (1 + df)) + 1) * (1 + evidence)
    chosen = some.where(place <= last).withColumn("place", place).toArrow()
    chosen = chosen.take(pa.array(np.lexsort((chosen.column("doc_id").to_numpy(), chosen.column("place").to_numpy()))[:most]))
    empty = Index({w: i for i, w in enumerate(terms)}, idf, np.zeros(0, np.int64), np.zeros(0), [])
    found = [empty.counted(dict(zip(*bag))) for bag in unpacked(chosen)]
    # examples with the same leading term lie in the same blocks, so that bounds are close
    lead = [terms[int(np.argmax((1 + np.log(counts)) * idf[terms]))] for terms, counts in found]
    ids = chosen.column("doc_id").to_numpy()
    order = np.lexsort((ids, lead))
    found = [found[i] for i in order.tolist()]
    counts = np.concatenate([c for _, c in found])
    rows = (np.array([len(t) for t, _ in found], np.int32),
            np.concatenate([t for t, _ in found], dtype=np.int32, casting="unsafe"),
            counts.astype(np.min_scalar_type(int(counts.max()))))
    none = bags.where("words IS NULL").agg(F.avg("toxic")).first()[0]
    index = Index(empty.terms, idf, ids[order], chosen.column("toxic").to_numpy()[order].astype(float), rows,
                  base=float(none or 0), share=toxic / n)
    shared = context.broadcast(index)
    _calibrate(index, shared, some)
    return index, shared


def _calibrate(index: Index, shared: Broadcast, bags: DataFrame) -> None:
    """Fit slope and offset to the votes about all labelled texts, each without itself. Votes are
    counted in 200 steps, so the driver sees that many rows."""
    def work(part):
        ids, bags = part.column("doc_id").to_pylist(), [dict(zip(*bag)) for bag in unpacked(part)]
        steps = [None if share is None else round(share * 200) for share, _ in shared.value.votes(bags, ids)]
        return {"step": steps, "toxic": part.column("toxic")}

    found = map_slices(bags, work, "step int, toxic int").where("step IS NOT NULL")
    rows = found.groupBy("step").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).orderBy("step").collect()
    share = np.clip(np.array([r.step / 200 for r in rows]), 0.0025, 0.9975)
    x, n, t = np.log(share / (1 - share)), np.array([r.n for r in rows], float), np.array([r.t for r in rows], float)
    if not len(rows) or t.sum() in (0, n.sum()):
        return
    b = np.array([0.0, 1.0])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):  # Newton steps with a light pull to the identity
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ (t - n * p) - (b - [0, 1])
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    index.offset, index.slope = float(b[0]), float(max(b[1], 0.0))


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``evidence`` of every row."""
    rows = texts_of(docs, id_column, text_column)
    index, shared = _learned(rows, labels)
    curve = index.slope, index.offset

    def work(part):
        index, out = shared.value, {"doc_id": part.column("doc_id"), "score": [], "evidence": []}
        index.slope, index.offset = curve
        for share, evidence in index.votes([words_of(text) for text in strings(part)]):
            out["score"].append(index.score(share))
            out["evidence"].append(evidence)
        return out

    found = map_slices(rows, work, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
    return found.select("doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
