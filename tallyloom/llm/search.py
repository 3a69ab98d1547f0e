"""Ranked lexical search: the best documents of a table for each item of a set of queries.

Terms are the maximal runs of ``TERM`` in a text, with only A-Z lower-cased; a null text has none.
N counts documents with at least one term, L all their terms, n one document's terms, df the
documents holding a term, tf its occurrences in one document. A term weighs
w = floor(1000 * ln((2N + 2) / (2df + 1))); a document's m is 25 + (75 n N) div L; its score for
an item sums w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included. All
but w is 64-bit integer arithmetic. Each item gets its ``TOP`` best documents with a score above
0, equal scores by ascending doc_id (null ids last).

Method: bit-sliced Bloom signatures. A task takes documents a slice at a time and sets, for each
of its terms (by Spark's 64-bit xxhash64 of the term, made when the terms are staged), ``HASHES`` bits of ``BITS`` in the slice's signature, stored by bit: one bitmap over
the slice's rows per bit. A query term is possibly present where all its bit slices are set; that
overestimates presence, never misses it. Weighted slice sums - per item, the sum over its terms of
the slices times the term's largest possible gain (its weight at the smallest of the document's n
and the corpus-wide largest tf) - bound every score from above. Documents are exactly rescored by
descending bound until the bound falls below the task's tenth best exact score; those left are
provably excluded. Each task keeps its ``TOP`` per item, and one small window ranks them.

Corpus statistics (N, L, df and largest tf of query terms) are DataFrame aggregates over all rows.
Items are processed in blocks of at most ``QUERY_TERMS`` (item, term) rows, the only data sent to
tasks; every block reads all documents.

Null, empty or term-less texts score 0 and are never listed. Repeated rows are separate documents.
Empty tables: no rows. Extra columns are ignored.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.rows import mix, slices
from tallyloom.operators.staging import stage

#: Fixed values of the contract: terms, the case fold, the constants of the score, the list size.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOP = 10

#: Parameters of the signatures: bits per document signature, hash functions per term, rows per slice.
BITS = 4096
HASHES = 2
ROWS = 256
#: Rows rescored at once.
RESCORED = 32
#: (item, term) rows sent to the tasks at once.
QUERY_TERMS = 200_000


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(TERM), 0)


def hashes_of(terms: Column) -> Column:
    """64-bit hashes of the terms, made by Spark's xxhash64 (JVM side, once per staged row)."""
    return F.transform(terms, lambda t: F.xxhash64(t))


def bit_positions(hashes: np.ndarray) -> np.ndarray:
    """``HASHES`` bit positions per 64-bit hash: (len(hashes), HASHES)."""
    seeds = np.asarray(hashes).astype(np.int64).view(np.uint64)
    return np.stack([(mix(seeds + np.uint64(k)) % np.uint64(BITS)).astype(np.int64)
                     for k in range(HASHES)], axis=1) if len(seeds) else np.zeros((0, HASHES), np.int64)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Ranker:
    """The exact best ``TOP`` of every item within one task, with bounds from bit slices."""

    def __init__(self, items: np.ndarray, terms: list[str], term_hashes: np.ndarray, counts: np.ndarray,
                 weights: np.ndarray, largest_tf: np.ndarray, n_docs: int, n_terms: int):
        self.items = items                          # item ids, (I,)
        self.terms = pa.array(terms, pa.string())   # query terms, (T,)
        # per item: its terms, and their repeats times weight
        self.item_terms = [np.flatnonzero(own) for own in counts]
        self.item_weights = [own[t] * weights[t] for own, t in zip(counts, self.item_terms)]
        self.largest_tf = largest_tf
        self.bits = bit_positions(term_hashes)      # (T, HASHES)
        self.N, self.L = n_docs, n_terms
        self.heaps = [[] for _ in items]            # (score, -order of id) min-heaps, worst first
        self.bounded = self.rescored = 0

    def floor(self, i: int) -> int:
        heap = self.heaps[i]
        return heap[0][0] if len(heap) == TOP else 1

    def offer(self, i: int, score: int, doc_id) -> None:
        place = -doc_id if doc_id is not None else -(1 << 63)
        entry, heap = (score, place, doc_id), self.heaps[i]
        if len(heap) < TOP:
            heapq.heappush(heap, entry)
        elif entry[:2] > heap[0][:2]:
            heapq.heapreplace(heap, entry)

    def slice(self, ids: list, terms: pa.ListArray, hashes: pa.ListArray) -> None:
        rows = len(ids)
        owner = pc.list_parent_indices(hashes).to_numpy()
        n = np.diff(terms.offsets.to_numpy()).astype(np.int64)
        # the signature, by bit: one bitmap over the rows per bit position
        signature = np.zeros((BITS, rows), bool)
        occurrence_bits = bit_positions(pc.list_flatten(hashes).to_numpy())
        for k in range(HASHES):
            signature[occurrence_bits[:, k], owner] = True
        present = signature[self.bits[:, 0]]
        for k in range(1, HASHES):
            present &= signature[self.bits[:, k]]
        m = 25 + (75 * n * self.N) // max(self.L, 1)
        # the largest possible gain, (T, rows), in doubles: not below the whole number
        tf = np.minimum(self.largest_tf[:, None], n[None, :]).astype(np.float64)
        most = 1000 * tf
        most += 8.0 * m
        np.divide(1e9 * tf, most, out=most)
        most *= present
        del tf
        bounds = [w.astype(np.float64) @ most[t] for t, w in zip(self.item_terms, self.item_weights)]
        del most, present, signature
        self.bounded += rows
        # rows that some item can't exclude; + 1: bounds are sums of doubles
        left = [np.flatnonzero((b > 0) & (b + 1 >= self.floor(i))) for i, b in enumerate(bounds)]
        wanted = np.zeros(rows, bool)
        for mine in left:
            wanted[mine] = True
        if not wanted.any():
            return
        # exact counts of the query terms (compared as text) in these rows
        coded = pc.dictionary_encode(pc.list_flatten(terms))
        query_code = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.terms), -1).to_numpy().astype(np.int64)
        code = query_code[coded.indices.to_numpy()]
        kept = (code >= 0) & wanted[owner]
        place = np.cumsum(wanted) - 1
        width = int(wanted.sum())
        held = np.bincount(code[kept] * width + place[owner[kept]], minlength=len(self.terms) * width)
        held = held.reshape(len(self.terms), width)
        self.rescored += width
        for i, mine in enumerate(left):
            bound = bounds[i]
            order = mine[np.argsort(-bound[mine], kind="stable")]
            for at in range(0, len(order), RESCORED):
                some = order[at:at + RESCORED]
                some = some[bound[some] + 1 >= self.floor(i)]
                if not len(some):
                    break
                tf = held[self.item_terms[i][:, None], place[some][None, :]]
                scores = self.item_weights[i] @ gain(tf, m[some][None, :])
                for r, score in zip(some.tolist(), scores.tolist()):
                    if score > 0 and score >= self.floor(i):
                        self.offer(i, score, ids[r])

    def best(self) -> dict:
        out = {"item_id": [], "doc_id": [], "score": []}
        for item, heap in zip(self.items, self.heaps):
            for score, _, doc_id in heap:
                out["item_id"].append(int(item))
                out["doc_id"].append(doc_id)
                out["score"].append(score)
        return out


def ranked(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) ranked for each row of ``queries`` (item_id, text, ...):
    item_id, rank (from 1), doc_id, score; see the module."""
    spark = docs.sparkSession
    terms = docs.select(F.col("doc_id").cast("long").alias("doc_id"), terms_of(F.col("text")).alias("terms"))
    rows = stage(terms.withColumn("hashes", hashes_of(F.col("terms"))).withColumn("_row", F.monotonically_increasing_id()))
    totals = rows.agg(F.count(F.when(F.size("terms") > 0, 1)).alias("N"),
                      F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("L")).first()
    n_docs, n_terms = int(totals["N"]), int(totals["L"])
    schema = "item_id long, rank int, doc_id long, score long"
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"),
                           F.explode(terms_of(F.col("text"))).alias("term"))
    asked = stage(asked.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")))
    items = [r[0] for r in asked.select("item_id").distinct().orderBy("item_id").collect()] if n_docs else []
    found = []
    for block in _blocks(asked, items):
        part = asked.join(block, "item_id")
        wanted = part.select("term").distinct()
        held = rows.select("_row", F.explode("terms").alias("term")).join(F.broadcast(wanted), "term")
        per_doc = held.groupBy("_row", "term").agg(F.count(F.lit(1)).alias("tf"))
        stats = per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("largest_tf"))
        held_by = F.coalesce("df", F.lit(0)).cast("double")
        weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2.0) / (2.0 * held_by + 1.0))).cast("long")
        table = part.join(stats, "term", "left").select(
            "item_id", "term", F.xxhash64("term").alias("hash"), "times", weight.alias("w"),
            F.coalesce("largest_tf", F.lit(0)).alias("largest_tf")).collect()
        found.append(_search(rows, table, n_docs, n_terms))
    if not found:
        return spark.createDataFrame([], schema)
    best = found[0]
    for f in found[1:]:
        best = best.unionByName(f)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP).select(
        "item_id", "rank", "doc_id", "score")


def _blocks(asked: DataFrame, items: list[int]):
    """Item ids in blocks whose (item, term) rows stay within ``QUERY_TERMS``."""
    sizes = dict(asked.groupBy("item_id").count().collect()) if items else {}
    block, size = [], 0
    spark = asked.sparkSession
    for item in items:
        if block and size + sizes[item] > QUERY_TERMS:
            yield spark.createDataFrame([(i,) for i in block], "item_id long")
            block, size = [], 0
        block.append(item)
        size += sizes[item]
    if block:
        yield spark.createDataFrame([(i,) for i in block], "item_id long")


def _search(rows: DataFrame, table: list, n_docs: int, n_terms: int) -> DataFrame:
    items = np.array(sorted({r["item_id"] for r in table}), np.int64)
    terms = sorted({r["term"] for r in table})
    at_item = {v: i for i, v in enumerate(items)}
    at_term = {t: i for i, t in enumerate(terms)}
    counts = np.zeros((len(items), len(terms)), np.int64)
    weights, largest = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    term_hashes = np.zeros(len(terms), np.int64)
    for r in table:
        t = at_term[r["term"]]
        counts[at_item[r["item_id"]], t] = r["times"]
        weights[t], largest[t], term_hashes[t] = r["w"], r["largest_tf"], r["hash"]
    schema = "item_id long, doc_id long, score long"

    def run(batches):
        ranker = Ranker(items, terms, term_hashes, counts, weights, largest, n_docs, n_terms)
        for part in slices(batches, ROWS):
            ranker.slice(part.column("doc_id").to_pylist(), part.column("terms"), part.column("hashes"))
        yield pa.RecordBatch.from_pydict(ranker.best(), schema=pa.schema(
            [("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return rows.select("doc_id", "terms", "hashes").mapInArrow(run, schema)
