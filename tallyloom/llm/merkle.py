"""A Merkle manifest of a table of documents: leaves, a tree per source, a root over the sources,
and a proof for every leaf found by descending the tree from its root.

[native] Only DataFrame functions: hashes, grouping and joins.

* A leaf is ``H`` of the fields doc_id, source, lang, n_chars and text, each ``-`` when null, else
  its UTF-8 byte count, ``:`` and its value (integers in decimal). ``H`` is the lowercase hex
  SHA-256 of its inputs concatenated; digests enter as their hex text.
* Per source, leaves ascend by doc_id (nulls first; equal ids by leaf digest, so repeated rows
  give the same tree in any order). While more than one node is left, every ``FAN`` consecutive
  nodes (the last run fewer, even one) become their ``H``. What remains is the source's subroot;
  a source with one leaf has that leaf as subroot. Subroots, ordered by source (null first, UTF-8
  bytewise), give the root the same way.
* The tree is kept as a content-addressed store: one record per digest with its children in order.
  A leaf's proof comes from a descent from the root: requests start at the root, and each step
  joins them with the store by digest, picks the child named by the next digit of the leaf's
  rank (its source's rank in the upper tree, then its place within the source) and keeps the
  unselected children, left and right of it. The segments, collected root first, are reversed:
  ``proof_sha256`` is ``H`` of all siblings, leaf level first, left to right, and ``H`` of nothing
  for a table of one row.

Every level and every step of the descent is a grouping or a join of at most one row per node;
no group holds more than ``FAN`` rows, so a hot source is spread like any other. The descent
stops at parents of leaves: each leaf meets its parent's request (the parent's children and the
segments above it) in one join and is finished there, so no per-leaf proof is ever shuffled. Places within
a source come from numbering in blocks (``ordered.row_positions``), never from one ordered group.
Each level is written to the shared folder, so lost executors recompute one level at most.

Empty table: no rows. Null text or fields: ``-`` as above. Extra columns are ignored.
Ids are whole numbers (a text id is refused at once).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyloom.operators.ordered import row_positions
from tallyloom.operators.staging import stage

#: Fixed values of the contract: fan-out, fields of a leaf in order, which leaves are tampered.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text, with A-Z lower-cased where ``TAMPER_EVERY`` divides the CRC-32 of the decimal id."""
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_EVERY == 0
    return F.when(chosen, F.translate(text, UPPER, UPPER.lower())).otherwise(text)


def _levels(nodes: DataFrame, total: str) -> tuple[DataFrame, DataFrame]:
    """Group ``nodes`` (tree, idx, digest, and ``total`` nodes of its tree at level 0) level by
    level. Returns the tops (tree, digest) and the store records (digest, kids, leafy: the kids
    are level 0)."""
    spark = nodes.sparkSession
    largest = nodes.agg(F.max(total)).first()[0] or 0
    tops, records, level, width = [], [], nodes, 1
    while True:
        alone = F.col(total) <= F.lit(width)  # one node left at this level
        tops.append(level.filter(alone).select("tree", "digest"))
        if width >= largest:
            break
        runs = level.filter(~alone).groupBy("tree", total, (F.col("idx") / FAN).cast("long").alias("run"))
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda k: k["digest"])
        parents = stage(runs.agg(kids.alias("kids")).select(
            "tree", total, F.col("run").alias("idx"),
            F.sha2(F.array_join("kids", ""), 256).alias("digest"), "kids"))
        records.append(parents.select("digest", "kids", F.lit(width == 1).alias("leafy")))
        level, width = parents.drop("kids"), width * FAN
    union = records[0] if records else spark.createDataFrame([], "digest string, kids array<string>, leafy boolean")
    for r in records[1:]:
        union = union.unionByName(r)
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return top, union


def _height(count: int) -> int:
    height, width = 0, 1
    while width < count:
        height, width = height + 1, width * FAN
    return height


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, leaf, subroot, root, proof_sha256, folded_root,
    verified (see the module)."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number")
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_src"),
        leaf_of(*[F.col(f) for f in FIELDS]).alias("_leaf"),
        leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"),
                tampered(F.col("doc_id"), F.col("text"))).alias("_tampered"))
    spark = docs.sparkSession
    placed = stage(row_positions(rows.withColumn("_has_src", F.col("_src").isNotNull()),
                                 ["_has_src", "_src", "_id", "_leaf"], "_place"))
    sources = placed.groupBy("_src").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ranked = row_positions(sources.withColumn("_has_src", F.col("_src").isNotNull()),
                           ["_has_src", "_src"], "_rank")
    ranked = stage(ranked.select("_src", (F.col("_rank") - 1).alias("tree"), "_first", "_n"))
    leaves = stage(placed.join(ranked, placed["_src"].eqNullSafe(ranked["_src"])).select(
        "tree", (F.col("_place") - F.col("_first")).alias("idx"), F.col("_n").alias("total"),
        F.col("_id").alias("doc_id"), F.col("_leaf").alias("digest"), "_tampered"))
    if ranked.isEmpty():
        return spark.createDataFrame([], (
            "doc_id long, source string, leaf string, subroot string, root string, "
            "proof_sha256 string, folded_root string, verified boolean"))

    subroots, lower = _levels(leaves.select("tree", "idx", "total", "digest"), "total")
    subroots = stage(subroots)
    sources_count = ranked.count()
    upper_nodes = subroots.select(
        F.lit(0).alias("tree"), F.col("tree").alias("idx"), F.lit(sources_count).alias("total"), "digest")
    top, upper = _levels(upper_nodes, "total")
    root = top.first()["digest"]
    store = stage(lower.unionByName(upper.withColumn("leafy", F.lit(False))).dropDuplicates(["digest"]))

    # Descent: one request per node on the path, named by its rank digits (tree, idx). It stops
    # at parents of leaves (and at sources of one leaf), which are finished beside their leaves.
    segment = "struct<left:string,right:string>"
    requests = spark.createDataFrame([(0, 0, root)], "tree long, idx long, digest string").withColumn(
        "segs", F.expr(f"cast(array() as array<{segment}>)"))
    upper_steps, alone, parents = _height(sources_count), [], []
    for step in range(max(1, upper_steps + _height(ranked.agg(F.max("_n")).first()[0]))):
        joined = stage(requests.join(store, "digest", "left"))
        alone.append(joined.filter(F.col("kids").isNull()).select("tree", "idx", "segs"))
        parents.append(joined.filter(F.col("leafy")).select("tree", "idx", "kids", "segs"))
        picked = joined.filter(~F.col("leafy")).select(
            "tree", "idx", "segs", "kids", F.posexplode("kids").alias("j", "digest"))
        child = F.col("idx") * FAN + F.col("j")
        into_source = F.lit(step == upper_steps - 1)  # the next level holds subroots
        requests = stage(picked.select(
            F.when(into_source, child).otherwise(F.col("tree")).alias("tree"),
            F.when(into_source, F.lit(0)).otherwise(child).cast("long").alias("idx"),
            "digest", F.concat("segs", F.array(_segment("kids", F.col("j")))).alias("segs")))
        if requests.isEmpty():
            break

    below = [leaves.join(a, ["tree", "idx"]).select(*LEAF, "segs") for a in alone]
    for p in parents:
        p = p.select(F.col("tree").alias("_tree"), F.col("idx").alias("_parent"), "kids", "segs")
        at = (F.col("idx") % FAN).cast("int")
        joined = leaves.join(p, (F.col("tree") == F.col("_tree")) & ((F.col("idx") / FAN).cast("long") == F.col("_parent")))
        below.append(joined.select(*LEAF, F.concat("segs", F.array(_segment("kids", at))).alias("segs")))
    # proofs were collected root first; folding starts at the leaf
    up = F.reverse("segs")
    proof = F.sha2(F.array_join(F.transform(up, lambda x: F.concat(x["left"], x["right"])), ""), 256)
    folded = F.aggregate(up, F.col("_tampered"), lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))
    done = [b.select("tree", "doc_id", F.col("digest").alias("leaf"), proof.alias("proof_sha256"),
                     folded.alias("folded_root")) for b in below]
    reached = done[0]
    for d in done[1:]:
        reached = reached.unionByName(d)
    names = ranked.select(F.col("tree").alias("_t"), F.col("_src").alias("source"))
    tops = subroots.select(F.col("tree").alias("_tree"), F.col("digest").alias("subroot")).join(
        names, F.col("_tree") == F.col("_t")).drop("_t")
    out = reached.join(tops, F.col("tree") == F.col("_tree"))
    return out.select(
        "doc_id", "source", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"))


LEAF = ("tree", "idx", "doc_id", "digest", "_tampered")


def _segment(kids: str, at: Column) -> Column:
    """The unselected children left and right of child ``at`` (from 0)."""
    return F.struct(
        F.array_join(F.slice(kids, 1, at), "").alias("left"),
        F.array_join(F.slice(kids, at + 2, FAN), "").alias("right"))
