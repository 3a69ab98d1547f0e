"""Join documents whose word shingles overlap by a Jaccard similarity of 0.8 or more, and the connected
components of these links. Exact: no pair is lost.

* Documents with equal shingle sets are one class from the start.
* Two similar sets share one of their first ``n - ceil(0.8 n) + 1`` shingles in any common order. The order
  puts frequent shingles last, so passages that many documents share lead no two of them
  together, and among the others those of frequent words, so that few are shared by chance however many
  documents there are. A tile holds the classes with one such shingle; a frequent one is cut into tiles
  of bounded size, one for each two blocks of classes.
* Within a tile only sets of fitting size meet. Each carries a bitmap as wide as its size band asks:
  bit i is the parity of its shingles with hash i. The bits in which two bitmaps differ are a lower
  bound of the differing shingles, so of the overlap from above.
* What passes is verified by intersecting the sorted arrays of both. Classes already linked are not
  compared again; pairs that fail are kept, and tiles are gone through again until nothing is
  left to verify. A component needs few verified pairs, however many links it has.

Null and empty texts have no shingles and link with nothing; their component is their own id. Repeated rows
are classes of equal sets. Rows without an id take part; a component of such rows only has none.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.exchange import (
    PACKED, bucket_count, collected, exchanged, flags_from, full_texts, groups_of, held_by_several, lists,
    pack_rows, small_texts)
from tallyloom.llm.rows import WordHashes, arrow_schema, map_slices, mix, shingles, slices, texts_of, unused, utf8, windows
from tallyloom.operators.staging import stage

WORDS, PERCENT = 5, 80
#: Shingles that are ordered by how frequent they are, as far as they are frequent at all.
FREQUENT = 100_000
#: A block of rows reports the shingles that more than this share of its rows have: one that more
#: than this share of all rows has is so in some block.
BLOCK, SHARE, LEAST = 4096, 1 / 1000, 4
#: Bits of a word's hash by which words are counted.
WORD_BITS = 16
#: Classes of a tile.
TILE = 4096
#: Classes of a small tile, whose pairs are tested together; pairs tested at a time.
SMALL, PAIRS = 128, 1 << 18
BUCKET_KEYS, BYTES_PER_KEY = 5_000_000, 32


def needed(n):
    """Least overlap of a set of ``n`` with one as similar as asked: at least 0.8 n."""
    return -(-PERCENT * n // 100)


def ranked_shingles(hashes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of a text by the hashes of its words, and how frequent the words of each are: the sum
    of their ``ranks``, the same wherever the shingle occurs."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    size = min(WORDS, len(hashes))
    tokens, first = np.unique(mix(windows(hashes, size) + np.uint64(size)), return_index=True)
    total = np.concatenate(([0], np.cumsum(ranks[(hashes & np.uint64(len(ranks) - 1)).astype(np.int64)])))
    return tokens, total[first + size] - total[first]


def prefix_of(tokens: np.ndarray, words: np.ndarray, frequent: np.ndarray,
              counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the common order, and how frequent each is (0: not known to be). Of equally
    frequent ones those of rarer ``words`` come first."""
    size = len(tokens) - needed(len(tokens)) + 1 if len(tokens) else 0
    count = np.zeros(len(tokens), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        count = np.where(frequent[at] == tokens, counts[at], 0)
    order = np.lexsort((tokens, words, count))[:size]
    return tokens[order], count[order]


def tile_keys(prefix: np.ndarray, counts: np.ndarray, owner: int) -> np.ndarray:
    """The tiles of a class. A shingle frequent beyond ``TILE`` has a tile for each two blocks."""
    large = counts > TILE
    if not large.any():
        return mix(prefix)
    keys = [mix(prefix[~large])]
    for token, count in zip(prefix[large], counts[large].tolist()):
        blocks = -(-count // TILE)
        own, others = owner % blocks, np.arange(blocks)
        pair = np.minimum(own, others) * blocks + np.maximum(own, others) + 1
        keys.append(mix(mix(token + np.zeros(1, np.uint64)) + pair.astype(np.uint64)))
    return np.concatenate(keys)


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of ``n``: a power of two, 2 n to 4 n, 64 at least."""
    return max(64, 1 << (2 * n - 1).bit_length()) if n else 64


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """The bitmap as 64-bit words."""
    width = width_of(len(tokens))
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def differ(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many bits ``one`` differs from each row of ``others``, which are as wide or half."""
    if len(one) > others.shape[1]:
        one = one[:len(one) // 2] ^ one[len(one) // 2:]  # parities fold exactly
    return np.bitwise_count(others ^ one).sum(1, dtype=np.int64)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``FREQUENT`` shingles that many rows have, sorted, with their counts; and a rank by frequency
    for each value of the last ``WORD_BITS`` bits of a word's hash."""
    schema = "is_word boolean, token long, n long"
    arrow = arrow_schema(schema)

    def count(batches):
        hashes, seen = WordHashes(), np.zeros(1 << WORD_BITS, np.int64)
        for part in slices(batches, BLOCK):
            words = [hashes(t.lower().split()) for t in utf8(part)]
            tokens = [shingles(w, WORDS) for w in words]
            every = np.concatenate([*words, np.zeros(0, np.uint64)]) & np.uint64(len(seen) - 1)
            seen += np.bincount(every.astype(np.int64), minlength=len(seen))
            found, n = np.unique(np.concatenate([*tokens, np.zeros(0, np.uint64)]), return_counts=True)
            many = n > max(LEAST, SHARE * part.num_rows)
            yield pa.RecordBatch.from_pydict({
                "is_word": np.zeros(many.sum(), bool), "token": found[many].view(np.int64), "n": n[many]}, schema=arrow)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict(
            {"is_word": np.ones(len(held), bool), "token": held, "n": seen[held]}, schema=arrow)

    sums = stage(docs.mapInArrow(count, schema).groupBy("is_word", "token").agg(F.sum("n").alias("n")))
    top = sums.where("NOT is_word").orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    words, ranks = sums.where("is_word").toArrow(), np.zeros(1 << WORD_BITS, np.int64)
    ranks[words.column("token").to_numpy()] = np.rint(8 * np.log2(1 + words.column("n").to_numpy()))
    return tokens[order], top.column("n").to_numpy()[order], ranks


def profiles(docs: DataFrame) -> DataFrame:
    """Per row: its class, number of shingles, tiles and bitmap."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))  # at most FREQUENT and 2 ** WORD_BITS numbers
    schema = "doc_id long, row long, class long, n long, tiles binary, bits binary"
    arrow = arrow_schema(schema)

    def run(batches):
        import xxhash

        hashes, (known, counts, ranks) = WordHashes(), frequent.value
        for part in slices(batches):
            rows = {name: [] for name in ("class", "n", "tiles", "bits")}
            for text in utf8(part):
                tokens, words = ranked_shingles(hashes(text.lower().split()), ranks)
                owner = xxhash.xxh3_64_intdigest(tokens.tobytes())
                rows["class"].append(owner - (1 << 64) if owner >> 63 else owner)
                rows["n"].append(len(tokens))
                keys = tile_keys(*prefix_of(tokens, words, known, counts), owner)
                rows["tiles"].append(keys.tobytes())
                rows["bits"].append(parity_bits(tokens).tobytes())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "row": part.column("row")} | rows, schema=arrow)

    return docs.mapInArrow(run, schema)


def _shared_tiles(classes: DataFrame, buckets: int) -> DataFrame:
    """Answers that flag the tiles of a class that another class has too."""
    schema = arrow_schema(PACKED)

    def emit(batches):
        for batch in batches:
            keys = [np.frombuffer(k, np.uint64) for k in batch.column("tiles").to_pylist()]
            if keys:
                rows = pack_rows(np.concatenate(keys), np.array(list(map(len, keys))),
                                 batch.column("class").to_numpy(), buckets, np.uint32)
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return exchanged(classes.mapInArrow(emit, PACKED), held_by_several, np.uint32)


def _active(classes: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """Classes that share a tile, with these tiles only."""
    def work(part):
        tiles = []
        for own, *marks in zip(part.column("tiles").to_pylist(), lists(part, "_buckets1"), lists(part, "_bits1")):
            keys = np.frombuffer(own, np.uint64)
            tiles.append(keys[flags_from(keys, buckets, *marks)].tobytes())
        return {"class": part.column("class"), "n": part.column("n"), "row": part.column("row"),
                "tiles": tiles, "bits": part.column("bits")}

    joined = classes.join(collected(shared, "1").withColumnRenamed("owner", "class"), "class")
    return map_slices(joined, work, "class long, n long, row long, tiles binary, bits binary")


def _promising(held, start, end, sizes, parent, table, narrow, place_in) -> np.ndarray:
    """Of the small tiles ``held[start:end]``, which have a pair of different components whose sizes and
    bitmaps allow a link. The others need no look at each class."""
    kept = np.zeros(len(start), bool)
    comp, bounds = np.append(parent[held], 0), np.stack((start, end), 1).ravel()
    several = (np.minimum.reduceat(comp, bounds) != np.maximum.reduceat(comp, bounds))[::2]
    for count in np.unique((end - start)[several]).tolist():
        tiles = np.flatnonzero(several & (end - start == count))
        i, j = np.triu_indices(count, 1)
        for at in range(0, len(tiles), max(1, PAIRS // len(i))):
            some = tiles[at:at + max(1, PAIRS // len(i))]
            a, b = held[start[some][:, None] + i].ravel(), held[start[some][:, None] + j].ravel()
            low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            fine = np.flatnonzero((parent[a] != parent[b]) & (low >= needed(high)))
            a, b = a[fine], b[fine]
            least = np.where(narrow[a] <= narrow[b], a, b)
            other = a + b - least
            passed = np.zeros(len(fine), bool)
            for w in np.unique(narrow[least]).tolist():
                for v in np.unique(narrow[other[narrow[least] == w]]).tolist():
                    pair = np.flatnonzero((narrow[least] == w) & (narrow[other] == v))
                    rows = table[v][place_in[other[pair]]]
                    if v > w:  # the wider ones fold
                        rows = rows[:, :rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2:]
                    total = sizes[least[pair]] + sizes[other[pair]]
                    overlap = -(-PERCENT * total // (100 + PERCENT))
                    unlike = np.bitwise_count(rows ^ table[w][place_in[least[pair]]]).sum(1, dtype=np.int64)
                    passed[pair] = unlike <= total - 2 * overlap
            kept[some[fine[passed] // len(i)]] = True
    return kept


def _meet(keys, owner, sizes, bits, comps, failed, most: int) -> set[tuple[int, int]]:
    """Pairs of one bucket to verify. ``owner``: for each key the place of its class; ``failed``: for each
    place the places it is known not to link with. Linked places are skipped; ``most`` pairs are
    given for a place and another component (0: all)."""
    first: dict[int, int] = {}
    parent = np.array([first.setdefault(c, i) for i, c in enumerate(comps.tolist())], np.int64)
    narrow = np.array([len(b) for b in bits])
    wide = {w: np.flatnonzero(narrow == w) for w in np.unique(narrow).tolist()}
    place_in = np.zeros(len(bits), np.int64)
    for rows in wide.values():
        place_in[rows] = np.arange(len(rows))
    table = {w: np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), -1)
             for w, rows in wide.items()}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = set()
    order, start = groups_of(keys)
    held, end = owner[order], np.append(start[1:], len(order))
    small = np.flatnonzero((end - start > 1) & (end - start <= SMALL))
    wanted = end - start > SMALL
    if len(small):
        wanted[small] = _promising(held, start[small], end[small], sizes, parent, table, narrow, place_in)
    for a, b in zip(start[wanted].tolist(), end[wanted].tolist()):
        if len({root(i) for i in held[a:b].tolist()}) < 2:
            continue
        members = np.unique(held[a:b])
        roots = np.array([root(i) for i in members.tolist()])
        found, times = np.unique(roots, return_counts=True)
        members = members[np.argsort(sizes[members], kind="stable")]
        roots = np.array([root(i) for i in members.tolist()])
        size = sizes[members]
        main = found[np.argmax(times)]
        for x in np.flatnonzero(roots != main).tolist():
            n = int(size[x])
            low = np.searchsorted(size, needed(n))
            high = np.searchsorted(size, n * 100 // PERCENT, side="right")
            near = np.arange(low, high)
            near = near[roots[near] != roots[x]]
            one, passed = int(members[x]), []
            mine = table[int(narrow[one])][place_in[one]]
            for w in np.unique(narrow[members[near]]).tolist():
                ys = near[narrow[members[near]] == w]
                rows = table[w][place_in[members[ys]]]
                if w > narrow[one]:  # the wider ones fold
                    rows = rows[:, :rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2:]
                total = n + size[ys]
                overlap = -(-PERCENT * total // (100 + PERCENT))
                passed += ys[differ(mine, rows) <= total - 2 * overlap].tolist()
            given: dict[int, int] = {}
            for y in passed:
                other = int(members[y])
                pair, r = (min(one, other), max(one, other)), int(roots[y])
                if other in failed.get(one, ()) or most and given.get(r, 0) >= most:
                    continue
                given[r] = given.get(r, 0) + 1
                out.add(pair)
            for r in given:
                mine = root(one)
                parent[mine] = r
                roots[roots == roots[x]] = r
    return out


def _places(active: DataFrame, buckets: int) -> DataFrame:
    """The buckets in which a class has tiles."""
    def work(part):
        keys = [np.frombuffer(k, np.uint64) for k in part.column("tiles").to_pylist()]
        return {"class": part.column("class"),
                "places": [np.unique(k % np.uint64(buckets)).astype(np.int64) for k in keys]}

    return map_slices(active.select("class", "tiles"), work, "class long, places array<long>")


def _candidates(active: DataFrame, comps: DataFrame, failed: DataFrame | None, buckets: int, most: int) -> DataFrame:
    """Pairs of classes to verify in this round, as ``a`` and ``b`` (distinct)."""
    packed_schema = "bucket long, owners binary, counts binary, keys binary, n binary, comp binary, bits array<binary>"
    schema = arrow_schema(packed_schema)

    def emit(batches):
        for part in slices(batches, 4096):
            keys = [np.frombuffer(k, np.uint64) for k in part.column("tiles").to_pylist()]
            if not keys:
                continue
            rows = pack_rows(np.concatenate(keys), np.array(list(map(len, keys))),
                             np.arange(part.num_rows), buckets)
            n, comp = part.column("n").to_numpy(), part.column("comp").to_numpy()
            owner, bits = part.column("class").to_numpy(), part.column("bits").to_pylist()
            held = [np.frombuffer(o, np.int64) for o in rows["owners"]]
            rows |= {"owners": [owner[h].tobytes() for h in held], "n": [n[h].tobytes() for h in held],
                     "comp": [comp[h].tobytes() for h in held], "bits": [[bits[i] for i in h] for h in held]}
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    pair_schema = arrow_schema("a long, b long")

    def meet(tables: tuple[pa.Table, pa.Table] | pa.Table, known: pa.Table | None = None) -> pa.Table:
        def joined(name, kind):
            return np.frombuffer(b"".join(tables.column(name).to_pylist()), kind)

        classes, counts = joined("owners", np.int64), joined("counts", np.uint32).astype(np.int64)
        place = {c: i for i, c in enumerate(classes.tolist())}
        no: dict[int, set[int]] = {}
        if known is not None:
            for a, b in zip(known.column("a").to_pylist(), known.column("b").to_pylist()):
                if a in place and b in place:
                    no.setdefault(place[a], set()).add(place[b])
                    no.setdefault(place[b], set()).add(place[a])
        bits = [b for row in tables.column("bits").to_pylist() for b in row]
        pairs = _meet(joined("keys", np.uint64), np.repeat(np.arange(len(classes)), counts),
                      joined("n", np.int64), bits, joined("comp", np.int64), no, most)
        a = classes[[p[0] for p in pairs]] if pairs else np.zeros(0, np.int64)
        b = classes[[p[1] for p in pairs]] if pairs else np.zeros(0, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=pair_schema)

    packed = active.join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")).mapInArrow(
        emit, packed_schema)
    if failed is None:
        found = packed.groupBy("bucket").applyInArrow(lambda t: meet(t), "a long, b long")
    else:
        # a failed pair is told only where both of it have tiles
        places = stage(_places(active, buckets))
        each = failed.join(places.toDF("a", "_a"), "a").join(places.toDF("b", "_b"), "b").select(
            "a", "b", F.explode(F.array_intersect("_a", "_b")).alias("bucket"))
        found = packed.groupBy("bucket").cogroup(each.groupBy("bucket")).applyInArrow(
            lambda left, right: meet(left, right) if left.num_rows else pair_schema.empty_table(), "a long, b long")
    return found.distinct()


def _sets(docs: DataFrame, active: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sorted shingles of the wanted classes, read from the text of one row each."""
    rows = active.select("class", "row").join(wanted, "class", "left_semi")

    def work(part):
        hashes = WordHashes()
        return {"class": part.column("class"), "tokens": [
            shingles(hashes(t.lower().split()), WORDS).tobytes() for t in full_texts(part)]}

    texts = small_texts(docs.select("row", "text")).join(rows, "row").select("class", "_text")
    return map_slices(texts, work, "class long, tokens binary").dropDuplicates(["class"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b`` and whether the two link."""
    def work(part):
        links = []
        for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            links.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        return {"a": part.column("a"), "b": part.column("b"), "linked": links}

    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("tokens").alias("y")), "b")
    return map_slices(both, work, "a long, b long, linked boolean", 64)


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: within each partition, every node to its least one."""
    arrow = arrow_schema("u long, v long")

    def run(batches):
        parent: dict[int, int] = {}

        def root(i):
            while (up := parent.setdefault(i, i)) != i:
                parent[i] = i = parent.setdefault(up, up)
            return i

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
        nodes = [i for i in parent if root(i) != i]
        for at in range(0, len(nodes), 10_000):
            part = nodes[at:at + 10_000]
            yield pa.RecordBatch.from_pydict({"u": [root(i) for i in part], "v": part}, schema=arrow)

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``class`` and ``comp``, the least class of its component, for all ends of ``edges`` (a, b). Tasks
    join what they hold; then each step links a node's larger neighbours to its least one, then its
    smaller ones, until only stars are left: steps in the order of the logarithm of the longest path."""
    now = stage(_stars(edges.where("a <> b").select(
        F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()))
    while not _only_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v")
        large = large.where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m"), "u", "v")
        now = stage(_stars(small.select(F.col("m").alias("u"), "v").unionByName(
            small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()))
    return now.select(F.col("v").alias("class"), F.col("u").alias("comp")).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether each larger end ``v`` has one smaller ``u`` and is none itself: then ``u`` is the least of all."""
    ends = edges.select(F.col("v").alias("node"), "u").unionByName(
        edges.select(F.col("u").alias("node"), F.col("u")))
    return ends.groupBy("node").agg(F.min("u").alias("low"), F.max("u").alias("high")).where("low <> high").isEmpty()


def linked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class``, ``comp`` and ``component_id`` of every row."""
    rows = texts_of(docs, id_column, text_column).withColumn("row", F.xxhash64("doc_id", "text"))
    spark = docs.sparkSession
    buckets = bucket_count(rows, BYTES_PER_KEY, BUCKET_KEYS)
    found = stage(profiles(rows))
    classes = found.where("n > 0").groupBy("class").agg(
        F.first(F.struct("n", "row", "tiles", "bits")).alias("_one")).select("class", "_one.*")
    classes = stage(classes)
    active = stage(_active(classes, stage(_shared_tiles(classes, buckets)), buckets))
    edges, failed, sets = None, None, None
    comps = spark.createDataFrame([], "class long, comp long")
    most = 1
    while True:
        pairs = stage(_candidates(active, comps, failed, buckets, most))
        if pairs.isEmpty():
            break
        if sets is None:  # every class that can link is in a pair of the first round
            ends = pairs.select(F.col("a").alias("class")).unionByName(
                pairs.select(F.col("b").alias("class"))).distinct()
            sets = stage(_sets(rows, active, stage(ends)))
        tested = stage(_verified(pairs, sets))
        # what is joined already comes as stars, so only new links need steps
        new = tested.where("linked").select("a", "b")
        comps = components(new if edges is None else new.unionByName(edges))
        edges = comps.select(F.col("class").alias("a"), F.col("comp").alias("b"))
        missed = tested.where("NOT linked").select("a", "b")
        if missed.isEmpty():
            break
        failed = missed if failed is None else failed.unionByName(missed)
        # from the fourth round on all pairs that are left are given at once
        most = {1: 8, 8: 64}.get(most, 0)
        # a component without a failed pair needs no more tests
        ends = missed.select(F.col("a").alias("class")).unionByName(missed.select(F.col("b").alias("class"))).distinct()
        comp = F.coalesce("comp", "class")
        again = ends.join(comps, "class", "left").select(comp.alias("_comp")).distinct()
        active = stage(active.join(comps, "class", "left").withColumn("_comp", comp).join(
            again, "_comp", "left_semi").select(*active.columns))
    all_rows = found.join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    least = all_rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("_least"))
    return all_rows.join(least, "comp", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), "class", "comp",
        F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, one of rows equal in id and text."""
    found = stage(linked(docs, id_column, text_column))
    lone = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("row"))
    kept = found.groupBy(lone.alias("_group"), F.col("n_shingles") > 0).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("_first")).select(
        F.col("_first.row").alias("_row"))
    row, name = F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string")), unused(docs, "_row")
    return docs.withColumn(name, row).join(kept.withColumnRenamed("_row", name), name, "left_semi").dropDuplicates(
        [name]).drop(name)
