"""Merkle manifest, first-fit decreasing and ranked search against plain Python versions, and odd inputs."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import DATA
from tallyloom.llm import ffd, merkle, search
from tallyloom.llm.catalog import QUERIES, tokenizer

ROWS = [
    (5, "Alpha Beta", "web", "en", 10), (3, "gamma", "web", None, 5), (3, "gamma", "web", None, 5),
    (None, None, None, "de", None), (7, "", "books", "fr", 0), (11, "ÄÖ Über 日本 🙂 ZZ", "books", "en", 9),
    (2, "x " * 5000, "wiki", "en", 10000),
] + [(100 + i, f"Doc {i} Text", "web" if i % 3 else "zzz", "en", 11) for i in range(40)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return spark.createDataFrame(
        [(*r, "clash", 1) for r in ROWS],
        "doc_id long, text string, source string, lang string, n_chars long, leaf string, kids int")


# ---- op11 -------------------------------------------------------------------------------------

def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_of(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        prev = levels[-1]
        levels.append([H(*prev[i:i + 16]) for i in range(0, len(prev), 16)])
    return levels


def path_of(levels, at):
    """(siblings left, siblings right) per level from the bottom."""
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + 16])))
        at //= 16
    return out


def brute_manifest(rows):
    by_source = defaultdict(list)
    for doc_id, text, source, lang, n_chars in rows:
        leaf = H(*map(field, (doc_id, source, lang, n_chars, text)))
        low = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        by_source[source].append((doc_id is not None, doc_id or 0, leaf, H(*map(field, (doc_id, source, lang, n_chars, low))), doc_id))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: r[:3])
        trees[s] = tree_of([r[2] for r in by_source[s]])
    upper = tree_of([trees[s][-1][0] for s in names])
    root = upper[-1][0]
    out = []
    for rank, s in enumerate(names):
        for at, (_, _, leaf, low, doc_id) in enumerate(by_source[s]):
            segs = path_of(trees[s], at) + path_of(upper, rank)
            folded = low
            for left, right in segs:
                folded = H(left, folded, right)
            proof = H(*[left + right for left, right in segs])
            out.append((doc_id, leaf, trees[s][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def test_merkle_matches_plain_python(spark, odd_docs):
    got = merkle.manifest(odd_docs).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(ROWS)


def test_merkle_trees_of_several_levels(spark):
    rows = [(i, f"T{i}", "a" if i % 7 else None, "en", i) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = merkle.manifest(df).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = brute_manifest([(i, t, s, lang, n) for i, t, s, lang, n in rows])
    assert sorted(map(tuple, got), key=repr) == want
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_merkle_one_row_and_empty(spark):
    one = spark.createDataFrame([(1, "A", "s", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    [r] = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest(one.limit(0)).count() == 0
    with pytest.raises(TypeError):
        merkle.manifest(one.withColumn("doc_id", one.doc_id.cast("string")))


# ---- op12 -------------------------------------------------------------------------------------

def naive_first_fit(lengths, size):
    room, out = [], []
    for need in lengths:
        for k, free in enumerate(room):
            if free >= need:
                out.append((k, size - free))
                room[k] -= need
                break
        else:
            out.append((len(room), 0))
            room.append(size - need)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tournament_equals_naive_first_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 4097, 300))[::-1]
    sequences, offsets = ffd.first_fit_decreasing(lengths, 4096)
    assert list(zip(sequences.tolist(), offsets.tolist())) == naive_first_fit(lengths.tolist(), 4096)


def test_ffd_pieces_and_places(spark, odd_docs):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = ffd.pack(odd_docs, tokenizer("word_bpe_49k.json")).collect()
    assert len({(r.doc_id, r.start) for r in rows if r.doc_id == 3}) == 1  # repeated rows: two pieces, one start
    assert sum(1 for r in rows if r.doc_id == 3) == 2
    expected = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        expected[doc_id].append(known.encode(text or "", add_special_tokens=False).ids + [2])
    for doc_id, versions in expected.items():
        ids = versions[0]
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)[:len(ids)]
        at = 0
        for r in mine:
            if r.start != at:
                continue
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    assert ffd.pack(odd_docs.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


def test_words_are_folded_and_equal_the_library():
    import random

    import pyarrow as pa

    own, draw = ffd.Encoder(tokenizer("word_bpe_49k.json")), random.Random(1)
    letters = "aAbBéÉßÄøЖжЁё09.,;:!?)\"'(-_ \u1e96H\u0331 İIΣς日ſ\u1e30…🙂 \n\t's't"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += ["it's.", "H\u0331.", "é,", "A\u0301.", "", " ", "a  b", "Ende.\" 'Start' end end, END?!"]
    ids, offsets = own.encode(pa.array(texts))
    for k, found in enumerate(own.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == found.ids
    ids, offsets = own.encode(pa.array(["Haus", "haus.", "HAUS,", None]))
    before = len(own.vocabulary)
    own.encode(pa.array(["hAUS!", "Haus?"]))
    assert len(own.vocabulary) == before


# ---- op13 -------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_search(docs, items):
    terms = [words(t) for _, t in docs]
    big_n = sum(1 for t in terms if t)
    big_l = sum(len(t) for t in terms)
    df = Counter(w for t in terms for w in set(t))
    out = []
    for item_id, q in items:
        scored = []
        for (doc_id, _), t in zip(docs, terms):
            if not t:
                continue
            tf, m = Counter(t), 25 + (75 * len(t) * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) *
                        ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in words(q))
            if score > 0:
                scored.append((score, doc_id))
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item_id, k + 1, d, s) for k, (s, d) in enumerate(scored[:10])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_exhaustive_scoring(spark, monkeypatch, small):
    if small:  # tiny slices and signatures: bounds are loose, many rows are rescored
        monkeypatch.setattr(search, "ROWS", 7)
        monkeypatch.setattr(search, "BITS", 64)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = search.ranked(docs, items).collect()
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, got), key=repr) == want


def test_search_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "gamma ZZ"), (2, None), (3, "über x"), (4, "x x x")], "item_id long, text string")
    got = search.ranked(odd_docs, items).collect()
    want = brute_search([(r[0], r[1]) for r in ROWS], [(1, "gamma ZZ"), (2, None), (3, "über x"), (4, "x x x")])
    assert sorted(map(tuple, got), key=repr) == want
    # the repeated row with id 3 is listed twice, with one score
    assert [r.doc_id for r in got if r.item_id == 1].count(3) == 2
    assert search.ranked(odd_docs.limit(0), items).count() == 0


def test_a_slice_of_the_search_stays_small():
    import tracemalloc

    import pyarrow as pa

    rng, count = np.random.default_rng(4), 4000
    names = [f"t{i}" for i in range(count)]
    asked = (rng.random((50, count)) < 0.01).astype(np.int64)
    hashes = rng.integers(-1 << 62, 1 << 62, count)
    ranker = search.Ranker(np.arange(50), names, hashes, asked, np.full(count, 900), np.full(count, 9), 10_000, 400_000)
    held = [rng.integers(0, count, 40) for _ in range(search.ROWS)]
    terms, own = pa.array([[names[i] for i in h] for h in held]), pa.array([hashes[h] for h in held], pa.list_(pa.int64()))
    tracemalloc.start()
    ranker.slice(list(range(search.ROWS)), terms, own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_queries_registered():
    assert {"op11_merkle", "op12_ffd", "op13_search"} <= set(QUERIES)
