"""The registered queries of the operators, each over its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    bpe, ffd, fingerprints, jaccard, merkle, packing, privacy, quality, search, secrets, substrings, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register under the function's name; it gets (spark, folder)."""
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@query()
def op2_quality(spark, folder):
    return quality.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality")


@query()
def op3_secrets(spark, folder):
    found = secrets.secrets(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.tiktoken"))

    def joined(spans):
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(joined(F.filter("found", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"))


@query()
def op4_bpe(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


@query()
def op5_warc(spark, folder):
    return warc.archived(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_jaccard(spark, folder):
    return jaccard.linked(table(spark, folder, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@query()
def op7_toxicity(spark, folder):
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op8_substrings(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substrings.without_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op9_fingerprints(spark, folder):
    return fingerprints.compared(table(spark, folder, "documents"))


@query()
def op10_pii(spark, folder):
    found = privacy.pseudonymized(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def _merkle_sql(levels: int = 8, upper_levels: int = 4) -> str:
    """DuckDB SQL of ``op11_merkle``: trees of at most 16**levels leaves per source and
    16**upper_levels sources, written out level by level."""
    fan = merkle.FAN

    def field(x):
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"

    def leaf(text):
        return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    bit = "xor(c, CASE WHEN i % 8 = 0 THEN ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]) ELSE 0 END)"
    crc = (f"xor(list_reduce(range(8 * strlen(CAST(doc_id AS VARCHAR))), lambda c, i: CASE WHEN ({bit} & 1) = 1 "
           f"THEN xor({bit} >> 1, 3988292384) ELSE {bit} >> 1 END, 4294967295::BIGINT), 4294967295)")
    low = f"CASE WHEN {crc} % {merkle.TAMPER_EVERY} = 0 THEN translate(text, '{merkle.UPPER}', '{merkle.UPPER.lower()}') ELSE text END"
    parts = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(low)} AS tleaf FROM documents)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,"
        " count(*) OVER (PARTITION BY source) AS total FROM d)",
        "s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS m"
        " FROM (SELECT DISTINCT source FROM d))",
        "n0 AS (SELECT s.tree, p.idx, p.leaf AS digest, p.total, p.doc_id, p.source, p.tleaf"
        " FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source)",
    ]

    def level_up(prefix, k):
        return (f"{prefix}{k} AS (SELECT tree, idx // {fan} AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest,"
                f" any_value(total) AS total FROM {prefix}{k - 1} WHERE total > {fan ** (k - 1)} GROUP BY tree, idx // {fan})")

    def siblings(prefix, k):
        frame = f"PARTITION BY tree, idx // {fan} ORDER BY idx"
        return (f"{prefix}s{k} AS (SELECT tree, idx, 1 AS hit,"
                f" coalesce(array_to_string(list(digest) OVER ({frame} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), '') AS l,"
                f" coalesce(array_to_string(list(digest) OVER ({frame} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), ''), '') AS r"
                f" FROM {prefix}{k} WHERE total > {fan ** k})")

    def tops(prefix, count):
        return " UNION ALL ".join(
            f"SELECT tree, digest FROM {prefix}{k} WHERE total <= {fan ** k}" + (f" AND total > {fan ** (k - 1)}" if k else "")
            for k in range(count + 1))

    parts += [level_up("n", k) for k in range(1, levels + 1)]
    parts += [siblings("n", k) for k in range(levels)]
    parts.append(f"sub AS ({tops('n', levels)})")
    parts.append("u0 AS (SELECT 0 AS tree, sub.tree AS idx, sub.digest, (SELECT count(*) FROM sub) AS total FROM sub)")
    parts += [level_up("u", k) for k in range(1, upper_levels + 1)]
    parts += [siblings("u", k) for k in range(upper_levels)]
    parts.append(f"top AS ({tops('u', upper_levels)})")
    joins = "".join(
        f" LEFT JOIN ns{k} ON ns{k}.tree = n0.tree AND ns{k}.idx = n0.idx // {fan ** k}" for k in range(levels))
    joins += "".join(f" LEFT JOIN us{k} ON us{k}.idx = n0.tree // {fan ** k}" for k in range(upper_levels))
    hops = [f"ns{k}" for k in range(levels)] + [f"us{k}" for k in range(upper_levels)]
    cols = ", ".join(f"{h}.hit AS h{i}, {h}.l AS l{i}, {h}.r AS r{i}" for i, h in enumerate(hops))
    proof = " || ".join(f"coalesce(l{i}, '') || coalesce(r{i}, '')" for i in range(len(hops)))
    parts.append(
        f"w AS (SELECT n0.doc_id, n0.source, n0.digest AS leaf, n0.tleaf AS f0, sub.digest AS subroot, {cols},"
        f" sha256({proof}) AS proof_sha256 FROM n0 JOIN sub ON sub.tree = n0.tree{joins})")
    for i in range(len(hops)):
        keep = ", ".join(f"f{i}" if c == "f" else c for c in ["doc_id", "source", "leaf", "subroot", "proof_sha256"])
        rest = ", ".join(f"h{j}, l{j}, r{j}" for j in range(i + 1, len(hops)))
        parts.append(
            f"f{i + 1} AS (SELECT {keep}, CASE WHEN h{i} = 1 THEN sha256(l{i} || f{i} || r{i}) ELSE f{i} END AS f{i + 1}"
            f"{', ' + rest if rest else ''} FROM {'w' if i == 0 else f'f{i}'})")
    last = len(hops)
    return ("WITH " + ",\n".join(parts) +
            f"\nSELECT doc_id, source, leaf, subroot, (SELECT digest FROM top) AS root, proof_sha256,"
            f" f{last} AS folded_root, f{last} = (SELECT digest FROM top) AS verified FROM f{last}")


@query(_merkle_sql())
def op11_merkle(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"))


def _search_sql() -> str:
    fold = f"translate(coalesce(text, ''), '{search.UPPER}', '{search.UPPER.lower()}')"
    terms = f"regexp_extract_all({fold}, '{search.TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
dr AS (SELECT r, doc_id, terms, len(terms) AS n FROM d),
st AS (SELECT count(*) FILTER (WHERE n > 0) AS big_n, coalesce(sum(n), 0) AS big_l FROM dr),
q AS (SELECT item_id, unnest({terms}) AS term FROM benchmark),
qt AS (SELECT DISTINCT term FROM q),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM dr) x
       WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT qt.term, CAST(floor(1000.0 * ln((2.0 * st.big_n + 2.0) / (2.0 * coalesce(df.df, 0) + 1.0))) AS BIGINT) AS w
      FROM qt LEFT JOIN df ON df.term = qt.term, st),
sc AS (SELECT q.item_id, dr.r, any_value(dr.doc_id) AS doc_id,
              sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * dr.n * st.big_n) // st.big_l))))::BIGINT AS score
       FROM q JOIN w ON w.term = q.term JOIN tf ON tf.term = q.term JOIN dr ON dr.r = tf.r, st
       GROUP BY q.item_id, dr.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM sc WHERE score > 0) WHERE rank <= {search.TOP}"""


@query(_search_sql())
def op13_search(spark, folder):
    return search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op12_ffd(spark, folder):
    return ffd.pack(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))
