"""Replace personal data by surrogates.

A surrogate is made from a keyed hash of the entity, so the same entity has the same surrogate in all
documents, and nobody without the key can find the entity by trying. It keeps the type, the
script, the letter case, the punctuation and the number of digits; a card number that passes the Luhn
test stays one that does; given names keep the gender that their title tells. Parts of names and
domains of mail addresses are entities of their own, so other mentions of a person agree.

Two entities must not get one surrogate, nor an entity's surrogate be another real entity. All
distinct entities of the corpus are checked for that by Spark; the few that collide take their next
candidate. Null texts stay null and have no entities. Rows are independent but for these checks.
"""
from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyloom.llm.rows import arrow_schema, map_slices, slices, strings, unused
from tallyloom.operators.staging import stage

#: For tests and samples; give a secret key of your own in production.
KEY = b"replace this key"

# How entities are recognised, in order of precedence.
KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b"),
    "card": re.compile(r"(?<!\d)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{13,19})(?!\d)"),
    "ip": re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": re.compile(
        r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
        r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\d-])"),
}
MALE_TITLES = ("Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "господин", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "г-жа")
OTHER_TITLES = ("Dr", "Prof", "Professor")
TITLE = re.compile(
    r"\b(" + "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=len, reverse=True))
    + r")\.? ([A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*\w)(?: ([A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*\w))?")
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Nils Oscar Paul".split(),
    ("latin", "f"): "Ada Berta Clara Diana Elsa Flora Greta Helen Ida Julia Karin Laura Maria Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Кирилл Лев Максим Олег".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга".split(),
}
SYLLABLES = {
    "latin": "ba bel bor dan del dor fal fen gar gol han hol jen kal ker lan lem lor mar mel mor nar nel "
             "nor pal per ral ren rol sal sen sol tal ten tor val ven vol wen zan zel".split(),
    "cyrillic": "ба бел вал вер гор дан дол жар зел кал кор лан лев мал мир нев пал пет род сав сол тар фед чер".split(),
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя"}


def script_of(text: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in text) else "latin"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def canonical(kind: str, text: str) -> str:
    """What mentions of one entity have in common."""
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    return text.casefold()


def domain_of(address: str) -> str:
    return address.rpartition("@")[2]


def entities(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) that do not overlap, by start. Kinds of name parts are
    ``given-m``, ``given-f`` and ``surname``."""
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= a or b <= start for a, b, _ in found):
            found.append((start, end, kind))

    has_digit = re.search(r"\d", text)
    for kind, pattern in KINDS.items():
        if "@" not in text if kind == "email" else not has_digit:
            continue
        for m in pattern.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 7 <= digits <= 15:
                continue
            add(*m.span(), kind)
    names: dict[str, str] = {}
    for m in TITLE.finditer(text):
        if m[3]:
            gender = "m" if m[1] in MALE_TITLES else "f" if m[1] in FEMALE_TITLES else _gender(m[2])
            names.setdefault(m[2], f"given-{gender}")
        names[m[3] or m[2]] = "surname"
    if names:  # other mentions of the same person, with or without the title
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b", text):
            add(*m.span(), names[m[0]])
    return sorted(found)


def _gender(given: str) -> str:
    """Where no title tells: as most given names of the two scripts end."""
    return "f" if given[-1] in "aeая" else "m"


class Surrogates:
    def __init__(self, key: bytes = KEY):
        self.key = hashlib.sha256(key).digest()

    def numbers(self, kind: str, value: str, attempt: int) -> Callable[[int], int]:
        """A keyed stream of numbers below a bound."""
        seed, state = f"{kind}\0{value}\0{attempt}".encode(), [b"", 0]

        def below(bound: int) -> int:
            if len(state[0]) < 8:
                state[0] += hashlib.blake2b(seed + b"\0%d" % state[1], key=self.key).digest()
                state[1] += 1
            number, state[0] = int.from_bytes(state[0][:8], "big"), state[0][8:]
            return number % bound

        return below

    def shaped(self, text: str, below: Callable[[int], int], keep: int = 0) -> str:
        """Letters for letters of the same script and case, digits for digits, from ``keep`` on."""
        out = []
        for i, c in enumerate(text):
            if i < keep or not c.isalnum():
                out.append(c)
            elif c.isdigit():
                out.append(str(below(10)))
            else:
                letters = LETTERS[script_of(c)]
                made = letters[below(len(letters))]
                out.append(made.upper() if c.isupper() else made)
        return "".join(out)

    @staticmethod
    def longer(made: str, below: Callable[[int], int], attempt: int) -> str:
        """Letters set later attempts apart where few short candidates are left."""
        return made + "".join(LETTERS["latin"][below(26)] for _ in range(attempt // 4))

    def of(self, kind: str, value: str, attempt: int = 0, domain: int = 0) -> str:
        """The surrogate of an entity in its canonical form, in canonical form too. ``domain`` is
        the attempt of a mail address' domain."""
        below = self.numbers(kind, value, attempt)
        if kind == "email":
            local, _, host = value.partition("@")
            # the domain is an entity of its own: addresses of one domain stay so
            return f"{self.longer(self.shaped(local, below), below, attempt)}@{self.of('domain', host, domain)}"
        if kind == "domain":
            host, _, top = value.rpartition(".")
            return f"{self.longer(self.shaped(host, below), below, attempt)}.{top}"
        if kind == "ip":
            if ipaddress.ip_address(".".join(str(int(p)) for p in value.split("."))).is_private:
                return f"10.{below(256)}.{below(256)}.{1 + below(254)}"
            return f"{11 + below(89)}.{below(256)}.{below(256)}.{1 + below(254)}"
        if kind.startswith("given"):
            names = GIVEN[script_of(value), kind[-1]]
            made = names[below(len(names))]
            if attempt:  # the list is short: a second part sets later ones apart
                made += "-" + self.surname(script_of(value), below, attempt)
            return made.casefold()
        if kind == "surname":
            return self.surname(script_of(value), below, 3 + attempt // 4).casefold()
        if kind == "card":
            digits = str(1 + below(9)) + self.shaped(value[1:], below)
            if luhn(value):
                digits = next(d for d in (digits[:-1] + c for c in "0123456789") if luhn(d))
            return digits
        return self.shaped(value, below, keep=2 if kind == "iban" else 0)

    @staticmethod
    def surname(script: str, below: Callable[[int], int], count: int) -> str:
        syllables = SYLLABLES[script]
        return "".join(syllables[below(len(syllables))] for _ in range(count)).capitalize()

    def as_in(self, text: str, kind: str, attempt: int = 0, domain: int = 0) -> str:
        """The surrogate in the form of this mention."""
        made = self.of(kind, canonical(kind, text), attempt, domain)
        if kind in ("card", "ssn", "phone", "iban"):
            rest = iter(made)
            return "".join(next(rest) if c.isalnum() and (kind == "iban" or c.isdigit()) else c for c in text)
        if kind.startswith(("given", "surname")):
            return made.upper() if text.isupper() and len(text) > 1 else "-".join(p.capitalize() for p in made.split("-"))
        if kind == "email":
            return "".join(m.upper() if c.isupper() else m for c, m in zip(text, made)) if len(made) == len(text) else made
        return made


def mentions(docs: DataFrame) -> DataFrame:
    """``_row``, ``kind`` and ``value`` of the distinct entities of each row (``_row``, ``text``);
    the domains of mail addresses are among them."""
    schema = "_row long, kind string, value string"
    arrow = arrow_schema(schema)

    def run(batches):
        for part in slices(batches):
            rows = []
            for row, text in zip(part.column("_row").to_pylist(), strings(part)):
                own = {(k, canonical(k, text[a:b])) for a, b, k in entities(text)}
                own |= {("domain", domain_of(value)) for k, value in own if k == "email"}
                rows += [(row, *pair) for pair in sorted(own)]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*rows))), schema=arrow)

    return docs.mapInArrow(run, schema)


def collisions(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """Entities (``kind``, ``value``) of all kinds that need a later ``attempt`` than 0, so that no
    two have one surrogate and no surrogate is an entity. Given names and surnames are one space:
    none of them gets the surrogate, or is the surrogate, of another. Mail addresses are settled
    after the domains they are made with."""
    real = stage(found.select("kind", "value").distinct())
    late = _late(real.where("kind <> 'email'").withColumn("domain", F.lit(0)), key)
    domains = late.where("kind = 'domain'").select(F.col("value").alias("_host"), F.col("attempt").alias("domain"))
    mails = real.where("kind = 'email'").withColumn("_host", F.substring_index("value", "@", -1))
    mails = mails.join(domains, "_host", "left").select("kind", "value", F.coalesce("domain", F.lit(0)).alias("domain"))
    return late.unionByName(_late(mails, key))


def _late(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``value`` and ``attempt`` of the entities (``kind``, ``value``, ``domain``) that can't
    have their first candidate."""
    schema = "space string, kind string, value string, domain int, attempt int, made string"
    name = F.col("kind").startswith("given") | (F.col("kind") == "surname")
    real = stage(entities.withColumn("space", F.when(name, "name").otherwise(F.col("kind"))))

    def make(rows: DataFrame) -> DataFrame:
        def work(part):
            own = Surrogates(key)
            kept = {c: part.column(c).to_pylist() for c in ("space", "kind", "value", "domain", "attempt")}
            return kept | {"made": [own.of(*x) for x in zip(
                kept["kind"], kept["value"], kept["attempt"], kept["domain"])]}

        return map_slices(rows, work, schema, 8192)

    now = stage(make(real.withColumn("attempt", F.lit(0))))
    taken = real.select("space", F.col("value").alias("made"), F.lit(True).alias("real")).distinct()
    while True:
        own = F.struct("kind", "value")
        first = now.groupBy("space", "made").agg(F.min(own).alias("first"), F.count("*").alias("n"))
        held = now.join(first.where("n > 1").drop("n"), ["space", "made"], "left").join(taken, ["space", "made"], "left")
        again = stage(held.where(F.col("real") | (own != F.col("first"))).select(
            "space", "kind", "value", "domain", "attempt"))
        if again.isEmpty():
            return now.where("attempt > 0").select("kind", "value", "attempt")
        later = make(again.withColumn("attempt", F.col("attempt") + 1))
        now = stage(now.join(again, ["kind", "value"], "left_anti").unionByName(later))


def pseudonymized(docs: DataFrame, key: bytes = KEY, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and ``entities``: kind, start and end in the old text. A
    column of that name is replaced."""
    row, late_name = unused(docs, "_row"), unused(docs, "_late")
    keyed = docs.drop("entities").withColumn(
        row, F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")))
    found = stage(mentions(keyed.select(
        F.col(row).alias("_row"), F.col(f"`{text_column}`").alias("text"))).distinct())
    late = stage(collisions(found, key))
    own = found.join(late, ["kind", "value"]).groupBy(F.col("_row").alias(row)).agg(
        F.collect_list(F.struct("kind", "value", "attempt")).alias(late_name))
    # written, so that the size of its files decides how it is joined
    joined = keyed.join(stage(own), row, "left")
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    kept = [f for f in keyed.schema.fields if f.name != row]
    schema = StructType([*kept, StructField("entities", ArrayType(span))])
    arrow = arrow_schema(schema)

    def run(batches):
        own_key = Surrogates(key)
        for part in slices(batches):
            texts, spans = [], []
            for text, late_ones in zip(part.column(text_column).to_pylist(), part.column(late_name).to_pylist()):
                found = entities(text) if text else []
                attempts = {(x["kind"], x["value"]): x["attempt"] for x in late_ones or []}
                out, at = [], 0
                for a, b, kind in found:
                    old = text[a:b]
                    value = canonical(kind, old)
                    domain = attempts.get(("domain", domain_of(value)), 0) if kind == "email" else 0
                    out += [text[at:a], own_key.as_in(old, kind, attempts.get((kind, value), 0), domain)]
                    at = b
                texts.append("".join([*out, text[at:]]) if found else text)
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
            yield pa.RecordBatch.from_arrays([
                *(pa.array(texts, pa.string()) if f.name == text_column else part.column(f.name) for f in kept),
                pa.array(spans, arrow.field("entities").type)], schema=arrow)

    return joined.mapInArrow(run, schema)
