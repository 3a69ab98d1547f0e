"""Secrets in texts: fixed patterns, and values in the context of a credential that would be
costly to guess.

The cost of a value is the least number of guesses over all ways to cut it into words, dates,
repeats, keyboard walks and spans of brute force, found by dynamic programming over its positions.
Values such as ``password: changeme`` are cheap and stay out; random ones are found
whatever characters they hold.

Null texts are empty and have no spans. Spans are in code points, the end exclusive. Rows are
independent, so repeated rows give repeated results. A value has no greatest length: the cost
takes time in proportion to it.
"""
from __future__ import annotations

import base64
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from tallyloom.llm.rows import map_slices, strings, texts_of

# Fixed values of the contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # a run of 24 or more
ASSIGN_KEYS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|(?:api|access|private|auth|secret)[_-]?key)s?
        ["']?\s*(?:[:=]>?|\bis\b)\s*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>]+))
      | \bbearer\s+([A-Za-z0-9._~+/=-]+)
      | [a-z][a-z0-9+.-]*://[^\s/:@]+:([^\s/@]+)@""", re.IGNORECASE | re.ASCII | re.VERBOSE)
CONTEXT_KEYS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer ", "://")
#: Guesses from which a value counts as a secret.
GUESSES = 1e8

# Fixed values of the cost model.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]" + "\\" + ";',./")
SWAPS = str.maketrans("@4830!1$57+", "aabeoiisstt")
DATE = re.compile(r"(\d{4})[-/._]?(\d{1,2})[-/._]?(\d{1,2})|(\d{1,2})[-/._]?(\d{1,2})[-/._]?(\d{4}|\d{2})")
LONGEST_WORD, LONGEST_DATE = 24, 10
SEGMENT = math.log10(10)  # each further segment: how the cut itself must be guessed


def neighbours() -> dict[str, set[str]]:
    """Keys that touch, on rows that are each set off by half a key."""
    out: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            near = {(y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x - 1), (y + 1, x)}
            out[key] = {ROWS[b][a] for b, a in near if 0 <= b < len(ROWS) and 0 <= a < len(ROWS[b])}
    return out


TOUCHING = neighbours()


def brute(character: str) -> float:
    """log10 of the characters a brute-force guess would try in this place."""
    if character.isdigit():
        return 1.0
    if character.isalpha():
        return math.log10(26) if character.isascii() else 3.0
    return math.log10(33) if character.isascii() else 4.0


class GuessCost:
    """log10 of the guesses a value takes. ``ranks``: words, lower case, by how common they are."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    def word(self, piece: str) -> float | None:
        low = piece.lower()
        rank, extra = self.ranks.get(low), 0.0
        if rank is None:
            rank, extra = self.ranks.get(low.translate(SWAPS)), math.log10(2)
            if rank is None or low.isdigit():
                return None
        if low != piece:
            capitals = sum(a != b for a, b in zip(piece, low))
            simple = piece[1:] == low[1:] or piece.upper() == piece
            extra += math.log10(2) if simple else math.log10(2) * min(capitals, len(piece) - capitals + 1) + 1
        return math.log10(rank + 2) + extra

    @staticmethod
    def date(piece: str) -> float | None:
        found = DATE.fullmatch(piece)
        if not found:
            return None
        y, m, d, a, b, z = found.groups()
        year = int(y or z)
        year += 0 if year > 99 else 2000 if year < 50 else 1900
        pairs = [(int(m), int(d))] if y else [(int(a), int(b)), (int(b), int(a))]
        if not 1900 <= year <= 2050 or not any(1 <= m <= 12 and 1 <= d <= 31 for m, d in pairs):
            return None
        return math.log10(365 * max(abs(year - 2020), 20)) + (0 if piece.isdigit() else math.log10(4))

    def __call__(self, value: str) -> float:
        n, low = len(value), value.lower().translate(SHIFTED)
        if len(low) != n:  # a letter whose lower case is longer
            low = value
        best, raw = [0.0] + [math.inf] * n, [0.0] + [math.inf] * n  # raw: ends in brute force
        walk = turns = run = 0  # characters of the walk and the run of equals that end here
        step, same = None, {2: 0, 3: 0, 4: 0}
        for j in range(1, n + 1):
            c = brute(value[j - 1])
            raw[j] = min(raw[j - 1] + c, best[j - 1] + c + (SEGMENT if j > 1 else 0))
            options = [raw[j]]
            open_at = lambda i: best[i] + (SEGMENT if i else 0)
            for i in range(max(0, j - LONGEST_WORD), j - 2):
                cost = self.word(value[i:j])
                if cost is not None:
                    options.append(open_at(i) + cost)
            if value[j - 1].isdigit():
                for i in range(max(0, j - LONGEST_DATE), j - 3):
                    cost = self.date(value[i:j])
                    if cost is not None:
                        options.append(open_at(i) + cost)
                if j > 3 and value[j - 4:j].isdigit() and 1900 <= int(value[j - 4:j]) <= 2050:
                    options.append(open_at(j - 4) + math.log10(120))
            run = run + 1 if j > 1 and value[j - 1] == value[j - 2] else 1
            if run > 2:
                options.append(open_at(j - run) + c + math.log10(run))
            for size in (2, 3, 4):  # a block said again: pay for it once
                same[size] = same[size] + 1 if j > size and value[j - 1] == value[j - 1 - size] else 0
                if times := same[size] // size:
                    at = j - (times + 1) * size
                    block = sum(map(brute, value[j - size:j]))
                    options.append(open_at(at) + block + math.log10(times + 1))
            a, b = low[j - 2] if j > 1 else "", low[j - 1]
            delta = ord(b) - ord(a) if a else 0
            if a and (b in TOUCHING.get(a, ()) or delta in (1, -1)):
                turns += delta != step and walk > 1
                walk, step = max(walk, 1) + 1, delta
            else:
                walk, turns, step = 1, 0, None
            if walk > 2:
                options.append(open_at(j - walk) + math.log10(47 * walk) + turns * math.log10(6))
            best[j] = min(options)
        return best[n]


@lru_cache(maxsize=2)
def costs(words_path: str) -> GuessCost:
    """Words and their ranks from a public rank file: its pieces are listed by how common they are."""
    ranks: dict[str, int] = {}
    with open(words_path, "rb") as file:
        for line in file:
            piece, rank = line.split()
            word = base64.b64decode(piece).decode("utf-8", "replace").strip().lower()
            if len(word) > 2 and word.isalpha():
                ranks.setdefault(word, int(rank))
    for rank, word in enumerate(("password", "changeme", "letmein", "admin", "secret", "example", "placeholder", "redacted")):
        ranks[word] = rank
    return GuessCost(ranks)


def spans_of(text: str, cost: GuessCost, guesses: float = GUESSES) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind) by start, then kind in the order of ``KINDS``."""
    out, low = [], text.lower()
    if any(k in low for k in ASSIGN_KEYS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if any(k in low for k in CONTEXT_KEYS):
        base, least = list(out), math.log10(guesses)
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            value = m[m.lastindex].rstrip(".,;:!?)") if m.lastindex in (3, 5) else m[m.lastindex]
            end = start + len(value)
            inside = any(a <= start and end <= b for a, b, _ in base)
            if value and not inside and cost(value) >= least:
                out.append((start, end, "guess"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]], s[1]))


def secrets(
    docs: DataFrame, words_path: str, guesses: float = GUESSES, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id`` and ``found``, an array of (kind, start, end) for every row."""
    def work(part):
        cost = costs(words_path)
        return {"doc_id": part.column("doc_id"), "found": [
            [{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t, cost, guesses)]
            for t in strings(part)]}

    return map_slices(
        texts_of(docs, id_column, text_column), work,
        "doc_id long, found array<struct<kind:string,start:long,end:long>>")
