"""Pack documents into sequences by bounded-space online best fit.

Each task packs the documents it reads. It keeps a fixed number of open sequences in a bit set keyed
by free space: the lowest set bit at or above a piece's length is the best fit, and when no open
sequence fits and all places are taken the fullest closes. What is still open at a task's end (a
bounded number) goes to a second round, where the open sequences of some dozens of tasks meet.

Null texts are empty and take one place, the end mark. Repeated rows are packed one by one; a null
id is kept. Texts longer than a sequence are cut into full pieces, the last may be shorter.
"""
from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.ffd import encoder
from tallyloom.llm.rows import arrow_schema, slices, texts_of
from tallyloom.operators.staging import stage

LENGTH = 4096
#: Open sequences of a task.
OPEN = 1024
#: Pieces that a task orders by length, longest first, before it places them.
AHEAD = 4096
#: Tasks whose open sequences meet in the second round.
TOGETHER = 32
#: Rows encoded at a time.
SLICE = 4096
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long"


class BestFit:
    """Bounded-space online best fit over lengths up to ``length``."""

    def __init__(self, length: int = LENGTH, open_sequences: int = OPEN, first_id: int = 0, step: int = 1):
        self.length, self.most, self.next_id, self.step = length, open_sequences, first_id, step
        self.bits, self.count, self.by_free = 0, 0, defaultdict(list)

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece of 1 to ``self.length`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            sequence, free = self.next_id, self.length
            self.next_id += self.step
        left = free - length
        if left:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.count += 1
        return sequence, self.length - free

    def still_open(self) -> set[int]:
        return {s for found in self.by_free.values() for s in found}


def pack(
    docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, open_sequences: int = OPEN,
    ahead: int = AHEAD, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Every piece with its place: the columns of ``PLACED``."""
    schema = PLACED + ", _open boolean, _task int"
    arrow, end = arrow_schema(schema), end_id.to_bytes(4, "little")

    def run(batches):
        words, task = encoder(path), TaskContext.get().partitionId()
        fit, waiting, placed = BestFit(length, open_sequences, task << 32), [], defaultdict(list)

        def settle():
            for piece in sorted(waiting, key=lambda p: -p[3]):
                sequence, offset = fit.place(piece[3])
                placed[sequence].append((*piece, sequence, offset))
            waiting.clear()
            open_now = fit.still_open()
            done = [s for s in placed if s not in open_now]
            return batch([p for s in done for p in placed.pop(s)], False)

        def batch(pieces, is_open):
            columns = list(zip(*pieces)) or [()] * 7
            names = [f.name for f in arrow]
            full = [*columns, [is_open] * len(pieces), [task] * len(pieces)]
            return pa.RecordBatch.from_pydict(dict(zip(names, full)), schema=arrow)

        for part in slices(batches, SLICE):
            ids, offsets = words.encode(part.column("text"))
            raw, offsets = ids.astype("<u4", copy=False).tobytes(), offsets.tolist()
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), offsets, offsets[1:]):
                total = b - a + 1
                for k, at in enumerate(range(0, total, length)):
                    upto = min(at + length, total)
                    crc = zlib.crc32(raw[4 * (a + at):4 * (a + min(upto, b - a))])
                    crc = zlib.crc32(end, crc) if upto == total else crc
                    waiting.append((doc_id, k, at, upto - at, crc))
                if len(waiting) >= ahead:
                    yield settle()
        yield settle()
        yield batch([p for found in placed.values() for p in found], True)

    first = stage(texts_of(docs, id_column, text_column).mapInArrow(run, schema))
    return _settled(first, length, open_sequences)


def _settled(first: DataFrame, length: int, open_sequences: int) -> DataFrame:
    """The second round: sequences still open at the end of a task are packed anew, longest piece
    first, ``TOGETHER`` tasks at a time. Each such group is bounded by the open sequences."""
    names = [c.split()[0] for c in PLACED.split(", ")]
    arrow = arrow_schema(PLACED)

    def again(table: pa.Table) -> pa.Table:
        pieces = table.sort_by([("length", "descending"), ("doc_id", "ascending"),
                                ("piece", "ascending")])
        group = pieces.column("_group")[0].as_py()
        fit = BestFit(length, open_sequences * TOGETHER, -(group << 32) - 1, -1)
        places = [fit.place(n) for n in pieces.column("length").to_pylist()]
        columns = {n: pieces.column(n) for n in names[:5]}
        return pa.table(columns | {"sequence_id": [s for s, _ in places],
                                   "offset": [o for _, o in places]}, schema=arrow)

    groups = first.where("_open").withColumn("_group", F.floor(F.col("_task") / TOGETHER).cast("long"))
    return first.where("NOT _open").select(*names).unionByName(
        groups.select(*names, "_group").groupBy("_group").applyInArrow(again, PLACED))
