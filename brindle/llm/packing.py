"""Harmonic packing of documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class j holds lengths over capacity/(j+1), up to capacity/j, of which
exactly j go to one bin. So every bin of a class takes a fixed number of documents, and a class is filled without
looking at any other. Each worker (partition) fills its own bins, so nothing is shuffled and no state is shared.

What is packed whole: each document that fits one sequence, and the tail of each longer one. What a class bin leaves
open is filled by cutting documents that are cut anyway: a long document first gives pieces to the bins that wait, then
full sequences, then its tail. Only when many bins wait does a document that fits one sequence fill them, whole where
one has room for it, else in pieces. When a partition ends, its open bins are bounded by the number of classes times
the capacity; their documents fill the bins that still wait and are then laid end to end, cut at sequence ends, the last
such sequence at powers of two, which need no padding. The only padding is what a closed bin leaves open, a few ids.

Defined results: a null text counts as empty; an empty text is the end id alone; repeated rows are packed as often as
they stand there. sequence_id is unique over all partitions. The same input partitions give the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import END_ID, Encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"


@dataclass
class Bin:
    held: list = field(default_factory=list)  # ((document, start), length)
    used: int = 0


class HarmonicPacker:
    """Fills bins class by class. add() and finish() yield (sequence, padded_to, [((document, start), length)...]).

    slack: what a closed bin may leave open. waiting: bins that may wait for pieces. hold: makes what is kept of a
    document for one of its pieces.
    """

    def __init__(self, capacity: int = 2048, slack: int = 8, waiting: int = 64, hold: Callable = lambda document, start, length: document):
        if capacity & (capacity - 1) or capacity <= 0 or not 0 <= slack < capacity or waiting < 1:
            raise ValueError("capacity is a power of two, slack below it, waiting positive")
        self.capacity, self.slack, self.waiting, self.hold = capacity, slack, waiting, hold
        self.open: dict[int, Bin] = {}
        self.wait: list[Bin] = []
        self.next = 0

    def add(self, document, length: int) -> Iterator:
        """Pack a document of so many ids."""
        at, fits = 0, length <= self.capacity
        if not fits:
            while self.wait and length - at > self.capacity:
                at += yield from self._fill(self.wait[0], document, at, length - at)
        elif len(self.wait) >= self.waiting:
            room = [b for b in self.wait if self.capacity - b.used >= length]
            if room:
                yield from self._fill(max(room, key=lambda b: b.used), document, 0, length)
                return
            while self.wait and at < length:
                at += yield from self._fill(min(self.wait, key=lambda b: b.used), document, at, length - at)
        while length - at >= self.capacity:
            yield self._close(Bin([((self.hold(document, at, self.capacity), at), self.capacity)], self.capacity))
            at += self.capacity
        if at < length:
            yield from self._class(document, at, length - at)

    def _class(self, document, at: int, length: int) -> Iterator:
        j = self.capacity // length
        b = self.open.setdefault(j, Bin())
        self._put(b, document, at, length)
        if len(b.held) == j:
            del self.open[j]
            if self.capacity - b.used > self.slack:
                self.wait.append(b)
            else:
                yield self._close(b)

    def _put(self, b: Bin, document, at: int, length: int) -> None:
        b.held.append(((self.hold(document, at, length), at), length))
        b.used += length

    def _fill(self, b: Bin, document, at: int, left: int) -> Iterator:
        """Put what fits of a document into a waiting bin; returns how much that is."""
        take = min(left, self.capacity - b.used)
        self._put(b, document, at, take)
        if self.capacity - b.used <= self.slack:
            self.wait.remove(b)
            yield self._close(b)
        return take

    def _close(self, b: Bin):
        self.next += 1
        return self.next - 1, b.used if b.used & (b.used - 1) == 0 else self.capacity, b.held

    def finish(self) -> Iterator:
        """Fill what waits with what is open, and lay the rest end to end."""
        left = [x for j in sorted(self.open) for x in self.open[j].held]
        wait, self.open, self.wait = self.wait, {}, []
        left.reverse()

        def take(b: Bin, size: int) -> None:
            while b.used < size and left:
                (document, start), n = left.pop()
                part = min(n, size - b.used)
                b.held.append(((document, start), part))
                b.used += part
                if part < n:
                    left.append(((document, start + part), n - part))

        for i, b in enumerate(wait):
            if not left:
                # nothing is left to fill these: lay their documents end to end too
                left = [x for c in wait[i:] for x in reversed(c.held)]
                break
            take(b, self.capacity)
            if b.used < self.capacity:
                left.extend(reversed(b.held))
            else:
                yield self._close(b)
        total = sum(n for _, n in left)
        rest = total % self.capacity
        for size in [self.capacity] * (total // self.capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]:
            b = Bin()
            take(b, size)
            yield self._close(b)


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to[, ids].

    Memory of a task: the ids of open and waiting bins, under (classes + waiting) * capacity, and one batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = PIECES + (", ids array<long>" if with_ids else "")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def hold(document, start, length):
            doc_id, ids, base, total = document
            return doc_id, ids[start - base : start - base + length].copy(), start, total

        first = TaskContext.get().partitionId() << 40
        encoder, packer = Encoder(tokenizer), HarmonicPacker(capacity, hold=hold)
        rows: list[tuple] = []

        def emit(closed):
            for seq, padded, held in closed:
                at = 0
                for ((doc_id, ids, base, total), start), n in held:
                    part = ids[start - base : start - base + n]
                    row = (doc_id, start, n, zlib.crc32(part.tobytes()), total, first + seq, at, padded)
                    rows.append((*row, part.tolist()) if with_ids else row)
                    at += n

        def flush():
            cols = list(zip(*rows, strict=True)) or [[]] * len(arrow)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                emit(packer.add((doc_id, ids, 0, len(ids)), len(ids)))
                if len(rows) >= 8192:
                    yield flush()
        emit(packer.finish())
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
