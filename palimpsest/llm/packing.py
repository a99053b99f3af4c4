"""Packing documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .tokens import Encoder

WINDOW, END_ID, TEXTS = 2048, 1, 1500
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Online packing of one stream of documents.

    ``levels[f]`` holds the windows filled to f ids and ``count[f]`` their
    number.  A document's last part (all before it are whole windows) goes to
    the level that leaves the sum of squares of ``count`` over 0 < f < window
    least; of equal levels the fullest.  What is open at the end is poured
    together, cutting documents, so that at most one window is not full; that one
    is split into sequences whose lengths are powers of two.  No padding is left.

    However many windows are open, the rule stays the same.  They hold their ids,
    so memory is at most what the stream's documents take; under this rule open windows
    grow with the square root of the documents, unless sizes are such
    that no two fit together (all above half a window).
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.levels: dict[int, list[int]] = {}
        self.parts: dict[int, list[tuple]] = {}  # of each open window: (doc, start, bytes, doc_tokens)
        self.rows: list[tuple] = []
        self.sequences = 0

    def _new(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _put(self, sequence: int, offset: int, part: tuple) -> None:
        doc, start, ids, total = part
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

    def add(self, doc: int | None, ids: bytes) -> None:
        """Place a document, given as little-endian unsigned 32-bit ids."""
        n, w = len(ids) // 4, self.window
        whole = n - n % w
        for a in range(0, whole, w):
            self._put(self._new(), 0, (doc, a, ids[a * 4 : (a + w) * 4], n))
        if whole == n:
            return
        size, c = n - whole, self.count
        # Of moving a window from level f to f + size; level 0 opens one, level w closes one.
        rise = 2 * c[size : w + 1] + 1
        rise[-1] = 0
        fall = 2 * c[: w - size + 1] - 1
        fall[0] = 0
        cost = np.where(c[: w - size + 1] > 0, rise - fall, np.iinfo(np.int64).max)
        cost[0] = rise[0]
        level = len(cost) - 1 - int(cost[::-1].argmin())
        if level:
            window = self.levels[level].pop()
            c[level] -= 1
        else:
            window = self._new()
            self.parts[window] = []
        self.parts[window].append((doc, whole, ids[whole * 4 :], n))
        if level + size == w:
            self._close(window)
        else:
            self.levels.setdefault(level + size, []).append(window)
            c[level + size] += 1

    def _close(self, window: int) -> None:
        offset = 0
        for part in self.parts.pop(window):
            self._put(window, offset, part)
            offset += len(part[2]) // 4

    def finish(self) -> None:
        """Pour the open windows together: the emptiest fill up the fullest."""
        order = [x for f in sorted(self.levels, reverse=True) for x in self.levels[f]]
        fill = {x: f for f, xs in self.levels.items() for x in xs}
        self.levels, self.count[:] = {}, 0
        while len(order) > 1:
            into, gap = order[0], self.window - fill[order[0]]
            last = order[-1]
            doc, start, ids, total = self.parts[last].pop()
            take = min(gap, len(ids) // 4)
            kept = len(ids) // 4 - take  # its end goes
            self.parts[into].append((doc, start + kept, ids[kept * 4 :], total))
            fill[into] += take
            fill[last] -= take
            if kept:
                self.parts[last].append((doc, start, ids[: kept * 4], total))
            if not fill[last]:
                self.parts.pop(order.pop())
            if fill[into] == self.window:
                self._close(order.pop(0))
        for window in order:
            parts, left = self.parts.pop(window), fill[window]
            while left:
                size = 1 << (left.bit_length() - 1)
                left -= size
                sequence, offset = (window if size == 1 << (fill[window].bit_length() - 1) else self._new()), 0
                while offset < size:
                    doc, start, ids, total = parts.pop(0)
                    take = min(size - offset, len(ids) // 4)
                    self._put(sequence, offset, (doc, start, ids[: take * 4], total))
                    offset += take
                    if take < len(ids) // 4:
                        parts.insert(0, (doc, start + take, ids[take * 4 :], total))

    def take_rows(self) -> list[tuple]:
        """Rows of the pieces placed in closed windows so far."""
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Pieces (see PIECES) of all documents, packed into windows of ``window`` ids.

    A document is the ids of its whole text, by the word-end vocabulary at
    ``path``, and ``end_id``; a null or empty text is the end id alone.  Each
    partition of the input packs its own stream, in its own order, with its
    own level array, so nothing is shuffled and the state is bounded by
    the partition's documents.  A sequence_id is the partition's number, shifted by 40
    bits, plus the sequence's number in it.  Repeated rows are packed each;
    an empty table gives no rows; only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(path, "words"), Packer(window)
        base, end = TaskContext.get().partitionId() << 40, np.array([end_id], "<u4").tobytes()

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.take_rows(), strict=True)) or [[]] * 7
            columns[5] = np.array(columns[5], np.int64) + base
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for a in range(0, b.num_rows, TEXTS):
                part = b.slice(a, TEXTS)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    packer.add(doc, ids + end)
                give_back()
                yield out()
        packer.finish()
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
