"""Sum-of-squares online packing of token documents into windows of a power-of-two length.

Each document is encoded and closed with id 0. Whole windows are cut off its front at once; what
remains goes, uncut, to the open window whose fill level makes the sum of squared counts of
partially filled windows smallest (Csirik et al., sum-of-squares for integral bin packing), kept
in an array of counts by level. When a partition ends, the windows still open are filled up: the
emptiest ones are taken apart, and their pieces, cut where needed, fill the others, which keep what was
placed in them; the last rest is split into powers of two, which need no padding.

Each input partition is packed on its own: no shuffle, and a task's result depends on its own rows
only, so a task that is run again after a lost executor gives whole, consistent sequences. Memory
is bounded by ``max_open`` windows: beyond that, the windows of the most crowded level (which weighs most in
the sum of squares) are filled up from each other in the same way, and the others stay as they are.

Defined cases: null and empty texts are documents of one id (the closing 0); equal rows are packed
each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from codeweave.llm.bpe import codec
from codeweave.llm.common import batch_of, task

WINDOW = 1024

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
    ]
)
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """The open windows by fill level, and the pieces that are placed for good.

    A piece is (doc_id, start, ids as bytes, doc_tokens).
    """

    def __init__(self, window: int, first_id: int, max_open: int = 4096):
        if window & (window - 1) or window < 2:
            raise ValueError("window must be a power of two")
        self.window, self.next_id, self.max_open = window, first_id, max(max_open, window)  # a level each, at least
        self.counts = np.zeros(window + 1, np.int64)  # windows by level
        self.at: list[list[list]] = [[] for _ in range(window)]  # their pieces
        self.n_open = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset, seq = 0, self.next_id
        self.next_id += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, seq, offset, ids))
            offset += n

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        whole = len(ids) - len(ids) % step
        for i in range(0, whole, step):
            self._close([(doc, i // 4, ids[i : i + step], total)])
        if whole < len(ids):
            self._place((doc, whole // 4, ids[whole:], total))

    def _place(self, piece: tuple) -> None:
        size, window, counts = len(piece[2]) // 4, self.window, self.counts
        # growth of the sum of squares: level h -> h + size is 2 (N[h+size] - N[h]) + 2; a full window leaves the sum
        best, growth = 0, 2 * counts[size] + 1
        levels = np.flatnonzero(counts[1 : window - size + 1]) + 1
        if len(levels):
            change = 2 * (counts[levels + size] - counts[levels]) + 2
            if levels[-1] == window - size:
                change[-1] = 1 - 2 * counts[levels[-1]]
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest
            if change[k] <= growth:
                best = int(levels[k])
        if best:
            pieces = self.at[best].pop()
            counts[best] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if best + size == window:
            self._close(pieces)
        else:
            self.at[best + size].append(pieces)
            counts[best + size] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                self._relieve()

    def _fill(self, windows: list[list]) -> tuple[list, int]:
        """Closes all of ``windows`` (fullest first) but one, filled with pieces of the last ones; the pieces of that one and their size."""
        levels = [sum(len(p[2]) for p in pieces) // 4 for pieces in windows]
        i, j = 0, len(windows) - 1
        while i < j:
            doc, start, ids, total = windows[j].pop()
            room = 4 * (self.window - levels[i])
            windows[i].append((doc, start, ids[:room], total))
            if len(ids) > room:
                windows[j].append((doc, start + room // 4, ids[room:], total))
            moved = min(room, len(ids)) // 4
            levels[i] += moved
            levels[j] -= moved
            if levels[i] == self.window:
                self._close(windows[i])
                i += 1
            if not levels[j]:
                j -= 1
        return (windows[i], levels[i]) if i == j else ([], 0)

    def _relieve(self) -> None:
        """Fills the windows of the most crowded level from each other; what is left of them stays open."""
        level = int(np.argmax(self.counts))
        crowd, self.at[level] = self.at[level], []
        self.n_open -= len(crowd)
        self.counts[level] = 0
        pieces, size = self._fill(crowd)
        if size == self.window:
            self._close(pieces)
        elif size:
            self.at[size].append(pieces)
            self.counts[size] += 1
            self.n_open += 1

    def finish(self) -> None:
        """Fills the open windows up; nothing is padded."""
        pieces, left = self._fill([pieces for level in reversed(self.at) for pieces in level])
        self.at = [[] for _ in range(self.window)]
        self.counts[:] = 0
        self.n_open = 0
        while left:  # the last window, in powers of two
            room, current = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, total = pieces.pop(0)
                current.append((doc, start, ids[: 4 * room], total))
                if len(ids) > 4 * room:
                    pieces.insert(0, (doc, start + room, ids[4 * room :], total))
                room -= len(current[-1][2]) // 4
            self._close(current)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = True, max_open: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids as bytes."""

    @task("bpe")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 36, max_open)

        def flush():
            rows = packer.take()
            for i in range(0, len(rows), 20_000):
                columns = list(zip(*rows[i : i + 20_000]))
                yield batch_of(PIECES, *columns[:-1], columns[-1] if with_ids else [None] * len(columns[0]))

        for b in batches:
            for doc_ids, _, rows in c.encoded(b):
                for doc, ids in zip(doc_ids.to_pylist(), rows):
                    packer.add(doc, ids.tobytes() + b"\0\0\0\0")
                yield from flush()
        packer.finish()
        yield from flush()

    out = docs.select("doc_id", "text").mapInArrow(work, PIECES_DDL)
    return out if with_ids else out.drop("ids")
