"""Sum-of-squares packing of token sequences into windows of fixed size.

Documents come one by one. Full windows of a long document stand by themselves; its rest is placed
into the fill level that makes the sum of the squared counts of partly filled windows least, as
tracked in an array of counts by level. What is still open at the end of a partition is closed by
cutting: the emptiest windows fill up the fullest, and the last rest is cut at powers of two. While
more windows are open than memory is set aside for, the fullest one is closed so.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintype.llm.byte_bpe import PieceEncoder
from tintype.llm.shared import give_back_memory, slices

WINDOW = 1024

#: Windows open at once (4 kB each). For each one more, the fullest is filled up from the emptiest; the others go on by the rule.
MOST_OPEN = 4096


class Packer:
    """Online packer of one partition. ``rows`` collects (doc, start, length, crc, doc_tokens, sequence, offset, ids)."""

    def __init__(self, first_sequence: int = 0, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open, self.next = window, most_open, first_sequence
        self.count = np.zeros(window + 1, dtype=np.int64)  # open windows by fill level
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset, ids))
            offset += n
        self.next += 1

    def level_for(self, size: int) -> int:
        """The level (0: a new window) to which ``size`` is added with the least growth of the sum of squares; the fullest of equals."""
        n, top = self.count, self.window - size
        gain = 1 - 2 * n[: top + 1]
        gain[0] = 0
        gain += 2 * n[size:] + 1
        gain[top] -= 2 * n[self.window] + 1  # a full window is no longer counted
        gain[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(gain[::-1]))

    def add(self, doc, ids: bytes) -> None:
        """Places one document, its ids as little-endian unsigned 32-bit bytes."""
        total, width = len(ids) // 4, self.window
        whole = total - total % width
        for start in range(0, whole, width):
            self._emit([(doc, start, ids[4 * start : 4 * (start + width)], total)])
        if size := total - whole:
            level = self.level_for(size)
            pieces = []
            if level:
                self.count[level] -= 1
                pieces = self.open[level].pop()
            pieces.append((doc, whole, ids[4 * whole :], total))
            if level + size == width:
                self._emit(pieces)
            else:
                self.count[level + size] += 1
                self.open[level + size].append(pieces)
                if self.count.sum() > self.most_open:
                    self._close_fullest()

    def _close_fullest(self) -> None:
        """Fills the fullest open window with pieces cut from the emptiest ones."""
        level = int(np.flatnonzero(self.count)[-1])
        self.count[level] -= 1
        pieces = self.open[level].pop()
        while (need := self.window - level) and self.count.any():
            low = int(np.flatnonzero(self.count)[0])
            self.count[low] -= 1
            donor, taken = self.open[low].pop(), 0
            while donor and taken < need:
                doc, start, ids, total = donor.pop()
                take = min(len(ids) // 4, need - taken)
                pieces.append((doc, start, ids[: 4 * take], total))
                if take < len(ids) // 4:
                    donor.append((doc, start + take, ids[4 * take :], total))
                taken += take
            level += taken
            if donor:
                self.count[low - taken] += 1
                self.open[low - taken].append(donor)
        if level == self.window:
            self._emit(pieces)
        else:  # it was the only one
            self.count[level] += 1
            self.open[level].append(pieces)

    def close(self) -> None:
        """Closes open windows by cutting, emptiest into fullest; the last rest is cut at powers of two."""
        left = [w for level in self.open[::-1] for w in level]
        self.count[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        i, j, donor = 0, len(left) - 1, []
        while i <= j:
            pieces, i = left[i], i + 1
            fill = sum(len(p[2]) // 4 for p in pieces)
            while fill < self.window and (donor or i <= j):
                if not donor:
                    donor, j = left[j][::-1], j - 1
                doc, start, ids, total = donor.pop()
                take = min(len(ids) // 4, self.window - fill)
                pieces.append((doc, start, ids[: 4 * take], total))
                if take < len(ids) // 4:
                    donor.append((doc, start + take, ids[4 * take :], total))
                fill += take
            if fill == self.window:
                self._emit(pieces)
            else:
                donor = pieces[::-1]
        rest = donor[::-1]
        fill = sum(len(p[2]) // 4 for p in rest)
        for size in (1 << k for k in reversed(range(fill.bit_length()))):
            if not fill & size:
                continue
            pieces, need = [], size
            while need:
                doc, start, ids, total = rest.pop(0)
                take = min(len(ids) // 4, need)
                pieces.append((doc, start, ids[: 4 * take], total))
                if take < len(ids) // 4:
                    rest.insert(0, (doc, start + take, ids[4 * take :], total))
                need -= take
            self._emit(pieces)


def pack_documents(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if ``with_ids``.

    Every partition packs its own documents and nothing is shuffled; sequence ids carry the
    partition's number. ``tokenizer`` is a tokenizers file as text; ``end_id`` follows each
    document's ids. Null and empty texts are documents of that id alone; repeated rows are packed
    each; null ids are kept; an empty table has no sequences; other columns are ignored. A very long
    text fills windows of its own but for its rest; equally good levels give the fullest.
    """
    rows = docs.select(docs[id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kind = rows.schema[0].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceEncoder(shared.value)
        packer = Packer(TaskContext.get().partitionId() << 36)
        end = np.array([end_id], "<u4").tobytes()
        first = pa.int64()

        def done() -> pa.RecordBatch:
            doc, *rest, ids = zip(*packer.rows, strict=True) if packer.rows else ([],) * 8
            packer.rows = []
            columns = [pa.array(doc, first), *(pa.array(c, pa.int64()) for c in rest)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in slices(batches, 1):
            first = b.schema.field(0).type
            for doc, ids in zip(b.column(0).to_pylist(), own.encode_column(b.column(1)), strict=True):
                packer.add(doc, ids.tobytes() + end)
            yield done()
        packer.close()
        yield done()
        own = packer = b = ids = None
        give_back_memory()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    return rows.mapInArrow(pack, f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} bigint" for n in names[1:7]) + ", ids array<int>" * with_ids)
