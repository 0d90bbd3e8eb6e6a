"""Bounded-space online packing of documents into sequences of a fixed number of tokens.

Every task packs its own partition: it keeps a fixed number of open windows, puts a document
into the fullest one that has room for it (best fit), and if none has, emits the fullest and
opens another. Documents are cut at window length; a document that does not fit is also cut to
fill the window that is emitted, if more than ``max_gap`` tokens of it are free. What is still
open at the end of a partition is merged: the leftovers of ``merge`` partitions are laid end to
end into windows, so that one window for each such group is not full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.tables import written
from rollbook.llm.tokens import encoder
from rollbook.llm.workers import giving_back

#: Sequences of one partition are numbered from its number times this.
STRIDE = 1 << 32
#: Merged sequences are numbered from here.
MERGED = 1 << 62

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "ids binary, merge_group long"
)


@dataclass
class Window:
    """An open sequence: its pieces as (document, start, ids) and its number of tokens."""

    pieces: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    size: int = 0

    def add(self, document: int, start: int, ids: np.ndarray) -> None:
        self.pieces.append((document, start, ids))
        self.size += len(ids)


class OnlinePacker:
    """Packs one document after another; ``open`` never holds more than ``windows`` windows."""

    def __init__(self, length: int, windows: int, max_gap: int) -> None:
        self.length, self.windows, self.max_gap = length, windows, max_gap
        self.open: list[Window] = []

    def add(self, document: int, ids: np.ndarray) -> Iterator[Window]:
        """Place all ids of a document; yields the windows that are closed by it."""
        start = 0
        while len(ids) - start >= self.length:
            full = Window()
            full.add(document, start, ids[start : start + self.length])
            yield full
            start += self.length
        if start == len(ids):
            return
        rest = len(ids) - start
        fits = [w for w in self.open if self.length - w.size >= rest]
        if not fits and len(self.open) >= self.windows:
            fullest = max(self.open, key=lambda w: w.size)
            gap = self.length - fullest.size
            if gap > self.max_gap:
                fullest.add(document, start, ids[start : start + gap])
                start += gap
            self.open.remove(fullest)
            yield fullest
        if fits:
            best = max(fits, key=lambda w: w.size)
        else:
            best = Window()
            self.open.append(best)
        best.add(document, start, ids[start:])
        if best.size == self.length:
            self.open.remove(best)
            yield best


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    keeps_space: bool = True,
    length: int = 2048,
    windows: int = 16,
    max_gap: int = 16,
    merge: int = 8,
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``length`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Each row is a document of
    its own, also if its doc_id is null or repeated; its tokens are the ids of its text (null or
    empty: none) and the end id, and each lies in one piece. Returns doc_id, start, length,
    doc_tokens, sequence_id, offset (gapless from 0 in each sequence) and ids (u32,
    little-endian). An empty table gives no pieces.

    The documents stay in their partitions. Only open windows are shuffled, at most ``windows``
    of each partition, and a merging task gets those of ``merge`` partitions.
    """
    columns = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64()] * 6 + [pa.binary(), pa.int64()]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, keeps_space)
        packer = OnlinePacker(length, windows, max_gap)
        part = TaskContext.get().partitionId()
        keys: dict[int, tuple] = {}  # number of a document: its doc_id and tokens, while open
        rows: list[tuple] = []
        number = sequence = 0

        def close(window: Window, group: int | None) -> None:
            nonlocal sequence
            offset = 0
            for document, start, ids in window.pieces:
                key, tokens = keys[document]
                rows.append(
                    (key, start, len(ids), tokens, part * STRIDE + sequence, offset)
                    + (ids.astype("<u4").tobytes(), group)
                )
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            values = list(zip(*rows, strict=True)) if rows else [[]] * len(columns)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, types, strict=True)], columns
            )

        for batch in batches:
            flat, offsets = coder.encode(batch.column("text"))
            for k, key in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.append(flat[offsets[k] : offsets[k + 1]], np.uint32(end_id))
                keys[number] = key, len(ids)
                for window in packer.add(number, ids):
                    close(window, None)
                number += 1
                if len(rows) >= 4096:
                    yield flush()
            still = {d for w in packer.open for d, _, _ in w.pieces}
            keys = {d: x for d, x in keys.items() if d in still}
            yield flush()
        for window in packer.open:
            close(window, part // merge)
        yield flush()

    def lay(group: pa.Table) -> pa.Table:
        """Lay the pieces of one group's leftovers end to end."""
        group = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        base, at, out = MERGED + group.column("merge_group")[0].as_py() * STRIDE, 0, []
        for row in group.to_pylist():
            ids, done = np.frombuffer(row["ids"], "<u4"), 0
            while done < len(ids):
                take = min(len(ids) - done, length - at % length)
                piece = ids[done : done + take].tobytes()
                out.append(
                    (row["doc_id"], row["start"] + done, take, row["doc_tokens"])
                    + (base + at // length, at % length, piece, None)
                )
                done += take
                at += take
        values = zip(*out, strict=True)
        return pa.table([pa.array(v, t) for v, t in zip(values, types, strict=True)], columns)

    placed = written(docs.select("doc_id", "text").mapInArrow(giving_back(place), PIECES), "packed")
    final = placed.where(F.col("merge_group").isNull())
    merged = placed.where(F.col("merge_group").isNotNull()).groupBy("merge_group")
    return final.unionByName(merged.applyInArrow(lay, PIECES)).drop("merge_group")
