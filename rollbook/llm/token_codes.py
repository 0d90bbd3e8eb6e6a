"""Token ids in directly addressable codes, written as segments and read by position.

An id is split into chunks of fixed widths, lowest bits first. Level 0 holds the first chunk of
every id, level 1 the second chunk of those ids that go on, and so forth; one bit for each entry
of a level tells whether its id goes on. The place of an id's next chunk is the number of such
bits before it, which a directory of running counts gives by one look and a count of at most
``BLOCK`` bits. So any id is read without decoding the ids before it.

Segment format (little-endian): the four bytes ``DAC1``; the numbers of documents, ids and
levels (u32 each); the width of each level (u32); doc ids (i64 each; null: 0) and a bit for each
that tells whether it is null; end of each document (u32 each); then for each level the number of its entries (u32), its chunks and its bits, packed and
filled up to whole bytes, and its directory (u32 each). The last level has no bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.tables import range_bounds, range_of, shuffle_partitions, written
from rollbook.llm.tokens import encoder

MAGIC = b"DAC1"
#: Bits that one entry of a rank directory covers.
BLOCK = 512
#: Chunk widths; they hold 32-bit ids.
WIDTHS = (10, 6, 16)
#: Ids after which a segment ends with the document at hand.
SEGMENT_IDS = 1 << 19

_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)
SEGMENTS = (
    "bucket int, segment int, first_token long, n_docs long, n_tokens long, payload binary"
)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` one after another in ``width`` bits each, high bit first."""
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((values[:, None] >> shifts) & np.uint32(1)).astype(np.uint8))


def unpack_bits(data: np.ndarray, width: int, first: int, count: int) -> np.ndarray:
    """``count`` values from number ``first`` on."""
    begin, end = first * width, (first + count) * width
    bits = np.unpackbits(data[begin // 8 : (end + 7) // 8])[begin % 8 :][: end - begin]
    weights = np.left_shift(np.uint32(1), np.arange(width - 1, -1, -1, dtype=np.uint32))
    return bits.reshape(count, width) @ weights if count else np.zeros(0, np.uint32)


def encode_segment(
    doc_ids: np.ndarray,
    ends: np.ndarray,
    ids: np.ndarray,
    widths: tuple[int, ...] = WIDTHS,
    no_doc_id: np.ndarray | None = None,
) -> bytes:
    """A segment of the documents whose ids end at ``ends``; ids must fit the widths' sum.

    ``no_doc_id`` tells which documents have no doc_id; by default all have one.
    """
    none = np.zeros(len(doc_ids), bool) if no_doc_id is None else no_doc_id
    if len(ids) and int(ids.max()) >> sum(widths):
        raise ValueError("An id has more bits than the chunk widths hold.")
    parts = [
        MAGIC,
        np.array([len(doc_ids), len(ids), len(widths), *widths], "<u4").tobytes(),
        np.where(none, 0, np.asarray(doc_ids, "<i8")).astype("<i8").tobytes(),
        np.packbits(none).tobytes(),
        np.asarray(ends, "<u4").tobytes(),
    ]
    rest = ids.astype(np.uint32)
    for level, width in enumerate(widths):
        parts.append(np.array([len(rest)], "<u4").tobytes())
        parts.append(pack_bits(rest & np.uint32((1 << width) - 1), width).tobytes())
        if level + 1 < len(widths):
            rest = rest >> np.uint32(width)
            on = rest > 0
            bits = np.packbits(on)
            filled = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)))
            counts = _ONES[filled].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
            parts.append(bits.tobytes())
            parts.append(np.concatenate(([0], np.cumsum(counts))).astype("<u4").tobytes())
            rest = rest[on]
    return b"".join(parts)


class Segment:
    """Reads ids of one segment by position."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("This is no segment of directly addressable codes.")
        self._payload, self._at = payload, 4
        docs, self.size, levels = self._numbers("<u4", 3).tolist()
        self.widths = self._numbers("<u4", levels).tolist()
        self.doc_ids = self._numbers("<i8", docs)
        self.no_doc_id = np.unpackbits(self._numbers("u1", -(-docs // 8)))[:docs].astype(bool)
        self.ends = self._numbers("<u4", docs).astype(np.int64)
        self.levels = []
        for level, width in enumerate(self.widths):
            count = int(self._numbers("<u4", 1)[0])
            chunks = self._numbers("u1", -(-count * width // 8))
            bits = directory = None
            if level + 1 < levels:
                bits = self._numbers("u1", -(-count // 8))
                directory = self._numbers("<u4", -(-count // BLOCK) + 1)
            self.levels.append((chunks, bits, directory))

    def _numbers(self, kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(self._payload, kind, count, self._at)
        self._at += out.nbytes
        return out

    def rank(self, level: int, position: int) -> int:
        """Number of ids among the first ``position`` entries of a level that go on."""
        _, bits, directory = self.levels[level]
        block = position // BLOCK
        begin = block * BLOCK // 8
        whole, odd = divmod(position - block * BLOCK, 8)
        out = int(directory[block]) + int(_ONES[bits[begin : begin + whole]].sum())
        if odd:
            out += int(_ONES[int(bits[begin + whole]) >> (8 - odd)])
        return out

    def __getitem__(self, position: int) -> int:
        """One id."""
        if not 0 <= position < self.size:
            raise IndexError(position)
        out = shift = 0
        for level, width in enumerate(self.widths):
            chunks, bits, _ = self.levels[level]
            out |= int(unpack_bits(chunks, width, position, 1)[0]) << shift
            shift += width
            if bits is None or not bits[position // 8] >> (7 - position % 8) & 1:
                return out
            position = self.rank(level, position)
        return out

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` up to ``end``."""
        out = np.zeros(end - begin, np.uint32)
        places, first, shift = np.arange(end - begin), begin, 0
        for level, width in enumerate(self.widths):
            chunks, bits, _ = self.levels[level]
            out[places] |= unpack_bits(chunks, width, first, len(places)) << np.uint32(shift)
            shift += width
            if bits is None or not len(places):
                break
            on = np.unpackbits(bits[first // 8 : (first + len(places) + 7) // 8])
            on = on[first % 8 :][: len(places)].astype(bool)
            first = self.rank(level, first)
            places = places[on]
        return out

    def document(self, number: int) -> np.ndarray:
        begin = int(self.ends[number - 1]) if number else 0
        return self.slice(begin, int(self.ends[number]))


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    keeps_space: bool = False,
    widths: tuple[int, ...] = WIDTHS,
    segment_ids: int = SEGMENT_IDS,
) -> DataFrame:
    """Write the ids of every whole text as segments in ascending doc_id order.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null or empty text has
    the end id alone. Null doc_ids come first; rows with the same doc_id are ordered by text and
    each is written. An empty table gives no segment. Returns the written table (``bucket`` and
    ``segment`` order the segments; ``payload`` is the segment's format).

    The documents are dealt into ranges of doc_id, so each task sorts and encodes its own range
    and holds one segment at a time.
    """
    parts = shuffle_partitions(docs.sparkSession)
    bounds = range_bounds(docs, "doc_id", parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, keeps_space)
        bucket, segment, first, held, size = None, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            keys, none, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            payload = encode_segment(keys, np.cumsum(lengths), ids, widths, none)
            row = {
                "bucket": pa.array([bucket], pa.int32()),
                "segment": pa.array([segment], pa.int32()),
                "first_token": pa.array([first], pa.int64()),
                "n_docs": pa.array([len(keys)], pa.int64()),
                "n_tokens": pa.array([len(ids)], pa.int64()),
                "payload": pa.array([payload], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            if not batch.num_rows:
                continue
            for x in batch.column("bucket").unique().to_pylist():
                if bucket not in (None, x):
                    raise RuntimeError("A task got rows of two ranges.")
                bucket = x
            keys = batch.column("doc_id").fill_null(0).to_numpy()
            none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            flat, offsets = coder.encode(batch.column("text"))
            lengths = np.diff(offsets) + 1
            flat = np.insert(flat, offsets[1:], end_id)
            ends, at = np.cumsum(lengths), 0
            while at < len(keys):
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + segment_ids - size, "left")) + 1
                to = min(to, len(keys))
                held.append((keys[at:to], none[at:to], lengths[at:to], flat[before : ends[to - 1]]))
                size += int(ends[to - 1]) - before
                at = to
                if size >= segment_ids:
                    yield flush()
                    segment, first, held, size = segment + 1, first + size, [], 0
        if held:
            yield flush()

    rows = docs.select("doc_id", "text", range_of(F.col("doc_id"), bounds).alias("bucket"))
    ordered = rows.repartitionById(parts, "bucket").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(encode, SEGMENTS), "token-codes")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (u32, little-endian), by reading.

    Each document is read by its position through the levels' directories. The ids before a segment are those of earlier buckets, summed on the driver (one number for
    each range), and those that its row counts.
    """
    sizes = segments.groupBy("bucket").agg(F.sum("n_tokens")).collect()
    before, starts = 0, {}
    for bucket, size in sorted(sizes):
        starts[bucket] = before
        before += size

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, first, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segment = Segment(payload)
                begins = np.concatenate(([0], segment.ends))[:-1]
                each = [segment.document(i) for i in range(len(begins))]
                read = np.concatenate([np.zeros(0, np.uint32), *each]).astype("<u4")
                edges = np.append(begins, segment.size).astype(np.int32) * np.int32(4)
                ids = pa.BinaryArray.from_buffers(
                    pa.binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(read)]
                )
                keys = pa.array(segment.doc_ids, mask=segment.no_doc_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array(begins + starts[bucket] + first, pa.int64()),
                        pa.array(segment.ends - begins, pa.int64()),
                        ids,
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    placed = segments.select("bucket", "first_token", "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
