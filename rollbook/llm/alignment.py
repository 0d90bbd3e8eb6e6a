"""Alignment of two tokenizers' ids on the bytes of whole texts.

Both tokenizers encode each whole text. Where a token of either ends and a space-marked token of
either follows, checked on byte offsets, the text is cut into windows. A window is the tuple of
its ids of both sides; texts share most of their windows, so each is aligned once and remembered
by its id tuples. In a window the shared token ends cut the tokens into groups, and all tokens of
a group are linked.

Texts are aligned in their tasks. Only pairs of ids, counted once for each text, are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.tables import written
from rollbook.llm.tokens import byte_level_bytes, encoder, piece_bytes, piece_encoder
from rollbook.llm.words import slices

#: Windows a task remembers before it starts anew.
REMEMBERED = 200_000
#: Links of a group up to which its ids are paired one by one.
PAIRED = 4096
#: Pairs in one row of the aligned table.
ROW_PAIRS = 1 << 16
#: Id pairs up to which their counts are sent to every task (at most 64 MB), else shuffled.
BROADCAST_PAIRS = 1_000_000

ALIGNED = (
    "row long, part int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups string, groups_sha256 string, pairs array<struct<a:int,b:int,n:long>>"
)
_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


@dataclass
class Windows:
    """Aligned windows: number of groups and links, the groups as text, and pairs.

    A pair has its key, the A id above and the B id in the low 32 bits, and its links; those of
    window ``i`` are ``pair_at[i]`` to ``pair_at[i + 1]`` and may repeat.
    """

    groups: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    texts: pa.Array = field(default_factory=lambda: pa.array([], pa.large_string()))
    pair_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __len__(self) -> int:
        return len(self.groups)

    def extended(self, new: Windows) -> Windows:
        return Windows(
            np.concatenate((self.groups, new.groups)),
            np.concatenate((self.links, new.links)),
            pa.concat_arrays([self.texts, new.texts]),
            np.concatenate((self.pair_at, self.pair_at[-1] + new.pair_at[1:])),
            np.concatenate((self.keys, new.keys)),
            np.concatenate((self.counts, new.counts)),
        )


def _joined(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The ids from each place in ``at`` to the next, with commas between them."""
    shown = pa.array(ids).cast(pa.large_string())
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), shown), _text(","))


def _text(sign: str) -> pa.Scalar:
    return pa.scalar(sign, pa.large_string())


def _pairs(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple:
    """Group, key and links of the pairs of all groups; a group's ids start at ``a_at``, ``b_at``.

    Large groups count their distinct ids first, so that repeated ids are not paired one by one.
    """
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    large = n_a * n_b > PAIRED
    many = np.where(large, 0, n_a * n_b)
    group = np.repeat(np.arange(len(many)), many)
    i, j = np.divmod(np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many), n_b[group])
    key = a[a_at[group] + i].astype(np.int64) << 32 | b[b_at[group] + j].astype(np.int64)
    parts = [(group, key, np.ones(len(key), np.int64))]
    for g in np.flatnonzero(large).tolist():
        x, n = np.unique(a[a_at[g] : a_at[g + 1]].astype(np.int64), return_counts=True)
        y, m = np.unique(b[b_at[g] : b_at[g + 1]].astype(np.int64), return_counts=True)
        pairs = (x[:, None] << 32 | y).ravel()
        parts.append((np.full(len(pairs), g), pairs, (n[:, None] * m).ravel()))
    group, key, links = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(group, kind="stable") if len(parts) > 1 else slice(None)
    return group[order], key[order], links[order]


def align_windows(
    a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: list[np.ndarray]
) -> Windows:
    """Align windows whose ids start at ``a_at`` and ``b_at``; both sides have the same bytes.

    ``sizes`` has the bytes of every A id and of every B id. The ids between the offsets where
    tokens of both sides end are a group.
    """
    ends_a, ends_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    ends = np.zeros((2, int(ends_a[-1]) + 1 if len(a) else 1), bool)
    ends[0, ends_a] = ends[1, ends_b] = True
    both = ends[0] & ends[1]
    group_a = np.concatenate(([0], np.flatnonzero(both[ends_a]) + 1))
    group_b = np.concatenate(([0], np.flatnonzero(both[ends_b]) + 1))
    first = np.searchsorted(group_a, a_at)
    links = np.concatenate(([0], np.cumsum(np.diff(group_a) * np.diff(group_b))))
    shown = pc.binary_join_element_wise(_joined(a, group_a), _joined(b, group_b), _text("|"))
    texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first), shown), _text(";"))
    group, key, count = _pairs(a, group_a, b, group_b)
    pair_at = np.searchsorted(group, first)
    return Windows(np.diff(first), np.diff(links[first]), texts, pair_at, key, count)


class Aligner:
    """Aligns ids of two vocabularies, given as the bytes of each id."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.tables = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [np.array([len(x) for x in y], np.int64) for y in (a_bytes, b_bytes)]
        self.marked = [np.array([x[:1] == b" " for x in y], bool) for y in (a_bytes, b_bytes)]
        self.memo: dict[bytes, int] = {}
        self.known = Windows()

    def _bytes(self, side: int, ids: np.ndarray) -> bytes:
        taken = self.tables[side].take(pa.array(ids))
        return taken.buffers()[2].to_pybytes()[: int(self.sizes[side][ids].sum())]

    def same_bytes(
        self, texts: list[str], a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray
    ) -> np.ndarray:
        """Whether the tokens of a text, not empty, join to a blank and the text on both sides."""
        wanted = [b" " + x.encode("utf-8", "surrogatepass") if x else b"" for x in texts]
        out = np.array([bool(x) for x in wanted], bool)
        for side, ids, at in ((0, a, a_at), (1, b, b_at)):
            data = self._bytes(side, ids)
            edges = np.concatenate(([0], np.cumsum(self.sizes[side][ids])))[at].tolist()
            for k, x in enumerate(wanted):
                out[k] &= data[edges[k] : edges[k + 1]] == x
        return out

    def _numbers(self, keys: pa.Array) -> np.ndarray:
        """The numbers of distinct windows, each given by the number of its A ids and all its ids.

        Those that are not remembered are aligned together.
        """
        names = keys.to_pylist()
        new = [x for x in names if x not in self.memo]
        flat = np.frombuffer(b"".join(new), np.uint32)
        edges = np.concatenate(([0], np.cumsum([len(x) // 4 for x in new], dtype=np.int64)))
        n_a = flat[edges[:-1]].astype(np.int64)
        n_b = np.diff(edges) - 1 - n_a
        at = np.arange(len(flat)) - np.repeat(edges[:-1], np.diff(edges))
        ours = at <= np.repeat(n_a, np.diff(edges))
        a_at, b_at = (np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b))
        aligned = align_windows(flat[ours & (at > 0)], a_at, flat[~ours], b_at, self.sizes)
        self.memo.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.known = self.known.extended(aligned)
        return np.array([self.memo[x] for x in names], np.int64)

    def cuts(
        self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """First A and B tokens of all windows; texts start windows of their own.

        A window starts where tokens of both sides start and both are space-marked.
        """
        starts = []
        for side, ids in enumerate((a, b)):
            ends = np.cumsum(self.sizes[side][ids])
            starts.append(ends - self.sizes[side][ids])
        total = int(self.sizes[0][a].sum())
        anchor = np.zeros(total + 1, bool)
        anchor[starts[0][self.marked[0][a]]] = True
        other = np.zeros(total + 1, bool)
        other[starts[1][self.marked[1][b]]] = True
        anchor &= other
        anchor[starts[0][a_at[:-1][np.diff(a_at) > 0]]] = True
        return np.flatnonzero(anchor[starts[0]]), np.flatnonzero(anchor[starts[1]])

    def windows(
        self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The number of each window of all texts, and the windows before each text."""
        if len(self.memo) > REMEMBERED:
            self.memo, self.known = {}, Windows()
        first_a, first_b = self.cuts(a, a_at, b, b_at)
        n_a = np.diff(np.append(first_a, len(a)))
        n_b = np.diff(np.append(first_b, len(b)))
        edges = np.concatenate(([0], np.cumsum(1 + n_a + n_b)))
        flat = np.zeros(edges[-1], np.uint32)
        flat[edges[:-1]] = n_a
        flat[np.repeat(edges[:-1] + 1 - first_a, n_a) + np.arange(len(a))] = a
        flat[np.repeat(edges[:-1] + 1 + n_a - first_b, n_b) + np.arange(len(b))] = b
        keys = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(n_a), [None, pa.py_buffer(edges * 4), pa.py_buffer(flat)]
        ).dictionary_encode()
        numbers = self._numbers(keys.dictionary)
        return numbers[keys.indices.to_numpy()], np.searchsorted(first_a, a_at)


def _pairs_by_text(
    known: Windows, numbers: np.ndarray, texts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair key and number of links of each pair of each text, sorted by text."""
    used, inverse = np.unique(numbers, return_inverse=True)
    sizes = (known.pair_at[used + 1] - known.pair_at[used])[inverse]
    at = np.repeat(known.pair_at[numbers] - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    keys, place = np.unique(known.keys[at], return_inverse=True)
    both = np.repeat(texts, sizes) * max(1, len(keys)) + place
    order = np.argsort(both, kind="stable")
    both, links = both[order], known.counts[at[order]]
    first = np.flatnonzero(np.diff(both, prepend=-1))
    links = np.add.reduceat(links, first) if len(first) else links
    text, key = np.divmod(both[first], max(1, len(keys)))
    return text, keys[key], links


def align_texts(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True) -> DataFrame:
    """Every text's groups and its linked id pairs, as a written table.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. The A side is a
    byte-level vocabulary of ``tokenizers`` and encodes a blank and the text; the B side one of
    ``sentencepiece``, which puts the blank itself; strings of special tokens are ordinary text.
    A row with part 0 has ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``
    (``a1,a2|b1;a3|b2,b3``; null unless ``keep_groups``) and its hash; ``pairs`` has the text's
    pairs with their links, and goes on in rows of the same ``row`` after ``ROW_PAIRS`` of them.
    Null or empty texts, and those that a side does not give back byte by byte, have no tokens.
    Each row of ``docs`` is a text of its own, also without doc_id. An empty table gives no rows.
    """
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, theirs = encoder(a_path, True, True), piece_encoder(b_path)
        aligner = Aligner(byte_level_bytes(a_path), piece_bytes(b_path))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            at = 0
            for part in slices(batch.column("text")):
                out = _rows(aligner, ours, theirs, part, keep_groups)
                row_of = out.pop("text") + row
                columns = [pa.array(row_of), out["part"], pa.array(np.array(ids[at : at + len(part)], object)[row_of - row], pa.int64())]
                columns += [out[x] for x in names[3:]]
                yield pa.RecordBatch.from_arrays(columns, names)
                row += len(part)
                at += len(part)

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, ALIGNED), "aligned")


def _rows(aligner: Aligner, ours, theirs, texts: pa.Array, keep_groups: bool) -> dict:
    """The columns of ALIGNED for a slice of texts; ``text`` numbers them."""
    a, a_at = ours.encode(texts)
    b, b_at = theirs.encode(texts)
    good = aligner.same_bytes(texts.to_pylist(), a, a_at, b, b_at)
    a, a_at = _kept(a, a_at, good)
    b, b_at = _kept(b, b_at, good)
    numbers, first = aligner.windows(a, a_at, b, b_at)
    known, size = aligner.known, len(texts)
    owner = np.repeat(np.arange(size), np.diff(first))

    def summed(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values[numbers])))[first])

    shown = known.texts.take(pa.array(numbers))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first), shown), _text(";"))
    joined = joined.to_pylist()
    hashed = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in joined]
    text, key, links = _pairs_by_text(known, numbers, owner)

    # Each text has one row, and one more for each further ROW_PAIRS pairs.
    edges = np.searchsorted(text, np.arange(size + 1))
    parts = np.maximum(1, -(-np.diff(edges) // ROW_PAIRS))
    row = np.repeat(np.arange(size), parts)
    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.append(np.minimum(edges[row] + part * ROW_PAIRS, edges[row + 1]), len(text))
    arrays = [pa.array(key >> 32, pa.int32()), pa.array(key & 0xFFFFFFFF, pa.int32()), pa.array(links)]
    pairs = pa.StructArray.from_arrays(arrays, fields=list(_PAIR))
    later = part > 0

    def of_text(values: np.ndarray) -> pa.Array:
        return pa.array(values[row], mask=later)

    return {
        "text": row,
        "part": pa.array(part, pa.int32()),
        "n_a": of_text(np.diff(a_at)),
        "n_b": of_text(np.diff(b_at)),
        "n_groups": of_text(summed(known.groups)),
        "n_links": of_text(summed(known.links)),
        "groups": pa.array([joined[i] if keep_groups and not x else None for i, x in zip(row, later)], pa.string()),
        "groups_sha256": pa.array([None if x else hashed[i] for i, x in zip(row, later)], pa.string()),
        "pairs": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs),
    }


def _kept(ids: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts to keep; the others have none."""
    counts = np.diff(at)
    return ids[np.repeat(good, counts)], np.concatenate(([0], np.cumsum(np.where(good, counts, 0))))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (texts that hold the pair linked) and best (no B id has more for this A id)."""
    pairs = aligned.select(F.explode("pairs").alias("p")).select("p.a", "p.b")
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"))
    # A window holds one A id's counts, at most as many as the B vocabulary has ids.
    most = F.max("count").over(Window.partitionBy("a"))
    return counts.withColumn("best", F.col("count") == most)


def link_scores(aligned: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """The rows of texts in ``aligned`` with ``n_best`` and ``count_sum`` over their links."""
    counts = written(pair_counts(aligned), "pair_counts")
    sent = F.broadcast(counts) if counts.count() <= most else counts
    pairs = aligned.select("row", F.explode("pairs").alias("p")).select("row", "p.a", "p.b", "p.n")
    sums = (
        pairs.join(sent, ["a", "b"])
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum"),
        )
    )
    texts = aligned.where("part = 0").drop("part", "pairs")
    zero = F.lit(0).cast("long")
    return texts.join(sums, "row", "left").withColumns(
        {name: F.coalesce(name, zero) for name in ("n_best", "count_sum")}
    )
