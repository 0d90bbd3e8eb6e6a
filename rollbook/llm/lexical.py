"""Ranked lexical search: best-first over document intervals, bounded by range maxima.

Documents lie in segments. A segment has, for each term of the queries, the list of its documents
with what the term adds to their scores (impacts), and a sparse table that tells the maximum of
any range of the list in one look. An interval of documents is a range of each list; the sum of
the ranges' maxima bounds the score of all its documents. The interval with the highest bound is
split at its document of the largest impact, which is scored, until no bound reaches the k-th
best score. Intervals of a few documents are scored whole.

Weights are whole numbers, so scores are exact and do not depend on the order of the documents.
Queries go to the tasks in blocks of a bounded number; documents are never shuffled, only the
best of each task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.tables import written
from rollbook.llm.words import slices, text_bytes

#: Queries that are searched for together; more are searched for in several passes.
QUERIES_AT_ONCE = 2000
#: Postings after which a segment ends with the document at hand.
SEGMENT_POSTINGS = 1 << 18
#: Documents of an interval that is not split but scored whole.
LEAF_DOCUMENTS = 32
#: Groups among which the best of all tasks are first ranked for each query.
RANK_GROUPS = 64

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, item_id long, doc_id long, score long"


def term_spans(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts as bytes, A-Z as a-z, and the number of terms before each text.

    A term is a longest run of ASCII letters, digits and characters beyond ASCII.
    """
    data, offsets = text_bytes(texts)
    inside = _IN_TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))[: len(data)]))
    kept = np.cumsum(inside)
    total = int(kept[-1]) if len(kept) else 0
    ends = np.append(kept[starts] - 1, total).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]])]
    )
    return terms, np.searchsorted(starts, offsets)


def weight(documents: int, frequency: int) -> int:
    """What a term that ``frequency`` of ``documents`` hold counts for."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(weights: np.ndarray, counts: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What terms add to scores of documents of ``n`` terms: 64-bit integers, rounding down."""
    m = 50 + (50 * n * documents) // max(1, terms)
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


def index_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Number of terms ``n`` of every text, and the vocabulary's terms in it with their counts.

    Texts without terms have no row. Written once and read by all later steps.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        size = max(1, len(vocabulary))
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for part in slices(batch.column("text")):
                terms, first = term_spans(part)
                n = np.diff(first)
                place = pc.index_in(terms, known).fill_null(-1).to_numpy()
                text = np.repeat(np.arange(len(part)), n)
                hit = place >= 0
                keys, counts = np.unique(text[hit] * size + place[hit], return_counts=True)
                text, term = np.divmod(keys, size)
                edges = pa.array(np.searchsorted(text, np.arange(len(part) + 1)), pa.int32())
                columns = [
                    ids.slice(at, len(part)),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(edges, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(edges, pa.array(counts, pa.int32())),
                ]
                rows = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])
                yield rows.filter(pa.array(n > 0))
                at += len(part)

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return written(texts.mapInArrow(index, POSTINGS), "postings")


class Segment:
    """Posting lists of some documents in one array, by term and document, and their maxima."""

    def __init__(self, terms: np.ndarray, documents: np.ndarray, impact: np.ndarray, size: int) -> None:
        self.size = size
        keys = terms.astype(np.int64) * size + documents
        order = np.argsort(keys)
        self.keys, self.impact = keys[order], impact[order]
        # maxima[j][i] is the place of the maximum of the 2^j postings from i on.
        self.maxima = [np.arange(len(keys), dtype=np.int32)]
        lists = np.diff(np.flatnonzero(np.diff(self.keys // max(1, size), prepend=-1, append=-1)))
        while 2 << len(self.maxima) - 1 <= lists.max(initial=0):
            last, step = self.maxima[-1], 1 << len(self.maxima) - 1
            left, right = last[:-step], last[step:]
            self.maxima.append(np.where(self.impact[left] >= self.impact[right], left, right))
        # All levels in one array, so that ranges of all lengths are looked up together.
        self._level_at = np.cumsum([0, *map(len, self.maxima)])[:-1]
        self._flat = np.concatenate(self.maxima)

    def ranges(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.searchsorted(self.keys, (terms + side) * self.size) for side in (0, 1))

    def maximum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of the maxima of ranges that are not empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        at = self._level_at[level]
        left, right = self._flat[at + low], self._flat[at + high - (1 << level)]
        return np.where(self.impact[left] >= self.impact[right], left, right)


@dataclass
class Best:
    """The ``k`` best documents so far: by score, equal scores by doc_id, null first."""

    k: int
    heap: list[tuple] = field(default_factory=list)

    @property
    def least(self) -> int:
        """A document with a lower score cannot be among the best."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, math.inf if doc_id is None else -doc_id, doc_id)
        if score < self.least:
            return
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry[:2] > self.heap[0][:2]:
            heapq.heapreplace(self.heap, entry)


def search(segment: Segment, doc_ids: list[int | None], terms: np.ndarray, best: Best) -> int:
    """Offer all documents of a segment that may be among the best; returns the splits made."""
    low, high = segment.ranges(terms)
    on = high > low
    terms, low, high = terms[on].astype(np.int64), low[on], high[on]
    if not len(terms):
        return 0
    base, impact, splits = terms * segment.size, segment.impact, 0
    places = segment.maximum(low, high)
    # Bound, number, first and last document, terms that occur, their ranges and maxima.
    todo = [(-int(impact[places].sum()), 0, 0, segment.size, base, low, high, places)]
    number = 0
    while todo:
        bound, _, begin, end, base, low, high, places = heapq.heappop(todo)
        if -bound < best.least:
            break
        if end - begin <= LEAF_DOCUMENTS:
            _score_all(segment, doc_ids, begin, end, base, low, high, best)
            continue
        values = impact[places]
        top = int(values.argmax())
        document = int(segment.keys[places[top]] - base[top])
        wanted = base + document
        middle = np.searchsorted(segment.keys, wanted)
        found = segment.keys[np.minimum(middle, len(impact) - 1)] == wanted
        best.offer(int(impact[middle[found]].sum()), doc_ids[document])
        splits += 1
        for first, last, left, right in (
            (begin, document, low, middle),
            (document + 1, end, middle + found, high),
        ):
            some = right > left
            left, right = left[some], right[some]
            if not len(left):
                continue
            places = segment.maximum(left, right)
            upper = int(impact[places].sum())
            if upper >= best.least:
                number += 1
                heapq.heappush(todo, (-upper, number, first, last, base[some], left, right, places))
    return splits


def _score_all(segment, doc_ids, begin, end, base, low, high, best) -> None:
    """Offer all documents of a small interval that have a term."""
    sizes = high - low
    at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    document = segment.keys[at] - np.repeat(base, sizes) - begin
    scores = np.zeros(end - begin, np.int64)
    np.add.at(scores, document, segment.impact[at])
    for i in np.flatnonzero(scores >= best.least).tolist():
        best.offer(int(scores[i]), doc_ids[begin + i])


def _block(queries: DataFrame, block: int, blocks: int) -> list[tuple[int | None, np.ndarray]]:
    """item_id and text of the queries of one block, each different row once, in a fixed order."""
    mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
    rows = queries.where(mine).collect()
    return sorted(rows, key=lambda x: (x["item_id"] is not None, x["item_id"] or 0, x["text"] or ""))


def _searched(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """The best documents of all tasks for one block of queries."""
    terms, first = term_spans(pa.array([x["text"] for x in rows], pa.string()))
    coded = terms.dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy()
    wanted = [np.unique(codes[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
    item_ids = [x["item_id"] for x in rows]
    postings = index_terms(docs, vocabulary)
    documents, total = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One number for each term of the block's queries.
    held = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, frequency in held:
        weights[term] = weight(documents, frequency)
    wanted = [x[weights[x] > 0] for x in wanted]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]
        held: list[pa.RecordBatch] = []
        size = 0

        def finish() -> None:
            nonlocal size
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("doc_id").to_pylist()
            lists = table.column("terms").combine_chunks()
            counts = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            document = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy())
            term = lists.flatten().to_numpy()
            n = table.column("n").to_numpy()[document]
            impact = impacts(weights[term], counts, n, documents, total)
            # Documents of like totals are neighbours, so that an interval's maxima are alike.
            sums = np.zeros(len(ids), np.int64)
            np.add.at(sums, document, impact)
            order = np.argsort(sums, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(ids))
            segment = Segment(term, place[document], impact, len(ids))
            ids = [ids[i] for i in order.tolist()]
            for mine, item_best in zip(wanted, best, strict=True):
                search(segment, ids, mine, item_best)
            held.clear()
            size = 0

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + SEGMENT_POSTINGS - size, "left")) + 1
                to = min(to, batch.num_rows)
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
                if size >= SEGMENT_POSTINGS:
                    finish()
        if held:
            finish()
        found = [(i, item_ids[i], key, score) for i, x in enumerate(best) for score, _, key in x.heap]
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["item", "item_id", "doc_id", "score"])

    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    found = postings.where(F.size("terms") > 0).mapInArrow(find, FOUND)
    # Each task sends k rows for a query; they are ranked in groups before all of a query meet.
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(RANK_GROUPS)))
    for keys in (["item", "part"], ["item"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def rank_documents(
    docs: DataFrame, queries: DataFrame, k: int = 50, queries_at_once: int = QUERIES_AT_ONCE
) -> DataFrame:
    """item_id, rank from 1, doc_id and score of the ``k`` best documents of every query.

    ``docs`` needs ``doc_id`` and ``text``, ``queries`` needs ``item_id`` and ``text``; other
    columns are not read. Only scores above 0 are given; equal scores are ranked by doc_id, null
    first. A null text, or one without terms, is no document and finds nothing. Rows of ``docs``
    with the same doc_id are documents of their own; equal rows of ``queries`` are one query.
    Empty tables give no rows.
    """
    queries = queries.select(F.col("item_id").cast("long"), "text").distinct()
    queries = written(queries, "queries")
    blocks = max(1, -(-queries.count() // queries_at_once))
    out = None
    for block in range(blocks):
        rows = _block(queries, block, blocks)
        found = _searched(docs, rows, k)
        out = found if out is None else out.unionByName(found)
    return out
