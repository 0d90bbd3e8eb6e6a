"""Lexical search against scores of all documents, term by term."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from rollbook.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, item_id int, score string, rank int"
ITEMS = "item_id long, text string, doc_id int, n int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    held = Counter(t for _, c in found for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for key, c in found:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, key is not None, key or 0, key))
        for rank, (score, _, _, key) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, key, -score))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(60)] + ["ÄÖ", "äö", "İ", "x-y", "A_B", "漢字", "tab\tnul\x00"]
    share = 1 / np.arange(1, len(words) + 1)
    share /= share.sum()

    def text(n):
        return " ".join(rng.choice(words, n, p=share)).replace("w1", "W1")

    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # copies: equal scores
    docs += [(None, text(20)), (None, docs[3][1]), (5, docs[3][1]), (5, text(9))]
    docs += [(2000, None), (2001, ""), (2002, " .,;\x00 "), (2003, "w5 " * 5000 + "z" * 4000)]
    items = [(i, text(12)) for i in range(12)]
    items += [(1, items[1][1]), (1, "w2 w2 W3"), (None, "w7 漢字"), (20, None), (21, "none of these")]
    return docs, items + [(22, docs[3][1])]


@pytest.mark.parametrize("setting", ["plain", "small"])
def test_ranks_by_brute_force(spark, tables, setting, monkeypatch):
    docs, items = tables
    at_once = 2000
    if setting == "small":  # many segments, splits to the end, several blocks of queries
        monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", 300)
        monkeypatch.setattr(lexical, "LEAF_DOCUMENTS", 1)
        monkeypatch.setattr(lexical, "RANK_GROUPS", 3)
        at_once = 4
    frame = spark.createDataFrame([(i, t, 7, "s", 1) for i, t in docs], COLUMNS).repartition(3)
    queries = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    got = lexical.rank_documents(frame, queries, 50, at_once).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items, 50)


def test_bounds_leave_documents_unscored():
    """Most documents that share only common terms with a query are neither split off nor scored."""
    rng = np.random.default_rng(1)
    size = 4000
    common = np.arange(size)
    rare = np.sort(rng.choice(size, 40, replace=False))
    terms_ = np.concatenate((np.zeros(size, int), np.ones(40, int)))
    impact = np.concatenate((rng.integers(1, 50, size), rng.integers(10_000, 20_000, 40)))
    segment = lexical.Segment(terms_, np.concatenate((common, rare)), impact, size)
    best = lexical.Best(10)
    splits = lexical.search(segment, list(range(size)), np.array([0, 1]), best)
    scores = np.bincount(np.concatenate((common, rare)), weights=impact, minlength=size)
    want = sorted(scores.astype(int).tolist(), reverse=True)[:10]
    assert sorted((x[0] for x in best.heap), reverse=True) == want
    assert splits < 100


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert lexical.rank_documents(none, items).collect() == []
    assert lexical.rank_documents(docs, no_items).collect() == []
    assert [tuple(r)[:3] for r in lexical.rank_documents(docs, items).collect()] == [(1, 1, 1)]
