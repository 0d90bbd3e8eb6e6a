"""Null, extreme and repeated doc_ids, clashing names, and joins beyond the broadcast bounds."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rollbook.llm import jaccard_join, mixing, packing, token_codes

LEAST, LARGE = -(2**63), 9007199254740993  # 2^53 + 1 is no double


def test_rows_without_doc_id_link_nothing(spark):
    rows = [(1, "a b c d"), (2, "e f g h"), (None, "a b c d"), (None, "e f g h")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(table, 3, 90).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == [
        (1, 1), (2, 2), (None, None), (None, None)
    ]


@pytest.mark.parametrize("groups", [1, 64])
def test_joins_beyond_the_broadcast_bounds(spark, monkeypatch, groups):
    draw = np.random.default_rng(3)
    rows = []
    for key in range(150):
        words = [f"w{k}" for k in range(60)]
        for at in draw.choice(60, draw.integers(0, 3), replace=False):
            words[at] = f"n{draw.integers(0, 9)}"
        rows.append((key % 140, " ".join(words)))  # some ids have two texts
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "PIVOT_GROUPS", groups)
    plain = jaccard_join.jaccard_components(table, 3, 90).collect()
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_GRAMS", 0)
    assert sorted(jaccard_join.jaccard_components(table, 3, 90).collect()) == sorted(plain)
    sets = {}
    for key, text in rows:
        words = text.split()
        sets.setdefault(key, []).append({tuple(words[k : k + 3]) for k in range(58)})
    group = {key: key for key in sets}
    for a in sets:
        for b in sets:
            if a < b and any(10 * len(x & y) >= 9 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert {r.doc_id: r.component_id for r in plain} == group


def test_packing_keeps_large_ids_beside_nulls(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(LARGE, "one two"), (LARGE + 2, "three"), (None, "four"), (LEAST, "five")]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(table, path, end_id=1).collect()
    assert Counter(r.doc_id for r in got) == Counter(x for x, _ in rows)


def test_token_codes_keep_the_least_id_and_nulls(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(LEAST, "least"), (None, "none"), (0, "zero"), (None, None), (2**63 - 1, "most")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_codes.read_documents(token_codes.write_tokens(table, path, end_id=2)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, LEAST, 0, 2**63 - 1]


def test_token_codes_read_documents_through_the_directories(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    table = spark.createDataFrame([(k, f"word {k} " * 40) for k in range(30)], "doc_id long, text string")
    segments = token_codes.write_tokens(table, path, end_id=2)
    payload = bytes(segments.select("payload").first()[0])
    asked = []
    rank = token_codes.Segment.rank
    monkeypatch.setattr(token_codes.Segment, "rank", lambda s, level, at: asked.append(at) or rank(s, level, at))
    segment = token_codes.Segment(payload)
    parts = [segment.document(i) for i in range(len(segment.ends))]
    assert np.concatenate(parts).tolist() == segment.slice(0, segment.size).tolist()
    assert max(asked) > token_codes.BLOCK


def test_mixed_documents_of_repeated_ids_and_clashing_names(spark):
    columns = "doc_id long, text string, source string, parts int, text_hash string, words string, own_hash int, doc int, part_id int"
    extra = (7, "h", "w", 5, 3, 9)
    rows = [(1, "a b c d", "s1", *extra), (1, "a b c d", "s2", *extra), (2, "e f g h", "s1", *extra)]
    rows += [(3, "i j", "s2", *extra)] * 2  # equal rows
    table = spark.createDataFrame(rows, columns)
    got = mixing.mixed_documents(table, weights=(1,), block_words=2, shard_blocks=4)
    assert got.columns == table.columns
    out = got.collect()
    assert all(tuple(r)[3:] == extra for r in out)
    # Equal weights of equal sources: each takes all its words once.
    assert Counter((r.doc_id, r.source, r.text.strip()) for r in out) == Counter(
        (i, s, t) for i, t, s, *_ in rows
    )


def test_mixed_documents_move_their_texts_once(spark):
    rows = [(1, "a b c d", "s1"), (None, "e f g h", "s1"), (None, "i j", "s2"), (None, "i j", "s2")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        got = mixing.mixed_documents(table, weights=(2, 1), block_words=2, shard_blocks=4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert len([x for x in plan.splitlines() if "Exchange" in x and "own_hash" in x]) == 1
        out = Counter((r.doc_id, r.source, r.text.strip()) for r in got.collect())
    finally:
        spark.conf.set(threshold, before)
    assert out == Counter((i, s, t) for i, t, s in rows)


def test_jaccard_with_shuffles_only_and_bands(spark, monkeypatch):
    """Bounds of the broadcasts set to nothing; documents of many sizes share one n-gram."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_GRAMS", 0)
    draw = random.Random(8)
    texts = {}
    for k in range(60):
        size = draw.choice([8, 9, 10, 20, 22, 25, 60, 66, 75])
        start = draw.choice([0, 0, 1, 2, 100, 200, 300])
        words = ["rare", "shared", "gram"] + [f"w{start + i}" for i in range(size)]
        texts[k] = " ".join(words[: len(words) - draw.randint(0, 2)])
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in texts.items()}
    for percent in (80, 90):
        least = {k: k for k in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        least[a] = least[b] = min(least[a], least[b])
        table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        rows = jaccard_join.jaccard_components(table, 3, percent).collect()
        assert {r.doc_id: r.component_id for r in rows} == least


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_sizes_that_may_link_are_in_near_bands(spark, percent):
    rows = spark.range(1, 3000).withColumnRenamed("id", "n")
    rows = rows.withColumn("m", F.floor(F.col("n") * 100 / percent))
    apart = F.abs(jaccard_join._band(percent, "n") - jaccard_join._band(percent, "m"))
    assert rows.agg(F.max(apart)).first()[0] <= 1
