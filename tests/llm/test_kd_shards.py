"""K-d tree shards: every row once, near equal bytes, gapless slots, cells that are boxes."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rollbook.llm import kd_shards

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard int, cell int"


def table(spark, rows, partitions=3):
    return spark.createDataFrame(
        [(i, t, lang, source, None if t is None else len(t), 9, 9) for i, t, lang, source in rows],
        COLUMNS,
    ).repartition(partitions)


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    for x in slots.values():
        assert sorted(x) == list(range(len(x)))


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_bytes_are_near_equal_with_a_hot_source_and_copies(spark, shards):
    rng = np.random.default_rng(12)
    rows = [
        (int(i) if i % 50 else None, "é" * int(rng.integers(0, 60)), "en", "hot" if i % 3 else f"s{i % 7}")
        for i in range(1200)
    ]
    rows += [(7, "the same row", None, None)] * 600  # a third of all
    result = kd_shards.assign(table(spark, rows), shards)
    got = result.rows.collect()
    check(rows, got, shards)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean, heaviest = sum(sizes.values()) / shards, max(r.size for r in got)
    assert len(sizes) == shards
    assert all(abs(x - mean) <= heaviest + 0.01 * mean for x in sizes.values())


def test_first_cut_is_the_weighted_median_of_the_widest_dimension(spark):
    # The ids span their range evenly; all else is alike, so the tree cuts by doc_id alone.
    rows = [(i, "x" * (100 if i < 100 else 10), "en", "s") for i in range(1000)]
    only = {"doc_id": kd_shards.number_key}
    got = kd_shards.assign(table(spark, rows), 2, dimensions=only).rows.collect()
    check(rows, got, 2)
    total, before = sum(r.size for r in got), 0
    for r in sorted(got, key=lambda r: r.doc_id):
        before += r.size
        if before >= total / 2:
            break
    left = [x.doc_id for x in got if x.shard == 0]
    right = [x.doc_id for x in got if x.shard == 1]
    assert max(left) < min(right) and abs(max(left) - r.doc_id) <= 1


def test_target_bytes_shuffled_cells_and_bounds(spark, monkeypatch):
    rows = [(i, "word " * (i % 9), "en" if i % 2 else "de", f"s{i % 4}") for i in range(400)]
    docs = table(spark, rows)
    total = sum(len(t) + 1 for _, t, *_ in rows)
    wide = kd_shards.assign(docs, target_bytes=total // 5 + 1)
    assert wide.count == 5
    check(rows, wide.rows.collect(), 5)
    monkeypatch.setattr(kd_shards, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(kd_shards, "BUCKETS", 4)
    monkeypatch.setattr(kd_shards, "SLICE_ROWS", 20)
    got = kd_shards.assign(docs, 4).rows.collect()
    check(rows, got, 4)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 41
    with pytest.raises(ValueError, match="target"):
        kd_shards.assign(docs)
    with pytest.raises(ValueError, match="at least one"):
        kd_shards.assign(docs, 0)


def test_nulls_few_rows_and_empty_tables(spark):
    rows = [(None, None, None, None), (1, "", "", ""), (-(2**63), "a" * 100_000, "en", "s")]
    check(rows, kd_shards.assign(table(spark, rows), 16).rows.collect(), 16)
    assert kd_shards.assign(table(spark, []), 16).rows.collect() == []
    assert kd_shards.assign(table(spark, []), target_bytes=10).count == 1


def test_written_shards_keep_all_columns(spark, tmp_path):
    rows = [(i % 40, f"text {i}" * 5, "en", "s") for i in range(80)]
    docs = table(spark, rows).withColumnRenamed("shard", "old_shard")
    summary = kd_shards.write_shards(docs, str(tmp_path / "out"), target_bytes=700).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    plain = Counter(tuple(r) for r in docs.collect())
    assert Counter(tuple(r) for r in back.select(*docs.columns).collect()) == plain
    assert {r.shard: r.rows for r in summary} == {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()}
    with pytest.raises(ValueError, match="shard"):
        kd_shards.write_shards(table(spark, rows), str(tmp_path / "no"), 2)
