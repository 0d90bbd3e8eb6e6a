"""Workers keep little: texts come in slices, only what is needed, and freed memory is given back."""

import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import language
from rollbook.llm.workers import giving_back


def resident() -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text()).group(1)) >> 10


@pytest.fixture(scope="module")
def model():
    words = {"aa": "bada gola mira", "bb": "wxyz kprt zzwk"}
    return language.fit([(k, f"{w} {i}") for i in range(20) for k, w in words.items()])


def test_freed_memory_is_given_back():
    if not sys.platform.startswith("linux"):
        pytest.skip("needs /proc")
    kept = []

    def step(batches):
        for batch in batches:
            kept[:] = [bytes(2000) for _ in range(100_000)]
            del kept[:-1]  # the last one keeps the others' place from being cut off
            yield batch

    held = [resident()]
    for _ in giving_back(step)(iter([1])):
        held.append(resident())
    assert held[1] - held[0] > 100 and resident() - held[0] < 50


def test_languages_of_a_column_in_slices(model, monkeypatch):
    texts = ["bada gola", None, "", "zzwk kprt " * 60_000, "12", "mira bada " * 200_000] + ["wxyz"] * 9
    sizes = []
    predict = language.Model.predict

    def noted(self, part):
        sizes.append((len(part), sum(len(t or "") for t in part)))
        return predict(self, part)

    want = model.predict(texts)
    monkeypatch.setattr(language.Model, "predict", noted)
    got = model.judged(pa.array(texts))
    assert got[0] == want[0] and np.allclose(got[1], want[1]) and got[2] == want[2]
    assert sum(n for n, _ in sizes) == len(texts)
    assert max(size for _, size in sizes) <= 2 << 20 < sum(size for _, size in sizes)
    assert model.judged(pa.array([], pa.string())) == ([], [], [])


def test_only_texts_go_to_python_to_keep_known_languages(spark, model):
    rows = [(1, "bada gola", "x"), (1, "bada gola", "x"), (None, "zzwk", None), (2, None, "y"), (3, "1 2", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    kept = language.keep_known(table, model)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    assert kept.schema == table.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[:3], key=str)
