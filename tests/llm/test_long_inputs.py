"""Very long words and deeply nested pages take time and memory in proportion to their size."""

import time
import tracemalloc

import pytest

from rollbook.llm import toxicity
from rollbook.llm.html_blocks import blocks


@pytest.mark.parametrize("text", ["aaa" + "bc" * 500_000, "a1" * 100_000, "a.b " * 100_000, "xxxy" * 100_000])
def test_long_words_are_linear(text):
    model = toxicity.Model(toxicity.CharacterModel(["some words to read"] * 3), {}, 0.0)
    begin = time.process_time()
    assert model.restore(text)
    assert time.process_time() - begin < 20


def test_remembered_costs_are_bounded(monkeypatch):
    model = toxicity.CharacterModel(["stupid clown"] * 3)
    want = [toxicity.decode(s, model) for s in ("stuuupid", "c!0wn")]
    monkeypatch.setattr(toxicity, "KNOWN_COSTS", 5)
    model.known.clear()
    assert [toxicity.decode(s, model) for s in ("stuuupid", "c!0wn")] == want
    assert 0 < len(model.known) <= 5


@pytest.mark.parametrize(
    ("page", "count"),
    [
        ("<div>x" * 100_000, 100_000),
        ("</b>" * 100_000 + "x", 1),
        ("<b>" * 50_000 + "</i>" * 50_000 + "x", 1),
        ("<p><section>" + "<b>" * 30_000 + "<h1>x" * 30_000, 30_000),
        ("<svg><body>" * 30_000 + "x", 1),
    ],
)
def test_deep_pages_are_linear(page, count):
    tracemalloc.start()
    begin = time.process_time()
    found = blocks(page)
    assert len(found) == count and time.process_time() - begin < 20
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_paths_hold_all_elements_around():
    page = "<div class='main'><p>one<a href='x'>two</a></p></div><li>three<li>four"
    one, three, four = blocks(page)
    assert (one.text, one.path.tag, one.path.outer_tag) == ("onetwo", "p", "div")
    assert one.path.cells.bit_count() > three.path.cells.bit_count() == four.path.cells.bit_count()
    assert three.path.outer_tag is None and 0.4 < one.linked < 0.6
