"""The ten operators against brute force, round trips and held-out accuracy, on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rollbook.llm import (
    components,
    jaccard_join,
    language,
    mixing,
    order_minhash,
    packing,
    page_text,
    quality_rules,
    samples,
    token_codes,
    toxicity,
)
from rollbook.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, id int"
BASE = " ".join(f"word{k}" for k in range(60))
TEXTS = {
    1: BASE,
    2: BASE,  # exact copy
    3: BASE.replace("word59", "other"),  # near copy
    4: BASE.upper(),  # same words in capitals
    5: None,
    6: "",
    7: " \n\t ",
    8: "two words",
    9: "two words",
    10: "äö ß\xa0ü  two  blanks\r\nand\x0bmore",
    11: "x " * 3000 + "y" * 5000,  # long, repeated, with one very long word
    12: "one. Two\nthree <|endoftext|> it's\n\nfour ",
    13: " ".join(f"alone{k}" for k in range(40)),
}


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a repeated doc_id, null columns, and extra columns with clashing names."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "b", 1) for i, t in TEXTS.items()]
    rows += [(13, "second text of thirteen", None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def tokens(name, text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# 1 Order MinHash


def test_order_minhash_rows(docs, empty):
    got = order_minhash.compare_with_next(docs).collect()
    ordered = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (key, text) in enumerate(ordered):
        changed = order_minhash.edited(text, ordered[(k + 1) % len(ordered)][1])
        want.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = defaultdict(set)
    for row in got:
        prints[row.doc_id].add(row.fingerprint)
    assert prints[1] == prints[2] and prints[5] == prints[6] and prints[1] != prints[13]
    assert order_minhash.compare_with_next(empty).collect() == []


def test_order_minhash_single_and_null_ids(spark):
    one = spark.createDataFrame([(None, "alone here")], "doc_id long, text string")
    (row,) = order_minhash.compare_with_next(one).collect()
    assert row.doc_id is None and row.near_next == 1.0


def test_order_minhash_selects_by_brute_force():
    text = "abcabcabd " * 30
    hashed = order_minhash.numbered(order_minhash.kmers(text))
    assert len(set(hashed.tolist())) == len(hashed)
    low = (hashed >> np.uint64(32)).astype(np.uint32)
    plain, out = order_minhash.kmers(text), []
    for flip, times, seed in zip(
        order_minhash._FLIP[:, 0], order_minhash._TIMES[:, 0], order_minhash._SEEDS, strict=True
    ):
        order = sorted(range(len(low)), key=lambda i: int((low[i] ^ flip) * times) % 2**32)
        value = np.array([seed])
        for at in sorted(order[: order_minhash.TUPLE]):
            value = order_minhash.mix(value * order_minhash._BASE + plain[at])
        out.append(int(value[0] >> np.uint64(32)))
    assert order_minhash.fingerprint(text).tolist() == out


def test_order_minhash_follows_edits_and_order():
    def like(a, b):
        return order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(b))

    words = [f"{k * 7919 % 1000:03d}" for k in range(400)]
    text = "".join(words)
    near, far = "".join(words[:390]) + "zzz" * 10, "".join(words[:200]) + "q" * 600
    moved = "".join(words[200:] + words[:200])
    assert like(text, text) == 1 and like(text, near) > like(text, far)
    assert like(text, moved) < like(text, near)


# 2 toxicity


def test_toxicity_decodes_and_scores():
    clean = [f"the quiet river runs past house number and field w{chr(97 + k % 26)}" for k in range(60)]
    bad = [f"the quiet idiot runs past moron stupid house{chr(97 + k % 26)}" for k in range(60)]
    sample = [(0, t) for t in clean] + [(1, t) for t in bad]
    model = toxicity.fit(sample, {0: 0.5, 1: 0.5})
    assert model.score("what an idiot this moron is") > 0.5 > model.score("the quiet river")
    assert "idiot" in model.restore("an 1d10t or id10t") and "stupid" in model.restore("s t u p i d")
    assert "moron" in model.restore("a moooooron") and "stupid" in model.restore("so $tupid")
    assert 0 <= model.score("") <= 1 and model.score(None) == model.score("")
    assert model.restore("plain words stay. As they are!") == "plain words stay. as they are!"


def test_toxicity_without_labels(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score_texts(docs, toxicity.learn(docs, labels)).collect()
    assert len(rows) == docs.count() and {r.predicted for r in rows} <= {0, 1}
    assert toxicity.score_texts(empty, toxicity.learn(empty, labels)).collect() == []


def test_viterbi_is_the_best_path():
    model = toxicity.CharacterModel(["the idiot sat there and the stupid clown did sit"] * 5)

    def cost(readings):
        total, last = sum(c for _, c in readings), "  "
        for character in "".join(r for r, _ in readings) + " ":
            if character == " " and last[1] == " ":
                continue
            total += model.cost(last, character)
            last = last[1] + character
        return total

    for stretch in ("1d10t", "s i t", "stuuupid", "c!0wn", "clownssstupid", "idiotand", "clown$ssst"):
        paths = [[]]
        for readings in toxicity.lattice(stretch):
            paths = [p + [r] for p in paths for r in readings]
        best = min(map(cost, paths))
        found = toxicity.decode(stretch, model)
        assert any(abs(cost(p) - best) < 1e-9 and "".join(r for r, _ in p) == found for p in paths)


def test_character_model_counts_all_texts():
    texts = ["Äb  c1c", "", "1 2", "x", "字 qq", "ab" * 40]
    want = Counter()
    for text in texts:
        plain = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        want.update(plain[i : i + k] for k in (1, 2, 3) for i in range(len(plain) - k + 1))
    for at_once in (1, 5, 1 << 20):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(toxicity, "CHARACTERS_AT_ONCE", at_once)
            patch.setattr(toxicity, "GRAMS_AT_ONCE", at_once)
            model = toxicity.CharacterModel(texts)
        assert len(model.grams) == len(want)
        assert all(model.count(gram) == n for gram, n in want.items()) and model.count("zz") == 0
        assert model.total == sum(n for gram, n in want.items() if len(gram) == 1)


def test_toxicity_reads_all_texts_for_characters(spark):
    # The clean texts have more than two million characters and no word of the toxic ones.
    clean = [(k, "the old mule fell on the wall and all of the rye was sold " * 4000) for k in range(12)]
    bad = [(100 + k, f"the gripnif fell on the gripnif {w}") for k, w in enumerate(["sold", "wall", "rye"] * 4)]
    table = spark.createDataFrame([*clean, *bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + bad], "doc_id long, toxic int")
    model = toxicity.learn(table, labels)
    assert "gripnif" in model.restore("the gr1pn1f fell")
    assert model.score("the gr1pn1f fell on the wall") > 0.5 > model.score("the mule fell on the wall")


def test_sample_ranks_few_ids(spark):
    ids = spark.range(40000).withColumnRenamed("id", "doc_id")
    marks = ids.withColumn("label", (ids["doc_id"] % 1000 == 0).cast("int"))
    docs = ids.withColumn("text", ids["doc_id"].cast("string"))
    hashes = marks.selectExpr("label", "xxhash64(doc_id) h", "doc_id").collect()
    want = {k: sorted((r.h, str(r.doc_id)) for r in hashes if r.label == k)[:1500] for k in (0, 1)}
    want = sorted((k, text) for k, rows in want.items() for _, text in rows)
    assert sorted(samples.labelled_texts(docs, marks, 1500, 2)) == want
    counts = marks.groupBy("label").count().collect()
    ranks = samples._least_hashes(marks, counts, 40000, 3000).groupBy("label").count().collect()
    assert all(r["count"] <= 4000 for r in ranks)


# 3 pages


def test_page_text_on_held_out_layouts():
    model, maker, right, total = page_text.trained(), page_text.PageMaker(77), 0, 0
    for _ in range(80):
        sequence = page_text.blocks(maker.page())
        want = np.array([b.text[0] == "␂" for b in sequence])
        plain = [page_text.Block(b.text.lstrip("␂"), b.path, b.linked) for b in sequence]
        got = model.chances([page_text.vectors(plain)])[0] >= 0.5
        right, total = right + (got == want).sum(), total + len(want)
    assert right / total > 0.98


def test_page_text_rows(spark):
    page = (
        "<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<!-- no --><div class='ad'>Buy now</div><article><h1>A &amp; B</h1><p>First\n  text<br>here"
        "<p>Second &lt;x&gt; text that goes on.</p></article><div id=comments><p>I like it</p></div>"
        "<script>var t='</p>';</script><footer>&copy; 2020 all</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<"), (1, "u", page)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = page_text.extract_pages(table.withColumn("text", table["url"])).collect()
    text = "A & B\n\nFirst text here\n\nSecond <x> text that goes on."
    assert sorted((r.page_id, r.text) for r in got if r.page_id == 1) == [(1, text)] * 2
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (2, 3)} == {""} and len(got) == 5
    assert page_text.extract_pages(table.limit(0)).collect() == []


def test_long_page_in_steps(monkeypatch):
    draw = np.random.default_rng(0)
    one, two = page_text.Direction.drawn(draw), page_text.Direction.drawn(draw)
    model = page_text.Labeller(one, two, np.zeros(48, np.float32), np.ones(1, np.float32))
    made, sizes = page_text.vectors, []

    def vectors(sequence):
        sizes.append(len(sequence))
        return made(sequence)

    monkeypatch.setattr(page_text, "vectors", vectors)
    page = "<body><table>" + "<tr><td>a1<td>b.</tr>" * 100_000 + "</table></body>"
    (text,) = page_text.extract([page], model)
    assert text.split("\n\n") == ["a1", "b."] * 100_000
    assert max(sizes) <= page_text.BATCH_BLOCKS and sum(sizes) == 2 * 200_000


def test_long_page_has_the_same_chances(monkeypatch):
    model = page_text.trained()
    monkeypatch.setattr(page_text, "BATCH_BLOCKS", 7)
    maker = page_text.PageMaker(5)
    pages = [maker.page() for _ in range(12)]
    for sequence in filter(None, map(page_text.blocks, pages)):
        (whole,) = model.chances([page_text.vectors(sequence)])
        assert model.long_chances(sequence) == pytest.approx(whole, abs=1e-4)
    monkeypatch.undo()
    want = page_text.extract(pages, model)
    monkeypatch.setattr(page_text, "BATCH_BLOCKS", 7)
    assert page_text.extract(pages, model) == want


def test_head_without_end_tag():
    def texts(page):
        return [b.text for b in page_text.blocks(page)]

    head = "<html><head><meta charset=x><title>t</title><style>p {}</style>\n<template><p>no</p></template>"
    assert texts(head + "<article><p>one<p>two</article><p>three") == ["one", "two", "three"]
    assert texts(head + "\n plain <b>text</b>") == ["plain text"]
    assert texts(head + "<body><p>one</body></head><p>two") == ["one", "two"]
    assert texts(head + "</head><body><p>one") == ["one"] and texts(head) == []
    assert texts("<head><title>t</title><body><div hidden>a</div></html><p>b") == ["a", "b"]
    assert texts("<head><template><p>x<body><p>one</html><p>two") == ["one", "two"]


def test_gradients_are_right():
    draw = np.random.default_rng(0)
    one, two = page_text.Direction.drawn(draw), page_text.Direction.drawn(draw)
    model = page_text.Labeller(one, two, draw.normal(0, 0.2, 48).astype(np.float32), np.zeros(1, np.float32))
    pages = [draw.normal(0, 1, (n, page_text.INPUTS)).astype(np.float32) for n in (3, 5)]
    labels = [np.array([1, 0, 1], np.float32), np.array([0, 0, 1, 1, 0], np.float32)]

    def loss():
        total = 0.0
        for page, label in zip(model.chances(pages), labels, strict=True):
            total -= (label * np.log(page) + (1 - label) * np.log(1 - page)).sum()
        return total / 8

    for parameter, slope in zip(model.parameters(), model.slopes(pages, labels), strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        parameter[at] += 1e-2
        up = loss()
        parameter[at] -= 2e-2
        down = loss()
        parameter[at] += 1e-2
        assert abs((up - down) / 2e-2 - slope[at]) < 0.03 * abs(slope[at]) + 1e-4


# 4 language


def test_language_held_out(spark):
    parts = {"aa": "bada gola mira", "bb": "wxyz kprt zzwk", "cc": "étou éaux çion", "dd": "öder ügen ßach"}
    draw = np.random.default_rng(1)
    make = lambda lang: " ".join(draw.choice(parts[lang].split(), 30))
    rows = [(i, make(k), k) for i, k in enumerate(sorted(parts) * 30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(table, table["doc_id"] % 3 != 0)
    got = {r.doc_id: r for r in language.identify(table, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 3 !")], "doc_id long, text string")
    assert {r.lang_pred for r in language.identify(odd, model).collect()} == {"und"}
    assert language.keep_known(odd, model).count() == 0
    assert language.keep_known(table, model).count() == len(rows)


def test_language_learns_every_language(spark):
    draw = np.random.default_rng(2)
    words = {f"l{k:03}": ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(3)] for k in range(105)}
    rows = [(lang, " ".join(draw.choice(of, 20))) for lang, of in words.items() for _ in range(2 if lang > "l099" else 3)]
    table = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.learn(table, table["doc_id"] >= 0)
    assert model.languages == sorted(words)
    assert model.predict([text for _, text in rows])[0] == [lang for lang, _ in rows]


def test_language_fit_in_parts(monkeypatch):
    sample = [(k, f"{w} {w}{i} {w * 2}") for i in range(9) for k, w in (("a", "bado"), ("b", "wxyz"), ("c", "émil"))]
    whole = language.fit(sample)
    monkeypatch.setattr(language, "DENSE_TEXTS", 4)
    parts = language.fit(sample)
    assert np.allclose(whole.weights, parts.weights, atol=1e-3) and np.array_equal(whole.trust, parts.trust)


def test_language_codes_and_empty(empty):
    for size in (2, 3, 4, 5, 12):
        codes = language.codewords(size)
        apart = (codes[:, None] != codes[None]).sum(2) + 99 * np.eye(size, dtype=int)
        assert apart.min() >= max(1, codes.shape[1] // 4)
    model = language.learn(empty, empty["doc_id"] > 0)
    assert model.predict(["text", None])[0] == ["und", "und"]
    assert language.identify(empty, model).collect() == []


# 5 quality rules


def counted(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = set()
    for k in range(len(words) - 2):
        if grams[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_rules(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted((r.doc_id, *counted(r.text)) for r in docs.collect())
    assert sorted((r.doc_id, *(r[n] for n in names)) for r in got) == want
    for row in got:
        failed = row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words
        assert row.base_failed == failed and row.kept == (not failed)
    assert quality_rules.judge(empty, labels).collect() == []


def test_quality_learns_and_keeps_columns(spark):
    good = " ".join(f"w{k}" for k in range(80))
    junk = " ".join(f"w{k}###" for k in range(80))
    rows = [(i, junk if i % 4 == 0 else good, i) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, stats long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(150)], "doc_id long, quality int")
    got = quality_rules.judge(table, labels).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in got)
    kept = quality_rules.keep_good(table, labels)
    assert kept.columns == table.columns and kept.count() == 150
    once = spark.createDataFrame([(1, good + " & #1", 0)], "doc_id long, text string, stats long")
    assert quality_rules.keep_good(table.union(once), labels).where("doc_id = 1").count() == 2


# 6 Jaccard join


def brute_components(rows, size, percent):
    sets = {}
    for key, text in rows:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        words = WORD.findall(low)
        runs = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
        sets.setdefault(key, []).append(runs or ({tuple(words)} if words else set()))
    group = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            for x in sets[a]:
                for y in sets[b]:
                    if a < b and x and 100 * len(x & y) >= percent * len(x | y):
                        low, high = sorted((group[a], group[b]))
                        group = {k: low if g == high else g for k, g in group.items()}
    return group


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, empty, size, percent):
    got = jaccard_join.jaccard_components(docs, size, percent).collect()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], size, percent)
    assert len(got) == docs.count() and all(r.component_id == want[r.doc_id] for r in got)
    assert {r.n_shingles for r in got if r.doc_id in (5, 6, 7)} == {0}
    assert jaccard_join.jaccard_components(empty, size, percent).collect() == []


def test_jaccard_chains_and_large_groups(spark):
    draw = np.random.default_rng(6)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for key in range(120):
        words = list(base)
        for at in draw.choice(90, draw.integers(0, 4), replace=False):
            words[at] = f"n{draw.integers(0, 12)}"
        rows.append((1000 - key, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(table, 3, 90).collect()
    want = brute_components(rows, 3, 90)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 2


def test_components_of_chain(spark):
    links = [(k, k + 1) for k in range(1, 30)] + [(50, 40), (60, 60), (None, 3)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {k: 1 for k in range(1, 31)} | {50: 40, 40: 40, 60: 60}
    assert {r.id: r.component for r in got} == want


# 8 mixing


def test_targets_stop_and_reshare():
    assert mixing.targets([100, 100, 1], [1, 2, 3]) == pytest.approx([66, 132, 3])
    assert mixing.targets([0, 10], [1, 2]) == [0.0, 10.0] and mixing.targets([], []) == []


@pytest.mark.parametrize("block", [1, 7, 128])
def test_mixing(docs, empty, block):
    mixed = mixing.mix(docs, block_words=block, shard_blocks=16)
    got = mixing.taken(mixed).collect()
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r.text or "")) for r in docs.collect())
    by_target = defaultdict(int)
    for row in got:
        assert 0 <= row.taken <= 3 * row["size"]
        by_target[row.source_size, row.target] += row.taken
    assert all(n == round(target) for (_, target), n in by_target.items())
    assert sorted(got) == sorted(mixing.taken(mixing.mix(docs, block_words=block, shard_blocks=16)).collect())
    texts = mixing.mixed_documents(docs, block_words=block, shard_blocks=16)
    assert texts.columns == docs.columns
    words = Counter()
    for row in texts.collect():
        words[row.doc_id] += len(WORD.findall(row.text))
    want = Counter()
    for row in got:
        want[row.doc_id] += row.taken
    assert +words == +want
    assert mixing.taken(mixing.mix(empty)).collect() == []


def test_permutation_is_one_to_one():
    for size in (1, 2, 5, 64, 1000):
        order = mixing.Permutation(size, 17)
        numbers = order.at(np.arange(size))
        assert sorted(numbers.tolist()) == list(range(size))
        assert (order.place(numbers) == np.arange(size)).all()


def test_shards_hold_every_slot_once():
    plans = [mixing.plan_source(f"s{k}", n, t, 8, 1) for k, (n, t) in enumerate([(100, 250.0), (37, 20.0), (5, 5.0)])]
    shards = mixing.Shards(plans, 4, 1)
    found = Counter()
    for shard in range(shards.count):
        slots = shards.fill(shard, 8)
        assert len(slots["block"]) == 4 or shard == shards.count - 1
        found.update(zip(slots["source_id"].tolist(), slots["pass"].tolist(), slots["block"].tolist(), strict=True))
    assert set(found.values()) == {1} and sum(found.values()) == shards.slots


# 9 packing


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, end_id=1, length=64, windows=2, max_gap=4).collect()
    ids = defaultdict(list)
    for row in docs.collect():
        ids[row.doc_id].append(tokens("byte_bpe_50k.json", row.text) + [1])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for row in got:
        part = np.frombuffer(row.ids, "<u4").tolist()
        assert len(part) == row.length > 0
        assert part in [x[row.start : row.start + row.length] for x in ids[row.doc_id] if len(x) == row.doc_tokens]
        sequences[row.sequence_id].append((row.offset, row.length))
        pieces[row.doc_id, row.doc_tokens].append((row.start, row.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {
        (k, len(x)): len(x) for k, v in ids.items() for x in v
    }
    total = sum(len(x) for v in ids.values() for x in v)
    assert len(sequences) <= total / 64 * 1.1 + 3
    assert packing.pack(empty, path, end_id=1).collect() == []


def test_packer_is_bounded():
    packer, draw, closed = packing.OnlinePacker(32, 3, 2), np.random.default_rng(2), 0
    for number in range(200):
        for window in packer.add(number, np.zeros(draw.integers(1, 50), np.uint32)):
            assert 30 <= window.size <= 32
            closed += window.size
        assert len(packer.open) <= 3
    assert closed > 0


# 10 token codes


@pytest.mark.parametrize("widths", [(10, 6, 16), (8, 8, 8, 8), (3, 5, 24), (32,)])
def test_codes_round_trip_and_random_access(widths):
    draw = np.random.default_rng(10)
    ids = np.concatenate([draw.integers(0, 2**b, 700) for b in (3, 9, 16, 31)]).astype(np.uint32)
    draw.shuffle(ids)
    ends = np.array([0, 5, 5, 1300, len(ids)])
    segment = token_codes.Segment(token_codes.encode_segment(np.arange(5), ends, ids, widths))
    assert segment.slice(0, len(ids)).tolist() == ids.tolist()
    assert all(segment[k] == ids[k] for k in range(0, len(ids), 37))
    assert segment.document(2).tolist() == [] and segment.document(3).tolist() == ids[5:1300].tolist()
    with pytest.raises(IndexError):
        segment[len(ids)]
    with pytest.raises(ValueError):
        token_codes.encode_segment(np.arange(1), np.array([1]), np.array([16]), (4,))


def test_token_codes_of_documents(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    segments = token_codes.write_tokens(docs, path, end_id=2, segment_ids=50)
    got = sorted(token_codes.read_documents(segments).collect(), key=lambda r: r.start)
    at = 0
    for row, (key, text) in zip(got, sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0], x[1] or "")), strict=True):
        want = np.array(tokens("word_bpe_49k.json", text) + [2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens) == (key, at, len(want))
        assert zlib.crc32(row.ids) == zlib.crc32(want.tobytes())
        at += len(want)
    assert token_codes.read_documents(token_codes.write_tokens(empty, path, end_id=2)).collect() == []


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_tokenizer(name, keeps):
    texts = [*TEXTS.values(), "  a", "a ", "a\tb", "é\u0301 x", "a\x1cb \x1c", "İstanbul ΣΑΣ ªº", "a\u2003 b", "x" * 300]
    flat, ends = Encoder(public_tokenizers.path(name), keeps).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert flat[ends[k] : ends[k + 1]].tolist() == tokens(name, text)


# the pipeline


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder)
        assert rows.dtypes == docs.dtypes
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert len({r.sequence_id for r in pieces}) >= 1 and all(r.length > 0 for r in pieces)
