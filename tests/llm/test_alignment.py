"""Token alignment against brute force on odd texts, and both joins of the pair counts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rollbook.llm import alignment
from rollbook.llm.tokens import byte_level_bytes, encoder, piece_bytes, piece_encoder

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = "doc_id long, text string, a int, n_a string, pairs string"
_SIGNS = list("ab  \n\t.,'é漢😀▁ 　<s>0123ABab<|endoftext|>\r\x00́")
_RNG = np.random.default_rng(11)
TEXTS = [
    None,
    "",
    " ",
    "one. Two\nthree <|endoftext|> it's\n\nfour ",
    "one. Two\nthree <|endoftext|> it's\n\nfour ",
    "<s> and </s> and <unk>",
    "a▁b",  # not given back byte by byte
    "a" * 700,  # token ends that rarely meet
    " ".join(["long"] * 3000) + "y" * 3000,
    *("".join(_RNG.choice(_SIGNS, _RNG.integers(1, 40))) for _ in range(300)),
]


@pytest.fixture(scope="module")
def vocabularies():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, SentencePieceProcessor(model_file=B), byte_level_bytes(A), piece_bytes(B)


def brute(text, vocabularies):
    """n_a, n_b, groups and links of a text, by sets of byte offsets."""
    tokenizer, pieces, a_bytes, b_bytes = vocabularies
    sides = [[], []]
    if text:
        sides = [tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)]
        tables = (a_bytes, b_bytes)
        if any(b"".join(t[i] for i in s) != f" {text}".encode() for s, t in zip(sides, tables)):
            sides = [[], []]
    ends = [np.cumsum([len(t[i]) for i in s]).tolist() for s, t in zip(sides, (a_bytes, b_bytes))]
    both = set(ends[0]) & set(ends[1])
    groups = [[], []]
    for side in (0, 1):
        part = []
        for token, end in zip(sides[side], ends[side]):
            part.append(token)
            if end in both:
                groups[side].append(part)
                part = []
    groups = list(zip(*groups, strict=True))
    links = Counter((x, y) for left, right in groups for x in left for y in right)
    return len(sides[0]), len(sides[1]), groups, links


def shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def test_encoders_give_the_libraries_ids(vocabularies):
    tokenizer, pieces, _, _ = vocabularies
    texts = pa.array([x or "" for x in TEXTS])
    ours, at = encoder(A, True, True).encode(texts)
    theirs, to = piece_encoder(B).encode(texts)
    for i, text in enumerate(texts.to_pylist()):
        assert pieces.encode(text) == theirs[to[i] : to[i + 1]].tolist()
        if text:
            want = tokenizer.encode(" " + text, add_special_tokens=False).ids
            assert want == ours[at[i] : at[i + 1]].tolist()


def test_alignment_by_brute_force(spark, vocabularies, monkeypatch):
    monkeypatch.setattr(alignment, "ROW_PAIRS", 7)  # many rows for one text
    rows = [(k if k else None, x, 1, "x", None) for k, x in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    aligned = alignment.align_texts(docs, A, B)
    want = {k or None: brute(x, vocabularies) for k, x in enumerate(TEXTS)}
    counts = Counter(pair for *_, links in want.values() for pair in links)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    for most in (10**6, 0):  # both joins
        got = alignment.link_scores(aligned, most).collect()
        assert len(got) == len(TEXTS)
        for row in got:
            n_a, n_b, groups, links = want[row.doc_id]
            assert (row.n_a, row.n_b, row.n_groups) == (n_a, n_b, len(groups))
            assert row.groups == shown(groups)
            digest = hashlib.sha256(shown(groups).encode()).hexdigest() if groups else ""
            assert row.groups_sha256 == digest
            assert row.n_links == sum(links.values())
            assert row.n_best == sum(n for p, n in links.items() if counts[p] == best[p[0]])
            assert row.count_sum == sum(n * counts[p] for p, n in links.items())


def test_groups_with_many_links_are_counted_by_id(monkeypatch):
    a = np.array([1, 1, 2, 3], np.uint32)
    b = np.array([5, 6, 6, 7], np.uint32)
    ends = np.array([0, 3, 4]), np.array([0, 3, 4])
    plain = alignment._pairs(a, ends[0], b, ends[1])
    monkeypatch.setattr(alignment, "PAIRED", 2)
    counted = alignment._pairs(a, ends[0], b, ends[1])

    def summed(found):
        out = Counter()
        for group, key, links in zip(*(x.tolist() for x in found)):
            out[group, key] += links
        return out

    assert summed(plain) == summed(counted)
    assert summed(plain)[0, 1 << 32 | 6] == 4


def test_memory_of_windows_starts_anew(vocabularies, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    aligner = alignment.Aligner(*vocabularies[2:])
    for text in TEXTS[3:9]:
        out = alignment._rows(aligner, encoder(A, True, True), piece_encoder(B), pa.array([text]), True)
        assert (out["groups"][0].as_py() or "") == shown(brute(text, vocabularies)[2])


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    aligned = alignment.align_texts(docs, A, B, keep_groups=False)
    assert alignment.link_scores(aligned).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    got = alignment.link_scores(alignment.align_texts(docs, A, B)).select(F.col("n_links") + F.col("n_best"))
    assert [x[0] for x in got.collect()] == [0, 0]
