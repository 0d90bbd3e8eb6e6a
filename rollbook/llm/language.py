"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier on hashed byte n-grams is trained for each
bit. A text gets the language whose codeword its bits' margins miss least, each bit weighed by
how well it tells that language on the sample. A text that two codewords miss nearly as little is
flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.samples import labelled_texts
from rollbook.llm.words import slices
from rollbook.llm.workers import give_back, giving_back

#: Texts of each language that are learned from at most; fewer if all languages' would be more
#: than ``TEXTS``, but not fewer than ``LEAST_PER_LANGUAGE``. No language is left out.
PER_LANGUAGE, LEAST_PER_LANGUAGE = 500, 20
TEXTS = 20_000
#: Texts whose features are dense together, and numbers of a table of losses.
DENSE_TEXTS = 4096
LOSSES = 1 << 22
BUCKETS = 1 << 13
SIZES = (1, 2, 3, 4)
STEPS = 120
RATE = 60.0
#: Difference of the two least losses below which a text is ambiguous.
AMBIGUOUS = 0.05
UNKNOWN = "und"

PREDICTED = "doc_id long, lang_pred string, score double, ambiguous boolean"
_GAPS = re.compile(r"[\W\d_]+")


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of the letters, blanks between words."""
    plain = " " + _GAPS.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(plain.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.float32)
    hashed = np.zeros(len(points), np.uint32)
    for size in range(1, max(SIZES) + 1):
        if len(points) < size:
            break
        hashed = hashed[: len(points) - size + 1] * np.uint32(0x01000193) + points[size - 1 :]
        if size in SIZES:
            spread = (hashed + np.uint32(size)) * np.uint32(0x9E3779B1)
            out += np.bincount(spread >> np.uint32(32 - 13), minlength=BUCKETS)
    return np.sqrt(out / max(1.0, float(out.sum())))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(languages: int, seed: int = 4) -> np.ndarray:
    """One row of +1 and -1 for each language: all splits of up to five, else random ones, of
    which the set with the greatest least distance of many is taken."""
    if languages <= 5:
        bits = range(1, 2 ** max(0, languages - 1))
        rows = [[-1 if k and b >> (k - 1) & 1 else 1 for b in bits] for k in range(languages)]
        return np.array(rows, np.float32).reshape(languages, len(bits))
    draw = np.random.default_rng(seed)
    length, best, most = int(np.ceil(10 * np.log2(languages))), None, -1
    for _ in range(200):
        rows = draw.choice(np.array([-1, 1], np.float32), (languages, length))
        if (np.abs(rows.sum(0)) == languages).any():
            continue
        likeness = rows @ rows.T - 2 * length * np.eye(languages)
        if (apart := int(length - likeness.max())) > most:
            best, most = rows, apart
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighed exponential loss of each text (row) with each language's codeword."""
        margins = np.clip(x @ self.weights + self.bias, -6, 6)
        misses = np.exp(-margins[:, None, :] * self.codes[None])
        return (misses * self.trust[None]).sum(2)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        step = max(1, min(256, LOSSES // max(1, self.codes.size)))
        for begin in range(0, len(known), step):
            part = known[begin : begin + step]
            losses = self.losses(np.stack([features(texts[i]) for i in part]))
            order = np.argsort(losses, axis=1, kind="stable")
            chance = np.exp(losses.min(1, keepdims=True) - losses)
            for i, row, first, share in zip(part, losses, order, chance, strict=True):
                names[i] = self.languages[first[0]]
                scores[i] = float(1 / share.sum())
                unsure[i] = len(first) > 1 and bool(row[first[1]] - row[first[0]] < AMBIGUOUS)
        return names, scores, unsure

    def judged(self, texts: pa.Array) -> tuple[list[str], list[float], list[bool]]:
        """``predict`` for a column, of which one slice at a time is turned into strings."""
        out: tuple[list[str], list[float], list[bool]] = ([], [], [])
        for part in slices(texts):
            for column, found in zip(out, self.predict(part.to_pylist()), strict=True):
                column += found
        return out


class Rows:
    """Features of texts, sparse; dense for ``DENSE_TEXTS`` of them at once."""

    def __init__(self, texts: list[str]) -> None:
        self.cells: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            row = features(text)
            at = np.flatnonzero(row).astype(np.uint16)
            self.cells.append((at, row[at]))
        few = len(texts) <= DENSE_TEXTS
        self.whole = [(slice(0, len(texts)), self.dense(0, len(texts)))] if few else None

    def dense(self, begin: int, end: int) -> np.ndarray:
        cells = self.cells[begin:end]
        out = np.zeros((len(cells), BUCKETS), np.float32)
        for row, (at, numbers) in zip(out, cells, strict=True):
            row[at] = numbers
        return out

    def parts(self) -> Iterator[tuple[slice, np.ndarray]]:
        if self.whole is not None:
            yield from self.whole
            return
        for begin in range(0, len(self.cells), DENSE_TEXTS):
            yield slice(begin, begin + DENSE_TEXTS), self.dense(begin, begin + DENSE_TEXTS)


def fit(sample: list[tuple[str, str]]) -> Model:
    """Train one classifier for each bit by logistic regression; empty without samples."""
    sample = [(lang, text) for lang, text in sample if has_letter(text)]
    languages = sorted({lang for lang, _ in sample})
    codes = codewords(len(languages))
    bits = codes.shape[1]
    weights, bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    if not bits:
        return Model(languages, codes, weights, bias, np.ones((len(languages), 0), np.float32))
    rows = Rows([text for _, text in sample])
    place = {lang: k for k, lang in enumerate(languages)}
    labels = np.array([place[lang] for lang, _ in sample])
    y = codes[labels]
    each = 1.0 / np.bincount(labels, minlength=len(languages))[labels][:, None] / len(languages)
    for _ in range(STEPS):
        pull, total = 0.0, 0.0
        for part, x in rows.parts():
            slope = each[part] * y[part] / (1 + np.exp(y[part] * (x @ weights + bias)))
            pull, total = pull + x.T @ slope, total + slope.sum(0)
        weights += np.float32(RATE) * (pull - 1e-5 * weights).astype(np.float32)
        bias += np.float32(RATE / 20) * total.astype(np.float32)
    right = np.concatenate([(x @ weights + bias) * y[part] > 0 for part, x in rows.parts()])
    trust = np.stack([right[labels == k].mean(0) for k in range(len(languages))]) + 1e-6
    return Model(languages, codes, weights, bias, trust / trust.sum(1, keepdims=True))


def learn(docs: DataFrame, learned_from: Column) -> Model:
    """A model from the texts and non-null ``lang`` of the rows for which ``learned_from`` holds."""
    marks = docs.where(learned_from & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.select("doc_id", F.col("lang").alias("label"))
    languages = marks.select("label").distinct().count()
    each = max(LEAST_PER_LANGUAGE, min(PER_LANGUAGE, TEXTS // max(1, languages)))
    return fit(labelled_texts(docs, marks, each, languages))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous of every row, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0 and ambiguous, and so is every
    text if nothing was learned. Repeated rows are judged each; an empty table gives no rows.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, unsure = model.judged(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(unsure, pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(giving_back(predict), PREDICTED)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a language, all columns kept; ``und`` and ambiguous ones go.

    Only texts go to Python, and one boolean for each comes back.
    """

    def known(texts: pa.Array) -> pa.Array:
        names, _, unsure = model.judged(texts)
        good = [n != UNKNOWN and not u for n, u in zip(names, unsure, strict=True)]
        return pa.array(good, pa.bool_())

    @F.arrow_udf("boolean")
    def keep(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(known, columns)
        give_back()

    return docs.where(keep("text"))
