"""Toxicity of texts whose words may be disguised, by a noisy channel and learned word weights.

Suspicious stretches of a text (letters mixed with look-alike digits and signs, runs of one
letter, single letters set apart) become lattices: every character stands for itself, for the
letters it looks like, or, between letters, for nothing; a run may be shorter. The best path
under a character trigram model with channel costs replaces the stretch. The restored text is
scored by logistic regression on how often chosen words and word beginnings stand in it.
"""

from __future__ import annotations

import logging
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.samples import labelled_texts
from rollbook.llm.tables import written

#: Labelled texts of each kind that are learned from at most.
PER_LABEL = 3000
MOST_FEATURES = 600
#: Toxic texts of the sample that a chosen word or beginning stands in.
LEAST_TEXTS = 3
#: Lengths of the word beginnings that are counted beside whole words.
BEGINNINGS = (4, 5, 6)
#: Characters that are counted together, and n-grams that a task holds before it gives them on.
CHARACTERS_AT_ONCE = 1 << 20
GRAMS_AT_ONCE = 1 << 21
#: Costs of trigrams, and readings of stretches of at most so many characters, that a task remembers.
KNOWN_COSTS = 1 << 18
KNOWN_STRETCHES, LONG_STRETCH = 100_000, 64

#: What signs and digits look like; fixed values.
LOOKS = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
}
#: Signs that may stand between the letters of one word.
FILLERS = " .-_*"
COST_LOOK, COST_DROP, COST_SHORTER, COST_KEEP_SIGN = 0.7, 0.9, 0.5, 3.0

_LETTER = r"[^\W\d_]"
_MIXED = re.compile(
    rf"(?<![\w@$!|+])(?:{_LETTER}+(?:[0134578@$!|+]{{1,2}}|[.*_-]){_LETTER}|[01345@$!|]{_LETTER})"
    rf"(?:{_LETTER}|[0134578@$!|+](?![@$!|+]{{2}})|[*_-](?={_LETTER}))*"
    rf"|(?<![\w@$!|+]){_LETTER}{{2,}}[@$]{{1,2}}(?![\w@$])"
)
_RUN = re.compile(rf"(?<!{_LETTER}){_LETTER}*({_LETTER})\1\1{_LETTER}*")
_APART = re.compile(rf"(?<!\w)[\w@$!|](?:[ .\-_*]{{1,2}}[\w@$!|](?!\w)){{2,}}")
#: What a text must have for the patterns above to find anything; these are quick to look for.
_ANY_MIXED = re.compile(rf"[0134578@$!|+]|{_LETTER}[.*_-]{_LETTER}")
_ANY_RUN = re.compile(rf"({_LETTER})\1\1")
_ANY_APART = re.compile(r"[ .\-_*][\w@$!|][ .\-_*]{1,2}[\w@$!|](?!\w)")
_WORDS = re.compile(rf"{_LETTER}+")

_NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)
_LOG = logging.getLogger(__name__)

SCORED = "doc_id long, score double, predicted int"


def _added(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once, ascending, with the sum of its counts."""
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(points: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of size 1 to 3 that end behind the first ``fresh`` code points; none holds a 0."""
    letters, places = np.unique(points, return_inverse=True)
    size = len(letters)
    keys, n = [], []
    codes = at = np.zeros(len(points), np.int64)
    for length in (1, 2, 3):
        codes = places if length == 1 else at[:-1] * size + places[length - 1 :]
        at = codes
        new = codes[max(0, fresh - length + 1) :]
        if size**length <= 1 << 22:
            many = np.bincount(new, minlength=1)
            some = np.flatnonzero(many)
            many = many[some]
        else:
            some, many = np.unique(new, return_counts=True)
        gram, whole, rest = np.zeros(len(some), np.int64), np.ones(len(some), bool), some
        for shift in range(length):
            rest, last = np.divmod(rest, size)
            gram |= letters[last].astype(np.int64) << 21 * shift
            whole &= letters[last] > 0
        keys.append(gram[whole])
        n.append(many[whole])
    return np.concatenate(keys), np.concatenate(n)


def count_grams(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Character n-grams of size 1 to 3 of the texts' words, as numbers, and how often they occur.

    A number has 21 bits for each character, the last one lowest. An n-gram may come again after
    ``GRAMS_AT_ONCE`` others, so that the memory is bounded.
    """
    held = _NONE
    plain, size = [], 0

    def take() -> None:
        nonlocal held, size
        data = "\0".join(plain).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(data, np.uint32)
        for begin in range(0, len(points), CHARACTERS_AT_ONCE):
            before = min(2, begin)
            part = points[begin - before : begin + CHARACTERS_AT_ONCE]
            both = zip(held, _counted(part, before), strict=True)
            held = _added(*map(np.concatenate, both))
        plain.clear()
        size = 0

    for text in texts:
        plain.append(" " + " ".join(_WORDS.findall(text.lower())) + " ")
        size += len(plain[-1]) + 1
        if size >= CHARACTERS_AT_ONCE:
            take()
            if len(held[0]) >= GRAMS_AT_ONCE:
                yield held
                held = _NONE
    if plain:
        take()
    if len(held[0]):
        yield held


class CharacterModel:
    """Trigram model of letters and blanks, smoothed by bigrams and single characters."""

    def __init__(self, texts: Iterable[str] = ()) -> None:
        parts = list(count_grams(texts))
        self._set(*(map(np.concatenate, zip(*parts, strict=True)) if parts else _NONE))

    def _set(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams, self.counts = _added(grams, counts)
        self.total = int(self.counts[: np.searchsorted(self.grams, 1 << 21)].sum())
        self.known: dict[str, float] = {}

    @classmethod
    def of(cls, docs: DataFrame) -> CharacterModel:
        """A model of all texts of ``docs``, counted in the tasks."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = (text for batch in batches for text in batch.column("text").to_pylist())
            for part in count_grams(texts):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["gram", "n"])

        texts = docs.select("text").where("text is not null")
        grams = texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        grams = written(grams, "character_grams")
        size = grams.count()
        _LOG.info("character model: %d n-grams, %d bytes to each task", size, 16 * size)
        rows = grams.toArrow()
        out = cls()
        out._set(rows["gram"].to_numpy(), rows["n"].to_numpy())
        return out

    def count(self, gram: str) -> int:
        key = 0
        for c in gram:
            key = key << 21 | ord(c)
        place = int(self.grams.searchsorted(key))
        return int(self.counts[place]) if place < len(self.grams) and self.grams[place] == key else 0

    def cost(self, before: str, next_: str) -> float:
        """Negative logarithm of the chance of a character behind two others."""
        key = before + next_
        if (out := self.known.get(key)) is None:
            low = (self.count(next_) + 0.1) / (self.total + 30)
            middle = (self.count(key[1:]) + 2 * low) / (self.count(before[1:]) + 2)
            high = (self.count(key) + 2 * middle) / (self.count(before) + 2)
            if len(self.known) >= KNOWN_COSTS:
                self.known.clear()
            out = self.known[key] = -math.log(high)
        return out


def lattice(stretch: str) -> Iterator[list[tuple[str, float]]]:
    """Readings of each part of a lower-cased stretch, with their costs.

    Parts are signs, runs of three equal letters or more, and plain letters; of many plain letters
    all behind the second are one part, as they are read in one way.
    """
    at, size = 0, len(stretch)
    while at < size:
        c, end = stretch[at], at + 1
        if not c.isalpha():
            readings = [(x, COST_LOOK) for x in LOOKS.get(c, "")]
            readings += [("", COST_DROP), (" ", 0.0)] if c in FILLERS else [(" ", COST_KEEP_SIGN)]
            yield readings
        elif stretch.startswith(c * 3, at):
            while end < size and stretch[end] == c:
                end += 1
            yield [(c, COST_SHORTER), (c * 2, COST_SHORTER)]
        else:
            while end < size and stretch[end].isalpha() and not stretch.startswith(stretch[end] * 3, end):
                end += 1
            for part in (stretch[at], stretch[at + 1 : min(at + 2, end)], stretch[at + 2 : end]):
                if part:
                    yield [(part, 0.0)]
        at = end


def _spelled(path: tuple) -> str:
    """The readings of a path, which is a pair of the path before and the last reading."""
    parts = []
    while path:
        path, reading = path
        parts.append(reading)
    return "".join(reversed(parts))


def decode(stretch: str, model: CharacterModel) -> str:
    """The best path through the lattice of a stretch (Viterbi over the last two letters).

    Paths share their beginnings, so time and memory are linear in the stretch. Where only one
    path is left and one reading follows, its cost adds to all alike and is not asked for.
    """
    best: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
    for readings in chain(lattice(stretch), [[(" ", 0.0)]]):
        if len(best) == len(readings) == 1 and " " not in readings[0][0]:
            (state, (cost, path)), (reading, extra) = *best.items(), *readings
            best = {(state + reading)[-2:]: (cost + extra, (path, reading))}
            continue
        after: dict[str, tuple[float, tuple]] = {}
        for state, (cost, path) in best.items():
            for reading, extra in readings:
                total, last = cost + extra, state
                for c in reading:
                    if c == " " and last[1] == " ":
                        continue
                    total += model.cost(last, c)
                    last = last[1] + c
                if last not in after or total < after[last][0]:
                    after[last] = (total, (path, reading))
        best = after
    return min((cost, _spelled(path)) for cost, path in best.values())[1][:-1]


@dataclass
class Model:
    characters: CharacterModel
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self._decode = None
        self._starts = {f.lstrip("=")[: BEGINNINGS[0]] for f in self.weights}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_decode": None}

    def restore(self, text: str) -> str:
        """Lower-cased text with its suspicious stretches replaced by their best readings."""
        if self._decode is None:
            self._decode = lru_cache(KNOWN_STRETCHES)(lambda s: decode(s, self.characters))

        def read(found: re.Match) -> str:
            stretch = found[0]
            short = len(stretch) <= LONG_STRETCH
            return self._decode(stretch) if short else decode(stretch, self.characters)

        text = text.lower()
        for some, pattern in ((_ANY_APART, _APART), (_ANY_MIXED, _MIXED), (_ANY_RUN, _RUN)):
            if some.search(text):
                text = pattern.sub(read, text)
        return text

    def score(self, text: str | None) -> float:
        """0 to 1; an empty text has the score of the bias alone."""
        words = _WORDS.findall(self.restore(text or ""))
        starts = self._starts
        some = [word for word in words if word[: BEGINNINGS[0]] in starts]
        total = self.bias
        for feature, value in values(some, len(words)).items():
            total += self.weights.get(feature, 0.0) * value
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def values(words: list[str], size: int) -> dict[str, float]:
    """How much of a text of ``size`` words each word (``=word``) or beginning makes up, at most 1.

    One word in a hundred or more counts as 1.
    """
    out: dict[str, float] = defaultdict(float)
    for word, n in Counter(words).items():
        out["=" + word] += n
        for k in BEGINNINGS:
            if len(word) > k:
                out[word[:k]] += n
    return {feature: min(1.0, 100 * n / size) for feature, n in out.items()}


def fit(
    sample: list[tuple[int, str]],
    shares: dict[int, float],
    characters: CharacterModel | None = None,
) -> Model:
    """Learn from (toxic 0 or 1, text); ``shares`` are the two kinds' shares of all labelled rows.

    Words are restored by ``characters``, or by a character model of the sample. Without texts of both kinds every score is the share of toxic ones, or one half.
    """
    if characters is None:
        characters = CharacterModel(text for _, text in sample)
    base = min(max(shares.get(1, 0.0) if shares else 0.5, 1e-3), 1 - 1e-3)
    empty = Model(characters, {}, math.log(base / (1 - base)))
    labels = np.array([label for label, _ in sample])
    if len(set(labels.tolist())) < 2:
        return empty
    texts = [empty.restore(text) for _, text in sample]

    def row(text: str) -> dict[str, float]:
        words = _WORDS.findall(text)
        return values(words, len(words))

    often: Counter[str] = Counter()
    for label, text in zip(labels.tolist(), texts, strict=True):
        if label:
            often.update(row(text).keys())
    # For each feature the sum and the sum of squares of its values among the two kinds.
    sums = {feature: [0.0] * 4 for feature, count in often.items() if count >= LEAST_TEXTS}
    del often
    for label, text in zip(labels.tolist(), texts, strict=True):
        for feature, value in row(text).items():
            if (entry := sums.get(feature)) is not None:
                entry[label] += value
                entry[2 + label] += value * value
    n = np.bincount(labels, minlength=2)

    def strength(entry: list[float]) -> float:
        means = entry[0] / n[0], entry[1] / n[1]
        spread = sum((entry[2 + k] / n[k] - means[k] ** 2 + 1e-3) / n[k] for k in (0, 1))
        return (means[1] - means[0]) / math.sqrt(spread)

    ranked = sorted(
        ((-strength(e), f) for f, e in sums.items() if e[1] * n[0] > e[0] * n[1])
    )
    chosen = [f for _, f in ranked[:MOST_FEATURES]]
    place = {f: k for k, f in enumerate(chosen)}
    x = np.zeros((len(texts), len(chosen)))
    for i, text in enumerate(texts):
        for feature, value in row(text).items():
            if feature in place:
                x[i, place[feature]] = value
    each = np.array([shares[int(k)] / n[k] for k in labels])
    weights, bias = np.zeros(len(chosen)), math.log(base / (1 - base))
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, 401):
        error = each * (labels - 1 / (1 + np.exp(-(x @ weights + bias))))
        slope = np.append(x.T @ error - 2e-5 * weights, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, bias = np.maximum(weights + move[:-1], 0.0), bias + move[-1]
    used = {f: float(w) for f, w in zip(chosen, weights, strict=True) if w > 1e-3}
    return Model(characters, used, float(bias))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the texts of ``docs`` that ``labels`` (doc_id, toxic) marks 0 or 1.

    Its character model is of all texts of ``docs``, with or without a label.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    counts = {row["label"]: row["count"] for row in marks.groupBy("label").count().collect()}
    shares = {label: n / sum(counts.values()) for label, n in counts.items()}
    return fit(labelled_texts(docs, marks, PER_LABEL, 2), shares, CharacterModel.of(docs))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (1 if score >= 0.5) of every row, from the whole text alone.

    A null text counts as empty. Repeated rows are scored each; an empty table gives no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(x >= 0.5) for x in scores], pa.int32()),
                ],
                ["doc_id", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(score, SCORED)
