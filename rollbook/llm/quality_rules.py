"""Quality rules: a learned decision list over text statistics, all in Spark expressions.

The statistics are expressions over the words and lines of a text. The list is learned by
sequential covering: a rule that rejects grows by the threshold condition of most information
gain on one part of the labelled rows, is pruned on the other part, and is kept while it is
precise enough there; the rows it covers go, and the next rule grows on the rest. Every step is
an aggregate of the labelled rows' bins, of which the driver gets one row for each feature and
bin. The list becomes one conditional expression, tried in order, that names the first rule
that fits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.tables import WORD, written

SYMBOLS = "#*$%&|<>"
#: A text fails without learning below so many words or above this share of repeated ones.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

#: Cuts of each feature: so many even shares of the labelled rows.
BINS = 40
MOST_RULES = 12
MOST_CONDITIONS = 4
#: A rule is kept if so large a share of what it covers in the pruning part is bad, and so much.
LEAST_PRECISION = 0.9
LEAST_COVERED = 3
#: Share of the covered bad rows beyond which a threshold may move.
OUTER = 0.02


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(_without(text, characters))).cast("long")


def _repeated(words: Column) -> Column:
    """Words that lie in a window of three that stands twice or more in the text."""

    def covered(windows: Column) -> Column:
        def same(x: Column, at: Column) -> Column:
            before, after = F.get(windows, at - 1)["h"], F.get(windows, at + 1)["h"]
            return x["h"].eqNullSafe(before) | x["h"].eqNullSafe(after)

        starts = F.sort_array(F.transform(F.filter(windows, same), lambda x: x["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            starts,
            zero,
            lambda s, i: F.struct(
                i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(3))).alias("n")
            ),
            lambda s: s["n"],
        )

    def window(at: Column) -> Column:
        three = [F.get(words, at + k) for k in range(3)]
        return F.struct(F.xxhash64(*three).alias("h"), at.alias("i"))

    many = F.size(words) >= 3
    places = F.when(many, F.sequence(F.lit(0), F.size(words) - 3))
    windows = F.sort_array(F.transform(places, window))
    return F.when(many, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def statistics(text: Column) -> Column:
    """A struct of counts of one text; a null text has no words, lines or characters."""
    text = F.coalesce(text, F.lit(""))

    def count(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
        blanks = " \t\n\x0b\x0c\r"

        def of_words(w: Column) -> Column:
            def of_lines(x: Column) -> Column:
                return F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(_without(t, blanks)).cast("long").alias("word_chars"),
                    _count(t, SYMBOLS).alias("n_symbols"),
                    (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                    _repeated(w).alias("n_repeat_words"),
                    F.size(x).cast("long").alias("n_lines"),
                    F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
                    _count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
                    _count(t, "0123456789").alias("n_digits"),
                    _count(t, ".,;:!?").alias("n_marks"),
                    _count(t, "!?").alias("n_calls"),
                )

            return let(lines, of_lines)

        return let(words, of_words)

    return let(text, count)


def base_failed(s: Column) -> Column:
    repeated = 100 * s["n_repeat_words"] > MOST_REPEATED_PERCENT * s["n_words"]
    return (s["n_words"] < LEAST_WORDS) | repeated


def features(s: Column) -> dict[str, Column]:
    """What conditions are about; every feature is a number, 0 where it would divide by 0."""

    def share(part: str, whole: str) -> Column:
        return F.when(s[whole] > 0, s[part] / s[whole]).otherwise(0.0)

    return {
        "words": s["n_words"].cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "capitals": share("n_capitals", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
        "calls_per_word": share("n_calls", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    """``feature`` is above (or not above) ``threshold``, the upper end of bin ``bin``."""

    feature: str
    place: int
    above: bool
    bin: int
    threshold: float

    def on_bins(self) -> Column:
        value = F.col("bins")[self.place]
        return value > self.bin if self.above else value <= self.bin

    def on(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    """How much a condition tells about badness, times the bad rows it keeps."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good)))


class _Learner:
    def __init__(self, binned: DataFrame, names: list[str], cuts: list[list[float]]) -> None:
        self.binned, self.names, self.cuts = binned, names, cuts
        self.rules: list[Rule] = []

    def _open(self, pruning: bool) -> DataFrame:
        covered = any_of([all_of([c.on_bins() for c in r]) for r in self.rules])
        return self.binned.where((F.col("pruning") == pruning) & ~covered)

    def _best(self, rule: Rule) -> Condition | None:
        rows = self._open(False).where(all_of([c.on_bins() for c in rule]))
        cells = rows.select("bad", F.posexplode("bins").alias("place", "bin"))
        counts = cells.groupBy("place", "bin").agg(
            F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")
        )
        found: dict[int, dict[int, tuple[int, int]]] = {}
        for place, bin_, bad, good in counts.collect():
            found.setdefault(place, {})[bin_] = (bad, good)
        best, most = None, 0.0
        for place, bins in sorted(found.items()):
            all_bad = sum(b for b, _ in bins.values())
            all_good = sum(g for _, g in bins.values())
            if not all_bad or not all_good:
                return None
            bad = good = 0
            for bin_, threshold in enumerate(self.cuts[place]):
                more = bins.get(bin_, (0, 0))
                bad, good = bad + more[0], good + more[1]
                for above in (False, True):
                    b, g = (all_bad - bad, all_good - good) if above else (bad, good)
                    gain = _gain(b, g, all_bad, all_good)
                    if gain > most + 1e-9 and b >= LEAST_COVERED:
                        most = gain
                        best = Condition(self.names[place], place, above, bin_, threshold)
        return best

    def _pruned(self, rule: Rule) -> Rule:
        """The beginning of ``rule`` that is most precise on the pruning part; empty if none is."""
        sums = []
        for size in range(1, len(rule) + 1):
            fits = all_of([c.on_bins() for c in rule[:size]])
            sums += [F.count_if(fits & (F.col("bad") == x)) for x in (1, 0)]
        counts = self._open(True).agg(*sums).first()
        best, most = (), -1.0
        for size in range(1, len(rule) + 1):
            bad, good = counts[2 * size - 2], counts[2 * size - 1]
            precision = bad / (bad + good) if bad >= LEAST_COVERED else 0.0
            if precision >= LEAST_PRECISION and bad - good / (1 - LEAST_PRECISION) > most:
                best, most = rule[:size], bad - good / (1 - LEAST_PRECISION)
        return best

    def _widened(self, rule: Rule) -> Rule:
        """Thresholds moved half way towards nearly all bad rows that the rule covers."""
        bad = self.binned.where(all_of([c.on_bins() for c in rule]) & (F.col("bad") == 1))
        ends = bad.agg(
            *(
                F.percentile_approx(F.col("values")[c.place], OUTER if c.above else 1 - OUTER)
                for c in rule
            )
        ).first()
        return tuple(
            replace(c, threshold=(c.threshold + end) / 2)
            for c, end in zip(rule, ends, strict=True)
        )

    def learn(self) -> list[Rule]:
        while len(self.rules) < MOST_RULES:
            rule: Rule = ()
            while len(rule) < MOST_CONDITIONS and (more := self._best(rule)):
                rule = (*rule, more)
            if not rule or not (kept := self._pruned(rule)):
                break
            self.rules.append(kept)
        return [self._widened(rule) for rule in self.rules]


def _bin(cuts: list[float], value: Column) -> Column:
    """Number of cuts that ``value`` is above."""
    return F.size(F.filter(F.lit(cuts), lambda cut: cut < value)) if cuts else F.lit(0)


def learn_rules(stats: DataFrame, labels: DataFrame, column: str = "stats") -> list[Rule]:
    """Rules that reject, in order, from the statistics of the rows that ``labels`` marks.

    ``stats`` needs ``doc_id`` and the struct ``column``; ``labels`` needs ``doc_id`` and
    ``quality`` (0: bad). Rows that the base rules reject, and labels that are null, are left
    out; several labels of one document count as bad if one is. Without good or bad rows no rule
    is learned.
    """
    marks = labels.where("doc_id is not null and quality is not null")
    marks = marks.groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    values = features(F.col(column))
    names = list(values)
    rows = (
        stats.where(~base_failed(F.col(column)))
        .select("doc_id", F.array(*values.values()).alias("values"))
        .join(marks, "doc_id")
    )
    rows = written(rows, "labelled")
    shares = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(
        *(F.percentile_approx(F.col("values")[i], shares, 10_000) for i in range(len(names)))
    ).first()
    cuts = [sorted(set(c or [])) for c in cuts]
    if not any(cuts):
        return []
    bins = [_bin(c, F.col("values")[i]) for i, c in enumerate(cuts)]
    binned = rows.select(
        "bad",
        "values",
        F.array(*bins).alias("bins"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning"),
    )
    return _Learner(written(binned, "binned"), names, cuts).learn()


def rejecting_rule(rules: list[Rule], stats: Column) -> Column:
    """Number of the first rule that fits, from 1; null if none does."""
    values = features(stats)
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(all_of([c.on(values) for c in rule]), F.lit(number)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``docs``; see ``statistics`` and ``learn_rules``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null or empty text has
    counts of 0 and fails the base rules. Repeated rows are judged each. An empty table gives
    no rows.
    """
    stats = written(docs.select("doc_id", statistics(F.col("text")).alias("stats")), "statistics")
    rules = learn_rules(stats, labels)
    s = F.col("stats")
    rule = rejecting_rule(rules, s)
    return stats.select(
        "doc_id",
        "stats.n_words",
        "stats.word_chars",
        "stats.n_symbols",
        "stats.n_dup_lines",
        "stats.n_repeat_words",
        base_failed(s).alias("base_failed"),
        (~base_failed(s) & rule.isNull()).alias("kept"),
        rule.alias("rule"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    name = "stats"
    while name in docs.columns:
        name += "_"
    rows = written(docs.withColumn(name, statistics(F.col("text"))), "statistics")
    rules = learn_rules(rows, labels, name)
    s = F.col(name)
    kept = ~base_failed(s) & rejecting_rule(rules, s).isNull()
    return rows.where(kept).select(*docs.columns)
