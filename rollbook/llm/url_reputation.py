"""URL filters: fixed rules, and the reputation of hosts by an empirical Bayes hierarchy.

A page's outcome is told by its own main text: it is bad if the quality rules reject the text or
it is toxic, both as learned from labelled documents. A host's pages with an outcome are few, so
its share of good pages is drawn towards its registered domain's, that towards its suffix's, and
that towards all pages'. How strongly is estimated at each level from the counts themselves: with
the beta-binomial overdispersion ``rho`` of the children around their parents, a parent counts as
``1 / rho - 1`` pages. A host is allowed if the lower bound of its posterior share of good pages
is high enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm import quality_rules, toxicity
from rollbook.llm.page_text import extract_pages
from rollbook.llm.tables import written

#: A host is allowed if its share of good pages is at least this, in ``1 - TAIL`` of the cases.
LEAST_GOOD = 0.5
#: Standard deviations below the mean for a tail of one in twenty.
DEVIATIONS = 1.645
LEAST_RHO, MOST_RHO = 1e-4, 0.95
#: Labelled documents that rules and word weights are learned from, about, if there are more.
LABELLED = 20_000
#: Labels that, before a country's two letters, are part of the suffix (``co.uk``, ``gob.mx``);
#: fixed values.
SECOND_LABELS = tuple(
    "ab ac ad art asso biz co com ed edu firm gen go gob gouv gov govt gr gub id ind inf info "
    "jus k12 lg ltd me mil mod muni ne net nhs nic nom or org plc police pro sch school web".split()
)


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains if a url's path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | host.endswith(f".{self.host}")
        return inside & path.startswith(self.path)


#: Block and allow rules of the query; fixed values.
RULES = (
    UrlRule("block", "net"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _UPPER.lower())
    return F.coalesce(found, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and closing dot, as reputations are kept by."""
    bare = F.regexp_replace(host, r"(?s)^.*@", "")
    return F.regexp_replace(bare, r":[0-9]*$|\.$|\.:[0-9]*$", "")


def _address(name: Column) -> Column:
    """Whether a name is an IP address; such a name is its own domain and suffix."""
    return name.rlike(r"^(?:\[.*\]|[0-9]+(?:\.[0-9]+){3})$")


def _labels_of_suffix(name: Column) -> Column:
    country = F.substring_index(name, ".", -1).rlike("^[a-z]{2}$")
    second = F.substring_index(F.substring_index(name, ".", -2), ".", 1)
    return F.when(country & second.isin(*SECOND_LABELS), 2).otherwise(1)


def _last(name: Column, labels: Column) -> Column:
    parts = F.split(name, r"\.")
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - labels + 1), labels)
    return F.when(_address(name), name).otherwise(F.array_join(last, "."))


def suffix_of(name: Column) -> Column:
    """The last label, or two where a country keeps second labels for kinds of owners."""
    return _last(name, _labels_of_suffix(name))


def domain_of(name: Column) -> Column:
    """The suffix and one label before it."""
    return _last(name, _labels_of_suffix(name) + 1)


def first_rule(rules: tuple[UrlRule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = rule.fits(host, path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _strength(children: DataFrame) -> float:
    """Pages that a parent's mean ``m`` counts for, from children's ``n`` and ``good``."""
    spread = F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("m"), 2)
    n, units, chi = (
        children.where("n > 0 and m > 0 and m < 1")
        .agg(F.sum("n"), F.count(F.lit(1)), F.sum(spread / (F.col("m") * (1 - F.col("m")))))
        .first()
    )
    if not units or n <= units:
        return 1 / MOST_RHO - 1
    rho = min(MOST_RHO, max(LEAST_RHO, (chi - units) / (n - units)))
    return 1 / rho - 1


def _shrunk(strength: float) -> Column:
    return (F.col("good") + F.lit(strength) * F.col("m")) / (F.col("n") + F.lit(strength))


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """name (of the host) and good of every row of ``pages`` (url, html); see ``name_of``.

    ``good`` is 1 if the page's main text passes the base and learned quality rules and is not
    toxic, else 0, and null for a page without main text. The rules and the word weights are
    learned from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality, toxic)
    marks, of which about ``LABELLED`` are chosen by a hash of their ids; characters are counted
    in those and in the texts of all pages.
    """
    marked = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    marked = marked.select("doc_id").distinct()
    share = min(1.0, LABELLED / max(1, marked.count()))
    marked = marked.where(F.xxhash64("doc_id") <= int(2**64 * share) - 2**63 - 1)
    learned = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id", "left_semi")
    learned = written(learned, "labelled_texts")
    stats = learned.select("doc_id", quality_rules.statistics(F.col("text")).alias("stats"))
    rules = quality_rules.learn_rules(stats, labels)

    # Tasks may come again on another executor, so that the texts are read from a table.
    name = name_of(host_of(F.col("url"))).alias("name")
    found = extract_pages(pages.withColumn("page_id", F.lit(None).cast("long")))
    texts = written(found.select(name, "text"), "page_texts")
    no_ids = texts.select(F.lit(None).cast("long").alias("doc_id"), "text")
    every = learned.select(F.col("doc_id").cast("long"), "text").unionByName(no_ids)
    model = toxicity.learn(every, labels)

    s = F.col("stats")
    passed = ~quality_rules.base_failed(s) & quality_rules.rejecting_rule(rules, s).isNull()
    rows = texts.withColumn("stats", quality_rules.statistics(F.col("text")))
    rows = rows.select("name", "text", passed.alias("passed"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("text").to_pylist(), batch.column("passed").to_pylist(), strict=True)
            good = [int(ok and model.score(text) < 0.5) if text else None for text, ok in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), pa.array(good, pa.int32())], ["name", "good"]
            )

    return rows.mapInArrow(mark, "name string, good int")


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """name, n (pages with an outcome), good, mean and lower bound of the share of good pages.

    ``outcomes`` has a row for each page: ``name`` of its host and ``good`` (1, 0 or null).
    Without any outcome every mean is one half and its bound that of a single page.
    """
    hosts = outcomes.groupBy("name").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    name = F.col("name")
    hosts = hosts.withColumns({"domain": domain_of(name), "suffix": suffix_of(name)})
    hosts = written(hosts, "hosts")
    counts = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = hosts.agg(*counts).first()
    overall = (good + 1) / (n + 2) if n else 0.5

    suffixes = hosts.groupBy("suffix").agg(*counts).withColumn("m", F.lit(overall))
    known = suffixes.select("suffix", _shrunk(_strength(suffixes)).alias("m"))
    domains = hosts.groupBy("domain", "suffix").agg(*counts).join(known, "suffix")
    domains = written(domains, "domains")
    known = domains.select("domain", _shrunk(_strength(domains)).alias("m"))
    placed = hosts.join(known, "domain")
    strength = _strength(placed)
    a = F.col("good") + F.lit(strength) * F.col("m")
    total = F.col("n") + F.lit(strength)
    mean = a / total
    deviation = F.sqrt(mean * (1 - mean) / (total + 1))
    lower = F.greatest(F.lit(0.0), mean - DEVIATIONS * deviation)
    return placed.select("name", "n", "good", mean.alias("mean"), lower.alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row of ``pages``.

    A rule that fits decides; else the reputation that ``outcomes`` (see ``page_outcomes``) give
    the host; a host that they do not name is blocked. A url that is null or has no ``://``
    has an empty host and path, and such pages together are one host. Repeated rows are judged each; other columns are not read. An empty table gives no rows.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = first_rule(rules, F.col("host"), F.col("path"))
    known = host_reputation(outcomes).select("name", "lower")
    own = F.when(F.col("lower") >= LEAST_GOOD, "allow").otherwise("block")
    named = rows.withColumn("name", name_of(F.col("host")))
    return named.join(known, "name", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict")
    )
