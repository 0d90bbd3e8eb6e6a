"""Time the headline jobs on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks.compare import session  # noqa: E402
from checks.fixtures import CONTRACT, registration, table  # noqa: E402
from checks.quality_queries import _thresholds  # noqa: E402
from rollbook.operators import breakdown, distribution, filters, profile, ranking  # noqa: E402
from rollbook.operators.clean import clean  # noqa: E402
from rollbook.operators.validate import gate  # noqa: E402
from rollbook.plans import pages  # noqa: E402
from rollbook.plans.quality import quality  # noqa: E402
from rollbook.registration import FILTERS  # noqa: E402
from rollbook.sources.delimited import read_raw  # noqa: E402
from rollbook.sources.files import fingerprints  # noqa: E402
from rollbook.staging import shared_folder, stage, together  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
# Pages are asked for again and again, so they run once to warm up and then count the best of
# three; the load runs once.
REPEATS = 3


def run(*results: DataFrame) -> None:
    """Compute whole results, as a page asks for them: all at once. Each is a small aggregate."""
    together(*(df.collect for df in results))


def main() -> None:
    spark = session(CORES)
    spark.sparkContext.setLogLevel("ERROR")
    scratch = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    source, stored = f"{scratch}/csv", f"{scratch}/clean"
    writer = registration(spark, FOLDER).repartition(int(CORES)).write.option("header", True)
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(source)
    times: dict[str, float] = {}

    def timed(name: str, job: Callable[[], object], repeats: int = 1) -> None:
        best = float("inf")
        for _ in range(repeats):
            start = time.perf_counter()
            job()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)

    # The load, step by step: first in a new session, then again when it is warm.
    bounds = _thresholds(spark)

    def full_quality() -> None:
        page = quality(spark.read.parquet(stored), bounds)
        run(page.metrics, page.missingness, page.checks, page.verdict)

    def clean_write() -> None:
        raw = read_raw(spark, source, CONTRACT, check=False)
        clean(raw, CONTRACT, validate=False).write.mode("overwrite").parquet(stored)

    steps = {
        "validate": lambda: gate(read_raw(spark, source, CONTRACT), CONTRACT),
        "clean_write": clean_write,
        "quality": full_quality,
        "fingerprint": lambda: fingerprints(spark, source).collect(),
    }
    for kind, repeats in (("cold", 1), ("load", REPEATS)):
        for name, step in steps.items():
            timed(f"{kind}_{name}", step, repeats)
    full = spark.read.parquet(stored)

    # Page interactions on the stored clean table, each computed from it in full.
    selection = filters.default_selection(full, FILTERS)
    home = filters.apply_filters(full, FILTERS, selection)

    def overview() -> None:
        page = pages.overview(home)
        run(page.headline, page.model_years, page.vehicle_types, page.top_makes)

    def market() -> None:
        page = pages.market(home)
        run(page.headline, page.makes, page.models, page.grid)

    def geography() -> None:
        page = pages.geography(home)
        run(page.headline, page.counties, page.cities, page.points)

    def ranges() -> None:
        page = pages.ranges(home)
        run(page.headline, page.statistics, page.coverage, page.bins, page.statuses)

    def exploratory() -> None:
        page = pages.exploratory(full, recent_from=2000)
        run(page.headline, *page.breakdowns.values(), page.range_by_type)

    pairs = {
        "page_filter": lambda: home.count(),
        "page_facets": lambda: filters.facets(full, FILTERS, selection).collect(),
        "page_overview": overview,
        "page_market": market,
        "page_geography": geography,
        "page_ranges": ranges,
        "page_exploratory": exploratory,
    }
    lineitem, events = table(spark, FOLDER, "lineitem"), table(spark, FOLDER, "events")

    def rank_parts() -> None:
        counts = stage(lineitem.groupBy("l_partkey").count())
        label = F.col("l_partkey").cast("string")
        run(ranking.rank_counts(counts, ["l_partkey"], lineitem.count(), label))

    def event_stats() -> None:
        counts = stage(distribution.measure_counts(events, ["event_type"], "value"))
        run(distribution.distribution(counts, "event_type"))

    pairs |= {
        "category_limited": lambda: run(breakdown.category_breakdown(lineitem, "l_partkey", 25)),
        "rank_parts": rank_parts,
        "event_stats": event_stats,
        "profile_lineitem": lambda: run(profile.column_profile(lineitem)),
        "duplicate_keys": lambda: run(
            profile.duplicate_keys(lineitem, ["l_orderkey", "l_linenumber"])
        ),
        "duplicate_documents": lambda: run(
            profile.duplicate_rows(
                table(spark, FOLDER, "documents"), ["text", "lang", "source", "n_chars"]
            )
        ),
    }
    for name, job in pairs.items():
        timed(name, job, REPEATS)
    rows = full.count()
    cold = sum(t for name, t in times.items() if name.startswith("cold_"))
    load = sum(t for name, t in times.items() if name.startswith("load_"))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(FOLDER).name.removeprefix("sf"),
                "registration_rows": rows,
                "cold_load_seconds": round(cold, 3),
                "load_seconds": round(load, 3),
                "load_rows_per_second": round(rows / load),
            }
        )
    )


if __name__ == "__main__":
    main()
