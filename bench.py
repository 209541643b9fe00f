"""
Time the headline queries: one JSON line on stdout.

The lake is derived from $BENCH_SF_DIR once, as Parquet; each query then starts from a
lake that holds no roll-up, so shared work is paid by the first query that needs it.
``full_extract`` writes all artifacts from another fresh lake. $BENCH_SCRATCH names the
folder for the lake, checkpoints and artifacts.
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from shelftally.operators import channels, comparison, coverage, links, overlap, provenance, serials
from shelftally.plans.artifacts import write_artifacts
from shelftally.sources.derived import stored_lake, write_derived

HEADLINE = {
    "corpus_totals": [overlap.corpus_totals],
    "overlap_histogram": [overlap.overlap_histogram],
    "overlap_pairwise": [overlap.overlap_pairwise],
    "coverage": [coverage.coverage],
    "cataloging_rollup": [provenance.cataloging_source],
    "cataloging_five_views": [
        provenance.cat_mix,
        provenance.cat_agency,
        provenance.cat_flow,
        provenance.cat_mod_depth,
        provenance.cat_timeline,
    ],
    "channel_coverage": [channels.channel_coverage],
    "channel_namespace": [channels.channel_namespace],
    "lc_class": [comparison.lc_class],
    "lang_matrix": [comparison.lang_matrix],
    "serials_active": [serials.serials_active],
    "link_hosts": [links.link_hosts],
    "publication_decade": [comparison.publication_decade],
}
# The views are timed on a roll-up that the query before them has already paid for.
CONTINUES = {"cataloging_five_views"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # on a cluster, a folder that every executor reaches; on one machine any will do
    scratch = os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .getOrCreate()
    )
    start = time.perf_counter()
    write_derived(spark, sf_dir, f"{scratch}/lake")
    setup = time.perf_counter() - start

    times: dict[str, float] = {}
    lake = None
    for name, operators in HEADLINE.items():
        if lake is None or name not in CONTINUES:
            if lake is not None:
                lake.release()
            lake = stored_lake(spark, f"{scratch}/lake")
        start = time.perf_counter()
        for operator in operators:
            operator(lake).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    lake.release()
    start = time.perf_counter()
    write_artifacts(stored_lake(spark, f"{scratch}/lake"), f"{scratch}/artifacts")
    times["full_extract"] = round(time.perf_counter() - start, 3)
    print("full_extract", times["full_extract"], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "lake_setup_sec": round(setup, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
