"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with the seconds of each."""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from islet.functions.scalars import regime_probability
from islet.operators import census, components, generators, merging, search
from islet.plans import queries as graph_queries
from islet.storage import stage

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
EXPONENTS = tuple(map(int, os.environ.get("BENCH_EXPONENTS", "17,20").split(",")))
NAMES = ("cc_sizes", "cc_labels_giant", "cc_stats_part_supplier", "cc_stats_customer_order", "degree", "adjacency", "mwoe_phase1", "mwoe_labels", "spanning_forest", "bfs_levels", "machine_hash", "text_parse", "ecg_roundtrip")


def run(df) -> int:
    """All rows and columns of a result, without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()
    return 0


def main() -> None:
    shared = tempfile.mkdtemp(prefix="islet-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, work):
        began = time.perf_counter()
        out = work()
        seconds[name] = round(time.perf_counter() - began, 3)
        return out

    run(graph_queries.QUERIES["vertices"](spark, SF_DIR))  # start of the session
    run(graph_queries.QUERIES["cc_sizes"](spark, os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")))
    for name in NAMES:
        timed(name, lambda name=name: run(graph_queries.QUERIES[name](spark, SF_DIR)))
    for exponent, regime in ((e, r) for e in EXPONENTS for r in ("1", "L")):
        n = 1 << exponent
        p, label = regime_probability(regime, n), f"er_{regime}_2e{exponent}"
        graph = timed(f"{label}_generate_exact", lambda n=n, p=p: stage(generators.exact(spark, n, p, 1), "bench"))
        timed(f"{label}_components", lambda g=graph: census.stats(census.sizes(components.labels(g))).first())
        if exponent <= 17:
            timed(f"{label}_merging", lambda g=graph: run(merging.merge(g).labels))
            timed(f"{label}_search", lambda g=graph: run(search.levels(g)))
        if exponent > 17:
            timed(f"{label}_generate_monte_carlo", lambda n=n, p=p: run(generators.monte_carlo(spark, n, p, 1)))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
