"""Times the headline queries and prints one JSON line.

Every query runs once to warm up and then three times into a sink that reads every row and
column and keeps nothing; the median counts. ``BENCH_SET=all`` measures every query of the library once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from spoolworks import build_session
from spoolworks.plans import catalog

HEADLINE = [
    "render_chatml",
    "split_exact",
    "split_exact_ranked",
    "tokenize_pad",
    "mask_prompt_labels",
    "mask_pad_labels",
    "pad_to_batch_longest",
    "explode_captions",
    "semi_join_images",
    "load_vision_records",
    "split_caption_records",
    "running_index",
    "run_summary",
    "keep_last_n",
    "unpivot_metrics",
    "gpu_memory",
    "gpu_wide",
    "prefix_rollup",
    "check_report",
]


def measure_all(spark, runs, folder: str) -> None:
    """One line for every query, streams and sinks too: seconds of the second run, rows out, rows a second."""
    for name, run in sorted(runs.items()):
        for _ in range(2):
            seen = Observation(name)
            began = time.perf_counter()
            run(spark, folder).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
        rows = seen.get["rows"]
        print(json.dumps({"query": name, "sec": round(took, 3), "rows": rows, "rows_per_sec": round(rows / took)}), flush=True)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "spoolworks-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="spoolworks-bench-"),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = catalog.callables()
    if os.environ.get("BENCH_SET") == "all":
        measure_all(spark, runs, folder)
        spark.stop()
        return
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            runs[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
