"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "w1_moving_averages", "w3_rsi", "w4_macd", "w5_bollinger", "w12_feature_frame", "w12_null_budget", "w18_expanding_folds",
    "a4_exact_quantiles", "a9_large_gaps", "a10_training_metrics", "j5_asof_join", "j10_apply_statistics", "s7_upsert",
    "v11_verdicts", "m2_standard_scaler", "m6_preprocess", "m8_random_forest", "m10_lasso", "m19_ensemble", "m20_backtest", "m24_pipeline",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("barline-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="barline-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from barline.plans.queries import QUERIES

    only = sys.argv[1:]
    seconds: dict[str, float] = {}
    QUERIES["k1_order_limit"](spark, sf).count()  # start the JVM's readers before the clock runs
    for name in only or HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf).name.removeprefix("sf"), "cpus": int(cpus), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
