"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402

from keyfold import queries as catalogue  # noqa: E402

HEADLINE = (
    "sum_as_alias_by_attr", "avg_countstar_by_attr_and_dim", "var_by_string", "avg_by_string_and_double", "max_var_by_two_strings",
    "count_countattr_by_dim", "single_row_groups_all_null", "by_dims_only_multi", "registered_udaf", "group_after_join",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run = catalogue.queries()[name]
        best = []
        for _ in range(3):  # the first run also compiles
            began = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        seconds[name] = round(min(best), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
