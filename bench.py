"""Times the headline queries; prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["exact_spectrum", "index_counters", "counter_histogram", "sketch_spectrum", "query_report", "sequence_summary", "sampled_spectrum"]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import functions as F

    from strandtally.config import SketchConfig
    from strandtally.plans.queries import QUERIES, documents, index

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(df) -> float:
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    timed(QUERIES["exact_spectrum"](spark, SF_DIR))  # warm-up
    times = {name: timed(QUERIES[name](spark, SF_DIR)) for name in NAMES}
    for bits in (8, 16, 32):
        for slots in (20, 22):
            config = SketchConfig(k=31, m=21, s=27, n_hashes=4, counter_bits=bits, counter_slots_exponent=slots)
            times[f"build_{bits}bit_2^{slots}"] = timed(index(spark, SF_DIR, config).counters)
    build = timed(index(spark, SF_DIR).packed)
    own = index(spark, SF_DIR).estimates(documents(spark, SF_DIR))
    windows, kmers, over = own.agg(F.sum("n"), F.count("*"), F.count(F.when(F.col("estimate") > F.col("n"), 1))).first()
    figures = {"build_s": build, "query_s": round(times["query_report"] - build, 3), "spectrum_s": times["sketch_spectrum"], "over_estimated": round(over / max(1, kmers), 4)}
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "windows_per_s": round(windows / times["query_report"])} | figures
    print(json.dumps(out))


if __name__ == "__main__":
    main()
