"""Time the headline queries: prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from comarca.checks import load
from comarca.checks.registry import QUERIES
from comarca.session import build_session

HEADLINE = [
    "a3_street_topk_lines", "a4_corridor", "a8_type_and_city", "f3_company_id_lines", "f15_synthetic_point",
    "p8_search", "a9_quality_report", "etl_registry", "etl_file_broad", "k3_upsert", "k4_geojson_features",
    "j14_geocode", "j4_visits_with_segments", "j10_box_join", "w5_lww_sync", "j9_synced_state", "w2_ranking",
    "k7_new_ids", "a12_exact_quantiles", "g1_clusters_lines", "g2_components_hubs", "g4_routes", "g5_kde_lines",
]


def main():
    load.everything()
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
