"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
"""

import json
import os
import time

from weirgauge.catalog import QUERIES
from weirgauge.session import local_session

HEADLINES = [
    "flow_1m", "flow_tops_1m", "rollup_src_ip_1m", "rollup_conversations_1m", "hybrid_window_src_ip", "scaled_by_interface_auto",
    "interface_series_receives", "traffic_series_p95_by_sensor", "top_src_ip_by_bps", "top_src_ip_from_rollup", "top_conversation_by_bytes",
    "flow_search_by_rate", "declarative_filters", "asn_resolution", "prefix_traffic_1m", "local_peaks_receives", "judged_peaks_receives",
    "incident_dominant_groups", "mitigation_recommendation", "detection_groups_conversation", "detection_rules", "event_sessions",
    "learned_thresholds", "subscriber_resolution", "ingested_csv_flows",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="weirgauge-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flow_1m"](spark, directory).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
             "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
