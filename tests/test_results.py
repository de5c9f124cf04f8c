"""Registered queries against their SQL text.

A spread over all families runs by default; ``ALL_QUERIES=1`` runs every one.
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tools.check_results import compare, connect  # noqa: E402
from weirgauge.catalog import ORACLES, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
CORE = [
    "flow_1m", "flow_tops_1m", "rollup_conversations_1m", "merged_partial_rollups", "hybrid_window_src_ip", "scaled_by_interface_auto",
    "interface_series_sends", "direction_consolidation", "series_downsampled", "series_thinned", "period_comparison", "series_reductions",
    "top_src_ip_from_rollup", "top_protocol_by_percentage", "ranking_with_others", "flow_search_by_rate", "declarative_filters",
    "asn_resolution", "whitelist_hits", "prefix_traffic_1m", "local_peaks_receives", "judged_peaks_sends", "draft_detection_rules",
    "incident_dominant_groups", "mitigation_validation", "nat_import_a10", "nat_rows_validated_a10", "subscriber_resolution",
    "nat_batch_activation", "detection_rules", "event_sessions", "events_upserted", "learned_thresholds", "rate_calibration",
    "ingested_csv_flows", "ingested_csv_with_headers", "stream_ingested_rollup", "stream_sliding_detection",
]
CHOSEN = sorted(QUERIES) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_gives_the_expected_rows(spark, con, name):
    text, _, good = compare(spark, con, DATA, name)
    assert good, text


def test_every_query_has_a_sql_text():
    assert set(ORACLES) == set(QUERIES)
