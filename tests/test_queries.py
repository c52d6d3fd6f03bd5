"""A sample of the named queries next to their SQL; all of them with KINETABLE_ALL_QUERIES=1."""

import os

import pytest

pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

import __spark_entry__ as entry  # noqa: E402
from tools import compare  # noqa: E402

SAMPLE = ("speech_report", "frame_gaps", "mouth_window", "monotonic_ms", "sequence_windows", "align_audio", "build_registry", "apply_events", "audit_vaults", "split_by_frame", "animation_loss", "rejection_reason",
          "session_inventory", "quality_state", "ema", "adaptive_peak", "attack_release", "watch_again", "exact_quantiles", "median_vector", "sequence_windows_sql",
          "stream_gaps_unordered", "stream_late_rows", "stream_queue")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("KINETABLE_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    line = compare.compare(spark, con, FOLDER, name)
    assert line.startswith("ok"), line


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "progress_pct" in frame.columns


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_report_plan_has_no_cross_join_and_prunes_columns(spark):
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "props" not in plan
