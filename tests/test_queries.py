"""The SQL check on a choice of queries; check_oracle.py runs all of them."""

import duckdb
import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

CHOICE = (
    "classify_sessions", "weekly_summary", "same_period", "segment_breakdown", "transfer_triggers", "attach_enrichment", "select_candidates", "dedupe_traces_strict",
    "survey_attribution", "classify_entry_coverage", "csat_weekly", "feedback_entries", "ab_arms", "ab_daily", "ticket_projection", "paginate", "escalation_class",
    "reopen_population", "session_scores", "weekly_report_export", "dimension_coverage", "extract_sections", "latest_response_stream", "incremental_week_refresh", "publish_run")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", CHOICE)
def test_query_equals_sql(spark, sf_dir, con, name):
    status, _, _, note = compare(spark, con, name, queries()[name], oracle_sql()[name], sf_dir)
    assert status == "ok", note


def test_reconciliation_checks_hold(spark, sf_dir):
    for name in ("view_checks", "segment_checks", "transfer_checks", "csat_checks", "coverage_checks", "ticket_checks", "session_checks", "weekly_checks", "period_checks", "reason_checks"):
        rows = queries()[name](spark, sf_dir)
        assert rows.count() > 0 and rows.where("not ok").count() == 0, name


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() == 10
    assert duckdb.__version__


def test_survey_texts_are_redacted_before_the_first_join(spark):
    from ticketloom.operators import csat
    from ticketloom.plans.fixtures import AGENT_CONFIG

    rows = spark.createDataFrame([(1, "7", "survey", 103, "gọi 0901234567 " + "x" * 500), (2, "7", "survey", -103, None)], "source_id long, ticket_id string, survey_id string, rating int, feedback string")
    out = csat.responses(rows.selectExpr("*", "timestamp_ntz'2024-01-02 00:00:00' AS responded_ts"), AGENT_CONFIG)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("AS comment_redacted")
    assert sorted((r["satisfaction_bucket"], r["comment_redacted"] is None) for r in out.collect()) == [("negative", True), ("positive", False)]
    assert "0901234567" not in out.where("rating_raw = 103").first()["comment_redacted"]


def test_survey_checks_read_written_inputs(spark, sf_dir):
    """No check joins, numbers or redacts anew: five broken inputs with five checks each would do so 25 times."""
    from ticketloom.plans.q_quality import _csat_inputs

    for rows in _csat_inputs(spark, sf_dir):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan and "Join" not in plan and "Aggregate" not in plan
