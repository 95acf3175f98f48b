"""Every operator as a runnable query over the driver tables, next to its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# DuckDB adds integers up to HUGEINT; these result columns are cast to the type Spark gives them.
_BIGINT = {
    "reopen_control_rate": "numerator", "label_metrics": "support true_positive predicted", "eval_labels": "model_denominator",
    "view_totals": "reopen_lifetime_numerator reopen_7d_numerator", "same_period": "reopen_lifetime_numerator",
    "week_set_rollup": "eligible_ticket_count transfer_total ai_end_to_end ai_then_cs direct_cs unclassified ai_first_count reopen_lifetime_numerator "
    "reopen_lifetime_denominator reopen_7d_numerator reopen_7d_denominator gt4_turn_with_cs gt4_turn_without_cs weekend_start_count",
    "decision_ledger": "value", "segment_breakdown": "total ai_first transferred reopen", "dashboard_snapshot": "app_total",
    "csat_rollup": "ticket_count positive neutral negative", "metrics_rollup": "total_tokens input_tokens output_tokens",
    "metrics_rollup_hourly": "total_tokens input_tokens output_tokens", "ab_arms": "reopen_count turn_total input_tokens output_tokens total_tokens",
    "ab_daily": "reopen_count turn_total total_tokens output_tokens", "data_quality_score": "score",
}
_DOUBLE = {"eval_labels": "human_consistency", "session_checks": "expected actual", "ticket_checks": "expected actual"}


def _typed(name: str, check: str) -> str:
    casts = [f'CAST("{c}" AS {t}) AS "{c}"' for t, table in (("BIGINT", _BIGINT), ("DOUBLE", _DOUBLE)) for c in table.get(name, "").split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({check})" if casts else check


def query(name: str, check: str | None = None):
    """Registers a query under its name, with the equivalent SQL when there is one."""

    def wrap(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLE[name] = _typed(name, check)
        return fn

    return wrap


def text_list(column: str):
    return F.array_join(F.col(column), ",")
