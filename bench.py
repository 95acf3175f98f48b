"""Times the headline queries and prints one JSON line.

The fact tables (narrow traces, signals, tickets, steps) are written once to a scratch folder, as
on a cluster with spark.checkpoint.dir set; that work is timed as the refresh_* entries.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from ticketloom.plans import fixtures as Fx
from ticketloom.plans import q_explain
from ticketloom.plans.queries import QUERIES
from ticketloom.session import build_session

REFRESH = {
    "refresh_traces": Fx.traces,
    "refresh_signals": Fx.signals,
    "refresh_sessions": Fx.sessions,
    "refresh_enriched_sessions": Fx.enriched_sessions,
    "refresh_steps": q_explain.steps,
}
HEADLINE = (
    "weekly_summary", "same_period", "view_totals", "segment_breakdown", "transfer_triggers", "transfer_tpe", "coverage_rates",
    "quality_counts", "select_candidates", "dedupe_traces_strict", "survey_attribution", "human_reply_after_bot", "classify_entry_coverage",
    "csat_weekly", "feedback_entries", "ab_arms", "ab_daily", "ticket_projection", "paginate", "escalation_class", "session_escalation",
    "phase_summary", "extract_sections", "reopen_population", "session_scores", "weekly_report_export", "mask_text", "redact_comment",
)


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ticketloom-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name, build in {**REFRESH, **{n: QUERIES[n] for n in HEADLINE}}.items():
        start = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
