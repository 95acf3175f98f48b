"""Support-ticket analytics as Spark jobs: one row per ticket, weekly cohorts, diagnostics."""
