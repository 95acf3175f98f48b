"""From raw traces to narrow rows and ticket facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import classify, enrich, ingest


def narrow_traces(raw: DataFrame, templates: tuple[str, ...] = K.TRANSFER_TEXTS) -> DataFrame:
    """Valid traces with flags and dimensions instead of payloads; no shuffle.

    Flags are computed before invalid rows are dropped: the filter then reads one finished column
    instead of being pushed down as a second evaluation of every check.
    """
    rows = classify.output_flags(ingest.normalize_traces(raw), templates)
    rows = enrich.extract_dimensions(rows).withColumn("arm", ingest.model_arm(F.col("input")))
    return ingest.valid_records(rows).drop("input", "output")
