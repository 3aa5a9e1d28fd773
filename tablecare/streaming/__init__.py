"""Apply a fitted safe-cleaning spec to a streaming DataFrame.

The reference has no streaming. What carries over naturally is the split
between *fitting* the safe cleaning (one aggregate over a batch table, see
``operators.clean.fit_safe_clean``) and *applying* it, which is a stateless
projection: renames, trimming, missing tokens and the voted type coercions.
Exact dedup on an unbounded stream needs state, so it is offered only
within an event-time watermark (``dropDuplicatesWithinWatermark``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.clean import SafeCleanSpec, apply_safe_clean, fit_safe_clean


def apply_clean_stream(stream: DataFrame, spec: SafeCleanSpec, event_time: str | None = None,
                       delay: str = "10 minutes") -> DataFrame:
    """Cleaned stream; with ``event_time`` (a column name after renaming),
    identical rows arriving within ``delay`` of each other are dropped."""
    out = apply_safe_clean(stream, spec, dedup=False)
    if event_time:
        out = out.withWatermark(event_time, delay).dropDuplicatesWithinWatermark()
    return out


__all__ = ["apply_clean_stream", "fit_safe_clean"]
