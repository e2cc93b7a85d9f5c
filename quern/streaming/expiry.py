"""Rows that leave after a time: silent runs and sessions, by event-time session windows.

The state of a key holds its open spans of activity, first and last time each.
Times that are at most ``gap`` apart belong to one span, in whatever order they
arrive within the watermark; once the watermark passes ``last + gap`` the span ends
and is one row.  The times of a batch are joined to spans in the tasks that read
them, and what is kept of them are spans, so a busy key needs no more state than a
quiet one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.streaming.jobs import with_event_time


def joined_spans(spans: np.ndarray, gap: int) -> np.ndarray:
    """Spans (first, last), joined where one begins at most ``gap`` behind another: what the windows below do, for an array."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    starts = np.concatenate([[True], spans[1:, 0] - ends[:-1] > gap])
    first = np.flatnonzero(starts)
    return np.stack([spans[first, 0], np.maximum.reduceat(spans[:, 1], first)], 1)


def expired(events: DataFrame, key: str, ts: str, gap_ms: int, late: str) -> DataFrame:
    """One row for each span of activity of a key once it has been silent for ``gap_ms``: first, last and expiry time in milliseconds.

    Sessions are the same with the token as key and their lifetime as gap; a use
    prolongs them.  Rows without a key or time have none and are left out.
    """
    known = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    whole = known.select(key, F.timestamp_millis(F.unix_millis(F.col(ts).cast("timestamp"))).alias(ts))
    spans = with_event_time(whole, ts, late).groupBy(key, F.session_window(ts, f"{gap_ms} milliseconds").alias("_w")).agg(F.count("*").alias("_n"))
    end = F.unix_millis("_w.end")
    return spans.select(key, F.unix_millis("_w.start").alias("first_ms"), (end - gap_ms).alias("last_ms"), end.alias("expired_ms"))
