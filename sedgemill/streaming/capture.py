"""Structured Streaming: windows with late data, longest-wins, session offsets with a threshold, cost bands.

Every stream has an event-time watermark that bounds its state; state of a session is dropped after ``ttl`` without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELTA = "session string, seq int, delta string, tokens long, reason string"


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """With a watermark on ``ts``, which may be a timestamp without a zone."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Count and sum per type and hour; rows later than ``late`` are left to the batch run."""
    w = _timed(events, late).groupBy(F.window("ts", "1 hour"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def user_sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    w = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_entries(entries: DataFrame, key: str = "id", late: str = "1 day") -> DataFrame:
    """The first arrival of every entry within the watermark."""
    return _timed(entries, late).dropDuplicatesWithinWatermark([key])


def longest_entries(entries: DataFrame, key: str = "id") -> DataFrame:
    """The longest text of every entry so far (run in update or complete mode)."""
    return entries.groupBy(key).agg(F.max_by("text", F.length("text")).alias("text"))


def session_deltas(captures: DataFrame, threshold: int = 4000, band: int = 50_000, stale: float = 0.8, ttl: str = "7 days") -> DataFrame:
    """What is new in append-only sessions: session, seq, delta, tokens, reason.

    ``captures`` holds session, ts, text: the whole text of the session so far. The state keeps how much was emitted and the text's
    length. A text that is no longer than before changes nothing; one that shrinks below ``stale`` of it is ignored; what is new is
    emitted (reason ``threshold``) once it has ``threshold`` tokens (a quarter of its characters), and a new multiple of ``band``
    tokens is told once (reason ``band``).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        saved, length, seq, level = state.get if state.exists else (0, 0, 0, 0)
        rows, newest = [], state.getCurrentWatermarkMs()
        for batch in batches:
            newest = max(newest, int(batch["ts"].max().timestamp() * 1000))
            for text in batch.sort_values(["ts", "text"], key=lambda c: c.str.len() if c.name == "text" else c)["text"]:
                if not isinstance(text, str) or len(text) <= length or len(text) < stale * length:
                    continue
                length = len(text)
                new = (length - saved) // 4
                if new >= threshold:
                    rows.append((key[0], seq, text[saved:], new, "threshold"))
                    saved, seq = length, seq + 1
                if length // 4 // band > level:
                    level = length // 4 // band
                    rows.append((key[0], seq, "", length // 4, "band"))
                    seq += 1
        state.update((saved, length, seq, level))
        state.setTimeoutTimestamp(newest + int(pd.Timedelta(ttl).total_seconds() * 1000) + 1)
        yield pd.DataFrame(rows, columns=["session", "seq", "delta", "tokens", "reason"])

    grouped = _timed(captures, "1 hour").groupBy("session")
    return grouped.applyInPandasWithState(run, DELTA, "saved long, length long, seq int, level long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append"):
    """Run a stream over all that is there now and stop; a second run goes on where the first ended."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
