"""Online scoring and its fan-out."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from txlake.operators.alerts import session_alerts
from txlake.plans.scoring import analyze
from txlake.sinks.history import history_rows
from txlake.sinks.publish import as_messages, notifications
from txlake.streaming.ingest import batch_folder, start_keyed

logger = logging.getLogger(__name__)


def score_events(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Score an event stream against the stored profiles: a stream-static join, then the batch plan."""
    return analyze(events, profiles, F.col("event_time"))


def fan_out(base: str, profiles: DataFrame, checkpoint: str):
    """What to do with a micro-batch of new events: they are scored in a batch plan, whose joins adapt to skew, and go to
    history, alerts and notifications. A failing notification is logged only."""

    def write(fresh: DataFrame, batch_id: int) -> None:
        def put(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(batch_folder(f"{base}/{name}", checkpoint, batch_id))

        scored = score_events(fresh, profiles).persist()
        try:
            # History goes last: until it is there, a retry takes the same events again.
            put(session_alerts(scored), "alerts")
            try:
                put(as_messages(notifications(scored), "transaction_id"), "notifications")
            except Exception:
                logger.warning("notifications of batch %s not published", batch_id, exc_info=True)
            put(history_rows(scored), "history")
        finally:
            scored.unpersist()

    return write


def start_scoring(events: DataFrame, profiles: DataFrame, base: str, checkpoint: str,
                  once: bool = True) -> StreamingQuery:
    """Score a stream of usable events; each transaction is stored and alerted once, under any number of checkpoints."""
    return start_keyed(events, f"{base}/history", checkpoint, fan_out(base, profiles, checkpoint), once)
