"""The queue of runs as a stream: the latest state of each run, one going per document, and a time limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TIME_LIMIT_S = 120
_OUT = "document_id string, run_id string, state string, at timestamp"
_STATE = "run_id string, at timestamp"


def state_changes(events: DataFrame, limit_s: int = TIME_LIMIT_S, watermark: str = "10 minutes") -> DataFrame:
    """Events (document_id, run_id, state, at) become state changes: a run starts only while none of its document is going, and one that outlasts the
    limit times out when a later event of the document or the watermark says so. Keyed state is a single row per document."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, current = [], state.get if state.exists else None
        limit = pd.Timedelta(seconds=limit_s)
        if state.hasTimedOut:
            if current:
                out.append((key[0], current[0], "TIMED_OUT", current[1] + limit))
            state.remove()
        else:
            for e in pd.concat(list(frames)).sort_values(["at", "run_id"]).itertuples():
                if current and e.at - current[1] > limit:
                    out.append((key[0], current[0], "TIMED_OUT", current[1] + limit))
                    current = None
                if e.state == "RUNNING" and current is None:
                    current = (e.run_id, e.at)
                    out.append((key[0], e.run_id, "RUNNING", e.at))
                elif e.state in ("COMPLETED", "FAILED") and current and current[0] == e.run_id:
                    out.append((key[0], e.run_id, e.state, e.at))
                    current = None
            if current:
                state.update(current)
                state.setTimeoutTimestamp(max(int((current[1] + limit).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["document_id", "run_id", "state", "at"])

    keyed = events.withWatermark("at", watermark).groupBy("document_id")
    return keyed.applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counts_by_window(events: DataFrame, width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Events per time window and type; late rows within the watermark still count."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").count()


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off all that is there and stop; progress is kept in the checkpoint, so a restart neither loses nor repeats rows."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
