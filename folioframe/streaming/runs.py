"""Section runs over a stream: an extension, as the batch operators have no streaming form of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "user_id long, run_no long, event_type string, n long"
_STATE = "run_no long, event_type string, n long"


def streaming_runs(events: DataFrame) -> DataFrame:
    """Runs of equal ``event_type`` of each user, given when the next one begins; the last run stays in the state."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run_no, kind, n = state.get if state.exists else (0, None, 0)
        done = []
        for value in pd.concat(list(frames)).sort_values(["ts", "event_id"]).event_type:
            if n and value == kind:
                n += 1
                continue
            if n:
                done.append((key[0], run_no, kind, n))
            run_no, kind, n = run_no + 1, value, 1
        state.update((run_no, kind, n))
        yield pd.DataFrame(done, columns=["user_id", "run_no", "event_type", "n"])

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and type, with late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
