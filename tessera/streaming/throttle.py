"""Failed attempts of a key in a sliding time, as state that empties itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.control import MAX_FAILURES, WINDOW_SECONDS

OUT = "key string, id long, recent long, refused boolean"


def throttle_stream(attempts: DataFrame, seconds: int = WINDOW_SECONDS, failures: int = MAX_FAILURES) -> DataFrame:
    """``attempts(key, at, id, failed)`` with recent and refused; ``at`` in whole seconds.

    State holds the times of failures within ``seconds``, at most. A success clears it, and the watermark does once it
    has passed the last failure by that time. Attempts later than ``seconds`` behind the newest are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = []
        for at, id_, failed in sorted(row for f in frames for row in zip(f["at"], f["id"], f["failed"])):
            times = [t for t in times if t > at - seconds]
            times = [*times, at] if failed else []
            rows.append((key[0], id_, len(times), len(times) >= failures))
        ends = 1000 * (max(times) + seconds) if times else 0
        if ends > state.getCurrentWatermarkMs():
            state.update((times,))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "id", "recent", "refused"])

    timed = attempts.withColumn("moment", F.timestamp_seconds("at")).withWatermark("moment", f"{seconds} seconds")
    return timed.groupBy("key").applyInPandasWithState(step, OUT, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
