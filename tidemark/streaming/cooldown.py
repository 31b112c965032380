"""Requests that wait after a failure, as a stream: state for each interval asked for, with a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.store import COOLDOWN

#: A request or the failure of one: ``kind`` is "asked" or "failed".
EVENTS = "ticker string, start date, end date, kind string, at timestamp"


def allowed(events: DataFrame, seconds: int = COOLDOWN, late: str = "10 minutes") -> DataFrame:
    """``(ticker, start, end, at)`` of the requests among a stream of ``events`` whose interval has not failed in the ``seconds`` before.

    Of each interval only its last failure is kept, and a timer at the end of the wait forgets it, so the state holds what waits just now and no more.
    Events of one instant count with the failure first; events later than ``late`` behind the newest are dropped.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["us", "kind"], ascending=[True, False])
        sent = []
        for kind, us in zip(rows["kind"], rows["us"].tolist(), strict=True):
            if kind == "failed":
                last = us
            elif last is None or us - last >= seconds * 1_000_000:
                sent.append(us)
        if last is not None:
            over = last // 1000 + seconds * 1000
            if over > state.getCurrentWatermarkMs():
                state.update((last,))
                state.setTimeoutTimestamp(over)
            elif state.exists:
                state.remove()
        yield pd.DataFrame({"ticker": key[0], "start": key[1], "end": key[2], "us": pd.array(sent, "int64")})

    rows = events.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    out = rows.groupBy("ticker", "start", "end").applyInPandasWithState(decide, "ticker string, start date, end date, us long", "failed long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("ticker", "start", "end", F.timestamp_micros("us").alias("at"))
