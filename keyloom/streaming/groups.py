"""Consumer groups over a stream: each message goes to one consumer of a group, and stays pending until acknowledged.

State is kept by message id and ends with the acknowledgement or, without one, when the watermark has passed by `keep_ms`;
so it is bounded by what is under way, and one busy group is spread over all partitions. Messages and acknowledgements
come in one stream, in any order within the watermark; delivery is at least once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "grp string, id long, consumer string, event string"


def consume(entries: DataFrame, consumers: int, keep_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """entries: ts (timestamp), grp, id, kind (message or ack). Returns grp, id, consumer, event: delivered, acked, or
    expired for what nobody acknowledged in time. Repeated messages of an id are delivered once while it is remembered;
    an ack that comes first is kept, and the message then isn't delivered."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        grp, ident = key
        who = f"c{ident % consumers}"
        if state.hasTimedOut:
            delivered, acked = state.get
            state.remove()
            said = ["expired"] if delivered and not acked else []
        else:
            delivered, acked = state.get if state.exists else (False, False)
            said, newest = [], 0
            kinds = set()
            for f in frames:
                kinds |= set(f["kind"])
                newest = max(newest, int(f["ts"].max().value // 1_000_000))
            if "message" in kinds and not delivered and not acked:
                delivered = True
                said.append("delivered")
            if "ack" in kinds and not acked:
                acked = True
                said += ["acked"] if delivered else []
            state.update((delivered, acked))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame({"grp": [grp] * len(said), "id": [ident] * len(said), "consumer": [who] * len(said), "event": said})

    marked = entries.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy("grp", "id").applyInPandasWithState(step, OUT, "delivered boolean, acked boolean", "append", GroupStateTimeout.EventTimeTimeout)
