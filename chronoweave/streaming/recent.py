"""Streaming extension: each entity's last events, kept as state.

``applyInPandasWithState`` holds the last l events of an entity in time order; the
state of one key is bounded by l. Events later than the watermark are dropped by
Spark before they arrive here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "entity string, event_idx long, ts timestamp, place int"


def last_events(stream: DataFrame, short: int = 20, delay: str = "1 day") -> DataFrame:
    """``stream``: entity, event_idx, ts (timestamp). Emits an entity's last events whenever it has new ones."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            held += list(zip(b["ts"].astype("int64").tolist(), b["event_idx"].tolist(), strict=True))
            held = sorted(set(held))[-short:]
        state.update(tuple(map(list, zip(*held, strict=True))) if held else ([], []))
        yield pd.DataFrame({"entity": key[0], "event_idx": [i for _, i in held], "ts": pd.to_datetime([t for t, _ in held]), "place": range(1, len(held) + 1)})

    rows = stream.withWatermark("ts", delay).select("entity", "event_idx", "ts")
    return rows.groupBy("entity").applyInPandasWithState(update, RESULT, "ts array<long>, idx array<long>", "update", GroupStateTimeout.NoTimeout)


def counts(stream: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events of each relation in tumbling windows, with late events up to ``delay``."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "relation").agg(F.count("*").alias("n"))
