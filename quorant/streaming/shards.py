"""Sets of shards that are closed a fixed time after their first shard arrives: stragglers are given up.

The stream holds one row for each shard, not the shard's rows: what a set keeps is when it began, whether it is closed and
how many shards came too late, so no set is hot. Accepted shards are joined to the rows they name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_DECIDED = "set_id string, shard string, arrived timestamp, accepted boolean, late long"


def decide_shards(arrivals: DataFrame, seconds: float, timer: bool = False, keep: float = 86_400.0) -> DataFrame:
    """set_id, shard, arrived, accepted, late (shards of the set that came too late, so far) of a stream (set_id, shard, arrived).

    By default a set takes the shards that arrived up to `seconds` after the first one it saw; the watermark, `keep` seconds
    behind the last arrival, forgets it. With `timer` the time of arrival is that of the micro-batch: a processing-time timer
    closes the set, whether anything comes or not, and forgets it `keep` seconds later. A stream with such timers goes on
    until it is stopped.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, closed, late = state.get
            if timer and not closed:
                state.update((first, True, late))
                state.setTimeoutDuration(max(1, int(keep * 1000)))
            else:
                state.remove()
            return
        first, closed, late = state.get if state.exists else (None, False, 0)
        rows = pd.concat(list(batches)).sort_values(["arrived", "shard"])
        at = rows["arrived"].astype("datetime64[us]").astype("int64")
        begun = first is None
        # In microseconds, by the clock that counts.
        first = (state.getCurrentProcessingTimeMs() * 1000 if timer else int(at.iloc[0])) if begun else first
        in_time = pd.Series(not closed, index=rows.index) if timer else at <= first + int(seconds * 1_000_000)
        late += int((~in_time).sum())
        state.update((first, closed, late))
        if not timer:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, first // 1000 + int((seconds + keep) * 1000)))
        else:
            # What is left of the set's time; each update sets the timer anew.
            end = first // 1000 + int((seconds + (keep if closed else 0)) * 1000)
            state.setTimeoutDuration(max(1, end - state.getCurrentProcessingTimeMs()))
        yield rows.assign(set_id=key[0], accepted=in_time, late=late)[["set_id", "shard", "arrived", "accepted", "late"]]

    told = arrivals.select(F.col("set_id").cast("string").alias("set_id"), F.col("shard").cast("string").alias("shard"), F.col("arrived").cast("timestamp").alias("arrived"))
    if not timer:
        told = told.withWatermark("arrived", f"{int(keep)} seconds")
    clock = GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.EventTimeTimeout
    return told.groupBy("set_id").applyInPandasWithState(decide, _DECIDED, "first long, closed boolean, late long", "append", clock)


def read_arrivals(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Files of arrivals, oldest first, so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
