"""Structured Streaming forms of the recorders, notifications and the trace sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def recorder(ticks: DataFrame, resolution: int, capacity: int) -> DataFrame:
    """user_id, bin, n of a stream of ticks (user_id, ts); ticks later than the capacity are dropped.

    The watermark moves once per batch, so more late ticks may be kept than the batch form keeps.
    """
    rows = ticks.withWatermark("ts", f"{capacity} seconds").groupBy(F.window("ts", f"{resolution} seconds").alias("w"), "user_id").count()
    return rows.select("user_id", F.expr(f"unix_timestamp(w.start) div {resolution}").alias("bin"), F.col("count").alias("n"))


def published(messages: DataFrame) -> DataFrame:
    """Of a stream (key long, seq long, message string), the messages that differ from their key's last one.

    A key's rows of one batch come in order of seq; only its last message is kept as state.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("seq")
        earlier = rows["message"].shift(1)
        earlier.iloc[0] = last
        state.update((rows["message"].iloc[-1],))
        yield rows[rows["message"] != earlier][["key", "seq", "message"]]

    schema = "key long, seq long, message string"
    return messages.groupBy("key").applyInPandasWithState(step, schema, "message string", "append", "NoTimeout")


def trace_to_csv(trace: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of trace rows as quoted CSV files, all that is there, then stop."""
    writer = trace.writeStream.format("csv").option("quoteAll", "true").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(folder)
