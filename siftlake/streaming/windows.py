"""Windows over a stream: by event time with late data, and by row count with state kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type", value: str = "value") -> DataFrame:
    """(by, start, end, n, mean, largest) of each window; rows later than ``late`` are dropped by the watermark."""
    g = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "largest")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """(by, start, end, n) of bursts of events no farther apart than ``gap``."""
    g = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def row_windows(events: DataFrame, width: int = 64, stride: int = 16, by: str = "series", order: str = "pos", value: str = "value", label: str = "label") -> DataFrame:
    """(by, win, v, y): whole windows of ``width`` rows at every ``stride`` as they fill, whatever the batches.

    The state of a series is at most ``width - 1`` values, its labels and a count. Rows of one batch are put in order;
    a series' batches must themselves come in order.
    """
    kind = events.schema[by].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, labels, first = state.get if state.exists else ([], [], 0)
        got = pd.concat(list(frames)).sort_values(order)
        values, labels = list(values) + got[value].tolist(), list(labels) + got[label].astype(int).tolist()
        wins, v, y, at = [], [], [], 0
        while at + width <= len(values):
            wins.append((first + at) // stride)
            v.append(values[at : at + width])
            y.append(max(labels[at : at + width]))
            at += stride
        state.update((values[at:], labels[at:], first + at))
        if wins:
            yield pd.DataFrame({by: [key[0]] * len(wins), "win": wins, "v": v, "y": y})

    return events.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, win long, v array<double>, y int", "v array<double>, l array<int>, first long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what there is and return the results in ``folder``; the checkpoint lets a later call go on from there.

    Results are written by the executors. A batch that runs again replaces its own files, so nothing is written twice; in
    complete mode the last batch is the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/batch=*")
