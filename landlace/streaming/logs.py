"""The append-only logs as streams: what holds now, and lockouts by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from landlace.workers import ship

DECISION = "seq long, ts timestamp, pair long, officer string, decision string, dataset string"
ACCESS = "seq long, ts timestamp, user_id long, event string"


def read(spark: SparkSession, path: str, schema: str = DECISION, per_trigger: int = 16) -> DataFrame:
    """A folder of JSON lines as a stream; blank lines and broken ones have a null seq and go."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path).where("seq is not null")


def latest(stream: DataFrame) -> DataFrame:
    """The last decision on each pair so far: a running maximum, to be written in update or complete mode."""
    return stream.groupBy("pair").agg(F.max_by(F.struct("decision", "officer", "seq"), "seq").alias("x")).select("pair", "x.*")


def per_window(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Decisions by hour and kind; a window closes when the watermark passes it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "decision").agg(F.count("*").alias("n")).select("window.start", "decision", "n")


def lockouts(stream: DataFrame, seconds: int = 300, most: int = 5, late: str = "10 minutes") -> DataFrame:
    """(user_id, seq, ts, failures): failures that lock an account, `most` within `seconds` since the last success.

    The state of a user is the times of the recent failures, `most` at most; it goes when the watermark has passed them.
    """
    ship(stream.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():
            at = row.ts.timestamp()
            if row.event == "success":
                recent = []
            elif row.event == "failed":
                recent = [*[t for t in recent if at - t < seconds], at][-most:]
                if len(recent) >= most:
                    out.append((key[0], row.seq, row.ts, len(recent)))
        if recent:
            state.update((recent,))
            state.setTimeoutTimestamp(max(int((recent[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "seq", "ts", "failures"])

    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(run, "user_id long, seq long, ts timestamp, failures int", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)
