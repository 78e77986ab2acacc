"""Sample-and-hold over a stream: a value holds until the next one of its key, which only state and timers can tell.

Every row waits in the state of its key until the watermark has passed it, so rows that
come late, but not too late, still find their place.  A key has a timer at its first
waiting row.  When it fires, all rows that the watermark has passed are taken in the order
of times: the value before each held until then, and is given with its duration; the last
one becomes the one that holds.  The last value of a key holds until a next one comes, as
the last step of a table isn't used either.  A query that is started again goes on from its
checkpoint.

Rows wait in pieces of packed times and values, one for each batch that brought some, so
calls to the state grow with keys and batches, not with rows.  The waiting rows of one key
(16 bytes each) are sorted by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows given at once.
PIECE = 10_000


def _in_order(ms: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times in order, each with its greatest value; NaN only where there is no other."""
    order = np.lexsort((v, ~np.isnan(v), ms))
    ms, v = ms[order], v[order]
    last = np.r_[ms[1:] != ms[:-1], np.ones(len(ms[:1]), bool)]
    return ms[last], v[last]


class Holds(StatefulProcessor):
    """State of a key: pieces of rows that wait (ms, v packed), and the one that holds."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", StructType([StructField("ms", BinaryType()), StructField("v", BinaryType())]))
        self.holding = handle.getValueState("holding", StructType([StructField("ms", LongType()), StructField("v", DoubleType())]))

    def _wait(self, ms: np.ndarray, v: np.ndarray) -> None:
        if len(ms):
            self.pending.appendValue((ms.tobytes(), v.tobytes()))
            self.handle.registerTimer(int(ms[0]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            ms, v = pdf["ms"].to_numpy("int64"), pdf["v"].to_numpy("float64", na_value=np.nan)
            new = ms > passed  # others are too late: what held then has been given
            self._wait(*_in_order(ms[new], v[new]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pieces = [(np.frombuffer(ms, "int64"), np.frombuffer(v, "float64")) for ms, v in self.pending.get()]
        if not pieces:
            return
        ms, v = _in_order(*map(np.concatenate, zip(*pieces, strict=True)))
        n = int(np.searchsorted(ms, max(timerValues.getCurrentWatermarkInMs(), int(expiredTimerInfo.getExpiryTimeInMs())), side="right"))
        if not n:
            return  # an earlier timer has taken the row
        self.pending.clear()
        self._wait(ms[n:], v[n:])
        ms, v = ms[:n], v[:n]
        last = (int(ms[-1]), None if np.isnan(v[-1]) else float(v[-1]))
        if self.holding.exists():
            since, held = self.holding.get()
            ms, v = np.r_[since, ms], np.r_[np.nan if held is None else held, v]
        self.holding.update(last)
        for at in range(0, len(ms) - 1, PIECE):
            until = ms[at + 1 : at + 1 + PIECE]
            here, values = ms[at : at + len(until)], pd.Series(v[at : at + len(until)])
            yield pd.DataFrame({self.key: [key[0]] * len(until), "ms": here, "dt": (until - here) / 1000.0, "v": values.astype(object).where(values.notna(), None)})

    def close(self) -> None:
        pass


def holds(stream: DataFrame, key: str, value: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """key, te (timestamp), dt (seconds), and the value that held, of a stream of rows (key, ts, value).

    Times count in milliseconds; of rows of one key and time the greatest value stays.
    Missing values hold too.  Rows without a time or a key are left out, and rows that come
    later than `late` after a newer one.
    """
    stream.sparkSession.conf.set(*STORE)
    rows = stream.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late)
    rows = rows.select(key, ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(value).cast("double").alias("v"))
    kind = stream.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("ms", LongType()), StructField("dt", DoubleType()), StructField("v", DoubleType())])
    found = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Holds(key), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return found.select(key, F.timestamp_millis("ms").alias("te"), "dt", F.col("v").alias(value))


def held_in_table(rows: DataFrame, key: str, value: str, ts: str = "ts") -> DataFrame:
    """What holds gives for a whole table, up to the last row of each key."""
    from pyspark.sql import Window

    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    once = rows.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).groupBy(key, ms.alias("ms")).agg(F.max(F.nanvl(F.col(value).cast("double"), F.lit(None))).alias(value))
    until = F.lead("ms").over(Window.partitionBy(key).orderBy("ms"))
    return once.withColumn("_until", until).where("_until is not null").select(key, F.timestamp_millis("ms").alias("te"), ((F.col("_until") - F.col("ms")) / 1000.0).alias("dt"), value)


def drained(spark: SparkSession, found: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream gives for the rows that are there, added to a table at the path."""
    from hydroframe.streaming.windows import run_once

    run_once(found, path, checkpoint)
    return spark.read.schema(found.schema).parquet(path)
