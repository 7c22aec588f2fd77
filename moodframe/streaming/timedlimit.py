"""Rate limit on an endless stream, in event-time order: state with timers.

Per client the state store holds the requests not decided yet, the admitted times of the last
window and the time up to which all is decided. A timer at the oldest open request fires when
the watermark has passed it; what lies before the watermark is then decided by the batch rule.
Nothing is read again, so the work of a batch follows its own rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from moodframe.operators.ratelimit import LIMIT, WINDOW_SECONDS, Admission

VERDICT = "client long, request_id long, us long, admitted boolean, late boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A time after all requests; a marker of it ends a stored table.
END_US = 200_000_000_000_000_000


def _packed(us: np.ndarray, ids: np.ndarray) -> tuple[bytes]:
    """Requests as one value of the state: a value a request would cost a call each."""
    return (np.concatenate([us, ids]).astype(np.int64).tobytes(),)


def _unpacked(blocks) -> tuple[np.ndarray, np.ndarray]:
    """(us, ids) of packed requests, by (us, id)."""
    pairs = [np.frombuffer(b[0], np.int64).reshape(2, -1) for b in blocks]
    us, ids = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
    order = np.lexsort((ids, us))
    return us[order], ids[order]


class TimedAdmission(StatefulProcessor):
    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "requests binary")
        # closed: the time up to which all is decided; wake: the first timer; times: the admitted
        # times of the last window.
        self.mark = handle.getValueState("mark", "closed long, wake long, times binary")

    @staticmethod
    def _timer(us: int) -> int:
        """Milliseconds just after a request."""
        return max(int(us) // 1000 + 1, 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed, wake, times = self.mark.get() or (None, None, b"")
        first = wake
        for frame in rows:
            us, ids = frame["us"].to_numpy(), frame["request_id"].to_numpy()
            if closed is not None and (late := us < closed).any():
                yield self._verdicts(key[0], us[late], ids[late], None)
                us, ids = us[~late], ids[~late]
            if len(us):
                self.held.appendValue(_packed(us, ids))
                first = min(self._timer(us.min()), self._timer(us.min()) if first is None else first)
        if first != wake:
            self.handle.registerTimer(first)
            self.mark.update((closed, first, times))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        us, ids = _unpacked(self.held.get())
        due = int(np.searchsorted(us, until, "left"))
        wake = self._timer(us[due]) if due < len(us) else None
        if due:
            _, _, times = self.mark.get()
            rule = Admission(self.limit, self.window, np.frombuffer(times, np.int64).tolist())
            admitted = rule.ask_sorted(us[:due])
            self.mark.update((until, wake, np.array(rule.times, np.int64).tobytes()))
            self.held.put([_packed(us[due:], ids[due:])]) if due < len(us) else self.held.clear()
            yield self._verdicts(key[0], us[:due], ids[:due], admitted)
        if wake is not None:  # the timer that fires now is gone after this call
            self.handle.registerTimer(wake)

    @staticmethod
    def _verdicts(client: int, us: np.ndarray, ids: np.ndarray, admitted: np.ndarray | None) -> pd.DataFrame:
        none = pd.array([None] * len(us), "boolean") if admitted is None else admitted
        return pd.DataFrame({"client": np.full(len(us), client, np.int64), "request_id": ids, "us": us, "admitted": none, "late": np.full(len(us), admitted is None)}, copy=False)

    def close(self) -> None:
        pass


def admit_in_time(requests: DataFrame, markers: DataFrame, limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS, lateness_seconds: float = 60.0) -> DataFrame:
    """(client, request_id, us, admitted, late) of a stream of (client, request_id, us), all whole
    numbers. Verdicts come once the watermark, ``lateness_seconds`` behind the newest request or
    marker, has passed a request. One that is older than what its client has been told gets no
    verdict and is given out as late. ``markers`` is a stream of (us) that only moves the clock.

    Equal times go by request_id. Memory follows the requests of one client inside the lateness."""
    asked = requests.select("client", "request_id", "us", F.lit(False).alias("marker"))
    none = F.lit(None).cast("long")
    clock = asked.unionByName(markers.select(none.alias("client"), none.alias("request_id"), "us", F.lit(True).alias("marker")))
    timed = clock.withColumn("t", F.timestamp_micros("us")).withWatermark("t", f"{int(lateness_seconds * 1000)} milliseconds")
    # Markers end here, by one comparison with the time, which cannot move below the watermark.
    # Without the time column Spark drops no late row; the processor tells them.
    least = F.when(F.col("marker"), F.lit(2**63 - 1)).otherwise(F.lit(-(2**63 - 1)))
    rows = timed.where(F.unix_micros("t") >= least).select("client", "request_id", "us")
    processor = TimedAdmission(limit, int(window_seconds * 1_000_000))
    return rows.groupBy("client").transformWithStateInPandas(statefulProcessor=processor, outputStructType=VERDICT, outputMode="Append", timeMode="EventTime")


def write_timed_admissions(
    requests: DataFrame, path: str, checkpoint: str, limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS, lateness_seconds: float = 60.0,
) -> StreamingQuery:
    """Appends verdicts and late requests to ``path``/decided, exactly once by the file sink's log.
    Markers are files of (us) in ``path``/markers. State with timers needs the RocksDB store, which
    is set for this stream alone."""
    spark = requests.sparkSession
    spark.createDataFrame([], "us long").write.mode("append").parquet(f"{path}/markers")
    markers = spark.readStream.schema("us long").parquet(f"{path}/markers")
    verdicts = admit_in_time(requests, markers, limit, window_seconds, lateness_seconds)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = verdicts.writeStream.format("parquet").outputMode("append").option("path", f"{path}/decided")
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def mark_end(spark: SparkSession, path: str) -> None:
    """The next run of the stream decides all that is held."""
    spark.createDataFrame([(END_US,)], "us long").coalesce(1).write.mode("append").parquet(f"{path}/markers")


def timed_admissions(spark: SparkSession, path: str) -> DataFrame:
    """(client, request_id, us, admitted) of the decided requests."""
    return spark.read.schema(VERDICT).parquet(f"{path}/decided").where(~F.col("late")).drop("late")


def timed_late(spark: SparkSession, path: str) -> DataFrame:
    """(client, request_id, us) of the requests that came too late for a verdict."""
    return spark.read.schema(VERDICT).parquet(f"{path}/decided").where("late").select("client", "request_id", "us")
