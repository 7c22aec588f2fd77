"""Rate limit on a stream of requests: at once with its state in the state store, or in event-time
order with requests held until the watermark passes them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from moodframe.operators.ratelimit import LIMIT, WINDOW_SECONDS, Admission, admit_requests

_REQUEST = "client long, request_id long, us long"
_BEFORE_ALL = -(2**62)


def admit_stream(
    requests: DataFrame, limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS
) -> DataFrame:
    """(client, request_id, us, admitted). Input: client, request_id, us, all whole numbers.
    A client's state is its admitted times of the last window, ``limit`` at most, and the
    newest time seen: a request older than that is late and refused. A batch of requests of a
    client is ordered by (us, request_id); the trigger bounds its size. For requests that come
    out of order from batch to batch, or many of one client, use ``write_admissions``."""
    window = int(window_seconds * 1_000_000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, times = state.get if state.exists else (-(2**62), [])
        rule = Admission(limit, window, times)
        rows = pd.concat(list(batches)).sort_values(["us", "request_id"])
        times = rows["us"].to_numpy()
        late = times < newest
        verdicts = np.zeros(len(times), bool)
        verdicts[~late] = rule.ask_sorted(times[~late])
        state.update((max(int(newest), int(times[-1])), list(rule.times)))
        yield rows.assign(client=key[0], admitted=verdicts)[["client", "request_id", "us", "admitted"]]

    return requests.groupBy("client").applyInPandasWithState(
        step,
        "client long, request_id long, us long, admitted boolean",
        "newest long, times array<long>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def write_admissions(
    requests: DataFrame, path: str, checkpoint: str, limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS,
    lateness_seconds: float | None = None,
) -> StreamingQuery:
    """Verdicts in event-time order, whatever the order of arrival. A request is held until one
    ``lateness_seconds`` newer has come (None: until ``close_admissions``), then the batch rule
    decides it, after the admitted requests of the window before; these pass the rule again, as
    refused ones do not count. A request older than what is decided goes to ``late_requests``.
    Every batch writes its own folders, so one that is run again after a failure counts once."""
    window = int(window_seconds * 1_000_000)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark, closed = batch.sparkSession, _closed(batch.sparkSession, path, batch_id)
        late = F.coalesce(F.col("us") < closed, F.lit(False))
        asked = batch.select("client", "request_id", "us")
        for name, rows in (("late", asked.filter(late)), ("held", asked.filter(~late))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        until = closed
        if lateness_seconds is not None:
            newest = spark.read.schema(_REQUEST).parquet(f"{path}/held/batch_id={batch_id}").agg(F.max("us")).first()[0]
            until = closed if newest is None else max(closed, newest - int(lateness_seconds * 1_000_000))
        _decide(spark, path, batch_id, closed, until, limit, window)
        spark.range(1).select(F.lit(until).alias("us")).write.mode("overwrite").parquet(f"{path}/closed/batch_id={batch_id}")

    return (
        requests.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def close_admissions(spark: SparkSession, path: str, limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS) -> None:
    """Decides what is still held at the end of a source. If the source goes on after all, its
    next batch replaces these verdicts."""
    last = _batches(spark, path, "closed", "us long").agg(F.max("batch_id")).first()[0]
    after = 0 if last is None else last + 1
    _decide(spark, path, after, _closed(spark, path, after), None, limit, int(window_seconds * 1_000_000))


def admissions(spark: SparkSession, path: str) -> DataFrame:
    """(client, request_id, us, admitted) of the decided requests."""
    return _batches(spark, path, "verdicts", _REQUEST + ", admitted boolean").drop("batch_id")


def late_requests(spark: SparkSession, path: str) -> DataFrame:
    """(client, request_id, us, batch_id) of the requests that came too late for a verdict."""
    return _batches(spark, path, "late", _REQUEST)


def _batches(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    whole = schema + ", batch_id long"
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(f"{path}/{name}")


def _closed(spark: SparkSession, path: str, batch_id: int) -> int:
    """The time up to which requests were decided before a batch."""
    before = _batches(spark, path, "closed", "us long").filter(F.col("batch_id") < batch_id)
    return before.agg(F.coalesce(F.max("us"), F.lit(_BEFORE_ALL))).first()[0]


def _decide(spark: SparkSession, path: str, batch_id: int, since: int, until: int | None, limit: int, window: int) -> None:
    """Writes the verdicts of the held requests of [since, until)."""
    at, asked = F.col("us"), ["client", "request_id", "us"]
    earlier = _batches(spark, path, "verdicts", _REQUEST + ", admitted boolean").filter(F.col("batch_id") < batch_id)
    held = _batches(spark, path, "held", _REQUEST).filter((F.col("batch_id") <= batch_id) & (at >= since))
    out = f"{path}/verdicts/batch_id={batch_id}"
    if until is not None and until <= since:
        spark.createDataFrame([], _REQUEST + ", admitted boolean").write.mode("overwrite").parquet(out)
        return
    due = held if until is None else held.filter(at < until)
    known = earlier.filter(F.col("admitted") & (at > since - window))
    rows = due.select(asked).unionByName(known.select(asked))
    verdicts = admit_requests(rows, "client", at, "request_id", limit, window / 1_000_000)
    verdicts.filter(at >= since).write.mode("overwrite").parquet(out)
