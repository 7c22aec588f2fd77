"""Rate limit per client over a request log: a request is admitted if fewer than ``limit``
requests of the client were admitted in the last ``window`` seconds; refused ones do not
count.

The rule needs state, but only where a client is busy. Windows over fixed time chunks find
the requests that are admitted whatever came before (at most ``limit`` requests in their
window), and the calm points where the state is known from the requests alone. Each
client's time line is cut there, so one very active client spreads over many tasks; only
stretches with a doubtful request go through the sequential rule, streamed in order with a
state of at most ``limit`` times. A stretch during which a client never falls calm is the
one unit that cannot be cut.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodframe.session import stage

LIMIT, WINDOW_SECONDS = 100, 60  # fixed values
_CHUNK_WINDOWS = 60


def micros(time: Column) -> Column:
    """Whole microseconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)


class Admission:
    """The sequential rule for one client."""

    def __init__(self, limit: int, window: int, times=()):
        self.limit, self.window, self.times = limit, window, deque(times)

    def ask_sorted(self, at: np.ndarray) -> np.ndarray:
        """Verdicts for times in order. Free places are given out in one go; without one, the
        search jumps to the first request after the oldest admitted one leaves the window,
        so refused requests cost no step of their own."""
        admitted = np.zeros(len(at), bool)
        i = 0
        while i < len(at):
            while self.times and at[i] - self.times[0] >= self.window:
                self.times.popleft()
            free = self.limit - len(self.times)
            if free > 0:
                admitted[i : i + free] = True
                self.times.extend(at[i : i + free].tolist())
                i += free
            else:
                i += int(np.searchsorted(at[i:], self.times[0] + self.window, "left"))
        return admitted


def _walk(limit: int, window: int):
    """Task body: batches sorted by client, stretch, time, id. State lives across batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rule = None, None
        for batch in batches:
            if batch.empty:
                continue
            client, stretch = batch["client"].to_numpy(), batch["stretch"].to_numpy()
            times, admitted = batch["us"].to_numpy(), np.zeros(len(batch), bool)
            turns = np.flatnonzero((client[1:] != client[:-1]) | (stretch[1:] != stretch[:-1])) + 1
            for start, end in zip([0, *turns], [*turns, len(batch)]):
                if (client[start], stretch[start]) != current:
                    current, rule = (client[start], stretch[start]), Admission(limit, window)
                admitted[start:end] = rule.ask_sorted(times[start:end])
            fresh = ~batch["warm"].to_numpy()
            yield batch.loc[fresh, ["client", "request_id", "us"]].assign(admitted=admitted[fresh])

    return run


def admit_requests(
    log: DataFrame, client_col: str, time_us: Column, id_col: str,
    limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS, chunk_windows: int = _CHUNK_WINDOWS,
) -> DataFrame:
    """(client, request_id, us, admitted) for every request; equal times go by id. Client
    and id must be whole numbers."""
    window = int(window_seconds * 1_000_000)
    chunk = window * chunk_windows
    base = log.select(
        F.col(client_col).cast("bigint").alias("client"), F.col(id_col).cast("bigint").alias("request_id"),
        time_us.cast("bigint").alias("us"),
    )
    own = F.floor(F.col("us") / F.lit(chunk)).cast("bigint")
    # A request in the last two windows of its chunk is also seen by the next chunk.
    late = F.col("us") >= (own + 1) * chunk - 2 * window
    seen = base.select("*", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("chunk"))
    seen = seen.withColumn("mine", own == F.col("chunk"))
    ordered = W.partitionBy("client", "chunk").orderBy("us", "request_id")
    # Sure to be admitted: the request ``limit`` places before is out of the window. Requests
    # whose own look-back is not fully inside the chunk are only look-back themselves.
    far = F.lag("us", limit).over(ordered)
    usable = F.col("us") >= F.col("chunk") * chunk - window
    counted = seen.withColumn("sure", usable & (far.isNull() | (F.col("us") - far >= window)))
    # Calm: every request of the last window is sure. Both tests look at one row each, so
    # their cost does not grow with the traffic inside a window.
    doubt = F.max(F.when(~F.col("sure"), F.col("us"))).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    calm = counted.withColumn("calm", F.col("mine") & (doubt.isNull() | (F.col("us") - doubt >= window)))
    whole = W.partitionBy("client", "chunk")
    marked = calm.withColumn("cut", F.min(F.when(F.col("calm"), F.col("us"))).over(whole))
    marked = stage(marked.select("client", "request_id", "us", "chunk", "mine", "sure", "cut"), "requests")

    # One row per client and chunk: the stretch a chunk opens (its cut) and the one it continues.
    chunks = marked.filter("mine").groupBy("client", "chunk").agg(F.max("cut").alias("cut"))
    before = W.partitionBy("client").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    stretches = chunks.select(
        "client", "chunk", F.coalesce(F.last("cut", ignorenulls=True).over(before), F.lit(-1)).alias("earlier")
    )
    joined = marked.join(stretches, ["client", "chunk"])
    in_new = F.col("cut").isNotNull() & (F.col("us") >= F.col("cut"))
    mine = joined.filter("mine").select(
        "client", "request_id", "us", "sure", F.lit(False).alias("warm"),
        F.when(in_new, F.col("cut")).otherwise(F.col("earlier")).alias("stretch"),
    )
    # The window before a cut is known to be admitted: it is the state the stretch starts with.
    warm = joined.filter(
        F.col("cut").isNotNull() & (F.col("us") < F.col("cut")) & (F.col("us") > F.col("cut") - window)
    ).select("client", "request_id", "us", "sure", F.lit(True).alias("warm"), F.col("cut").alias("stretch"))
    doubtful = mine.filter(~F.col("sure")).select("client", "stretch").distinct()
    settled = mine.join(doubtful, ["client", "stretch"], "left_anti").select(
        "client", "request_id", "us", F.lit(True).alias("admitted")
    )
    open_rows = mine.unionByName(warm).join(doubtful, ["client", "stretch"], "left_semi")
    walked = (
        open_rows.select("client", "stretch", "us", "request_id", "warm")
        .repartition("client", "stretch")
        .sortWithinPartitions("client", "stretch", "us", "request_id")
        .mapInPandas(_walk(limit, window), "client long, request_id long, us long, admitted boolean")
    )
    return settled.unionByName(walked)
