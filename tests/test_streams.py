import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from moodframe.functions.lexicon import SAMPLE_POLARITY
from moodframe.operators.collect import keep_unique_retweets
from moodframe.operators.ratelimit import admit_requests
from moodframe.plans import all_queries
from moodframe.streaming import logstreams as ls
from moodframe.streaming import timedlimit as tl
from moodframe.streaming.ratelimit import admissions, admit_stream, close_admissions, late_requests, write_admissions

LOG = "id long, user_id long, created_at timestamp_ntz"


def write_batch(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "id long, user_id long, t string")
    df.select("id", "user_id", F.col("t").cast("timestamp_ntz").alias("created_at")).coalesce(1).write.parquet(f"{folder}/{name}")


def source(spark, folder):
    return ls.read_stream(spark, f"{folder}/*", LOG, files_per_batch=1)


def test_daily_counts_drop_rows_behind_the_watermark(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: ls.write_updates(ls.daily_counts(source(spark, folder)), out, out + "-state").awaitTermination()
    write_batch(spark, folder, "1", [(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-09 10:00:00")])
    run()
    # The first row is days behind the newest one by now, the second is not.
    write_batch(spark, folder, "2", [(3, 1, "2024-01-02 10:00:00"), (4, 2, "2024-01-09 09:00:00")])
    run()
    found = {str(r["date"]): r["count"] for r in ls.latest_values(spark, out, "date", "count").collect()}
    assert found == {"2024-01-01": 1, "2024-01-09": 2}


def test_counters_sum_over_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name, rows in (("1", [(1, 7, "2024-01-01 10:00:00")]), ("2", [(2, 7, "2024-01-03 10:00:00"), (3, 8, "2024-01-02 00:00:00")])):
        write_batch(spark, folder, name, rows)
        ls.count_users(source(spark, folder), out, out + "-state").awaitTermination()
    found = {r["user_id"]: (r["new_predictions"], str(r["last_interaction"])) for r in ls.user_counts(spark, out).collect()}
    assert found == {7: (2, "2024-01-03 10:00:00"), 8: (1, "2024-01-02 00:00:00")}


def test_rate_limit_state_lives_across_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "client long, request_id long, us long"
    batches = [[(1, 1, 0), (1, 2, 1), (1, 3, 2)], [(1, 4, 9), (1, 5, 10), (1, 6, 3)], [(1, 7, 11), (2, 8, 0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        stream = ls.read_stream(spark, f"{folder}/*", schema, files_per_batch=1)
        run = (
            admit_stream(stream, limit=2, window_seconds=10e-6).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    found = {r["request_id"]: r["admitted"] for r in spark.read.parquet(out).collect()}
    # 3 finds the window full; 4 still does; 5 comes when 1 has left; 7 when 2 has left. In its
    # batch, 6 sorts before 4 and finds the window full.
    assert found == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 8: True}


def test_posts_are_labelled_on_a_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    posts = [(1, "@me GREAT day http://x.y"), (2, "worst. day!")]
    spark.createDataFrame(posts, "arrival long, text string").write.parquet(f"{folder}/1")
    stream = ls.read_stream(spark, f"{folder}/*", "arrival long, text string")
    run = (
        ls.labelled_posts_stream(stream, "text", SAMPLE_POLARITY).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    found = {r["arrival"]: (r["text"], r["sentiment"]) for r in spark.read.parquet(out).collect()}
    assert found == {1: ("GREAT day", "positive"), 2: ("worst day", "negative")}


@pytest.fixture(scope="module")
def reversed_requests(spark, tmp_path_factory):
    """(folder, rows): four files, the newest first, one read per micro-batch."""
    draw, folder = random.Random(5), str(tmp_path_factory.mktemp("reversed"))
    rows = sorted(((draw.randrange(3), i, draw.randrange(400)) for i in range(240)), key=lambda r: -r[2])
    for k in range(4):
        part = spark.createDataFrame(rows[60 * k : 60 * k + 60], "client long, request_id long, us long")
        part.coalesce(1).write.parquet(f"{folder}/{k}")
    return folder, rows


@pytest.mark.parametrize("lateness", [None, 400e-6, 60e-6])
def test_held_requests_get_the_batch_verdicts(spark, reversed_requests, tmp_path, lateness):
    (folder, rows), out = reversed_requests, str(tmp_path / "out")
    schema = "client long, request_id long, us long"
    stream = ls.read_stream(spark, f"{folder}/*", schema, files_per_batch=1)
    write_admissions(stream, out, out + "-state", 2, 20e-6, lateness).awaitTermination()
    close_admissions(spark, out, 2, 20e-6)
    found = {tuple(r) for r in admissions(spark, out).collect()}
    late = {(r["client"], r["request_id"], r["us"]) for r in late_requests(spark, out).collect()}
    assert len(found) + len(late) == len(rows) and {r[:3] for r in found} | late == set(rows)
    assert bool(late) == (lateness == 60e-6)
    rest = spark.createDataFrame(sorted(set(rows) - late), schema)
    assert found == {tuple(r) for r in admit_requests(rest, "client", F.col("us"), "request_id", 2, 20e-6).collect()}


def test_verdicts_carry_over_batches_in_order(spark, reversed_requests, tmp_path):
    (folder, rows), out, own = reversed_requests, str(tmp_path / "out"), str(tmp_path / "in")
    schema = "client long, request_id long, us long"
    for k in range(4):
        part = spark.createDataFrame(rows[::-1][60 * k : 60 * k + 60], schema)
        part.coalesce(1).write.parquet(f"{own}/{k}")
        stream = ls.read_stream(spark, f"{own}/*", schema, files_per_batch=1)
        write_admissions(stream, out, out + "-state", 2, 20e-6, 10e-6).awaitTermination()
        close_admissions(spark, out, 2, 20e-6)  # the next batch replaces these
    want = admit_requests(spark.createDataFrame(rows, schema), "client", F.col("us"), "request_id", 2, 20e-6)
    assert sorted(map(tuple, admissions(spark, out).collect())) == sorted(map(tuple, want.collect()))
    assert late_requests(spark, out).count() == 0


@pytest.mark.parametrize(("name", "batch"), [("p7_rate_limit_stream", "p7_rate_limit"), ("p8_streaming_daily_counts", None)])
def test_stream_queries_take_files_in_any_order(spark, sf, tmp_path, monkeypatch, name, batch):
    read, events = ls.read_stream, spark.read.parquet(f"{sf}/events.parquet")
    for k, day in enumerate((24, 16, 8, 0)):  # the newest days first
        part = events.filter(F.dayofmonth("ts").between(day, day + 7))
        part.coalesce(1).write.parquet(f"{tmp_path}/{k}")
    monkeypatch.setattr(ls, "read_stream", lambda s, path, schema: read(s, f"{tmp_path}/*", schema, files_per_batch=1))
    found = sorted(map(tuple, all_queries()[name](spark, sf).collect()))
    days = events.groupBy(F.to_date("ts").cast("string").alias("date")).count()
    assert found == sorted(map(tuple, (all_queries()[batch](spark, sf) if batch else days).collect()))


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]])
def test_retweet_rule_on_a_stream_for_any_file_order(spark, tmp_path, order):
    """Equal posts spread over files: the first one wins whenever it comes, repeats of a file's
    batch change nothing, and null texts are posts of their own."""
    draw, schema = random.Random(9), "arrival long, retweet_count int, text string, sentiment string"
    rows = [(i, draw.randrange(2), draw.choice(["a", "b", "c", None, ""]), draw.choice(["positive", "neutral", None])) for i in range(80)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in order:
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(f"{folder}/{k}")
        for _ in range(2):
            for run in ls.write_unique_posts(ls.read_stream(spark, f"{folder}/*", schema, files_per_batch=1), out, out + "-state"):
                run.awaitTermination()
    found = sorted(map(str, ls.unique_posts(spark, out, spark.createDataFrame([], schema).schema).select("arrival", "retweet_count", "text", "sentiment").collect()))
    batch = keep_unique_retweets(spark.createDataFrame(rows, schema)).select("arrival", "retweet_count", "text", "sentiment")
    assert found == sorted(map(str, batch.collect())) and len(found) < len(rows)


@pytest.mark.parametrize(("order", "lateness"), [([3, 2, 1, 0], 10.0), ([0, 1, 2, 3], 0.01), ([3, 2, 1, 0], 0.02), ([1, 0, 3, 2], 0.25)])
def test_timers_give_the_batch_verdicts(spark, tmp_path, order, lateness):
    """Files of 100 ms each, a run and a restart for each file; what is told late is told once."""
    draw, folder, out = random.Random(6), str(tmp_path / "in"), str(tmp_path / "out")
    schema = "client long, request_id long, us long"
    rows = [(draw.randrange(3), i, 100_000 * (i // 60) + draw.randrange(100) * 1000 + draw.randrange(2)) for i in range(240)]
    run = lambda: tl.write_timed_admissions(ls.read_stream(spark, f"{folder}/*", schema, files_per_batch=1), out, out + "-state", 2, 0.02, lateness).awaitTermination()
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k in order:
        spark.createDataFrame(rows[60 * k : 60 * k + 60], schema).coalesce(1).write.parquet(f"{folder}/{k}")
        run()
    tl.mark_end(spark, out)
    run()
    found = [tuple(r) for r in tl.timed_admissions(spark, out).collect()]
    late = [tuple(r) for r in tl.timed_late(spark, out).collect()]
    assert sorted([r[:3] for r in found] + late) == sorted(rows)
    assert bool(late) == (order == [3, 2, 1, 0] and lateness < 1)
    rest = spark.createDataFrame(sorted(set(rows) - set(late)), schema)
    want = admit_requests(rest, "client", F.col("us"), "request_id", 2, 0.02)
    assert sorted(found) == sorted(map(tuple, want.collect())) and {r[3] for r in found} == {True, False}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


class Held:
    """State of one client that counts its calls."""

    def __init__(self):
        self.values, self.calls = [], 0

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return Marked(self)

    def appendValue(self, value):
        self.values.append(value)
        self.calls += 1

    def appendList(self, values):
        self.values += values
        self.calls += len(values)

    def put(self, values):
        self.values = values
        self.calls += len(values)

    def get(self):
        return iter(self.values)

    def clear(self):
        self.values = []

    def registerTimer(self, ms):
        self.calls += 1

    def listTimers(self):
        return iter([])


class Marked:
    def __init__(self, held):
        self.held, self.value = held, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value
        self.held.calls += 1


class Clock:
    def getCurrentWatermarkInMs(self):
        return 500


def test_state_of_a_client_takes_few_calls_whatever_its_requests():
    """A thousand requests are kept and read back in a few values, a frame without late rows says nothing."""
    processor, held = tl.TimedAdmission(2, 20_000), Held()
    processor.init(held)
    order = random.Random(4).sample(range(1000), 1000)
    frame = pd.DataFrame({"us": [1000 * i for i in order], "request_id": order})
    assert sum(map(len, processor.handleInputRows((7,), iter([frame[:600], frame[600:]]), None))) == 0
    told = pd.concat(processor.handleExpiredTimer((7,), Clock(), None))
    assert held.calls <= 10
    assert told["request_id"].tolist() == list(range(500)) and told["us"].tolist() == [1000 * i for i in range(500)]
    assert told["admitted"].tolist() == [i % 20 < 2 for i in range(500)]
    late = pd.concat(processor.handleInputRows((7,), iter([frame[:600]]), None))
    assert late["us"].tolist() == [1000 * i for i in order[:600] if i < 500] and late["late"].all() and late["admitted"].isna().all()
