import random

import pytest
from pyspark.sql import functions as F

from moodframe.operators import predlog as pl
from moodframe.operators import ratelimit as rl
from moodframe.sources import tables as tb


def brute(rows, limit, window):
    """The sequential rule as the definition states it."""
    admitted, out = {}, {}
    for us, key, client in sorted((us, key, client) for client, key, us in rows):
        times = [t for t in admitted.get(client, []) if us - t < window]
        ok = len(times) < limit
        admitted[client] = times + [us] if ok else times
        out[key] = ok
    return out


def run(spark, rows, limit, seconds, **kw):
    df = spark.createDataFrame(rows, "client long, id long, us long").repartition(5)
    got = rl.admit_requests(df, "client", F.col("us"), "id", limit, seconds, **kw).collect()
    assert len(got) == len(rows)
    return {r["request_id"]: r["admitted"] for r in got}


def test_window_is_strict_and_refused_do_not_count(spark):
    second = 1_000_000
    rows = [(1, i, i * 500_000) for i in range(101)]  # 101 requests in 50 s
    rows += [(1, 200, 60 * second), (1, 201, 60 * second + 1), (2, 300, 0)]
    got = run(spark, rows, 100, 60)
    assert [i for i in range(101) if not got[i]] == [100]
    # At exactly 60 s the first one has left the window; the refused one never counted.
    assert got[200] and not got[201] and got[300]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk_windows", [2, 7])
def test_equal_to_the_sequential_rule_with_a_hot_client(spark, seed, chunk_windows):
    rng = random.Random(seed)
    rows, key = [], 0
    for client in range(6):
        t = 0
        for _ in range(900 if client == 0 else 80):
            # Bursts, equal times and long pauses.
            t += rng.choice([0, 1, 1, 2, 3, 30, 400] if client == 0 else [0, 1, 5, 200, 900]) * 100_000
            rows.append((client, key, t))
            key += 1
    assert run(spark, rows, 3, 2, chunk_windows=chunk_windows) == brute(rows, 3, 2_000_000)


def test_hot_client_is_cut_into_stretches(spark):
    """Only stretches with a doubtful request reach the sequential step."""
    rows = [(1, i, i * 10_000_000) for i in range(500)]  # never more than 1 per second
    df = spark.createDataFrame(rows, "client long, id long, us long")
    out = rl.admit_requests(df, "client", F.col("us"), "id", 3, 2, chunk_windows=4)
    assert out.filter(~F.col("admitted")).count() == 0


def make_log(spark):
    rows = [
        (1, 7, "2024-01-10 10:00:00", "Depressed", 0.9, 0.1), (2, 7, "2024-01-11 10:00:00", "Not depressed", 0.7, 0.3),
        (3, 8, "2024-01-01 10:00:00", "Depressed", 0.5, 0.5), (4, 9, "2024-01-05 00:00:00", "Depressed", 0.8, 0.2),
    ]
    df = spark.createDataFrame(rows, "id long, user_id long, t string, prediction string, confidence double, inference_time double")
    return df.withColumn("created_at", F.col("t").cast("timestamp_ntz")).drop("t")


def test_period_includes_its_start(spark):
    row = pl.analytics(make_log(spark), "2024-01-12 00:00:00", 7).first()
    assert (row["total_predictions"], row["unique_users"]) == (3, 2)
    assert row["depression_rate"] == pytest.approx(2 / 3)


def test_empty_period_gives_zeros(spark):
    row = pl.analytics_report(make_log(spark), "2030-01-01 00:00:00", 7).first()
    assert (row["total_predictions"], row["depression_rate"], row["avg_confidence"], row["predictions_by_date"]) == (0, 0.0, 0.0, [])


def test_counters_only_for_known_users(spark):
    users = spark.createDataFrame([(7, 5), (10, 1)], "user_id long, total_predictions long").withColumn(
        "last_interaction", F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")
    )
    out = {r["user_id"]: r for r in pl.update_counters(users, make_log(spark)).collect()}
    assert set(out) == {7, 10} and out[7]["total_predictions"] == 7 and out[10]["total_predictions"] == 1
    assert str(out[7]["last_interaction"]) == "2024-01-11 10:00:00"


def test_anonymous_ids_repeat_on_rerun(spark):
    requests = spark.createDataFrame([(1, 7), (2, None), (3, 99)], "rid long, user_id long")
    users = spark.createDataFrame([(7,)], "user_id long")
    make = lambda: {r["rid"]: (r["resolved_user"], r["is_anonymous"]) for r in pl.resolve_users(requests, users, "rid").collect()}
    a = make()
    assert a == make() and a[1] == ("7", False) and a[2][1] and a[3][1] and a[2][0] != a[3][0]


def test_log_append_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    tb.append_predictions(make_log(spark), path)
    back = tb.read_predictions(spark, path, since="2024-01-10")
    assert back.count() == 2
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
