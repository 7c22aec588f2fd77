"""Plan shape: what must hold whatever the data size."""

import pytest

import __spark_entry__ as entry

# Queries that fit models before they return; their plans are those of the others.
FITTED = {"m5_cross_validated_bayes", "m11_text_logistic_regression", "m24_best_weights_checkpoint", "e10_fit_time"}
SHAPED = sorted(n for n in entry.queries() if n not in FITTED and not n.startswith("m18"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", SHAPED)
def test_no_cross_join(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", [n for n in SHAPED if n[0] in "tralp" and not n.startswith("p7")])
def test_text_profile_and_log_work_stays_in_the_jvm(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    for step in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonMapInArrow"):
        assert step not in plan


def test_rows_are_scored_where_they_lie(spark):
    from pyspark.ml.linalg import Vectors

    from moodframe.operators.bayes import margins

    rows = spark.createDataFrame([(1, Vectors.sparse(3, [0, 2], [1.0, 2.0])), (2, Vectors.sparse(3, [], []))], ["doc_id", "features"])
    scored = margins(rows, spark.createDataFrame([(0, 0.5), (2, -1.0)], "idx int, w0 double"), ["doc_id"])
    assert "Exchange" not in plan_of(scored) and "Join" not in plan_of(scored)
    assert sorted(map(tuple, scored.collect())) == [(1, -1.5), (2, 0.0)]


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(entry.queries()["p1_analytics"](spark, sf))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan


def test_per_user_pages_are_cut_before_the_shuffle(spark, sf):
    plan = plan_of(entry.queries()["p4_all_histories"](spark, sf))
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["flagship_bayes_confusion", "e7_roc_auc", "a6_exact_quantiles", "m3_stratified_split", "p7_rate_limit", "a10_word_and_pair_counts"])
@pytest.mark.parametrize("partitions", ["1", "200"])
def test_same_rows_with_any_partitioning(spark, sf, name, partitions):
    rows = lambda: sorted(map(str, entry.queries()[name](spark, sf).collect()))
    usual = rows()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows() == usual
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
