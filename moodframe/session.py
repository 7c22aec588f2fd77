"""Session, staging and size-checked broadcast helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_ROWS = 200_000
HOT_KEYS, TRACKED_KEYS = 1_000, 10_000
_local_folder: list[str] = []
_staged: list[str] = []


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("moodframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only a local session without
    that setting gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="moodframe-"))
    return _local_folder[0]


def new_folder(spark: SparkSession, label: str) -> str:
    """A scratch folder of this program, which ``drop_stages`` deletes."""
    path = f"{scratch_dir(spark)}/moodframe/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Writes a reused intermediate once as parquet in the shared folder and reads it
    back: lineage is cut, lost executors cost nothing, and the planner knows its size."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Deletes the scratch folders of this program, staged tables and others; call it when
    results are saved and nothing reads them any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _staged:
        path = hadoop(_staged.pop())
        done += int(path.getFileSystem(conf).delete(path, True))
    return done


def fits(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> bool:
    """True if the frame has at most ``max_rows`` rows. Reads no more than that per task."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on, how: str = "inner", max_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Joins to a lookup table: broadcast when its row count is checked to be small,
    else a shuffle join that adaptive execution can split on hot keys."""
    side = F.broadcast(lookup) if fits(lookup, max_rows) else lookup
    return facts.join(side, on, how)


def hot_keys(facts: DataFrame, on: str, most: int = HOT_KEYS) -> list:
    """The at most ``most`` commonest values of a column, by a sketch of ``TRACKED_KEYS``
    counters; every value that holds clearly more than one in ``most`` rows is among them."""
    top = facts.agg(F.expr(f"approx_top_k(`{on}`, {int(most)}, {TRACKED_KEYS})")).first()[0]
    return [r["item"] for r in top or [] if r["item"] is not None]


def hot_join(facts: DataFrame, lookup: DataFrame, on: str, most: int = HOT_KEYS, found: list | None = None) -> DataFrame:
    """Inner join to a ``lookup`` of one row a key. Facts of the commonest keys stay where
    they are and get the few rows of those keys by broadcast (at most ``most``); all others are
    shuffled, and none of their keys is large. ``facts`` is read twice, and once more for its
    common keys unless they are ``found`` before: stage it."""
    hot = hot_keys(facts, on, most) if found is None else found
    if not hot:
        return facts.join(lookup, on)
    common = F.col(on).isin(hot)
    near = facts.filter(common).join(F.broadcast(lookup.filter(common)), on)
    return near.unionByName(facts.filter(~common).join(lookup, on))


def spread_small(df: DataFrame, bytes_per_core: int = 16 << 20) -> DataFrame:
    """Spreads a frame over all cores if the planner knows it to be small. A large one has
    splits enough and is left as it is: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * bytes_per_core else df
