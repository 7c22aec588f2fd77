"""Exact top-k inner products with a KD-tree for each shard of vectors.

Trees split at the median of the widest side and keep tight boxes. The largest inner product
of a query with a box is a sum over sides; nodes are opened best-first until the best open
bound is below the query's k-th score so far. That score travels: from a sixteenth of the
shards to all others, and from shard to shard inside a task."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodframe.session import stage

SHARD, LEAF, QUERY_BLOCK, SEED_SHARDS = 4096, 64, 4096, 16


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, dim, vector): floor(scale * x) of each component. Rows with a null id, a null
    vector, or a null or non-finite component take no part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long"), F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("vector"))


def build_tree(vectors: np.ndarray, leaf: int = LEAF):
    """(order of the rows, first row, last row, left child (-1: leaf), low, high) by node."""
    order = np.arange(len(vectors))
    first, last, left, low, high = [0], [len(vectors)], [-1], [None], [None]
    at = 0
    while at < len(first):
        own = order[first[at] : last[at]]
        rows = vectors[own]
        low[at], high[at] = rows.min(0), rows.max(0)
        if len(own) > leaf and vectors.shape[1]:
            side = int(np.argmax(high[at] - low[at]))
            if high[at][side] > low[at][side]:
                half = len(own) // 2
                order[first[at] : last[at]] = own[np.argpartition(rows[:, side], half)]
                left[at] = len(first)
                middle = first[at] + half
                first += [first[at], middle]
                last += [middle, last[at]]
                left += [-1, -1]
                low += [None, None]
                high += [None, None]
        at += 1
    return order, np.array(first), np.array(last), np.array(left), np.stack(low), np.stack(high)


def kd_index(rows: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """One row for each shard: ids and vectors in leaf order, and the tree, as bytes. Shards are
    hash ranges of the id inside a dimension, so no key decides their size."""
    counts = rows.groupBy("dim").count()
    sized = rows.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.ceil(F.col("count") / shard_rows)))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        dim = table.column("dim")[0].as_py()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        order, *tree = build_tree(vectors)
        kinds = ["<i8", "<i8", "<i8", "<i8", "<i8"]
        cells = [table.column("dim")[0].as_py(), table.column("shard")[0].as_py(), ids[order].astype("<i8").tobytes(), vectors[order].astype("<i8").tobytes(), *[v.astype(k).tobytes() for v, k in zip(tree, kinds, strict=True)]]
        return pa.Table.from_arrays([pa.array([c], pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(cells)], ["dim", "shard", "ids", "vectors", "first", "last", "left", "low", "high"])

    return sized.groupBy("dim", "shard").applyInArrow(build, "dim long, shard long, ids binary, vectors binary, first binary, last binary, left binary, low binary, high binary")


def search_shards(index: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], floors: dict[int, int], k: int) -> DataFrame:
    """(query_id, vec_id, score): candidates that may be among the k best of each query.
    ``queries`` has (ids, vectors) by dimension, at most a block of them; ``floors`` are scores
    that k other vectors are known to reach."""

    def run(parts):
        best: dict[int, list] = {}
        for batch in parts:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                if dim not in queries:
                    continue
                ids, vectors, first, last, left, low, high = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in range(1, 8))
                vectors, low, high = (v.reshape(-1, dim) if dim else np.zeros((n, 0), np.int64) for v, n in ((vectors, len(ids)), (low, len(first)), (high, len(first))))
                known, asked = queries[dim]
                reach = int(np.abs(vectors).max(initial=0)) * int(np.abs(asked).max(initial=0)) * max(dim, 1)
                kind = np.float64 if reach < 1 << 53 else object  # doubles are exact below that
                asked, vectors, low, high = (v.astype(kind) for v in (asked, vectors, low, high))
                bounds = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
                for row, query in enumerate(known.tolist()):
                    heap = best.setdefault(query, [])
                    floor = heap[0][0] if len(heap) == k else floors.get(query, -(1 << 200))
                    floor = max(floor, floors.get(query, -(1 << 200)))
                    open_ = [(-bounds[row, 0], 0)]
                    while open_ and -open_[0][0] >= floor:
                        _, node = heapq.heappop(open_)
                        if left[node] >= 0:
                            for child in (int(left[node]), int(left[node]) + 1):
                                if bounds[row, child] >= floor:
                                    heapq.heappush(open_, (-bounds[row, child], child))
                            continue
                        own = slice(int(first[node]), int(last[node]))
                        scores = vectors[own] @ asked[row]
                        for at in np.flatnonzero(scores >= floor):
                            other = int(ids[own][at])
                            if other == query:
                                continue
                            item = (int(scores[at]), -other)
                            if len(heap) < k:
                                heapq.heappush(heap, item)
                            elif item > heap[0]:
                                heapq.heapreplace(heap, item)
                            if len(heap) == k:
                                floor = max(floor, heap[0][0])
        rows = [(q, -other, min(max(score, -(1 << 63)), (1 << 63) - 1)) for q, heap in best.items() for score, other in heap]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return index.select("dim", "ids", "vectors", "first", "last", "left", "low", "high").mapInArrow(run, "query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all
    rows of other ids and the same dimension, ties to the smaller id; fewer if there are fewer.

    Queries are searched in hash blocks of about ``query_block``, each held by every task, so
    memory is bounded however many there are. Repeated ids ask once, with their smallest vector,
    and are candidates each. Scores beyond the long range are cut to it."""
    rows = stage(quantised(vectors, scale), "vectors")
    index = stage(kd_index(rows), "kd_index")
    asked = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("v")).select("vec_id", "v.dim", "v.vector")
    blocks = max(1, -(-asked.count() // query_block))
    asked = stage(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "queries")
    seeds, others = index.where(F.col("shard") % SEED_SHARDS == 0), index.where(F.col("shard") % SEED_SHARDS != 0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    results = []
    for block in range(blocks):
        queries: dict[int, list] = {}
        for r in asked.where(F.col("block") == block).collect():
            queries.setdefault(r["dim"], []).append((r["vec_id"], r["vector"]))
        packed = {d: (np.array([q for q, _ in own], np.int64), np.array([v for _, v in own], np.int64).reshape(len(own), d)) for d, own in queries.items()}
        near = stage(ranked(search_shards(seeds, packed, {}, k)).drop("rank"), "seeds")
        floors = {r["query_id"]: r["floor"] for r in near.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
        results.append(stage(ranked(near.union(search_shards(others, packed, floors, k))), "top"))
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
