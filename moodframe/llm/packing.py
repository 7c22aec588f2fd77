"""Best-fit packing: length patterns, repeat counts by non-negative least squares, residuals.

Only a histogram of lengths (at most ``capacity`` rows) reaches the driver. Patterns of two or
three lengths that fill a sequence exactly are fitted to it; repeat counts are rounded so that
no length is used more often than it occurs, and what is left is packed best-fit decreasing,
on the histogram too. The plan is a table of slots; pieces find theirs by their rank among the
pieces of their length, which is counted over about sqrt(n) hash ranges at once."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodframe.llm.token_ids import encoded_batches, worker_encoder
from moodframe.session import stage

CAPACITY = 1024
MAX_TRIPLES = 800


def length_patterns(present: np.ndarray, capacity: int, max_triples: int = MAX_TRIPLES) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the capacity: all pairs, and triples evenly
    chosen from all of them."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    low = present[(present <= capacity // 2)]
    pairs = low[have[capacity - low]]
    rows = [np.stack([capacity - pairs, pairs, np.zeros_like(pairs)], 1)]
    x, y = np.meshgrid(present, present, indexing="ij")
    z = capacity - x - y
    ok = (x >= y) & (y >= z) & (z > 0)
    triples = np.stack([x[ok], y[ok], z[ok]], 1)
    triples = triples[have[triples[:, 2]]]
    if len(triples) > max_triples:
        triples = triples[np.linspace(0, len(triples) - 1, max_triples).astype(np.int64)]
    return np.concatenate([*rows, triples])


def nonnegative_least_squares(matrix: np.ndarray, target: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """min |matrix x - target| with x >= 0, by block principal pivoting."""
    gram = matrix.T @ matrix + ridge * np.eye(matrix.shape[1])
    goal = matrix.T @ target
    free = np.zeros(len(goal), bool)
    x, y = np.zeros(len(goal)), -goal
    fewest, tries = len(goal) + 1, 3
    slack = 1e-7 * max(float(np.abs(goal).max(initial=0)), 1.0)
    for _ in range(300):
        wrong = np.flatnonzero((free & (x < -slack)) | (~free & (y < -slack)))
        if not len(wrong):
            break
        if len(wrong) < fewest:
            fewest, tries = len(wrong), 3
        elif tries:
            tries -= 1
        else:
            wrong = wrong[-1:]
        free[wrong] = ~free[wrong]
        x[:] = 0
        x[free] = np.linalg.solve(gram[np.ix_(free, free)], goal[free])
        y = gram @ x - goal
        y[free] = 0
    return np.maximum(x, 0)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on a histogram: (sequences, [(length, times in each)])."""
    gaps: dict[int, list] = {}
    done = []

    def put(gap, number, pattern):
        if number:
            gaps.setdefault(gap, []).append((number, pattern))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g in gaps if g >= length and gaps[g]), default=None)
            if gap is None:
                each = capacity // length
                full = left // each
                put(capacity - each * length, full, [(length, each)])
                if left % each:
                    put(capacity - (left % each) * length, 1, [(length, left % each)])
                break
            number, pattern = gaps[gap].pop()
            used = min(number, left)
            put(gap, number - used, pattern)
            more = pattern[:-1] + [(length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
            put(gap - length, used, more)
            left -= used
        done += [x for x in gaps.pop(0, [])]
    return done + [x for own in gaps.values() for x in own]


def packing_plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, times in each)]) that use up the histogram ``counts`` exactly,
    the fewest sequences among some shares of the fitted repeat counts."""
    plan, counts = [], counts.astype(np.int64).copy()
    if counts[capacity]:
        plan.append((int(counts[capacity]), [(capacity, 1)]))
        counts[capacity] = 0
    present = np.flatnonzero(counts)
    if not len(present):
        return plan
    patterns = length_patterns(present, capacity)
    best = None
    if len(patterns):
        matrix = np.zeros((capacity + 1, len(patterns)))
        for k in range(3):
            np.add.at(matrix, (patterns[:, k], np.arange(len(patterns))), 1.0)
        matrix[0] = 0
        fitted = nonnegative_least_squares(matrix, counts.astype(float))
    for share in (1.0, 0.7, 0.35) if len(patterns) else (0.0,):
        left, own = counts.copy(), []
        if share:
            for u in np.argsort(-fitted, kind="stable"):
                times = int(share * fitted[u])  # rounded down: what is over is easy to pack
                if not times:
                    continue
                lengths, each = np.unique(patterns[u][patterns[u] > 0], return_counts=True)
                times = min(times, int((left[lengths] // each).min()))
                if times > 0:
                    left[lengths] -= times * each
                    own.append((times, [(int(n), int(m)) for n, m in zip(lengths, each, strict=True)]))
        own += best_fit(left, capacity)
        if best is None or sum(n for n, _ in own) < sum(n for n, _ in best):
            best = own
    return plan + best


def slot_table(plan) -> dict[str, np.ndarray]:
    """Slots by (length, first rank): pieces of a length fill them in turn."""
    rows, given, base = [], {}, 0
    for number, pattern in plan:
        offset = 0
        for length, each in pattern:
            start = given.get(length, 0)
            rows.append((length, start, base, each, offset))
            given[length] = start + number * each
            offset += length * each
        base += number
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "start", "sequence", "each", "offset"))}


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text with its end id. A text of more
    than ``capacity`` ids is cut so that only its first piece may be shorter. Null: empty."""

    def run(parts):
        encoder = worker_encoder(tokenizer, True, 4)
        for own, ids in encoded_batches(parts, 1, encoder, end_id):
            row, number, start, length, crc = [], [], [], [], []
            for i, body in enumerate(ids):
                total = len(body) // 4
                at, k = 0, 0
                size = (total - 1) % capacity + 1
                while at < total:
                    row.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(body[4 * at : 4 * (at + size)]))
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays(
                [own.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (staged; read three times) with sequence_id and offset. Equal rows are ranked in
    any order, which gives the same set of rows. No row: no sequence."""
    lengths = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in lengths:
        counts[r["length"]] = r["count"]
    slots = slot_table(packing_plan(counts, capacity))
    ranges = max(1, int(np.sqrt(counts.sum())))
    keyed = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(ranges)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("k", F.row_number().over(inside) - 1).join(starts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("k")).alias("rank"))
    key = slots["length"] << 44 | slots["start"]

    def run(parts):
        for batch in parts:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(key, length.astype(np.int64) << 44 | rank, "right") - 1
            inner = rank - slots["start"][at]
            sequence = slots["sequence"][at] + inner // slots["each"][at]
            offset = slots["offset"][at] + inner % slots["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``capacity`` ids;
    the pieces of a sequence follow each other without a gap from 0."""
    return pack_pieces(stage(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
