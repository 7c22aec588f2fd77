"""What trees are grown from: binned rows in blocks, the rows and features that a tree draws, and
the best cut of a node. All of it is the same wherever and together with whatever a tree grows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Upper borders of the bins of a value: 0, then thirds of powers of two up to 1.
BINS = 32
EDGES = np.append(0.0, 2.0 ** ((np.arange(1, BINS) - (BINS - 1)) / 3.0))
DRAWS = 256  # nodes that draw their features at once
_STEP, _TREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Shape:
    """Trees that are grown alike: on the rows outside ``fold``, with so many random features at
    each node, from bootstrap samples unless there is one tree."""

    fold: int
    subset: str
    impurity: str
    trees: int
    max_depth: int
    min_split: int

    def width(self, features: int) -> int:
        size = {"all": features, "sqrt": int(math.sqrt(features)), "log2": int(math.log2(max(features, 1)))}[self.subset]
        return max(1, min(size, features))


def bin_of(values: np.ndarray) -> np.ndarray:
    """Bin numbers of values from 0 to 1: 0 for zero, the first border not below otherwise."""
    return np.minimum(np.searchsorted(EDGES, values, "left"), BINS - 1).astype(np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def own_features(width: int, features: int, number: np.ndarray, path: np.ndarray, seed: int = 42) -> np.ndarray:
    """(nodes, width): the features that each node looks at, in rising order, a fair draw without
    replacement that depends on the number of its tree and its path from the root alone."""
    if width == features:
        return np.broadcast_to(np.arange(features), (len(number), features))
    key = _mix(_mix(number.astype(np.uint64) * _TREE + np.uint64(seed * 1000 + width)) + path.astype(np.uint64) * _STEP)
    turns, out = np.arange(width, dtype=np.uint64) * _TREE, np.empty((len(number), width), np.int32)
    rest = np.uint64(features) - np.arange(width, dtype=np.uint64)[:, None]
    left = np.tile(np.arange(features, dtype=np.int32), min(len(number), DRAWS))
    for first in range(0, len(number), DRAWS):
        own = key[first : first + DRAWS]
        start = np.arange(len(own)) * features
        other = (_mix(own + turns[:, None]) % rest).astype(np.int64) + np.arange(width)[:, None] + start
        for i, at in enumerate(other):
            chosen = left[at]
            left[at] = left[start + i]
            out[first : first + DRAWS, i] = chosen
        left[other.ravel()] = (other - start).ravel()  # as before the draw
    out.sort(1)
    return out.astype(np.int64)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def bootstrap(ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """How often each tree (rows) draws each row (columns): Poisson counts of a hash of both."""
    x = ids.astype(np.int64).view(np.uint64)[None, :] * _STEP + (number.astype(np.uint64) + np.uint64(1))[:, None] * _TREE
    return np.searchsorted(_POISSON, _mix(x) / 2.0**64).astype(np.int64)


@dataclass
class Rows:
    """Binned rows of one data set in a task."""

    ids: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    bounds: np.ndarray
    idx: np.ndarray
    bins: np.ndarray

    def dense(self, first: int, last: int, features: int) -> np.ndarray:
        out = np.zeros((last - first, features), np.uint8)
        own = slice(self.bounds[first], self.bounds[last])
        out[np.repeat(np.arange(last - first), np.diff(self.bounds[first : last + 1])), self.idx[own]] = self.bins[own]
        return out

    def take(self, rows: np.ndarray) -> Rows:
        lengths = np.diff(self.bounds)[rows]
        at = np.repeat(self.bounds[rows] - np.append(0, np.cumsum(lengths))[:-1], lengths) + np.arange(lengths.sum())
        return Rows(self.ids[rows], self.label[rows], self.fold[rows], np.append(0, np.cumsum(lengths)), self.idx[at], self.bins[at])


#: Columns of the arrays of a block, and how they are written.
_ARRAYS = {"ids": np.int64, "label": np.int64, "fold": np.int32, "lengths": np.int32, "idx": np.int32, "bins": np.uint8}
BLOCKS = "data int, block long, entries long, " + ", ".join(f"{c} binary" for c in _ARRAYS)


def row_blocks(rows: DataFrame) -> DataFrame:
    """Rows (data, id, label, fold, idx, val) binned, a few thousand of one data set in a block."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, values = batch.column(batch.schema.get_field_index("idx")), batch.column(batch.schema.get_field_index("val"))
            flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
            numbers = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("data", "id", "label", "fold")}
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bounds = np.append(0, np.cumsum(lengths.astype(np.int64)))
            every = Rows(numbers["id"], numbers["label"], numbers["fold"], bounds, flat(lists).astype(np.int64), bin_of(flat(values)))
            for data in np.unique(numbers["data"]):
                own = every.take(np.flatnonzero(numbers["data"] == data))
                arrays = own.ids, own.label, own.fold, np.diff(own.bounds), own.idx, own.bins
                bytes_ = [pa.array([np.ascontiguousarray(a, t).tobytes()], pa.binary()) for a, t in zip(arrays, _ARRAYS.values(), strict=True)]
                facts = [pa.array([int(data)], pa.int32()), pa.array([number]), pa.array([len(own.idx)])]
                yield pa.RecordBatch.from_arrays([*facts, *bytes_], ["data", "block", "entries", *_ARRAYS])
                number += 1

    return rows.select("data", "id", "label", "fold", "idx", "val").mapInArrow(run, BLOCKS)


def rows_of(table: pa.Table) -> Rows:
    """The rows of blocks of one data set, in the order of the blocks."""
    table = table.take(np.argsort(table.column("block").to_numpy()))
    ids, label, fold, lengths, idx, bins = (
        np.concatenate([np.zeros(0, t), *(np.frombuffer(v.as_buffer(), t) for v in table.column(c))]) for c, t in _ARRAYS.items()
    )
    return Rows(ids, label, fold, np.append(0, np.cumsum(lengths, dtype=np.int64)), idx, bins)


def read_rows(parts) -> dict[int, Rows]:
    """All rows of a partition of blocks, by data set."""
    batches = [b for b in parts if b.num_rows]
    if not batches:
        return {}
    table = pa.Table.from_batches(batches)
    data = table.column("data").to_numpy()
    return {int(d): rows_of(table.take(np.flatnonzero(data == d))) for d in np.unique(data)}


def entries_of(rows: Rows, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all entries of the rows, number of entries of each)."""
    lengths = rows.bounds[row + 1] - rows.bounds[row]
    return np.repeat(rows.bounds[row] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum()), lengths


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, key[1:] != key[:-1]))


def _score(c0: np.ndarray, c1: np.ndarray, logs: np.ndarray, bits: bool) -> np.ndarray:
    return logs[c0] + logs[c1] - logs[c0 + c1] if bits else (c0**2 + c1**2) / np.maximum(c0 + c1, 1)


def best_cuts(key: np.ndarray, n: np.ndarray, totals: np.ndarray, looks: np.ndarray, entropy: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature, border, left of class 0, left of class 1) of the best cut of each node: the largest
    fall of the impurity, ties to the smaller feature and then the smaller border. feature is -1
    where all features looked at are constant. ``key`` are the cells ((node, place of the feature),
    bin, class) with rows in rising order, bin 0 left out, ``n`` their counts.

    Borders between two bins with rows cut alike, so only the smallest of each such run is tried."""
    width = looks.shape[1]
    feature, border, left = np.full(len(totals), -1), np.zeros(len(totals), np.int64), np.zeros((len(totals), 2), np.int64)
    if not len(key):
        return feature, border, left[:, 0], left[:, 1]
    first = _starts(key >> 1)
    ones = np.add.reduceat(n * (key & 1), first)
    sums = np.stack([np.add.reduceat(n, first) - ones, ones], 1)
    spot = key[first] >> 1
    column = spot // BINS
    begin = _starts(column)
    upto = np.cumsum(sums, 0)
    ends = np.repeat(upto[np.append(begin[1:], len(column)) - 1], np.diff(np.append(begin, len(column))), 0)
    right = ends - upto + sums
    below = np.append(0, spot[:-1] % BINS)
    below[begin] = 0
    node = column // width
    lower = totals[node] - right
    kept = np.flatnonzero(lower.sum(1) > 0)
    if not len(kept):
        return feature, border, left[:, 0], left[:, 1]
    lower, right, node = lower[kept], right[kept], node[kept]
    whole = np.arange(1 + int(totals.sum(1).max(initial=0)))
    logs = whole * np.log(np.maximum(whole, 1))  # counts are whole numbers: their logarithms are looked up
    score, bits = np.empty(len(kept)), entropy[node]
    for kind in np.unique(bits):
        some = slice(None) if (bits == kind).all() else bits == kind
        score[some] = _score(lower[some, 0], lower[some, 1], logs, kind) + _score(right[some, 0], right[some, 1], logs, kind)
    begin = _starts(node)
    best = np.maximum.reduceat(score, begin)
    # equal counts may differ in the last digit: the first of those that tie
    tie = np.flatnonzero(score >= np.repeat(best * (1 - 1e-12 * np.sign(best)), np.diff(np.append(begin, len(node)))))
    tie = tie[_starts(node[tie])]
    own, at = node[tie], kept[tie]
    feature[own], border[own], left[own] = looks[own, column[at] % width], below[at], lower[tie]
    return feature, border, left[:, 0], left[:, 1]


def summed(keys: list[np.ndarray], weights: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys below ``size`` in rising order, sums of their weights, which are from 1 to 15)."""
    key, weight = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (keys, weights))
    if size <= min(4 * len(key), 1 << 24):
        n = np.bincount(key, weight, size)
        key = np.flatnonzero(n)
        return key, n[key].astype(np.int64)
    every = np.sort(key << 4 | weight)
    first = _starts(every >> 4) if len(every) else np.zeros(0, np.int64)
    return every[first] >> 4, np.add.reduceat(every & 15, first) if len(every) else every
