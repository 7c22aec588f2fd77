"""Decision trees and random forests of a whole grid, grown together level by level.

The rows are binned once and written. Each level of all trees of all folds and settings is one
scan: a task lets its rows run down the trees so far, counts them by (node, feature, bin, class)
and sends the counts, never rows. Partial counts are added in rounds of bounded groups, the best
split of each node is chosen where its counts meet, and only splits reach the driver.

Settings that prune a tree cost nothing: a node's split depends on its rows and its own random
features alone, so the tree of a smaller depth or a larger minimum split is the same tree cut off
earlier, and the first trees of a large forest are the small forest."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.operators.groves import grove_hits
from moodframe.operators.treerows import BINS, Rows, Shape, best_cuts, bin_of, bootstrap, entries_of, own_features, read_rows, row_blocks  # noqa: F401
from moodframe.session import spread_small, stage

#: Counts made dense at once, rows made dense at once, partial counts added at once.
CELLS, ROWS, FAN_IN = 1 << 20, 256, 32
#: Times ``CELLS`` that a group of nodes may span, trees and values looked at at once, counts held unadded.
SPAN, TREES, PAIRS, HELD = 32, 256, 1 << 18, 1 << 23
#: Entries of a data set up to which a task grows whole trees of it, about 20 bytes each.
ENTRIES = 1 << 25


@dataclass
class Forests:
    """Nodes of all trees; the first ones are the roots. feature -1 marks a leaf; a row goes to
    ``left``, or to the node after it if its bin is above ``bin``."""

    shapes: list[Shape]
    features: list[int]
    shape: np.ndarray
    number: np.ndarray
    tree: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    path: np.ndarray
    counts: np.ndarray

    @classmethod
    def roots(cls, shapes: list[Shape], features: list[int]) -> Forests:
        shape = np.repeat(np.arange(len(shapes)), [s.trees for s in shapes])
        number = np.concatenate([np.arange(s.trees) for s in shapes])
        n = len(shape)
        none = np.full(n, -1, np.int32)
        return cls(shapes, features, shape, number, np.arange(n, dtype=np.int32), none, np.zeros(n, np.uint8), none.copy(), np.zeros(n, np.int16), np.ones(n, np.int64), np.zeros((n, 2), np.int64))

    def split(self, node: np.ndarray, feature: np.ndarray, bin_: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Adds both children of each node; returns the new nodes."""
        first = len(self.feature) + 2 * np.arange(len(node))
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, first
        twice = lambda v: np.repeat(v, 2, 0)
        self.tree = np.concatenate([self.tree, twice(self.tree[node])])
        self.depth = np.concatenate([self.depth, twice(self.depth[node] + 1)])
        self.path = np.concatenate([self.path, twice(2 * self.path[node]) + np.tile([0, 1], len(node))])
        self.counts = np.concatenate([self.counts, np.stack([left, self.counts[node] - left], 1).reshape(-1, 2)])
        more = np.full(2 * len(node), -1, np.int32)
        self.feature, self.left = np.concatenate([self.feature, more]), np.concatenate([self.left, more])
        self.bin = np.concatenate([self.bin, np.zeros(2 * len(node), np.uint8)])
        return np.arange(len(self.feature) - 2 * len(node), len(self.feature))

    def open_nodes(self, nodes: np.ndarray) -> np.ndarray:
        """Those that may be split again: enough rows, both classes, depth left."""
        least = np.array([s.min_split for s in self.shapes])[self.shape[self.tree[nodes]]]
        deepest = np.array([s.max_depth for s in self.shapes])[self.shape[self.tree[nodes]]]
        n = self.counts[nodes]
        return nodes[(n.sum(1) >= np.maximum(least, 2)) & (n.min(1) > 0) & (self.depth[nodes] < deepest)]


def descend(trees, node: np.ndarray, row: np.ndarray, dense: np.ndarray, may_descend: np.ndarray) -> np.ndarray:
    """The nodes that the rows reach which start in ``node``, which is changed."""
    live = np.flatnonzero(may_descend[node])
    while len(live):
        at = node[live]
        node[live] = trees.left[at] + (dense[row[live], trees.feature[at]] > trees.bin[at])
        live = live[may_descend[node[live]]]
    return node


def route(forests: Forests, trees: np.ndarray, dense: np.ndarray, may_descend: np.ndarray) -> np.ndarray:
    """(trees, rows): the node each row ends in; ``may_descend`` says which nodes let rows on."""
    row = np.tile(np.arange(len(dense)), len(trees))
    return descend(forests, np.repeat(trees, len(dense)), row, dense, may_descend).reshape(len(trees), len(dense))


@dataclass
class Group:
    """Open nodes of one data set and width, with all that their features and samples depend on."""

    data: int
    features: int
    width: int
    nodes: np.ndarray
    tree: np.ndarray
    number: np.ndarray
    path: np.ndarray
    sampled: np.ndarray
    entropy: np.ndarray

    def part(self, own: slice) -> Group:
        return Group(self.data, self.features, self.width, *(v[own] for v in (self.nodes, self.tree, self.number, self.path, self.sampled, self.entropy)))

    def looks(self) -> np.ndarray:
        return own_features(self.width, self.features, self.number, self.path)

    @property
    def dense_nodes(self) -> int:
        """Nodes whose counts are made dense at once."""
        return max(1, CELLS // (self.width * BINS * 2))


@dataclass
class Level:
    """What a task needs of the trees so far, and the nodes to count."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    groups: list[Group]


def node_groups(forests: Forests, nodes: np.ndarray, least_groups: int) -> list[Group]:
    """All open nodes in groups of one data set and width."""
    tree = forests.tree[nodes]
    shape = forests.shape[tree]
    of = lambda values: np.array(values)[shape]
    width, data = of([s.width(forests.features[s.fold]) for s in forests.shapes]), of([s.fold for s in forests.shapes])
    facts = nodes, tree, forests.number[tree], forests.path[nodes], of([s.trees > 1 for s in forests.shapes]), of([s.impurity == "entropy" for s in forests.shapes])
    share = -(-len(nodes) // least_groups)
    groups = []
    for key in sorted(set(zip(data.tolist(), width.tolist(), strict=True))):
        own = np.flatnonzero((data == key[0]) & (width == key[1]))
        whole = Group(key[0], forests.features[key[0]], key[1], *(v[own] for v in facts))
        most = max(1, min(SPAN * whole.dense_nodes, share))
        groups += [whole.part(slice(i, i + most)) for i in range(0, len(own), most)]
    return groups


def added(cells: list[np.ndarray]) -> np.ndarray:
    """Sorted cells with the sum of their counts. A cell is its number times 2 ** 32 plus a count."""
    every = np.sort(np.concatenate([np.zeros(0, np.int64), *cells]))
    if not len(every):
        return every
    key = every >> 32
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[first] << 32) | np.add.reduceat(every & 0xFFFFFFFF, first)


def count_group(level: Level, group: Group, rows: Rows, inner: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the cells (node, feature, bin, class), class totals) of the rows in each node of
    the group. Bin 0 is left out: totals minus the others give it. ``slot`` is -1 for all nodes and
    is so again afterwards."""
    every = group.width == group.features
    looks = None if every else group.looks()
    slot[group.nodes] = np.arange(len(group.nodes))
    trees, first = np.unique(group.tree, return_index=True)
    number, sampled = group.number[first], group.sampled[first]
    totals, found, size = np.zeros(2 * len(group.nodes), np.int64), [], 0
    for begin in range(0, len(rows.ids), ROWS):
        end = min(begin + ROWS, len(rows.ids))
        dense = rows.dense(begin, end, group.features)
        for at in range(0, len(trees), TREES):
            own_trees = slice(at, at + TREES)
            weight = np.ones((len(trees[own_trees]), end - begin), np.int64)
            if sampled[own_trees].any():
                weight = np.where(sampled[own_trees, None], bootstrap(rows.ids[begin:end], number[own_trees]), 1)
            tree, row = np.nonzero(weight)
            own = slot[descend(level, trees[own_trees][tree], row, dense, inner)]
            kept = np.flatnonzero(own >= 0)
            own, row, weight = own[kept].astype(np.int64), row[kept], weight[tree[kept], row[kept]]
            label = rows.label[begin + row]
            totals += np.bincount(2 * own + label, weight, 2 * len(group.nodes)).astype(np.int64)
            step = max(1, PAIRS // (ROWS if every else group.width))
            for some in range(0, len(own), step):
                part = slice(some, some + step)
                if every:
                    place, lengths = entries_of(rows, begin + row[part])
                    pair, column, seen = np.repeat(np.arange(len(lengths)), lengths), rows.idx[place], rows.bins[place]
                    if not seen.all():
                        pair, column, seen = (v[seen > 0] for v in (pair, column, seen))
                else:
                    seen = dense.ravel().take(row[part, None] * group.features + looks[own[part]]).ravel()
                    hit = np.flatnonzero(seen != 0)
                    pair, column, seen = hit // group.width, hit % group.width, seen[hit]
                key = ((own[part][pair] * group.width + column) * BINS + seen) * 2 + label[part][pair]
                found.append((key << 32) | weight[part][pair])
                size += len(key)
            if size > HELD:
                found = [added(found)]
                size = len(found[0]) // 2  # so that distinct cells alone do not sort again each time
    slot[group.nodes] = -1
    return added(found), totals


def best_splits(group: Group, cells: np.ndarray, totals: np.ndarray) -> dict[str, np.ndarray]:
    """Best split of each node; feature is -1 where all features looked at are constant."""
    feature, border, l0, l1 = best_cuts(cells >> 32, cells & 0xFFFFFFFF, totals.reshape(-1, 2), group.looks(), group.entropy)
    return {"node": group.nodes, "n0": totals[0::2], "n1": totals[1::2], "feature": feature, "bin": border, "l0": l0, "l1": l1}


_SPLITS = "node long, n0 long, n1 long, feature long, bin long, l0 long, l1 long"
_COUNTS = "group int, part int, cells binary, totals binary"


def _counted(group: int, part: int, cells: np.ndarray, totals: np.ndarray) -> list[pa.Array]:
    row = [group, part, cells.tobytes(), totals.tobytes()]
    return [pa.array([v], k) for v, k in zip(row, [pa.int32()] * 2 + [pa.binary()] * 2, strict=True)]


def _level_counts(rows: DataFrame, shared) -> DataFrame:
    def run(parts):
        from pyspark import TaskContext

        level, part = shared.value, TaskContext.get().partitionId()
        own = {data: r.take(np.flatnonzero(r.fold != data)) for data, r in read_rows(parts).items()}
        inner, slot = level.feature >= 0, np.full(len(level.feature), -1, np.int32)
        for number, group in enumerate(level.groups):
            if group.data in own:
                yield pa.RecordBatch.from_arrays(_counted(number, part, *count_group(level, group, own[group.data], inner, slot)), ["group", "part", "cells", "totals"])

    return rows.mapInArrow(run, _COUNTS)


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    cells, totals = ([np.frombuffer(v.as_buffer(), np.int64) for v in table.column(c)] for c in ("cells", "totals"))
    return added(cells), np.sum(totals, 0)


def _add_partials(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py() // FAN_IN
    return pa.Table.from_arrays(_counted(table.column("group")[0].as_py(), part, *_added(table)), ["group", "part", "cells", "totals"])


def level_splits(rows: DataFrame, forests: Forests, nodes: np.ndarray) -> pa.Table:
    """The splits of all open nodes, from one scan of the rows."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(Level(forests.feature, forests.bin, forests.left, node_groups(forests, nodes, 4 * context.defaultParallelism)))
    partial, parts = _level_counts(rows, shared), rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        partial = partial.groupBy("group", F.floor(F.col("part") / FAN_IN)).applyInArrow(_add_partials, _COUNTS)
        parts = -(-parts // FAN_IN)

    def choose(table: pa.Table) -> pa.Table:
        group = shared.value.groups[table.column("group")[0].as_py()]
        return pa.table(best_splits(group, *_added(table)))

    try:
        return partial.groupBy("group").applyInArrow(choose, _SPLITS).toArrow()
    finally:
        shared.unpersist()


def grow_forests(rows: DataFrame, shapes: list[Shape], features: list[int]) -> Forests:
    """All trees of all shapes. ``rows`` is a written table (data, id, label 0 or 1, fold, idx,
    val): values of the features of data set ``data``, whose fold of that number is held out; or
    their blocks. Values are from 0 to 1; missing entries are 0. The trees are held by the driver;
    their number of nodes follows the grid and the minimum split."""
    rows = rows if "block" in rows.columns else stage(row_blocks(rows), "tree-blocks")
    forests = Forests.roots(shapes, features)
    usable = np.array([features[s.fold] > 0 for s in shapes])[forests.shape]
    nodes = np.flatnonzero(usable)
    while len(nodes):
        found = level_splits(rows, forests, nodes)
        node, feature, bin_, n0, n1, l0, l1 = (found.column(c).to_numpy() for c in ("node", "feature", "bin", "n0", "n1", "l0", "l1"))
        order = np.argsort(node)
        node, feature, bin_ = node[order], feature[order], bin_[order]
        left = np.stack([l0, l1], 1)[order]
        roots = forests.depth[node] == 0
        forests.counts[node[roots]] = np.stack([n0, n1], 1)[order][roots]
        split = (feature >= 0) & np.isin(node, forests.open_nodes(node))
        nodes = forests.open_nodes(forests.split(node[split], feature[split], bin_[split], left[split]))
    return forests


def shares_of_one(forests: Forests) -> np.ndarray:
    """Share of class 1 in each node; a tree without rows says one half."""
    n = forests.counts.sum(1)
    return np.where(n > 0, forests.counts[:, 1] / np.maximum(n, 1), 0.5)


def splits_of(forests: Forests, max_depth: int, min_split: int) -> np.ndarray:
    """The nodes that still split in the trees cut to the depth and the minimum split."""
    return (forests.feature >= 0) & (forests.depth < max_depth) & (forests.counts.sum(1) >= min_split)


def settings_of(grid: dict) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def shapes_of(settings: list[dict], folds: int) -> list[Shape]:
    """The trees that serve all settings: the deepest, largest and finest of each kind."""
    kinds = dict.fromkeys((s.get("featureSubsetStrategy", "all"), s["impurity"]) for s in settings)
    most = {k: [s for s in settings if (s.get("featureSubsetStrategy", "all"), s["impurity"]) == k] for k in kinds}
    return [
        Shape(fold, *kind, max(s.get("numTrees", 1) for s in own), max(s["maxDepth"] for s in own), min(s["minSplit"] for s in own))
        for fold in range(folds) for kind, own in most.items()
    ]


def held_out_hits(rows: DataFrame, forests: Forests, settings: list[dict]) -> DataFrame:
    """(setting_order, fold, hits, rows): rows of each fold scored by the trees that never saw
    them; class 1 if the mean share is above one half. One scan, a few rows a task."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)
    first_tree = np.append(0, np.cumsum([s.trees for s in forests.shapes]))

    def run(parts):
        held = shared.value
        shares = shares_of_one(held)
        cuts = {cut: splits_of(held, *cut) for cut in dict.fromkeys((s["maxDepth"], s["minSplit"]) for s in settings)}
        for data, own in read_rows(parts).items():
            own = own.take(np.flatnonzero(own.fold == data))
            hits = np.zeros(len(settings), np.int64)
            for first in range(0, len(own.ids), ROWS):
                last = min(first + ROWS, len(own.ids))
                dense = own.dense(first, last, held.features[data])
                sums = np.zeros((len(settings), last - first))
                for number, shape in enumerate(held.shapes):
                    if shape.fold != data:
                        continue
                    mine = [i for i, s in enumerate(settings) if (s.get("featureSubsetStrategy", "all"), s["impurity"]) == (shape.subset, shape.impurity)]
                    for cut in dict.fromkeys((settings[i]["maxDepth"], settings[i]["minSplit"]) for i in mine):
                        stops = sorted({settings[i].get("numTrees", 1) for i in mine})
                        so_far = np.zeros(last - first)
                        for begin, end in zip([0, *stops], stops, strict=False):
                            for at in range(begin, end, 64):
                                trees = first_tree[number] + np.arange(at, min(at + 64, end))
                                so_far = so_far + shares[route(held, trees, dense, cuts[cut])].sum(0)
                            for i in mine:
                                if (settings[i]["maxDepth"], settings[i]["minSplit"]) == cut and settings[i].get("numTrees", 1) == end:
                                    sums[i] = so_far / end
                hits += ((sums > 0.5) == (own.label[first:last] == 1)).sum(1)
            n = len(settings)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, data, np.int32)), pa.array(hits), pa.array(np.full(n, len(own.ids)))], ["setting_order", "fold", "hits", "rows"])

    scored = rows.mapInArrow(run, "setting_order int, fold int, hits long, rows long")
    return scored.groupBy("setting_order", "fold").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows"))


def forest_fold_scores(rows: DataFrame, grid: dict, folds: int, features: list[int]) -> DataFrame:
    """(setting_order, setting, fold, accuracy, rows) of every setting and fold of a grid of trees
    (impurity, maxDepth, minSplit) or forests (also numTrees, featureSubsetStrategy)."""
    settings, rows = settings_of(grid), rows.select("data", "id", "label", "fold", "idx", "val")
    shapes = shapes_of(settings, folds)
    blocks = stage(row_blocks(spread_small(rows)), "tree-blocks")
    most = blocks.groupBy("data").agg(F.sum("entries").alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= ENTRIES:
        hits = grove_hits(blocks, settings, shapes, features)
    else:
        hits = held_out_hits(blocks, grow_forests(blocks, shapes, features), settings)
    names = F.array(*[F.lit(str(s)) for s in settings])
    return hits.where("rows > 0").select("setting_order", names[F.col("setting_order")].alias("setting"), "fold", (F.col("hits") / F.col("rows")).alias("accuracy"), "rows")
