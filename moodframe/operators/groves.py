"""Trees of a grid grown side by side in tasks, where the rows of a data set fit one.

A task holds the rows of one data set as bits (row, feature), with their bins in the order of the
bits, and grows its share of the trees by levels, many trees at once. A row keeps its node from one
level to the next. Large nodes are counted by the bits of their rows and those of the features they
look at, small ones by looking the features up in each row. Held-out rows run along and leave the share of class 1
where each setting cuts the tree, so no tree leaves its task: only sums of shares do.

Trees are those of ``forest.grow_forests``, which takes rows of any number."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.operators.treerows import BINS, Rows, Shape, best_cuts, bootstrap, entries_of, own_features, rows_of, summed

#: Trees whose shares are added at once, (row, tree) pairs grown at once, values looked at at once.
CHUNK, PAIRS, VALUES = 64, 1 << 19, 1 << 17
#: Words of the rows of a feature that are read in the time of looking it up in one row.
WORD_GAIN = 2


def _bits(line: np.ndarray, spot: np.ndarray, words: int, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(words with the bits of rising places (line, spot), number of the first place of each word)."""
    word = line * words + (spot >> 6)
    bits, place = np.zeros(lines * words, "<u8"), np.zeros(lines * words, np.int32)
    if len(word):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        bits[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (spot & 63).astype(np.uint64), first)
        place[word[first]] = first
    return bits, place


def _below(words: np.ndarray, place: np.ndarray, word: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Numbers of places that are set."""
    lower = (np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1)
    return place.take(word) + np.bitwise_count(words.take(word) & lower)


class Matrix:
    """Binned rows as bits, by row and by feature; the first ``n_train`` rows are trained on."""

    def __init__(self, rows: Rows, n_train: int, features: int):
        row = np.repeat(np.arange(len(rows.ids)), np.diff(rows.bounds))
        kept = np.flatnonzero(rows.bins)
        key = row[kept] * max(features, 1) + rows.idx[kept]
        if len(key) and (key[1:] <= key[:-1]).any():  # the last of equal ones counts
            order = np.argsort(key, kind="stable")
            order = order[np.append(key[order][1:] != key[order][:-1], True)]
            kept, key = kept[order], key[order]
        row, idx, self.bins = row[kept], rows.idx[kept], rows.bins[kept]
        self.n_train, self.features, self.ids = n_train, features, rows.ids
        self.label = rows.label
        self.words_a_row = features // 64 + 1
        self.words, self.place = _bits(row, idx, self.words_a_row, len(rows.ids))
        self.bytes = self.words.view(np.uint8)
        self.words_a_column = n_train // 64 + 1
        own = np.flatnonzero(row < n_train)
        order = own[np.argsort(idx[own].astype(np.uint16 if features <= 1 << 16 else np.int32), kind="stable")]
        self.column_bins = self.bins[order]
        self.column_words, self.column_place = _bits(idx[order], row[order], self.words_a_column, features)
        lengths = np.bincount(row, minlength=len(rows.ids))
        self.rows = Rows(rows.ids, rows.label, rows.fold, np.append(0, np.cumsum(lengths)), idx, self.bins)

    def bins_at(self, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Bins of places that are set."""
        return self.bins.take(_below(self.words, self.place, row * self.words_a_row + (feature >> 6), feature & 63))

    def above(self, row: np.ndarray, feature: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Whether the bin of each row in its feature is above the border."""
        bits = self.bytes.take(row * (8 * self.words_a_row) + (feature >> 3)) >> (feature & 7).astype(np.uint8)
        out = (bits & 1).astype(bool)
        some = np.flatnonzero(out & (border > 0))
        out[some] = self.bins_at(row[some], feature[some]) > border[some]
        return out


def _by_entry(m: Matrix, own: np.ndarray, row: np.ndarray, weight: np.ndarray, nodes: int):
    """Cells of nodes that look at all features."""
    keys, weights, step = [], [], max(1, VALUES // max(1, len(m.bins) // max(len(m.ids), 1)))
    for first in range(0, len(row), step):
        some = slice(first, first + step)
        place, lengths = entries_of(m.rows, row[some])
        base = (own[some] * m.features) * (2 * BINS) + m.label[row[some]]
        keys.append(np.repeat(base, lengths) + m.rows.idx[place] * (2 * BINS) + m.bins[place].astype(np.int64) * 2)
        weights.append(np.repeat(weight[some], lengths))
    return summed(keys, weights, nodes * m.features * BINS * 2)


def _pairs_of(nodes: np.ndarray, count: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs of some of the nodes, in the order of the nodes; place of the node of each; bounds of the nodes)."""
    rank = np.full(count, len(nodes))
    rank[nodes] = np.arange(len(nodes))
    own = rank.take(own)
    pairs = np.flatnonzero(own < len(nodes))
    pairs = pairs.take(np.argsort(own.take(pairs).astype(np.uint16 if len(nodes) <= 1 << 16 else np.int64), kind="stable"))
    own = own.take(pairs)
    return pairs, own, np.append(0, np.cumsum(np.bincount(own, minlength=len(nodes))))


def _by_feature(m: Matrix, tree, drawn, looks, large, own, row):
    """(keys, weights) of large nodes, from the bits of the rows of each feature they look at."""
    width, words = looks.shape[1], m.words_a_column
    pairs, own, bounds = _pairs_of(large, len(looks), own)
    row = row.take(pairs)
    columns = m.column_words.reshape(-1, words)
    keys, weights, step = [], [], max(1, VALUES // (width * words))
    for begin in range(0, len(large), step):
        nodes = large[begin : begin + step]
        mine = slice(bounds[begin], bounds[begin + len(nodes)])
        inside = np.zeros((len(nodes), words * 64), bool)
        inside[own[mine] - begin, row[mine]] = True
        shared = columns.take(looks[nodes], 0)
        shared &= np.packbits(inside, 1, "little").view("<u8")[:, None]
        shared = shared.ravel()
        word = np.flatnonzero(shared != 0)
        byte = shared.take(word).view(np.uint8)
        some_set = np.flatnonzero(byte != 0)
        bit = np.flatnonzero(np.unpackbits(byte.take(some_set), bitorder="little").view(bool))
        spot = some_set.take(bit >> 3)
        word, bit = word.take(spot >> 3), (spot & 7) << 3 | bit & 7
        look = word // words
        word -= look * words
        hit_row = word * 64 + bit
        entry = _below(m.column_words, m.column_place, looks[nodes].ravel().take(look) * words + word, bit)
        keys.append((nodes[:, None] * width + np.arange(width)).ravel().take(look) * (2 * BINS) + m.column_bins.take(entry) * np.int64(2) + m.label.take(hit_row))
        weights.append(drawn.take((tree[nodes] * m.n_train).take(look // width) + hit_row).astype(np.int64))
    return keys, weights


def _by_row(m: Matrix, looks, own, row, weight):
    """(keys, weights) of pairs (node, row), from the bits of the row."""
    width = looks.shape[1]
    byte, mask = looks >> 3, (1 << (looks & 7)).astype(np.uint8)
    keys, weights, step = [], [], max(1, VALUES // width)
    for first in range(0, len(own), step):
        some, rows = own[first : first + step], row[first : first + step]
        at = byte.take(some, 0)
        at += (rows * (8 * m.words_a_row))[:, None]
        seen = m.bytes.take(at)
        seen &= mask.take(some, 0)
        hit = np.flatnonzero(seen != 0)
        pair = hit // width
        column = hit - pair * width
        hit_row, node = rows[pair], some[pair]
        bins = m.bins_at(hit_row, looks[node, column]).astype(np.int64)
        keys.append((node * width + column) * (2 * BINS) + bins * 2 + m.label[hit_row])
        weights.append(weight[first : first + step][pair])
    return keys, weights


def shares_at_cuts(m: Matrix, shape: Shape, numbers: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """(cuts, trees, held rows): the share of class 1 that each tree, cut to a depth and a minimum
    split, gives to each held-out row; one half if the tree has no rows."""
    count, held = len(numbers), len(m.ids) - m.n_train
    values = np.full((len(cuts), count * held), 0.5)
    if not m.features or not m.n_train:
        return values.reshape(len(cuts), count, held)
    sampled, width = shape.trees > 1, shape.width(m.features)
    drawn = (bootstrap(m.ids[: m.n_train], numbers) if sampled else np.ones((count, m.n_train), np.int64)).astype(np.uint8)
    pair_tree, row = np.nonzero(drawn)
    weight, drawn = drawn[pair_tree, row].astype(np.int64), drawn.ravel()
    slot = pair_tree
    held_row, held_slot, spot = np.tile(np.arange(m.n_train, len(m.ids)), count), np.repeat(np.arange(count), held), np.arange(count * held)
    counts = np.bincount(2 * slot + m.label[row], weight, 2 * count).astype(np.int64).reshape(-1, 2)
    tree, path, over = np.arange(count), np.ones(count, np.int64), np.zeros((len(cuts), count), bool)
    for depth in range(shape.max_depth + 1):
        n = counts.sum(1)
        open_ = np.flatnonzero((n >= max(shape.min_split, 2)) & (counts.min(1) > 0) & (depth < shape.max_depth))
        feature, border, left = np.full(len(n), -1), np.zeros(len(n), np.int64), np.zeros((len(n), 2), np.int64)
        if len(open_):
            number = np.full(len(n), -1)
            number[open_] = np.arange(len(open_))
            own = number.take(slot)
            if own.min() < 0:  # rows of roots that are leaves
                some = np.flatnonzero(own >= 0)
                row, weight, slot, own = row.take(some), weight.take(some), slot.take(some), own.take(some)
            looks = own_features(width, m.features, numbers[tree[open_]], path[open_])
            if width == m.features:
                key, sums = _by_entry(m, own, row, weight, len(open_))
            else:
                size = np.bincount(own, minlength=len(open_))
                large = WORD_GAIN * size > m.words_a_column
                few = np.flatnonzero(~large.take(own))
                parts = [_by_row(m, looks, own.take(few), row.take(few), weight.take(few))]
                if large.any():
                    parts.append(_by_feature(m, tree[open_], drawn, looks, np.flatnonzero(large), own, row))
                key, sums = summed(*(sum(p, []) for p in zip(*parts, strict=True)), len(open_) * width * BINS * 2)
            feature[open_], border[open_], *sides = best_cuts(key, sums, counts[open_], looks, np.full(len(open_), shape.impurity == "entropy"))
            left[open_] = np.stack(sides, 1)
        share = np.where(n > 0, counts[:, 1] / np.maximum(n, 1), 0.5)
        ends = np.stack([(feature < 0) | (depth >= deepest) | (n < least) for deepest, least in cuts])
        ending = np.flatnonzero((ends & ~over).any(0).take(held_slot))
        there = held_slot.take(ending)
        for cut in range(len(cuts)):
            here = np.flatnonzero((ends[cut] & ~over[cut]).take(there))
            values[cut, spot.take(ending.take(here))] = share.take(there.take(here))
        over |= ends
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        child = np.full(len(n), -1)
        child[split] = 2 * np.arange(len(split))
        counts = np.stack([left[split], counts[split] - left[split]], 1).reshape(-1, 2)
        some = np.flatnonzero(((child >= 0) & ~over.all(0)).take(held_slot))
        held_row, held_slot, spot = held_row.take(some), held_slot.take(some), spot.take(some)
        held_slot = child.take(held_slot) + m.above(held_row, feature.take(held_slot), border.take(held_slot))
        some = np.flatnonzero((child >= 0).take(slot))
        slot, goes = slot.take(some), row.take(some)
        slot = child.take(slot) + m.above(goes, feature.take(slot), border.take(slot))
        may = (counts.sum(1) >= max(shape.min_split, 2)) & (counts.min(1) > 0) & (depth + 1 < shape.max_depth)
        kept = np.flatnonzero(may.take(slot))
        row, slot, weight = goes.take(kept), slot.take(kept), weight.take(some.take(kept))
        tree = np.repeat(tree[split], 2)
        path = np.repeat(2 * path[split], 2) + np.tile([0, 1], len(split))
        over = np.repeat(over[:, split], 2, 1)
    return values.reshape(len(cuts), count, held)


def _kind(setting: dict) -> tuple[str, str]:
    return setting.get("featureSubsetStrategy", "all"), setting["impurity"]


def _plan(settings: list[dict], shapes: list[Shape], features: list[int], cores: int) -> tuple[list, int]:
    """((data, copy) by task to its pieces of trees (shape, first, last), copies of each data set):
    pieces end where a setting ends, and the larger ones are dealt first. As many copies as leave
    the fewest cores idle in the last round."""
    pieces: dict[int, list] = {}
    for number, shape in enumerate(shapes):
        stops = sorted({s.get("numTrees", 1) for s in settings if _kind(s) == (shape.subset, shape.impurity)})
        for begin, end in zip([0, *stops], stops, strict=False):
            for at in range(begin, end, CHUNK):
                last = min(at + CHUNK, end)
                pieces.setdefault(shape.fold, []).append(((last - at) * (20 + shape.width(features[shape.fold])), number, at, last))
    most = max(map(len, pieces.values()), default=1)
    waste = lambda copies: -(-len(pieces) * copies // cores) / (len(pieces) * copies) + copies / 1000
    copies = min(range(1, max(2, min(most, 4 * -(-cores // max(len(pieces), 1))) + 1)), key=waste) if pieces else 1
    plan = []
    for fold, own in pieces.items():
        loads = [(0, copy, []) for copy in range(copies)]
        for cost, *piece in sorted(own, reverse=True):
            load, copy, taken = heapq.heappop(loads)
            heapq.heappush(loads, (load + cost, copy, [*taken, tuple(piece)]))
        plan += [(fold, copy, taken) for _, copy, taken in loads]
    return plan, copies


def grove_hits(blocks: DataFrame, settings: list[dict], shapes: list[Shape], features: list[int]) -> DataFrame:
    """(setting_order, fold, hits, rows), as ``forest.held_out_hits``, for data sets that each fit a
    task: ``blocks`` go to as many copies of their data set as it takes to use all cores."""
    plan, copies = _plan(settings, shapes, features, blocks.sparkSession.sparkContext.defaultParallelism)
    pieces = {(fold, copy): taken for fold, copy, taken in plan}
    cuts = {n: list(dict.fromkeys((s["maxDepth"], s["minSplit"]) for s in settings if _kind(s) == (shape.subset, shape.impurity))) for n, shape in enumerate(shapes)}

    def grow(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        data, copy = (table.column(c).to_numpy() for c in ("data", "copy"))
        for d, c in sorted(set(zip(data.tolist(), copy.tolist(), strict=True))):
            rows = rows_of(table.take(np.flatnonzero((data == d) & (copy == c))))
            train = rows.fold != d
            rows = rows.take(np.argsort(~train, kind="stable"))
            matrix = Matrix(rows, int(train.sum()), features[d])
            label = rows.label[matrix.n_train :].astype(np.uint8).tobytes()
            at_once = max(1, PAIRS // max(matrix.n_train, 1))
            for number, first, last in pieces.get((d, c), []):
                parts = [shares_at_cuts(matrix, shapes[number], np.arange(i, min(i + at_once, last)), cuts[number]) for i in range(first, last, at_once)]
                sums = np.concatenate(parts, 1).sum(1)
                row = [number, first, last, sums.tobytes(), label]
                kinds = [pa.int32()] * 3 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["shape", "first", "last", "sums", "label"])

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        number = table.column("shape")[0].as_py()
        label = np.frombuffer(table.column("label")[0].as_buffer(), np.uint8)
        so_far, hits = np.zeros((len(cuts[number]), len(label))), {}
        for last, sums in zip(table.column("last").to_pylist(), table.column("sums"), strict=True):
            so_far = so_far + np.frombuffer(sums.as_buffer()).reshape(so_far.shape)
            for order, s in enumerate(settings):
                if _kind(s) == (shapes[number].subset, shapes[number].impurity) and s.get("numTrees", 1) == last:
                    hits[order] = int(((so_far[cuts[number].index((s["maxDepth"], s["minSplit"]))] / last > 0.5) == (label == 1)).sum())
        columns = list(hits), [shapes[number].fold] * len(hits), list(hits.values()), [len(label)] * len(hits)
        return pa.table({c: pa.array(v, k) for (c, k), v in zip({"setting_order": pa.int32(), "fold": pa.int32(), "hits": pa.int64(), "rows": pa.int64()}.items(), columns, strict=True)})

    copied = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    dealt = copied.repartitionById(len(features) * copies, F.col("data") * copies + F.col("copy"))
    grown = dealt.mapInArrow(grow, "shape int, first int, last int, sums binary, label binary")
    return grown.groupBy("shape").applyInArrow(score, "setting_order int, fold int, hits long, rows long")
