"""Trees grown together against trees grown one by one in plain Python."""

import math
from itertools import groupby

import numpy as np
import pytest

from moodframe.operators import forest as fo
from moodframe.operators import groves as gr
from moodframe.operators import tune as tn
from moodframe.plans import all_queries
from moodframe.session import stage

FEATURES = 7


def corpus(n=260, seed=1):
    """(data, id, label, fold, idx, val): sparse values, many ties, one empty row, one feature
    without values."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        dense = np.where(draw.random(FEATURES) < 0.5, draw.choice([0.05, 0.1, 0.3, 0.31, 0.9], FEATURES), 0)
        dense[6] = 0
        label = int(dense[0] + dense[1] * draw.random() > 0.35) if i % 9 else int(draw.random() < 0.5)
        if i == 4:
            dense[:] = 0
        idx = np.flatnonzero(dense)
        rows += [(data, i, label, i % 2, idx.tolist(), dense[idx].tolist()) for data in (0, 1)]
    return rows


def dense_of(rows):
    out = np.zeros((len(rows), FEATURES), np.uint8)
    for k, r in enumerate(rows):
        out[k, r[4]] = fo.bin_of(np.array(r[5]))
    return out


def impurity(kind, counts):
    n = sum(counts)
    return n * (1 - sum((c / n) ** 2 for c in counts)) if kind == "gini" else -sum(c * math.log(c / n) for c in counts if c)


def plain_tree(shape, number, x, y, w, path=1, depth=0):
    """Nested (counts, feature, bin, left, right) of one tree."""
    counts = (int(w[y == 0].sum()), int(w[y == 1].sum()))
    if sum(counts) < max(shape.min_split, 2) or min(counts) == 0 or depth >= shape.max_depth:
        return (counts,)
    best = None
    for f in fo.own_features(shape.width(FEATURES), FEATURES, np.array([number]), np.array([path]))[0]:
        for b in range(fo.BINS - 1):
            right = x[:, f] > b
            sides = [[w[own & (y == c)].sum() for c in (0, 1)] for own in (~right, right)]
            if min(map(sum, sides)):
                score = sum(impurity(shape.impurity, s) for s in sides)
                if best is None or score < best[0] - 1e-9:
                    best = (score, int(f), b)
    if best is None:
        return (counts,)
    right = x[:, best[1]] > best[2]
    children = [plain_tree(shape, number, x[own], y[own], w[own], 2 * path + side, depth + 1) for side, own in enumerate((~right, right))]
    return (counts, best[1], best[2], *children)


def nested(forests, node):
    counts = tuple(forests.counts[node].tolist())
    if forests.feature[node] < 0:
        return (counts,)
    left = int(forests.left[node])
    return (counts, int(forests.feature[node]), int(forests.bin[node]), nested(forests, left), nested(forests, left + 1))


def share(tree, row, depth, min_split, at=0):
    if len(tree) == 1 or at >= depth or sum(tree[0]) < min_split:
        return tree[0][1] / sum(tree[0]) if sum(tree[0]) else 0.5
    return share(tree[3 + int(row[tree[1]] > tree[2])], row, depth, min_split, at + 1)


@pytest.fixture(scope="module")
def rows(spark):
    return stage(spark.createDataFrame(corpus(), "data int, id long, label int, fold int, idx array<int>, val array<double>").repartition(5), "tree-rows")


SHAPES = [fo.Shape(0, "all", "gini", 1, 6, 20), fo.Shape(1, "all", "entropy", 1, 40, 2), fo.Shape(0, "sqrt", "gini", 4, 5, 10), fo.Shape(1, "log2", "entropy", 3, 8, 2)]


@pytest.mark.parametrize(("cells", "fan_in"), [(1 << 20, 32), (900, 2)])
def test_trees_equal_plain_trees(spark, rows, monkeypatch, cells, fan_in):
    """Also with one node a group and several rounds of adding."""
    monkeypatch.setattr(fo, "CELLS", cells)
    monkeypatch.setattr(fo, "FAN_IN", fan_in)
    grown = fo.grow_forests(rows, SHAPES, [FEATURES, FEATURES])
    root = 0
    for shape in SHAPES:
        own = [r for r in corpus() if r[0] == shape.fold and r[3] != shape.fold]
        x, y, ids = dense_of(own), np.array([r[2] for r in own]), np.array([r[1] for r in own])
        for number in range(shape.trees):
            w = fo.bootstrap(ids, np.array([number]))[0] if shape.trees > 1 else np.ones(len(own), int)
            assert nested(grown, root) == plain_tree(shape, number, x, y, w)
            root += 1


def test_smaller_settings_are_read_off_larger_trees(spark, rows):
    """Accuracies of all settings equal those of trees grown for each setting alone."""
    grid = {"numTrees": [2, 5], "featureSubsetStrategy": ["sqrt"], "maxDepth": [2, 6], "impurity": ["gini", "entropy"], "minSplit": [10, 60]}
    found = {(r["setting_order"], r["fold"]): r for r in fo.forest_fold_scores(rows, grid, 2, [FEATURES, FEATURES]).collect()}
    assert len(found) == 32
    for order, setting in enumerate(fo.settings_of(grid)):
        for fold in (0, 1):
            shape = fo.Shape(fold, "sqrt", setting["impurity"], setting["numTrees"], setting["maxDepth"], setting["minSplit"])
            own, held = ([r for r in corpus() if r[0] == fold and (r[3] == fold) == side] for side in (False, True))
            x, y, ids = dense_of(own), np.array([r[2] for r in own]), np.array([r[1] for r in own])
            trees = [plain_tree(shape, t, x, y, fo.bootstrap(ids, np.array([t]))[0]) for t in range(shape.trees)]
            ones = [np.mean([share(t, row, 99, 0) for t in trees]) > 0.5 for row in dense_of(held)]
            hits = sum(int(one) == r[2] for one, r in zip(ones, held, strict=True))
            got = found[order, fold]
            assert (got["accuracy"], got["rows"], got["setting"]) == (hits / len(held), len(held), str(setting))


def test_draws_are_fair_and_bootstrap_is_poisson():
    looks = fo.own_features(5, 40, np.arange(8000) % 90, np.arange(8000))
    assert all(len(set(own)) == 5 for own in looks.tolist())
    seen = np.bincount(looks.ravel(), minlength=40)
    assert seen.min() > 850 and seen.max() < 1150  # 1,000 each, seven deviations of 30 and less
    drawn = fo.bootstrap(np.arange(5000), np.arange(20))
    assert abs(drawn.mean() - 1) < 0.02 and abs((drawn == 0).mean() - math.exp(-1)) < 0.01
    assert abs(np.corrcoef(drawn[0], drawn[1])[0, 1]) < 0.06


def test_bins_and_odd_inputs(spark):
    assert fo.bin_of(np.array([0.0, 1e-9, 0.5, 0.5000001, 1.0])).tolist() == [0, 1, 28, 29, 31]
    schema = "data int, id long, label int, fold int, idx array<int>, val array<double>"
    empty = stage(spark.createDataFrame([], schema))
    grown = fo.grow_forests(empty, [fo.Shape(0, "all", "gini", 1, 5, 2)], [FEATURES])
    assert grown.feature.tolist() == [-1] and fo.forest_fold_scores(empty, tn.TREE_GRID, 2, [3, 0]).count() == 0
    alike = [(0, i, 1, i % 2, [], []) for i in range(9)] + [(1, i, 1, i % 2, [0], [0.5]) for i in range(9)]
    scores = fo.forest_fold_scores(stage(spark.createDataFrame(alike, schema)), {"impurity": ["gini"], "maxDepth": [3], "minSplit": [2]}, 2, [0, 1]).collect()
    assert {(r["fold"], r["rows"]) for r in scores} == {(0, 5), (1, 4)} and scores[0]["accuracy"] in (0.0, 1.0)


@pytest.mark.parametrize(("name", "settings"), [("m18_tree_grid", 18), ("m18_forest_grid", 32)])
def test_grids_score_every_setting_in_five_folds(spark, sf, name, settings):
    rows = all_queries()[name](spark, sf).collect()
    assert sorted(r["setting_order"] for r in rows) == list(range(settings)) and {r["folds"] for r in rows} == {5}
    assert all(0.5 < r["mean_accuracy"] <= 1 for r in rows) and len({r["setting"] for r in rows}) == settings
    assert {k for k, _ in groupby(sorted(r["setting"].count("40") for r in rows))} <= {0, 1}


def test_groups_of_nodes_span_many_trees():
    """Each group scans the rows once more, so they must be few; equal cells are added up."""
    forests = fo.Forests.roots([fo.Shape(0, "sqrt", "gini", 20_000, 5, 2)], [5000])
    groups = fo.node_groups(forests, np.arange(20_000), 1)
    assert len(groups) <= 5 and np.concatenate([g.nodes for g in groups]).tolist() == list(range(20_000))
    cells = [np.array([7 << 32 | 2, 3 << 32 | 1, 7 << 32 | 5]), np.array([3 << 32 | 9])]
    assert fo.added(cells).tolist() == [3 << 32 | 10, 7 << 32 | 7] and not len(fo.added([]))


def test_trees_grown_in_tasks_equal_trees_grown_by_levels(spark, rows, monkeypatch):
    """Whatever the way nodes are counted and the number of trees at once; rows that repeat a
    feature or give it out of order included."""
    grids = {"impurity": ["gini", "entropy"], "maxDepth": [2, 6], "minSplit": [10, 60]}, {
        "numTrees": [3, 70], "featureSubsetStrategy": ["sqrt", "log2"], "maxDepth": [3], "impurity": ["gini"], "minSplit": [5]}
    schema = "data int, id long, label int, fold int, idx array<int>, val array<double>"
    odd = [(d, i, y, f, idx[::-1], val[::-1]) for d, i, y, f, idx, val in corpus(90, 3)] + [(0, 500, 1, 1, [2, 2], [0.1, 0.1])]
    odd = stage(spark.createDataFrame(odd, schema))
    scores = lambda table, grid: sorted(map(tuple, fo.forest_fold_scores(table, grid, 2, [FEATURES, FEATURES]).collect()))
    for table in (rows, odd):
        for grid in grids:
            monkeypatch.setattr(fo, "ENTRIES", -1)
            levels = scores(table.where("id < 500"), grid)
            monkeypatch.setattr(fo, "ENTRIES", 1 << 25)
            for gain, pairs, values in ((0, 1 << 19, 1 << 17), (1 << 20, 200, 40)):
                monkeypatch.setattr(gr, "WORD_GAIN", gain)
                monkeypatch.setattr(gr, "PAIRS", pairs)
                monkeypatch.setattr(gr, "VALUES", values)
                assert scores(table.where("id < 500"), grid) == levels
    assert len(scores(odd, grids[0])) == 16


def test_forests_of_small_data_sets_take_one_job_and_not_one_a_level(spark, rows, monkeypatch):
    """No level of all trees is counted, shuffled and sent to the driver."""
    def refuse(*_):
        raise AssertionError("grown by levels")

    monkeypatch.setattr(fo, "level_splits", refuse)
    grid = {"numTrees": [20], "featureSubsetStrategy": ["sqrt"], "maxDepth": [9], "impurity": ["gini"], "minSplit": [4]}
    assert fo.forest_fold_scores(rows, grid, 2, [FEATURES, FEATURES]).count() == 2


def test_pieces_of_trees_cover_the_grid():
    settings = fo.settings_of(tn.FOREST_GRID)
    shapes = fo.shapes_of(settings, 5)
    plan, copies = gr._plan(settings, shapes, [5000] * 5, 8)
    assert len(plan) == 5 * copies and 5 * copies % 8 == 0
    trees = sorted((n, t) for _, _, taken in plan for n, first, last in taken for t in range(first, last))
    assert trees == [(n, t) for n in range(len(shapes)) for t in range(500)]


def test_a_root_that_is_a_leaf_leaves_other_trees_alone(spark, monkeypatch):
    """Samples of few rows often have one class only."""
    rows = stage(spark.createDataFrame([(0, i, int(i == 3), i % 2, [i % 3], [0.2 + i / 20]) for i in range(12)], "data int, id long, label int, fold int, idx array<int>, val array<double>"))
    for subset in ("sqrt", "all"):
        grid = {"numTrees": [40], "featureSubsetStrategy": [subset], "maxDepth": [4], "impurity": ["gini"], "minSplit": [2]}
        found = fo.forest_fold_scores(rows, grid, 1, [3]).collect()
        monkeypatch.setattr(fo, "ENTRIES", -1)
        assert fo.forest_fold_scores(rows, grid, 1, [3]).collect() == found and found[0]["rows"] == 6
        monkeypatch.setattr(fo, "ENTRIES", 1 << 25)
