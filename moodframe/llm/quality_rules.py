"""Quality: counting rules and a calibrated n-gram classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.frames import add_from_text
from moodframe.llm.linear_text import labelled_sample, mean_scores, sparse_rows
from moodframe.llm.numeric_fit import calibrate, fit_logistic, sigmoid
from moodframe.llm.textblocks import Hasher, distinct_pairs, mix64, owners, per_text, space_table, text_blocks, word_ranges

SIZES = (3, 4)
BUCKETS = 1 << 16
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 50_000
#: Fixed thresholds.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CHANCE = 50, 50, 0.5
SYMBOLS = b"#*$%&|<>"


@dataclass
class Quality:
    """log-odds = slope * (sum of the families' mean weights) + shift."""

    table: np.ndarray
    slope: float
    shift: float


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text of a block: words, code points in words, symbols, repeated lines
    that hold a word, and words inside three-word windows that occur twice or more."""
    n = len(offsets) - 1
    starts, ends, bounds = word_ranges(data, offsets)
    letters = ~space_table()[data]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": np.diff(bounds),
        "word_chars": per_text(letters & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(symbol[data], offsets),
    }
    hasher = Hasher.of(data)
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1])).astype(np.int64)
    line_starts = line_starts[line_starts < len(data)]
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    stops = np.append(breaks, len(data))
    line_ends = np.minimum(stops[np.searchsorted(stops, line_starts)], offsets[line_text + 1])
    worded = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_text, hashes = line_text[worded], hasher.ranges(line_starts[worded], line_ends[worded])
    owner, _, count = distinct_pairs(line_text, hashes)
    out["n_dup_lines"] = np.bincount(owner, count - 1, n).astype(np.int64)
    words, owner = hasher.ranges(starts, ends), owners(bounds)
    if len(words) < 3:
        return out | {"n_repeat_words": np.zeros(n, np.int64)}
    at = np.flatnonzero(owner[2:] == owner[:-2])
    window = mix64(mix64(words[at] * np.uint64(3) + words[at + 1]) * np.uint64(5) + words[at + 2])
    order = np.lexsort((window, owner[at]))
    same = (window[order][1:] == window[order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])
    twice = np.zeros(len(order) + 1, bool)
    twice[1:-1] = same
    twice = (twice[1:] | twice[:-1]) if len(order) else twice[:0]
    again = at[order[twice]]
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[again + k] = True
    return out | {"n_repeat_words": np.bincount(owner, marked, n).astype(np.int64)}


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS, buckets: int = BUCKETS, held_out=None) -> Quality:
    """Logistic regression on hashed words, word pairs and character n-grams of a labelled
    sample bounded by ``max_rows`` and ``max_chars``, Platt-scaled on every fifth of its rows.
    Without both labels every text gets the share of label 1 (1 if there are no labels)."""
    rows = labelled_sample(docs, labels, label, max_rows, max_chars, held_out)
    known = labels if held_out is None else labels.where(~held_out(F.col("doc_id")))
    share = {r["v"]: r["count"] for r in known.groupBy(F.col(label).cast("int").alias("v")).count().where("v in (0, 1)").collect()}
    target = np.array([r[2] for r in rows], np.int64)
    if len(rows) < 10 or len(set(target.tolist())) < 2:
        chance = min(max(share.get(1, 0) / sum(share.values()) if share else 1.0, 1e-9), 1 - 1e-9)
        return Quality(np.zeros(3 * buckets, np.float32), 0.0, float(np.log(chance / (1 - chance))))
    bounds, ids, weights = sparse_rows(pa.array([r[1] for r in rows], pa.large_string()), SIZES, buckets, pairs=True)
    part = np.arange(len(rows)) % 5
    if len(set(target[part == 0].tolist())) < 2:
        part[:] = 1
    table, bias = fit_logistic(bounds, ids, weights, target, np.flatnonzero(part != 0), 3 * buckets)
    check = part == 0 if (part == 0).any() else part == 1
    logits = np.bincount(np.repeat(np.arange(len(rows)), np.diff(bounds)), table[ids] * weights, len(rows)) + bias
    natural = np.array([share[0] / max((target == 0).sum(), 1), share[1] / max((target == 1).sum(), 1)])
    natural /= natural.mean()
    slope, shift = calibrate(logits[check], target[check], natural[target[check]])
    return Quality(table.astype(np.float32), slope, shift + slope * bias)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(docs: DataFrame, model: Quality) -> DataFrame:
    """All columns of ``docs``, the five counts, base_failed, quality_score and kept, which
    replace columns of these names. A text fails the rules with fewer than 50 words or if more
    than half of its words lie in repeated three-word windows; others are kept from a chance
    of one half on. Null texts are empty and fail."""
    table, slope, shift = model.table, model.slope, model.shift

    def judge(column):
        found = {k: np.zeros(len(column), np.int64) for k in COUNTS}
        logits = np.zeros(len(column))
        for first, data, offsets in text_blocks(column):
            own = slice(first, first + len(offsets) - 1)
            for k, v in text_counts(data, offsets).items():
                found[k][own] = v
            logits[own] = mean_scores(data, offsets, SIZES, table)
        chance = sigmoid(slope * logits + shift)
        failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
        return [*(pa.array(found[k]) for k in COUNTS), pa.array(failed), pa.array(chance), pa.array(~failed & (chance >= MIN_CHANCE))]

    added = [*((k, "long") for k in COUNTS), ("base_failed", "boolean"), ("quality_score", "double"), ("kept", "boolean")]
    return add_from_text(docs, judge, added)
