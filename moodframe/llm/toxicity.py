"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.frames import add_from_text
from moodframe.llm.linear_text import labelled_sample, sparse_rows, word_means
from moodframe.llm.numeric_fit import calibrate, fit_bag_softmax, sigmoid
from moodframe.llm.textblocks import crc32_text, owners, text_blocks

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 50_000


@dataclass
class Toxicity:
    """Log-odds of a word: mean of its buckets' numbers + bias; of a text: slope * (log of the
    mean of its words' odds) + shift."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float


def held_out(doc_id):
    """Column: true for the fifth of the ids that no model learns from."""
    return crc32_text(doc_id) % 5 == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, held_out=held_out) -> Toxicity:
    """Learns from a sample of labelled texts bounded by ``max_rows`` and ``max_chars``, chosen
    in hash order of the ids outside the held-out fifth.

    Every fifth sample row is kept for Platt scaling, weighted to the label shares of all
    labelled rows. Without both labels every text gets the share of label 1 (0 if none)."""
    rows = labelled_sample(docs, labels, label, max_rows, max_chars, held_out)
    known = labels.where(~held_out(F.col("doc_id"))).groupBy(F.col(label).cast("int").alias("v")).count().where("v in (0, 1)").collect()
    share = {r["v"]: r["count"] for r in known}
    target = np.array([r[2] for r in rows], np.int64)
    if len(rows) < 10 or len(set(target.tolist())) < 2:
        return Toxicity(np.zeros(buckets, np.float32), 0.0, 0.0, _odds(share.get(1, 0), sum(share.values())))
    words, texts = _bags([r[1] for r in rows], sizes, buckets)
    part = np.arange(len(rows)) % 5
    if len(set(target[part == 0].tolist())) < 2:
        part[:] = 1
    table, bias = fit_bag_softmax(words, texts, target, np.flatnonzero(part != 0), buckets)
    check = part == 0 if (part == 0).any() else part == 1
    odds = np.bincount(np.repeat(np.arange(len(words[0]) - 1), np.diff(words[0])), table[words[1]] * words[2], len(words[0]) - 1) + bias
    logits = _pooled(odds[texts[1]], texts[2], np.repeat(np.arange(len(rows)), np.diff(texts[0])), len(rows))
    natural = np.array([share[0] / max((target == 0).sum(), 1), share[1] / max((target == 1).sum(), 1)])
    natural /= natural.mean()
    slope, shift = calibrate(logits[check], target[check], natural[target[check]])
    return Toxicity(table.astype(np.float32), bias, slope, shift)


def _bags(texts: list[str], sizes, buckets: int):
    """Subword bags of the distinct words of a sample, and the word shares of its texts."""
    known: dict[bytes, int] = {}
    # arrays of numbers, not lists of objects: the driver is small
    bounds, word_of, share_of = [0], array("q"), array("d")
    for text in texts:
        counts = Counter(text.encode("utf-8", "surrogatepass").lower().split())
        word_of.extend(known.setdefault(w, len(known)) for w in counts)
        share_of.extend(n / counts.total() for n in counts.values())
        bounds.append(len(word_of))
    words = pa.array(list(known), pa.large_binary())
    del known
    return sparse_rows(words, sizes, buckets), (np.array(bounds), np.frombuffer(word_of, np.int64), np.frombuffer(share_of))


def _pooled(odds: np.ndarray, share: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Log of the mean of the words' odds; very low for texts without words."""
    total = np.bincount(text, share * np.exp(np.clip(odds, -30, 30)), n)
    return np.where(total > 0, np.log(np.maximum(total, 1e-12)), -30.0)


def _odds(ones: int, total: int) -> float:
    share = min(max(ones / total if total else 0.0, 1e-9), 1 - 1e-9)
    return float(np.log(share / (1 - share)))


def score_toxicity(docs: DataFrame, model: Toxicity, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """All columns of ``docs`` but ``score`` and ``predicted``, which are added: the chance of
    label 1, and 1 if it is at least one half.

    Null and empty texts get the score of an empty bag. One pass without a shuffle; whole
    texts; memory follows blocks of half a megabyte or one longer text."""
    table, bias, slope, shift = model.table, model.bias, model.slope, model.shift

    def score(column):
        found = np.zeros(len(column))
        for first, data, offsets in text_blocks(column):
            odds, bounds = word_means(data, offsets, sizes, table)
            share = np.repeat(1 / np.maximum(np.diff(bounds), 1), np.diff(bounds))
            found[first : first + len(offsets) - 1] = _pooled(odds + bias, share, owners(bounds), len(offsets) - 1)
        chance = sigmoid(slope * found + shift)
        return [pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))]

    return add_from_text(docs, score, [("score", "double"), ("predicted", "int")])
