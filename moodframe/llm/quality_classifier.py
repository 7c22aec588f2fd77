"""Quality: supervised subword embeddings, averaged over a document into a softmax.

Words, pairs of neighbouring words and the character n-grams inside words are hashed to buckets. Each bucket has a learned
vector; a document is the mean of the vectors of all its words and n-grams, and a softmax over
that mean gives the chance of each label. Vectors and output layer are trained together by
stochastic gradient descent, one document a step, with a rate that falls to zero."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from moodframe.llm.frames import add_from_text
from moodframe.llm.linear_text import gram_positions, labelled_sample
from moodframe.llm.numeric_fit import sigmoid
from moodframe.llm.textblocks import Hasher, crc32_text, distinct_pairs, lower_table, mix64, owners, text_blocks, word_ranges

SIZES = (3, 4, 5)
BUCKETS = 1 << 17
WIDTH, ROUNDS, RATE, SEED = 8, 8, 2.0, 11
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 50_000
#: Fixed threshold.
KEEP_FROM = 0.3


def held_out(doc_id):
    """Column: true for the fifth of the ids that no model learns from."""
    return crc32_text(doc_id) % 5 == 0


@dataclass
class QualityClassifier:
    """vectors (buckets, width), output (width, 2) and bias (2): softmax(mean vector @ output + bias)."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @property
    def bucket_odds(self) -> np.ndarray:
        """Log-odds that each bucket adds: mean and output layer are linear, so a document's
        log-odds are the mean of these plus the difference of the biases."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0])


def document_features(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], buckets: int):
    """Yields (bucket, text number): words, pairs of neighbouring words (all pairs of a word with
    itself are one), and character n-grams inside words. One space of buckets for all."""
    data = lower_table()[data]
    starts, ends, bounds = word_ranges(data, offsets)
    if not len(starts):
        return
    owner, words = owners(bounds), Hasher.of(data, 6).ranges(starts, ends)
    yield (words % np.uint64(buckets)).astype(np.int64), owner
    near = np.flatnonzero(owner[1:] == owner[:-1])
    pair = mix64(words[near] * np.uint64(3) + words[near + 1])
    pair[words[near] == words[near + 1]] = 0
    yield (pair % np.uint64(buckets)).astype(np.int64), owner[near]
    for bucket, word in gram_positions(data, starts, ends, sizes, buckets):
        yield bucket, owner[word]


def document_bags(column: pa.Array, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row bounds, bucket ids, shares that sum to 1 in each row with words)."""
    rows, ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, data, offsets in text_blocks(column):
        parts = list(document_features(data, offsets, sizes, buckets))
        if parts:
            owner, bucket, count = distinct_pairs(np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts]))
            rows.append(owner + first)
            ids.append(bucket)
            counts.append(count)
    row, count = np.concatenate(rows), np.concatenate(counts)
    total = np.bincount(row, count, len(column))
    return np.searchsorted(row, np.arange(len(column) + 1)), np.concatenate(ids), count / np.maximum(total, 1)[row]


def train_sgd(bounds: np.ndarray, ids: np.ndarray, weights: np.ndarray, labels: np.ndarray, importance: np.ndarray, buckets: int, width: int = WIDTH, rounds: int = ROUNDS, rate: float = RATE, seed: int = SEED):
    """(vectors, output, bias) of bags (row bounds, bucket ids, shares that sum to 1).

    ``importance`` scales the steps of each row. Empty bags move the bias alone."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / width, 1 / width, (buckets, width))
    output, bias = np.zeros((width, 2)), np.zeros(2)
    total, done = rounds * len(labels), 0
    for _ in range(rounds):
        for row in random.permutation(len(labels)):
            own = slice(bounds[row], bounds[row + 1])
            hidden = weights[own] @ vectors[ids[own]]
            logits = hidden @ output + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[labels[row]] -= 1
            step = rate * (1 - done / total) * importance[row]
            back = output @ error
            output -= step * np.outer(hidden, error)
            bias -= step * error
            vectors[ids[own]] -= step * weights[own][:, None] * back
            done += 1
    return vectors, output, bias


def fit_quality_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, held_out=held_out) -> QualityClassifier:
    """Learns from a sample of labelled texts bounded by ``max_rows`` and ``max_chars``, chosen in
    hash order of the ids outside the held-out fifth, up to half of them of the rarer label.

    Rows weigh so that both labels count alike. Null labels, ids with two labels and ids without
    a text teach nothing. Without both labels the softmax gives the share of label 1 to all
    texts (one half if there are no labels)."""
    rows = labelled_sample(docs, labels, label, max_rows, max_chars, held_out)
    target = np.array([r[2] for r in rows], np.int64)
    counts = np.bincount(target, minlength=2)
    if counts.min() == 0:
        share = np.clip((counts + 1e-9) / (counts.sum() + 2e-9), 1e-9, 1)
        return QualityClassifier(np.zeros((buckets, WIDTH)), np.zeros((WIDTH, 2)), np.log(share))
    bags = document_bags(pa.array([r[1] for r in rows], pa.large_string()), sizes, buckets)
    importance = (len(target) / (2 * counts))[target]
    return QualityClassifier(*train_sgd(*bags, target, importance / importance.max(), buckets))


def score_quality_classifier(docs: DataFrame, model: QualityClassifier, keep_from: float = KEEP_FROM, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """All columns of ``docs`` but ``score`` and ``predicted``, which are added: the softmax
    chance of label 1, and 1 if it is at least ``keep_from``.

    Null texts are empty; texts without words get the chance that the biases give. Repeated
    rows score alike. One pass over whole texts without a shuffle; memory follows blocks of
    half a megabyte or one longer text."""
    odds, shift, buckets = model.bucket_odds, float(model.bias[1] - model.bias[0]), len(model.vectors)

    def score(column):
        logits = np.full(len(column), shift)
        for first, data, offsets in text_blocks(column):
            n = len(offsets) - 1
            total, count = np.zeros(n), np.zeros(n)
            for bucket, owner in document_features(data, offsets, sizes, buckets):
                total += np.bincount(owner, odds[bucket], n)
                count += np.bincount(owner, minlength=n)
            logits[first : first + n] += total / np.maximum(count, 1)
        chance = sigmoid(logits)
        return [pa.array(chance), pa.array((chance >= keep_from).astype(np.int32))]

    return add_from_text(docs, score, [("score", "double"), ("predicted", "int")])
