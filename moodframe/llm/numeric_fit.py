"""Small numpy trainers on a bounded labelled sample, and probability calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        weights -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def entries(bounds: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of each entry of the chosen rows, number of its row among them)."""
    lengths = bounds[own + 1] - bounds[own]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(bounds[own] - ends + lengths, lengths), np.repeat(np.arange(len(own)), lengths)


def batches(rows: np.ndarray, size: int, seed: int):
    order = np.random.default_rng(seed).permutation(rows)
    for at in range(0, len(order), size):
        yield order[at : at + size]


def fit_bag_softmax(words, texts, labels, rows, buckets: int, width: int = 4, rounds: int = 10, rate: float = 0.02, seed: int = 7):
    """Embeddings of subword buckets, averaged over each word's bag into a two-class linear
    softmax, trained jointly through a smooth maximum over the words of a text.

    ``words`` is (bounds, buckets, weights) by distinct word, ``texts`` is (bounds, words,
    shares) by text. Returns (one number per bucket, bias): averaging and the output layer are
    both linear, so a word's log-odds are the mean of its buckets' numbers plus the bias."""
    word_bounds, bucket_of, weight_of = words
    text_bounds, word_of, share_of = texts
    random = np.random.default_rng(seed)
    embedding = random.uniform(-1, 1, (buckets, width)) / width
    output, bias = random.uniform(-1, 1, (width, 2)), np.zeros(2)
    steps = Adam(embedding.shape, rate), Adam(output.shape, rate), Adam(2, rate)
    for turn in range(rounds):
        for own in batches(rows, 64, seed + turn):
            at, text = entries(text_bounds, own)
            if not len(at):
                continue
            used, slot = np.unique(word_of[at], return_inverse=True)
            each, word = entries(word_bounds, used)
            bucket, weight = bucket_of[each], weight_of[each]
            hidden = np.stack([np.bincount(word, embedding[bucket, k] * weight, len(used)) for k in range(width)], 1)
            logits = hidden @ output + bias
            odds = np.clip(logits[:, 1] - logits[:, 0], -30, 30)
            part = share_of[at] * np.exp(odds)[slot]
            pooled = np.maximum(np.bincount(text, part, len(own)), 1e-12)
            # a text's log-odds are the log of the mean of its words' odds
            error = (sigmoid(np.log(pooled)) - labels[own]) / len(own)
            slope = np.bincount(slot, error[text] * part / pooled[text], len(used))
            back = slope[:, None] * (output[:, 1] - output[:, 0])
            gradient = np.stack([np.bincount(bucket, back[word, k] * weight, buckets) for k in range(width)], 1)
            own_step = hidden.T @ slope
            steps[1].step(output, np.stack([-own_step, own_step], 1))
            steps[2].step(bias, np.array([-slope.sum(), slope.sum()]))
            steps[0].step(embedding, gradient)
    return embedding @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0])


def fit_logistic(bounds, ids, weights, labels, rows, buckets: int, rounds: int = 12, rate: float = 0.05, decay: float = 1e-6):
    """Logistic regression by mini-batches: (weights, bias)."""
    beta, bias = np.zeros(buckets), np.zeros(1)
    steps = Adam(buckets, rate), Adam(1, rate)
    for turn in range(rounds):
        for own in batches(rows, 64, turn):
            at, holder = entries(bounds, own)
            error = (sigmoid(np.bincount(holder, beta[ids[at]] * weights[at], len(own)) + bias[0]) - labels[own]) / len(own)
            steps[0].step(beta, np.bincount(ids[at], error[holder] * weights[at], buckets) + decay * beta)
            steps[1].step(bias, np.array([error.sum()]))
    return beta, float(bias[0])


def calibrate(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets: (slope, shift), by Newton steps."""
    positive, negative = weights[labels == 1].sum(), weights[labels == 0].sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    spread = max(float(np.abs(logits).mean()), 1e-9)
    x = np.stack([logits / spread, np.ones(len(logits))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        chance = sigmoid(x @ beta)
        gradient = x.T @ (weights * (chance - target)) + 1e-3 * (beta - [1.0, 0.0])
        curve = (x * (weights * np.maximum(chance * (1 - chance), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-6) / spread), float(beta[1])
