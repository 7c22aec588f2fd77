"""Hashed n-gram features of texts and the bounded labelled sample that models learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.textblocks import Hasher, byte_codes, distinct_pairs, lower_table, mix64, owners, text_blocks, word_ranges


def gram_positions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], buckets: int):
    """Character n-grams inside words, over UTF-8 bytes with one mark on each side of a word.

    Yields (bucket, word number) arrays, one pair for each n-gram size. The words are laid
    out with a zero byte between them, which serves as both marks."""
    lengths = ends - starts
    marks = np.concatenate([[0], np.cumsum(lengths + 1)])
    laid = np.zeros(int(marks[-1]) + 1, np.uint8)
    source = np.repeat(starts - marks[:-1] - 1, lengths)
    places = np.arange(int(lengths.sum()))
    word = np.repeat(np.arange(len(starts)), lengths)
    places = places + word + 1
    laid[places] = data[places + source]
    codes = byte_codes(5)[laid]
    # the word on whose left mark or inside whose letters a position lies
    holder = np.repeat(np.arange(len(starts)), lengths + 1)
    room = np.repeat(marks[1:], lengths + 1) - np.arange(int(marks[-1])) + 1
    value = codes.copy()
    for size in range(2, max(sizes) + 1):
        value = value[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1 :]
        if size in sizes:
            fits = np.flatnonzero(room >= size)
            yield (mix64(value[fits] + np.uint64(size)) % np.uint64(buckets)).astype(np.int64), holder[fits]


def word_features(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], buckets: int, pairs: bool = False):
    """Yields (family, bucket, text number): whole words, word pairs if asked for, n-grams."""
    data = lower_table()[data]
    starts, ends, bounds = word_ranges(data, offsets)
    owner = owners(bounds)
    if not len(starts):
        return
    words = Hasher.of(data, 5).ranges(starts, ends)
    yield "word", (words % np.uint64(buckets)).astype(np.int64), owner
    if pairs:
        near = np.flatnonzero(owner[1:] == owner[:-1])
        both = mix64(words[near] * np.uint64(3) + words[near + 1])
        yield "pair", (both % np.uint64(buckets)).astype(np.int64), owner[near]
    for bucket, word in gram_positions(data, starts, ends, sizes, buckets):
        yield "gram", bucket, owner[word]


#: Bytes of text that the driver takes apart at once; what that needs is some hundred times as much.
SAMPLE_BLOCK = 1 << 16


def _drained(parts: list[np.ndarray]) -> np.ndarray:
    """The arrays in one; the list is emptied, so that nothing is held twice for longer than this."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def sparse_rows(column: pa.Array, sizes: tuple[int, ...], buckets: int, pairs: bool = False):
    """(row bounds, feature ids, weights): each family is averaged over its members; families
    have id ranges of their own only if ``pairs`` is set (one bag otherwise)."""
    ids, weights, rows, lengths = [], [], [], np.zeros(len(column), np.int64)
    for first, data, offsets in text_blocks(column, SAMPLE_BLOCK):
        parts = list(word_features(data, offsets, sizes, buckets, pairs))
        shift = {"word": 0, "pair": buckets, "gram": 2 * buckets} if pairs else dict.fromkeys(("word", "pair", "gram"), 0)
        for family in ("word", "pair", "gram") if pairs else ("all",):
            own = [p for p in parts if family in ("all", p[0])]
            if not own:
                continue
            owner, value, count = distinct_pairs(np.concatenate([p[2] for p in own]), np.concatenate([p[1] + shift[p[0]] for p in own]))
            total = np.bincount(owner, count, len(offsets) - 1)
            lengths[first : first + len(offsets) - 1] += np.bincount(owner, minlength=len(offsets) - 1)
            if pairs:
                rows.append((owner + first).astype(np.int32))
            ids.append(value.astype(np.int32))
            weights.append((count / total[owner]).astype(np.float32))
    bounds = np.append(0, np.cumsum(lengths))
    if not ids:
        return bounds, np.zeros(0, np.int64), np.zeros(0)
    if not pairs:  # already in the order of the texts
        return bounds, _drained(ids), _drained(weights)
    row = _drained(rows)
    order = np.argsort(row, kind="stable").astype(np.int32)
    return bounds, _drained(ids)[order], _drained(weights)[order]


def mean_scores(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], table: np.ndarray) -> np.ndarray:
    """Sum over the three families of the mean of their members' table values, by text."""
    buckets = len(table) // 3
    shift = {"word": 0, "pair": buckets, "gram": 2 * buckets}
    n = len(offsets) - 1
    sums = {f: np.zeros(n) for f in shift}
    counts = {f: np.zeros(n) for f in shift}
    for family, bucket, owner in word_features(data, offsets, sizes, buckets, pairs=True):
        sums[family] += np.bincount(owner, table[bucket + shift[family]], n)
        counts[family] += np.bincount(owner, minlength=n)
    return sum(sums[f] / np.maximum(counts[f], 1) for f in shift)


def word_means(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean table value of the subword bag of each word, word bounds of the texts)."""
    data = lower_table()[data]
    starts, ends, bounds = word_ranges(data, offsets)
    if not len(starts):
        return np.zeros(0), bounds
    total = table[(Hasher.of(data, 5).ranges(starts, ends) % np.uint64(len(table))).astype(np.int64)].astype(float)
    count = np.ones(len(starts))
    for bucket, word in gram_positions(data, starts, ends, sizes, len(table)):
        total += np.bincount(word, table[bucket], len(starts))
        count += np.bincount(word, minlength=len(starts))
    return total / count, bounds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int, held_out=None) -> list:
    """At most ``max_rows`` rows (text, label), up to half of them of the rarer label, taken in
    hash order of the id. Only the bounded id list is broadcast, only its texts are collected.
    Texts over ``max_chars`` characters teach nothing here. Ids with two different labels,
    null labels and ids without a text are left out."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    if held_out is not None:
        known = known.where(~held_out(F.col("_id")))
    known = known.where("_label in (0, 1) and _id is not null").groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other").drop("_other")
    half = max_rows // 2
    picked = [known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(half) for value in (0, 1)]
    ids = picked[0].union(picked[1])
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.length("_text") <= max_chars)
    found = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_text").alias("text"), F.first("_label").alias("label"))
    return sorted((r["_id"], r["text"], r["label"]) for r in found.collect())
