"""Language-model scoring with a weighted backoff automaton of smoothed bigrams.

States are the root and one state for each context: a word seen in training, or the start of
a text. An arc (h, w) exists for each bigram of the training texts and weighs
log10((c(h w) + K p(w)) / (c(h) + K)); the failure arc of h weighs log10(K / (c(h) + K)) and
leads to the root, whose arc for w weighs log10 p(w) with p(w) = (c(w) + 1) / (N + V + 1). The
chances of a state sum to one over the vocabulary and one unknown token. Reading w leads to the
state w, or to the root if w was never seen, so the states of a text are its tokens shifted by
one, and a block of texts is traversed by one lookup for each position.

The counts grow with the corpus and are never held whole. Texts lie in hash blocks of a few
megabytes; a block sends its distinct n-grams with their counts to the key ranges, which add
them up over all blocks and send each block the totals of its own n-grams: the part of the
automaton that its texts can reach."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.textblocks import Hasher, crc32_text, lower_table, mix64, owners, raw_text, text_blocks, word_ranges

BLOCK_BYTES = 4 << 20
#: Weight of the unigram chances in a context, in tokens.
SMOOTHING = 300.0
END, START = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BC2B2AE35)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, text bounds): the words of a text, ASCII lower-cased, then one end."""
    data = lower_table()[data]
    starts, ends, bounds = word_ranges(data, offsets)
    n = len(offsets) - 1
    out = np.full(len(starts) + n, END, np.uint64)
    out[np.arange(len(starts)) + owners(bounds)] = Hasher.of(data, 3).ranges(starts, ends)
    return out, bounds + np.arange(n + 1)


def grams(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each token, key of its state, key of each bigram)."""
    state = np.empty_like(tokens)
    state[1:] = tokens[:-1]
    state[bounds[:-1]] = START
    return mix64(tokens + np.uint64(1)), mix64(state + np.uint64(1)), mix64(mix64(state * np.uint64(3)) + tokens)


def squeezed(values: np.ndarray) -> bytes:
    """Bytes by place, so that the shuffle's compression meets equal ones in a row."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def spread(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def fragments(keys: np.ndarray, counts: np.ndarray, ranges: int):
    """Slices of sorted keys by key range: (range, steps from key to key, counts)."""
    if not len(keys):
        return
    part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
        yield int(part[a]), squeezed(np.diff(keys[a:b], prepend=np.uint64(0))), squeezed(counts[a:b].astype("<u4"))


def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each sent key among the distinct ones, totals, lengths of the fragments)."""
    keys = [np.cumsum(spread(k.as_py(), "<u8"), dtype=np.uint64) for k in table.column("keys")]
    counts = np.concatenate([spread(c.as_py(), "<u4") for c in table.column("counts")])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    return place, np.bincount(place, counts), np.array([len(k) for k in keys])


def corpus_size(docs: DataFrame, ranges: int) -> tuple[int, int, int]:
    """(tokens, distinct tokens, bytes of all texts); docs has text and training. Distinct
    tokens are counted inside key ranges; three numbers reach the driver."""

    def local(parts):
        for batch in parts:
            for first, data, offsets in text_blocks(batch.column(0), BLOCK_BYTES):
                tokens, bounds = token_hashes(data, offsets)
                used = np.repeat(batch.column(1).slice(first, len(offsets) - 1).to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
                keys, counts = np.unique(mix64(tokens[used] + np.uint64(1)), return_counts=True)
                rows = list(fragments(keys, counts, ranges)) or [(0, b"", b"")]
                size = [len(data)] + [0] * (len(rows) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array(size)], ["range", "keys", "counts", "bytes"])

    def distinct(table: pa.Table) -> pa.Table:
        _, totals, _ = summed(table)
        return pa.table({"tokens": [int(totals.sum())], "words": [len(totals)], "bytes": [int(table.column("bytes").to_numpy().sum())]})

    sent = docs.select("text", "training").mapInArrow(local, "range long, keys binary, counts binary, bytes long")
    found = sent.groupBy("range").applyInArrow(distinct, "tokens long, words long, bytes long")
    return tuple(found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in found.columns]).first())


def score_texts(docs: DataFrame, held_out, smoothing: float = SMOOTHING) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` is a function of the id column; the model learns from all other texts. Null
    texts are empty (one end token). base_score uses the root alone. Without training texts
    every chance is one (N = V = 0). Rows that repeat an id are texts of their own."""
    ranges = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    n, v, size = corpus_size(rows.select("text", (~F.col("held_out")).alias("training")), ranges)
    ranges = max(ranges, -(-size // (2 * BLOCK_BYTES)))
    blocks = max(ranges, -(-size // BLOCK_BYTES))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def send(table: pa.Table) -> pa.Table:
        keys, counts = block_keys(table)
        rows = list(fragments(keys, counts, ranges))
        return pa.Table.from_arrays(
            [pa.array([table.column("block")[0].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
            ["block", "range", "keys", "counts"],
        )

    def reply(table: pa.Table) -> pa.Table:
        place, totals, lengths = summed(table)
        own = totals[place].astype("<u8")
        cuts = np.append(0, np.cumsum(lengths))
        answers = [squeezed(own[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_arrays([table.column("block"), table.column("range"), pa.array(answers, pa.binary())], ["block", "range", "totals"])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("range")
        totals = np.concatenate([spread(t.as_py(), "<u8") for t in answers.column("totals")]).astype(float)
        tokens, bounds, _ = block_tokens(texts)
        token_key, state_key, pair_key = grams(tokens, bounds)
        keys, place = np.unique(np.concatenate([token_key, state_key, pair_key]), return_inverse=True)
        if len(keys) != len(totals):
            raise ValueError("a block and its totals differ")
        word, state, pair = totals[place].reshape(3, -1)
        root = np.log10((word + 1) / (n + v + 1))
        chance = (word + 1) / (n + v + 1)
        arc = np.log10((pair + smoothing * chance) / (state + smoothing))
        failed = np.log10(smoothing / (state + smoothing)) + root
        text, m = owners(bounds), len(bounds) - 1
        return pa.Table.from_arrays(
            [
                texts.column("doc_id"),
                texts.column("held_out"),
                pa.array(np.diff(bounds)),
                pa.array(np.bincount(text, word > 0, m).astype(np.int64)),
                pa.array(np.full(m, n, np.int64)),
                pa.array(np.bincount(text, root, m)),
                pa.array(np.bincount(text, np.where(pair > 0, arc, failed), m)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    sent = blocked.groupBy("block").applyInArrow(send, "block long, range long, keys binary, counts binary")
    answers = sent.groupBy("range").applyInArrow(reply, "block long, range long, totals binary")
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def block_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = raw_text(table.column("text").combine_chunks().cast(pa.large_string()))
    tokens, bounds = token_hashes(data, offsets)
    return tokens, bounds, np.repeat(~table.column("held_out").to_numpy().astype(bool), np.diff(bounds))


def block_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block in order, with their counts in its training texts. A state
    counts as often as it is left, which is as often as its token occurs (the start: once in
    each text), so tokens and states share their keys and only tokens and starts are counted."""
    tokens, bounds, training = block_tokens(table)
    token_key, state_key, pair_key = grams(tokens, bounds)
    begins = np.zeros(len(tokens), bool)
    begins[bounds[:-1]] = True
    keys, place = np.unique(np.concatenate([token_key, state_key, pair_key]), return_inverse=True)
    counted = np.concatenate([training, training & begins, training])
    return keys, np.bincount(place, counted, len(keys)).astype(np.int64)


def default_held_out(doc_id):
    return crc32_text(doc_id) % 7 == 2
