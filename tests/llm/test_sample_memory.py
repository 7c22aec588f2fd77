"""The driver takes the learning sample apart in small pieces."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from moodframe.llm import linear_text


@pytest.mark.parametrize("pairs", [False, True])
def test_pieces_do_not_change_the_features(monkeypatch, pairs):
    texts = pa.array(["", None, "one two one", "x" * 300, "été " * 40, " ", "two\none"], pa.large_string())
    found = []
    for size in (1, 100, 1 << 19):
        monkeypatch.setattr(linear_text, "SAMPLE_BLOCK", size)
        found.append(linear_text.sparse_rows(texts, (3, 4), 64, pairs))
    for other in found[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(found[0], other, strict=True))
    assert found[0][0][:3].tolist() == [0, 0, 0] and found[0][0][-1] == len(found[0][1]) == len(found[0][2])


def test_features_of_many_words_need_little_more_than_themselves():
    words = pa.array([f"word{i:016d}".encode() for i in range(25_000)], pa.large_binary())
    tracemalloc.start()
    bounds, ids, weights = linear_text.sparse_rows(words, (3, 4, 5, 6), 1 << 17)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * (bounds.nbytes + ids.nbytes + weights.nbytes) + (40 << 20)
