"""What an encoder remembers is bounded, and common pieces outlast rare ones."""

import random

import numpy as np

from moodframe.llm import token_ids
from moodframe.llm.queries import vocabulary


def test_a_worker_remembers_few_pieces():
    encoder = token_ids.PieceEncoder(vocabulary("byte_bpe_50k.json"), True, 4)
    for first in range(0, 600_000, 60_000):
        encoder.texts([" ".join(f"w{i}" for i in range(k, k + 10_000)) for k in range(first, first + 60_000, 10_000)])
    assert len(encoder.known) < 400_000 and len(encoder.flat) < 3_000_000


def test_common_pieces_are_kept_and_ids_stay_right(monkeypatch):
    monkeypatch.setattr(token_ids, "REMEMBERED", 200)
    monkeypatch.setattr(token_ids, "BLOCK", 1000)
    draw = random.Random(3)
    texts = [" ".join(["the", "common", "words", *(f"x{draw.randrange(10**9)}" for _ in range(60))]) for _ in range(60)]
    encoder = token_ids.PieceEncoder(vocabulary("byte_bpe_50k.json"), True, 4)
    dropped, kept, forget = [], [], encoder._forget

    def counted():
        before = len(encoder.known)
        forget()
        dropped.append(before - len(encoder.known))
        kept.append({b" common", b" words"} <= set(encoder.known))

    encoder._forget = counted
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.encode.encode_batch(texts, add_special_tokens=False)]
    assert encoder.texts(texts) == want
    assert len(dropped) > 3 and min(dropped) > 100 and all(kept)
