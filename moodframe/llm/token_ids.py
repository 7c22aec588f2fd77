"""Token ids of texts with a tokenizers file: a block of texts is cut into pieces as one byte
array, and each distinct piece is encoded once in a worker."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from moodframe.llm.textblocks import text_blocks

#: Distinct pieces and ids a worker remembers before it drops most of them, and the longest
#: piece that it looks up again. Workers outlive their stage, so this stays in memory.
REMEMBERED, STORED, LONGEST = 250_000, 2_000_000, 64

#: Bytes of text encoded at once. The arrays of a block take some 40 times as much.
BLOCK = 1 << 20

#: ASCII signs before which a word of Latin letters may end: not those that may begin a
#: contraction or stand in a special token.
SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"
_LETTERS = r"A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf" ?(?:[{_LETTERS}]+|[{re.escape(SIGNS)}]+)")

#: How a tokenizer file must split texts for the cuts below to be safe.
WORDS_AND_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = re.compile(r"<\|[a-z]+\|>")


def byte_letters() -> dict[int, int]:
    """Byte-level letters: printable Latin-1 stands for itself, other bytes for the characters
    from 256 on, in their order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


def known_split(spec: dict, joined: bool) -> bool:
    """Whether the file splits texts in the way the cuts rely on: byte-level with its own
    pattern and nothing before it (``joined``), or lower-cased words without white space."""
    for token in spec.get("added_tokens") or []:
        if not SPECIAL.fullmatch(token["content"]) or any(token.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            return False
    before, split, model = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec["model"]
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec.get("truncation") or spec.get("padding"):
        return False
    if joined:
        return before is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    kinds = [n.get("type") for n in (before or {}).get("normalizers", [])]
    steps = split.get("pretokenizers", [])
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": WORDS_AND_CONTRACTIONS}
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert") is True
        and not steps[1].get("add_prefix_space")
        and steps[1].get("use_regex") is False
    )


def _flags(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_BLANK = _flags([*range(33), 127])
_WIDE2, _WIDE3 = _flags([0xC2, 0xE1, 0xE2, 0xE3]), _flags([0xE1, 0xE2, 0xE3])
_LETTER, _SIGN = _flags([*range(65, 91), *range(97, 123)]), _flags(SIGNS.encode())
_LATIN = _flags(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start, the first byte of each text that has one included. A piece ends

    - before a blank, and around a line break, that stands between two characters which
      surely are no white space (characters of the ranges with wide blanks count as unsure);
    - before one of ``SIGNS`` that follows a letter of ASCII or Latin-1.

    No token and no special token of a ``known_split`` file reaches over such a place, and
    what stands on one side does not change the tokens of the other."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        unsure = _BLANK[data] | _WIDE2[data]
        follows = (data & 0xC0) == 0x80
        unsure[1:] |= follows[1:] & _WIDE2[data[:-1]]
        unsure[2:] |= follows[2:] & _WIDE3[data[:-2]]
        middle = data[1:-1]
        alone = ~(unsure[:-2] | unsure[2:])
        line = alone & (middle == 10)
        cut[1 : n - 1] = alone & (middle == 32) | line
        cut[2:n] |= line
        letter = _LETTER[data]
        letter[1:] |= _LATIN[data[1:]] & (data[:-1] == 0xC3)
        cut[1:n] |= _SIGN[data[1:]] & letter[:-1]
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class PieceEncoder:
    """Ids of whole texts, as the tokenizers library gives them with ``add_special_tokens``
    False; the strings of special tokens in a text become their ids, as it does by default.

    Texts are cut into pieces (``piece_starts``); Arrow's dictionary finds the distinct ones of
    a block, and only those not met before are encoded: plain words and signs by the
    tokenizer's model, others by the whole tokenizer. Files that split in another way
    (``known_split``) have whole texts as pieces, so any file gives right ids. ``joined``: a
    blank is part of the token behind it, otherwise white space has no ids."""

    def __init__(self, path: str, joined: bool, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.cuts = known_split(json.load(file), joined)
        self.joined, self.width = joined, width
        self.letters = byte_letters()
        self.blank = chr(self.letters[32])
        self.known: dict[bytes | int, int] = {}
        self.flat, self.starts, self.sizes, self.met = np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Drops pieces met in one block only since the last time, and all but those of the most
        blocks, until at most half the bounds is in use."""
        rows = np.fromiter(self.known.values(), np.int64, len(self.known))
        order = np.argsort(-self.met[rows], kind="stable")[: REMEMBERED // 2]
        order = order[(self.met[rows[order]] > 1) & (np.cumsum(self.sizes[rows[order]]) <= STORED // 2)]
        new = np.full(len(self.sizes), -1, np.int64)
        new[rows[order]] = np.arange(len(order))
        self.known = {piece: int(new[row]) for piece, row in self.known.items() if new[row] >= 0}
        sizes, starts = self.sizes[rows[order]], self.starts[rows[order]]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.arange(int(sizes.sum())) + np.repeat(starts - ends + sizes, sizes)]
        self.starts, self.sizes, self.met = ends - sizes, sizes, np.zeros(len(sizes), np.int64)

    def _keep(self, ids: list[int], sizes: list[int]) -> None:
        own = np.array(sizes, np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(own) - own])
        self.sizes = np.concatenate([self.sizes, own])
        self.met = np.concatenate([self.met, np.zeros(len(own), np.int64)])
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])

    def _plain(self, word: str) -> list[int]:
        if not self.joined:
            word = word.lstrip(" ").lower()
        if word.isascii():
            word = word.replace(" ", self.blank)
        else:
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.encode.model.tokenize(word)]

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The row of each piece, new ones encoded."""
        at = [self.known.get(p, -1) for p in pieces]
        rows = np.array(at, np.int64)
        ids, sizes, order, odd = [], [], [], []
        for i in np.flatnonzero(rows < 0).tolist():
            text = pieces[i].decode()
            if self.cuts and PLAIN.fullmatch(text):
                own = self._plain(text)
                ids += own
                sizes.append(len(own))
                order.append(i)
            else:
                odd.append((i, text))
        for first in range(0, len(odd), 2000):
            some = odd[first : first + 2000]
            for (i, _), found in zip(some, self.encode.encode_batch([t for _, t in some], add_special_tokens=False), strict=True):
                own = found.ids
                ids += own
                sizes.append(len(own))
                order.append(i)
        base = len(self.sizes)
        self._keep(ids, sizes)
        for row, i in enumerate(order, base):
            rows[i] = row
            if len(pieces[i]) <= LONGEST:
                self.known[pieces[i]] = row
        self.met[rows] += 1
        return rows

    def block(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids), each text's with the end id if given."""
        if len(self.sizes) > REMEMBERED or len(self.flat) > STORED:
            self._forget()
        starts = piece_starts(data, offsets) if self.cuts else np.unique(offsets[:-1][np.diff(offsets) > 0])
        places = np.append(starts, len(data))
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        distinct = binary.dictionary_encode()
        rows = self._learn(distinct.dictionary.to_pylist())[distinct.indices.to_numpy()]
        bounds = np.searchsorted(starts, offsets)
        if end_id is not None:
            if end_id not in self.known:
                self.known[end_id] = len(self.sizes)
                self._keep([end_id], [1])
            rows = np.insert(rows, bounds[1:], self.known[end_id])
            bounds = bounds + np.arange(len(bounds))
        sizes = self.sizes[rows]
        ends = np.append(0, np.cumsum(sizes))
        take = np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends[:-1], sizes)
        return self.flat[take], ends[bounds]

    def bodies(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> list[memoryview]:
        """Each text's ids as little-endian bytes of ``width`` bytes an id."""
        ids, bounds = self.block(data, offsets, end_id)
        raw, at = memoryview(ids.astype(f"<u{self.width}").tobytes()), (bounds * self.width).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def texts(self, texts: list[str]) -> list[bytes]:
        return [bytes(b) for _, data, offsets in text_blocks(pa.array(texts, pa.large_string()), BLOCK) for b in self.bodies(data, offsets)]


@lru_cache(maxsize=2)
def worker_encoder(path: str, joined: bool, width: int) -> PieceEncoder:
    """One encoder for all tasks that a Python worker runs, so that words are learned once."""
    return PieceEncoder(path, joined, width)


def encoded_batches(parts, column: int, encoder: PieceEncoder, end_id: int):
    """Yields (slice of a record batch, ids of each of its texts with the end id)."""
    for batch in parts:
        for first, data, offsets in text_blocks(batch.column(column), BLOCK):
            yield batch.slice(first, len(offsets) - 1), encoder.bodies(data, offsets, end_id)


def empty_like(names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)
