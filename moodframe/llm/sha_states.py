"""SHA-256 over many messages at once, with states that can be kept and resumed.

A digest written as lower-case hex is 64 bytes long, one block of SHA-256. The state of a hash
that has taken some digests is therefore eight words, which a table can hold: a later task goes
on from them as from a copied hash object."""

from __future__ import annotations

import math
from itertools import count, islice

import numpy as np

_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _primes():
    return (n for n in count(2) if all(n % d for d in range(2, math.isqrt(n) + 1)))


def _cube_root(n: int) -> int:
    at = round(n ** (1 / 3))
    while at**3 > n:
        at -= 1
    while (at + 1) ** 3 <= n:
        at += 1
    return at


#: First 32 bits of the fractions of the cube roots of the first 64 primes, and of the square
#: roots of the first eight.
ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in islice(_primes(), 64)], np.uint32)
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in islice(_primes(), 8)], np.uint32)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) or (16, 1) each."""
    words = list(block)
    for i in range(16, 64):
        low, high = words[i - 15], words[i - 2]
        words.append(words[i - 16] + words[i - 7] + (_turn(low, 7) ^ _turn(low, 18) ^ (low >> np.uint32(3))) + (_turn(high, 17) ^ _turn(high, 19) ^ (high >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for word, constant in zip(words, ROUNDS, strict=True):
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (constant + word)
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def fresh(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, 1)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Blocks (16, n) of digests (n, 32) as hex text."""
    text = np.empty((len(digests), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    return text.view(">u4").astype(np.uint32).T


def finish(state: np.ndarray, blocks: int) -> np.ndarray:
    """Digests (n, 32) of states that have taken so many whole blocks and nothing else."""
    last = np.zeros((16, 1), np.uint32)
    last[0], last[14], last[15] = 1 << 31, (512 * blocks) >> 32, (512 * blocks) & 0xFFFFFFFF
    return np.ascontiguousarray(compress(state, last).T).astype(">u4").view(np.uint8)
