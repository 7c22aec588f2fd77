"""The Merkle manifest against plain hashlib, on small tables with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodframe.llm import merkle, sha_states
from moodframe.session import stage

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return hashed("".join(map(value, (doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text))))


def tree(level, arity):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([hashed("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def brute_force(rows, arity):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    owns = {k: sorted(trees[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in names}
    built = {k: tree([leaf(r) for r in owns[k]], arity) for k in names}
    top = tree([built[k][-1][0] for k in names], arity) if names else []
    out = []
    for number, name in enumerate(names):
        for place, row in enumerate(owns[name]):
            hit = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, near = leaf(row, int(hit)), []
            for levels, at in ((built[name], place), (top, number)):
                for level in levels[:-1]:
                    first = at // arity * arity
                    run = level[first : first + arity]
                    near += [h for k, h in enumerate(run) if first + k != at]
                    node = hashed("".join(node if first + k == at else h for k, h in enumerate(run)))
                    at //= arity
            root = top[-1][0]
            out.append((row[0], leaf(row), built[name][-1][0], root, hashed("".join(near)), node, node == root))
    return sorted(out, key=str)


def manifest_rows():
    draw = random.Random(2)
    langs = [None, "", "en", "é", "zz", "en-GB"]
    rows = [(i, draw.choice([None, "web", ""]), draw.choice(langs), draw.choice([None, 0, 7, (1 << 63) - 1]), draw.choice([None, "", "text", "漢字 " * 50, "x" * 70_000])) for i in range(-3, 60)]
    return rows + [rows[5], rows[5], rows[9], (9, "other", rows[12][2], 1, "same id"), (None, None, None, None, None), (None, None, None, None, None), (100, "s", "alone", 3, "one leaf")]


def test_hashes_equal_the_library():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(9)), np.uint8).reshape(9, 32)
    state = sha_states.compress(sha_states.fresh(9), sha_states.hex_block(digests))
    kept = state.copy()
    one, two = sha_states.finish(state, 1), sha_states.finish(sha_states.compress(kept, sha_states.hex_block(digests[::-1])), 2)
    text = [bytes(d).hex() for d in digests]
    assert [bytes(d).hex() for d in one] == [hashed(t) for t in text]
    assert [bytes(d).hex() for d in two] == [hashed(a + b) for a, b in zip(text, text[::-1], strict=True)]


@pytest.mark.parametrize("arity", [2, 3])
@pytest.mark.parametrize("block", [4, 4096])
def test_proofs_equal_brute_force(spark, monkeypatch, arity, block):
    monkeypatch.setattr(merkle, "BLOCK", block)  # small blocks: several tiers
    docs = spark.createDataFrame(manifest_rows(), FIELDS).repartition(5)
    got = sorted((tuple(r) for r in merkle.document_proofs(docs, arity).collect()), key=str)
    assert got == brute_force(manifest_rows(), arity)


def test_clashing_columns_and_empty_tables(spark):
    rows = manifest_rows()[:12]
    docs = spark.createDataFrame([(*r, 1, b"x", "y", 2, 3) for r in rows], FIELDS + ", pos long, digest binary, tree string, n long, block long")
    assert sorted((tuple(r) for r in merkle.document_proofs(docs).collect()), key=str) == brute_force(rows, 2)
    assert merkle.document_proofs(docs.limit(0)).collect() == []


def test_any_single_change_breaks_the_root(spark):
    """Folding finds each change of one leaf, and the root again where nothing changed."""
    docs = spark.createDataFrame([(i, "s", f"l{i % 3}", 1, "t") for i in range(40)], FIELDS)
    rows = merkle.document_proofs(docs).collect()
    assert {r["verified"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0} == {False}
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7)


def test_every_leaf_is_folded(spark):
    """A digest that was spoilt after the tree was built breaks the fold of its sibling, which has
    not changed itself; leaves of other trees still reach the root."""
    docs = spark.createDataFrame([(i, "s", f"l{i % 2}", 1, "t") for i in range(0, 12)], FIELDS)
    manifest = merkle.document_manifest(docs)
    second = F.unhex(F.sha2(F.expr("substr(digests, 33, 32)"), 256))
    spoilt = F.when(F.col("tree") == "=l0", F.concat(F.expr("substr(digests, 1, 32)"), second, F.expr("substr(digests, 65)"))).otherwise(F.col("digests"))
    manifest.tiers[0] = stage(manifest.tiers[0].withColumn("digests", spoilt))
    found = {(r["tree"], r["pos"]): bytes(r["folded"]).hex() == manifest.root for r in merkle.proofs(manifest).collect()}
    assert {k for k, held in found.items() if not held} == {("=l0", 0), ("=l0", 1)} and len(found) == 12
