"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

A set is sketched in rounds. In round i below T every element is thrown into a hashed bin with
a hashed value; in round T + i every element competes for bin i. A bin keeps the smallest
(round, value), so all T bins are full after 2 T rounds at the latest, and long sets are done
after one or two. A coordinate of two sketches agrees with the chance of their similarity.

Bands of ``ROWS`` coordinates make buckets. A link at similarity 0.8 is missed with a chance
of (1 - 0.8 ** ROWS) ** (T / ROWS), 5e-8 here. Every member of a bucket is compared with the
bucket's smallest member, its pivot. Members linked to the pivot hang together already. Any
other pair x, y of a bucket (a pivot's members in one band) has an intersection of |p| minus the elements of the pivot p that x
or y lacks, plus what the two share outside p. Small bit maps of the lacking and the outside
elements bound both parts, so a pair is met again only if the bound allows a link and it either
shares an element outside the pivot (looked up by element) or needs none. This loses no link,
and a hot bucket costs one comparison a member and a few for those at the rim."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.components import connected_components
from moodframe.llm.textblocks import Hasher, distinct_pairs, lower_table, mix64, owners, text_blocks, word_ranges
from moodframe.session import stage

COORDINATES, ROWS = 128, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, bounds) of the distinct shingles of each text, sorted inside a text. A
    text with fewer words has one shingle of all of them; one without words has none."""
    data = lower_table()[data]
    starts, ends, bounds = word_ranges(data, offsets)
    hashes, owner, have = Hasher.of(data, 9).ranges(starts, ends), owners(bounds), np.diff(bounds)
    at = np.flatnonzero(owner[words - 1 :] == owner[: len(owner) - words + 1]) if len(owner) >= words else np.zeros(0, np.int64)
    value = np.full(len(at), words, np.uint64)
    for k in range(words):
        value = mix64(value * np.uint64(3) + hashes[at + k])
    short = np.flatnonzero((have > 0) & (have < words))
    single = have[short].astype(np.uint64)
    for k in range(words - 1):
        own = have[short] > k
        single[own] = mix64(single[own] * np.uint64(3) + hashes[bounds[short[own]] + k])
    owner, value, _ = distinct_pairs(np.concatenate([owner[at], short]), np.concatenate([value, single]))
    return owner, value, np.searchsorted(owner, np.arange(len(offsets)))


def sketch(owner: np.ndarray, value: np.ndarray, n: int, size: int = COORDINATES) -> np.ndarray:
    """n x size coordinates; rows without elements keep the largest value everywhere."""
    empty = np.iinfo(np.uint64).max
    best = np.full(n * size, empty, np.uint64)
    done, width = 0, 1
    while done < 2 * size and len(value):
        rounds = np.arange(done, min(2 * size, done + width), dtype=np.uint64)
        mixed = mix64(value[None, :] + (rounds[:, None] + np.uint64(1)) * _STEP)
        bins = np.where(rounds[:, None] < size, (mixed >> np.uint64(40)) % np.uint64(size), rounds[:, None] % np.uint64(size)).astype(np.int64)
        place = (owner[None, :] * size + bins).ravel()
        key = ((rounds[:, None] << np.uint64(48)) | (mixed & np.uint64((1 << 48) - 1))).ravel()
        open_ = best[place] == empty
        np.minimum.at(best, place[open_], key[open_])
        done += len(rounds)
        width = 1 if done < 4 else min(64, 2 * width)
        left = (best.reshape(n, size) == empty).any(1)[owner]
        owner, value = owner[left], value[left]
        width = max(1, min(width, (1 << 18) // max(len(value), 1)))
    return best.reshape(n, size)


def sketch_documents(docs: DataFrame, words: int = 2, size: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): set_a and set_b identify the set, bands are
    the bucket keys (empty for an empty set). One pass without a shuffle."""

    def run(parts):
        for batch in parts:
            for first, data, offsets in text_blocks(batch.column(1)):
                n = len(offsets) - 1
                owner, value, bounds = shingle_sets(data, offsets, words)
                sums = np.zeros((2, len(value) + 1), np.uint64)
                np.cumsum(mix64(value + np.uint64(11)), out=sums[0, 1:])
                np.cumsum(mix64(value ^ np.uint64(0x5DEECE66D)), out=sums[1, 1:])
                whole = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64)
                key = np.tile(np.arange(size // rows, dtype=np.uint64), (n, 1))
                coordinates = sketch(owner, value, n, size).reshape(n, size // rows, rows)
                for k in range(rows):
                    key = mix64(key * np.uint64(3) + coordinates[:, :, k])
                filled = np.diff(bounds) > 0
                lengths = np.where(filled, size // rows, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(key[filled].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(bounds)), pa.array(whole[0]), pa.array(whole[1]), bands], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, items): the sorted distinct shingle hashes of each text as little-endian bytes."""

    def run(parts):
        for batch in parts:
            for first, data, offsets in text_blocks(batch.column(1)):
                _, value, bounds = shingle_sets(data, offsets, words)
                items = [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(items)), pa.array(items, pa.binary())], ["doc_id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, items binary")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, common, linked, rest, whole, marks) of the pairs (a, b) by full sets:
    linked if 100 * intersection >= percent * union; rest are elements of a outside b, of which
    so many, in the order of their values, that a partner sharing enough of them with a shares
    one of these; whole if they are all of them. marks are two maps of 256 bits, of the elements
    of a outside b and of those of b outside a. Other columns of the pairs are whole numbers and
    are carried along."""
    carried = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b")
    names = ["a", "b", "n_a", "n_b", "common", "linked", "rest", "whole", "marks", *carried]

    def run(parts):
        for batch in parts:
            sizes, rests = [], []
            marks = np.zeros((batch.num_rows, 8), np.uint64)
            for row, (left, right) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                rest = np.setdiff1d(x, y, assume_unique=True)
                for side, own in ((0, rest), (4, np.setdiff1d(y, x, assume_unique=True))):
                    np.bitwise_or.at(marks[row], side + (own >> np.uint64(6) & np.uint64(3)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
                common = len(x) - len(rest)
                # a partner has at least percent * len(x) / 100 elements
                need = -(-percent * len(x) // 100) - common
                used = rest[: len(rest) - max(need, 1) + 1]
                sizes.append((len(x), len(y), common, 100 * common >= percent * (len(x) + len(y) - common), len(used) == len(rest)))
                rests.append(used.view(np.int64))
            n_a, n_b, common, linked, whole = (pa.array(v) for v in zip(*sizes, strict=True)) if sizes else (pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))
            bounds = pa.array(np.append(0, np.cumsum([len(r) for r in rests])).astype(np.int32))
            maps = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * 8), pa.array(marks.view(np.int64).ravel()))
            values = pa.array(np.concatenate(rests) if rests else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], n_a, n_b, common, linked, pa.ListArray.from_arrays(bounds, values), whole, maps, *batch.columns[4:]], names)

    more = "".join(f", {c} long" for c in carried)
    return both.select("a", "b", "items_a", "items_b", *carried).mapInArrow(run, f"a long, b long, n_a long, n_b long, common long, linked boolean, rest array<long>, whole boolean, marks array<long>{more}")


def with_component(rows: DataFrame, node: str, groups: DataFrame) -> DataFrame:
    found = rows.join(groups.select(F.col("node").alias(node), F.col("component").alias("_component")), node, "left")
    return found.withColumn("component", F.coalesce("_component", node)).drop("_component")


def rim_pairs(stars: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of members of one bucket, one of them not linked to its pivot, that may be
    linked and are not connected yet. ``stars`` are members (a) compared with their pivots (b);
    bit i of ``shared`` says that they share the bucket of band i. Members of one pivot without
    a common bucket are no pair: if they are linked, another bucket holds both."""
    members = with_component(stars.withColumnRenamed("a", "x").withColumnRenamed("b", "p"), "x", groups)
    mixed = members.groupBy("p").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"), F.max((~F.col("linked")).cast("int")).alias("loose"))
    open_ = stage(members.join(mixed.where("n > 1 and least <> most and loose = 1").select("p"), "p"), "members")
    side = lambda rows, m: rows.select(*[F.col(c).alias(c if c in ("p", "element") else f"{c}_{m}") for c in rows.columns])
    open_ = open_.withColumns({"outside": F.col("n_a") - F.col("common"), "like": F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))})
    narrow = open_.drop("rest")
    rim = narrow.where("not linked")
    # one minus similarity is a metric: linked members lie about as far from the pivot
    near = f"abs(like_1 - like_2) <= {(100 - percent) / 100 + 1e-9}"
    apart = F.expr(f"shared_1 & shared_2 <> 0 and component_1 <> component_2 and (linked_2 or x_1 < x_2) and {near}")
    need = F.lit(percent) * (F.col("n_a_1") + F.col("n_a_2"))
    bits = lambda places, form: sum((F.bit_count(form(F.col("marks_1")[i], F.col("marks_2")[i])) for i in places), F.lit(0))
    inside = F.least("common_1", "common_2", F.col("n_b_1") - bits(range(4, 8), lambda u, v: u.bitwiseOR(v)))
    only_1 = F.col("outside_1") - bits(range(4), lambda u, v: u.bitwiseAND(F.bitwise_not(v)))
    only_2 = F.col("outside_2") - bits(range(4), lambda u, v: v.bitwiseAND(F.bitwise_not(u)))
    enough = side(rim, 1).join(side(narrow, 2), "p").where(apart & (inside * (100 + percent) >= need)).select("x_1", "x_2")
    parts = open_.withColumn("element", F.explode("rest")).drop("rest")
    shared = (
        side(parts.where("not linked"), 1)
        .join(side(parts, 2), ["p", "element"])
        .where(apart & ((inside + F.least(only_1, only_2)) * (100 + percent) >= need))
        .groupBy("p", "x_1", "x_2")
        .agg(F.count("*").alias("n"), F.first("whole_1").alias("w1"), F.first("whole_2").alias("w2"), F.first((inside * (100 + percent)).alias("i")).alias("i"), F.first(need).alias("need"))
        .where(F.expr(f"not (w1 and w2) or i + n * {100 + percent} >= need"))
        .select("x_1", "x_2")
    )
    return enough.union(shared).select(F.least("x_1", "x_2").alias("a"), F.greatest("x_1", "x_2").alias("b")).distinct()


def near_duplicate_groups(docs: DataFrame, words: int = 5, percent: int = 80, size: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Two texts are linked if their sets of ``words``-word shingles share at least ``percent``
    hundredths of their union; component_id is the smallest doc_id that links lead to. Null and
    empty texts have an empty set and no links; rows without a doc_id keep a null component.
    Rows with one doc_id are one node. Equal sets are met once, as one class; the result joins
    classes to documents, so copies are never paired."""
    sketched = stage(sketch_documents(docs, words, size, rows), "sketch")
    classes = stage(
        sketched.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes"
    )
    members = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    pivots = members.groupBy("bucket").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").select("bucket", "b")
    met = members.join(pivots, "bucket").where("rep <> b")
    bits = F.expr("bit_or(shiftleft(1L, band))")
    pairs = stage(met.select(F.col("rep").alias("a"), "b", "band").groupBy("a", "b").agg(bits.alias("shared")), "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = stage(document_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted.hint("merge"), "doc_id", "left_semi"), words).dropDuplicates(["doc_id", "items"]), "sets")
    ids = sketched.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "set_a", "set_b").distinct()
    several = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    same = ids.join(several, "doc_id").join(classes, ["n_shingles", "set_a", "set_b"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    stars = stage(compared(pairs, sets, percent), "stars")
    groups = stage(connected_components(stars.where("linked").select("a", "b").union(same)), "groups")
    rim = stage(compared(rim_pairs(stars, groups, percent).select("a", "b"), sets, percent).where("linked").select("a", "b"), "rim")
    if not rim.isEmpty():
        groups = stage(connected_components(rim.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))), "groups")
    named = classes.select("n_shingles", "set_a", "set_b", "rep")
    named = with_component(named, "rep", groups)
    out = sketched.drop("bands").join(named.drop("rep"), ["n_shingles", "set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
