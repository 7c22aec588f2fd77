"""Exact repeats of long byte strings, by column-wise multi-document suffix sorting.

A string of ``length`` bytes that occurs twice has the same anchor at the same distance in both
places: the leftmost smallest of its hashed ``GRAM``-byte pieces. So every start belongs to one
anchor, a run of starts with one anchor is a segment, and only segments with equal anchors can
hold equal strings, in the same column when they are aligned at the anchor.

Segments with equal anchors are a collection of short documents. Their suffixes are sorted
column by column from the right: each round every document inserts one symbol, the collection's
transform is the symbols in the order of the suffixes behind them, and a stable sort by symbol
gives the next order. Common prefixes follow by a range minimum over the last ones. A start is
repeated if its suffix shares ``length`` bytes with a neighbour. Because equal strings stand in
equal columns, a round compares the suffixes of one column only, so a collection takes as many
rounds as a segment is long (under 2 * ``length``), not as the longest document is.

Texts lie in hash blocks of a few megabytes. A block sends the distinct (anchor, segment) hashes
to key ranges. These answer which anchors are alone (nothing to do), which segments have an
identical copy (all their starts are repeated), and which must be sorted; only then bytes
travel, once for each distinct segment. An anchor with more than ``CROWD`` distinct segments
(a very common passage between different neighbours) is split further: it is settled by the
hashes of its whole strings, spread over all ranges."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodframe.llm.frames import under_neutral_names
from moodframe.llm.language_model import spread, squeezed
from moodframe.llm.textblocks import Hasher, byte_codes, mix64, per_text, raw_text, text_blocks

LENGTH, GRAM, CROWD = 200, 32, 4096
BLOCK_BYTES = 4 << 20
BATCH = 10_000
ALONE, COPIED, SORTED, SUPPLIES, CROWDED = 0, 1, 2, 4, 8


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, distance from first start to anchor, anchor hash,
    segment hash) of every segment of the texts; gram is a power of two."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    value, size = byte_codes(21)[data], 1
    while size < gram:
        value = mix64(value[:-size] * np.uint64(2 * size + 1) + value[size:])
        size *= 2
    width = length - gram + 1
    # the upper half decides, then the place, so equal pieces give the leftmost
    least = (value >> np.uint64(32) << np.uint64(32)) | np.arange(len(value), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    room = np.maximum(np.diff(offsets) - length + 1, 0)
    start = np.arange(int(room.sum())) + np.repeat(offsets[:-1] - np.cumsum(room) + room, room)
    if not len(start):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))
    count = np.diff(np.append(new, len(start)))
    first, place = start[new], place[new]
    content = Hasher.of(data, 23).ranges(first, first + count - 1 + length)
    return first, count, place - first, mix64(value[place]), mix64(content + (place - first).astype(np.uint64))


def block_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``anchors`` of a block of texts, worked off in small runs of texts."""
    found = []
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data))])
    for first, own, places in text_blocks(column):
        start, *rest = anchors(own, places, length, gram)
        found.append((start + offsets[first], *rest))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else anchors(data, offsets, length, gram)


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def cuts_of(parts: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal values, with the end."""
    return np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(parts)) if len(parts) else np.zeros(1, np.int64)


def distinct_segments(key: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one row of each distinct (key, segment) in order, distinct number of each row, counts)."""
    order = np.lexsort((segment, key))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (segment[order][1:] != segment[order][:-1])) if len(order) else np.zeros(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], number, np.diff(np.append(first, len(order)))


def sort_columns(body: np.ndarray, places: np.ndarray, lead: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Repeated starts of segments, as flags laid out segment by segment.

    Segment i has its bytes at places[i]..places[i + 1] of ``body``, ``starts[i]`` starts and its
    anchor ``lead[i]`` bytes behind the first; ``group`` ascends. One round for each column."""
    m = len(starts)
    begin, end = -lead, starts - lead + length - 1
    left, right = int(begin.min()), int(end.max())
    columns = np.zeros((right - left, m), np.uint8)  # 0: no symbol there; others one higher
    row = np.repeat(np.arange(m), end - begin)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
    columns[inner + begin[row] - left, row] = body[places[row] + inner] + np.uint8(1)
    base = np.append(0, np.cumsum(starts))
    flags = np.zeros(int(base[-1]), bool)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int32)
    wide = group.astype(np.int64) << 8
    for column in range(right - left - 1, -1, -1):
        symbol = columns[column, order]  # the column of the collection's transform
        key = wide[order] | symbol
        step = np.argsort(key, kind="stable")
        key, symbol = key[step], symbol[step]
        joined = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] > 0)) + 1
        fresh = np.zeros(m + 1, np.int32)
        if len(joined):
            before, after = step[joined - 1] + 1, step[joined] + 1
            fresh[joined] = 1 + np.minimum.reduceat(common, np.stack([before, after], 1).ravel())[::2]
        order, common = order[step], fresh
        long = common >= length
        start = column + left - begin[order]
        hit = np.flatnonzero((long[:-1] | long[1:]) & (start >= 0) & (start < starts[order]))
        flags[base[order[hit]] + start[hit]] = True
    return flags


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, texts: bool = False) -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_removed, n_spans and kept_sha256 and, if
    ``texts`` is set, kept_text, which replace columns of these names. kept_text lacks whole
    characters: those of which a byte is removed.

    A byte is removed if it lies in a string of ``length`` bytes that starts at another place
    too, in any text, judged on the texts as given. Null texts are empty; texts shorter than
    ``length`` stay whole; rows that repeat a text are texts of their own."""
    spark = docs.sparkSession
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * texts]
    others = [c for c in docs.columns if c not in new]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    ranges = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * BLOCK_BYTES)))
    blocks = max(2 * ranges, -(-size // BLOCK_BYTES))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    blocked = plain.withColumn("block", F.pmod(F.xxhash64(*[c for c, kind in plain.dtypes if "map" not in kind]), F.lit(blocks)))

    def of_block(table: pa.Table):
        data, offsets = raw_text(table.column("body").combine_chunks().cast(pa.large_string()))
        return data, offsets, block_anchors(data, offsets, length, gram)

    def send_hashes(table: pa.Table) -> pa.Table:
        _, _, (_, _, _, key, segment) = of_block(table)
        row, _, count = distinct_segments(key, segment)
        cuts = cuts_of(ranges_of(key[row], ranges))
        sent = [(squeezed(key[row[a:b]]), squeezed(segment[row[a:b]]), squeezed(count[a:b].astype("<u4"))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        where = ranges_of(key[row[cuts[:-1]]], ranges)
        block = table.column("block")[0].as_py()
        return pa.Table.from_arrays([pa.array([block] * len(sent), pa.int64()), pa.array(where, pa.int64()), *[pa.array([s[k] for s in sent], pa.binary()) for k in range(3)]], ["block", "range", "keys", "segments", "counts"])

    def answer_hashes(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")  # the same block supplies a segment whenever this runs
        keys = [spread(v.as_py(), "<u8") for v in table.column("keys")]
        lengths = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        segment = np.concatenate([spread(v.as_py(), "<u8") for v in table.column("segments")])
        count = np.concatenate([spread(v.as_py(), "<u4") for v in table.column("counts")]).astype(np.int64)
        row, number, _ = distinct_segments(key, segment)
        total = np.bincount(number, count).astype(np.int64)
        group = np.cumsum(np.append(True, key[row][1:] != key[row][:-1])) - 1
        members, single = np.bincount(group), np.bincount(group, total == 1)
        mixed = ((members > 1) & (single > 0))[group]
        crowded = mixed & (members > crowd)[group]
        status = np.where(total > 1, COPIED, np.where(mixed, SORTED, ALONE))
        status = np.where(crowded, status | CROWDED, status)[number]
        supplies = np.zeros(len(key), bool)
        supplies[row] = mixed & ~crowded
        status = np.where(supplies, status | SUPPLIES, status).astype(np.uint8)
        ends = np.cumsum(lengths)
        return pa.Table.from_arrays([table.column("block"), table.column("range"), pa.array([status[a:b].tobytes() for a, b in zip(ends - lengths, ends, strict=True)], pa.binary())], ["block", "range", "answer"])

    def roles(answers: pa.Table, kind: int) -> bytes:
        own = sorted((r["range"], r["answer"]) for r in answers.to_pylist() if r["kind"] == kind)
        return b"".join(a for _, a in own)

    def wanted(table: pa.Table, answers: pa.Table):
        """What a block supplies: its segments with their status, and the strings of crowds."""
        data, offsets, (first, count, lead, key, segment) = of_block(table)
        row, number, _ = distinct_segments(key, segment)
        status = np.frombuffer(roles(answers, 0), np.uint8)
        if len(status) != len(row):
            raise ValueError("a block and its answers differ")
        many = np.flatnonzero(status[number] & CROWDED) if len(row) else np.zeros(0, np.int64)
        at = np.arange(int(count[many].sum())) + np.repeat(first[many] - np.cumsum(count[many]) + count[many], count[many])
        strings = Hasher.of(data, 25).ranges(at, at + length) if len(at) else np.zeros(0, np.uint64)
        return data, offsets, first, count, lead, key, row, number, status, at, strings

    def send_bytes(table: pa.Table, answers: pa.Table) -> pa.Table:
        data, _, first, count, lead, key, row, _, status, _, strings = wanted(table, answers)
        own = np.flatnonzero(status & SUPPLIES)
        rows = {}
        where = ranges_of(key[row[own]], ranges)
        cuts = cuts_of(where)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r = row[own[a:b]]
            body = b"".join(data[f : f + c - 1 + length].tobytes() for f, c in zip(first[r], count[r], strict=True))
            rows[int(where[a])] = [key[r].tobytes(), status[own[a:b]].tobytes(), count[r].astype("<u2").tobytes(), lead[r].astype("<u2").tobytes(), body, b"", b""]
        unique, times = np.unique(strings, return_counts=True)
        where = ranges_of(unique, ranges)
        cuts = cuts_of(where)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows.setdefault(int(where[a]), [b""] * 7)[5:] = [squeezed(unique[a:b]), squeezed(times[a:b].astype("<u4"))]
        block = table.column("block")[0].as_py()
        names = ["keys", "status", "counts", "leads", "bodies", "strings", "times"]
        return pa.Table.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(list(rows), pa.int64()), *[pa.array([v[k] for v in rows.values()], pa.binary()) for k in range(7)]], ["block", "range", *names])

    def answer_bytes(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(v.as_py(), kind) for v in table.column(name)]
        keys = read("keys", "<u8")
        lengths = np.array([len(k) for k in keys])
        key, status = np.concatenate(keys), np.concatenate(read("status", np.uint8))
        count, lead = (np.concatenate(read(n, "<u2")).astype(np.int64) for n in ("counts", "leads"))
        body = np.concatenate(read("bodies", np.uint8))
        places = np.append(0, np.cumsum(count - 1 + length))
        base = np.append(0, np.cumsum(count))
        flags = np.zeros(int(base[-1]), bool)
        order = np.argsort(key, kind="stable")
        borders = cuts_of(key[order])
        at = 0
        while at < len(borders) - 1:
            to = max(at + 1, int(np.searchsorted(borders, borders[at] + BATCH, "right")) - 1)
            own = order[borders[at] : borders[to]]
            found = sort_columns(body, places[own], lead[own], count[own], np.repeat(np.arange(to - at), np.diff(borders[at : to + 1])), length)
            inner = np.arange(len(found)) + np.repeat(base[own] - np.cumsum(count[own]) + count[own], count[own])
            flags[inner] = found
            at = to
        ends = np.cumsum(lengths)
        first = [np.packbits(flags[base[a] : base[b]]).tobytes() for a, b in zip(ends - lengths, ends, strict=True)]
        strings = [spread(v.as_py(), "<u8") for v in table.column("strings")]
        times = np.concatenate([spread(v.as_py(), "<u4") for v in table.column("times")])
        _, place = np.unique(np.concatenate(strings), return_inverse=True)
        twice = (np.bincount(place, times) > 1)[place] if len(place) else np.zeros(0, bool)
        ends = np.cumsum([len(s) for s in strings])
        second = [np.packbits(twice[e - len(s) : e]).tobytes() for s, e in zip(strings, ends, strict=True)]
        both = [b"".join([len(x).to_bytes(4, "little"), x, y]) for x, y in zip(first, second, strict=True)]
        return pa.Table.from_arrays([table.column("block"), table.column("range"), pa.array(both, pa.binary()), pa.array([1] * len(both), pa.int32())], ["block", "range", "answer", "kind"])

    fields = [f for f in plain.schema.fields if f.name != "body"]
    result = StructType([*fields, *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts).fields])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets, first, count, _, key, row, number, status, at, strings = wanted(table, answers)
        replies = {r["range"]: r["answer"] for r in answers.to_pylist() if r["kind"] == 1}
        total = len(data)
        mark = np.zeros(total + 1, np.int32)  # +1 where a repeated string begins, -1 where it ends
        copied = np.flatnonzero(status[number] & COPIED) if len(row) else np.zeros(0, np.int64)
        np.add.at(mark, first[copied], 1)
        np.add.at(mark, first[copied] + count[copied] - 1 + length, -1)
        repeated = []
        own = np.flatnonzero(status & SUPPLIES)
        where = ranges_of(key[row[own]], ranges)
        cuts = cuts_of(where)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            reply = replies[int(where[a])]
            size = int.from_bytes(reply[:4], "little")
            r = row[own[a:b]]
            flags = np.unpackbits(np.frombuffer(reply[4 : 4 + size], np.uint8), count=int(count[r].sum())).astype(bool)
            place = np.arange(len(flags)) + np.repeat(first[r] - np.cumsum(count[r]) + count[r], count[r])
            repeated.append(place[flags & np.repeat((status[own[a:b]] & SORTED) > 0, count[r])])
        unique, back = np.unique(strings, return_inverse=True)
        where = ranges_of(unique, ranges)
        cuts = cuts_of(where)
        twice = np.zeros(len(unique), bool)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            reply = replies[int(where[a])]
            size = int.from_bytes(reply[:4], "little")
            twice[a:b] = np.unpackbits(np.frombuffer(reply[4 + size :], np.uint8), count=b - a).astype(bool)
        repeated.append(at[twice[back]] if len(at) else at)
        for place in repeated:
            np.add.at(mark, place, 1)
            np.add.at(mark, place + length, -1)
        gone = np.cumsum(mark)[:-1] > 0
        edge = np.zeros(total + 1, bool)
        edge[offsets] = True
        begins = gone.copy()
        begins[1:] &= ~gone[:-1] | edge[1:-1]
        removed, spans = per_text(gone, offsets), per_text(begins, offsets)
        pieces = lambda lost: [data[a:b][~lost[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        cells = [*[table.column(f.name) for f in fields], pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans)]
        cells.append(pa.array([hashlib.sha256(k).hexdigest() for k in pieces(gone)], pa.string()))
        if texts:
            character = np.cumsum((data & 0xC0) != 0x80)
            torn = np.bincount(character, gone, int(character[-1]) + 1 if total else 0) > 0
            cells.append(pa.array([k.decode("utf-8", "ignore") for k in pieces(torn[character])], pa.string()))
        return pa.Table.from_arrays(cells, [*[f.name for f in fields], *new])

    hashes = blocked.groupBy("block").applyInArrow(send_hashes, "block long, range long, keys binary, segments binary, counts binary")
    status = hashes.groupBy("range").applyInArrow(answer_hashes, "block long, range long, answer binary").withColumn("kind", F.lit(0))
    sent = blocked.groupBy("block").cogroup(status.groupBy("block")).applyInArrow(
        send_bytes, "block long, range long, keys binary, status binary, counts binary, leads binary, bodies binary, strings binary, times binary"
    )
    flags = sent.groupBy("range").applyInArrow(answer_bytes, "block long, range long, answer binary, kind int")
    done = blocked.groupBy("block").cogroup(status.unionByName(flags).groupBy("block")).applyInArrow(finish, result)
    return done.toDF(*others, *new)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with its columns, repeated strings cut out of text; characters of which a part
    is gone go too. n_chars follows where it exists; null texts stay null; other columns keep
    their values whatever their names."""

    def work(plain: DataFrame) -> DataFrame:
        out = remove_repeats(plain, length, texts=True).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
        return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out

    return under_neutral_names(docs, work)
