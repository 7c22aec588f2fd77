"""Merkle manifest of a dataset: a tree of SHA midstates.

Leaves are digests of rows, ordered inside a tree by given keys; runs of ``arity`` consecutive
nodes become their hash until one is left, and the tops of all trees form a last tree. A parent
keeps a copy of its hash state before each child slot. To fold a changed node upwards, the state
of its slot is resumed and takes the new digest and the siblings to the right; what stands to
the left is in the state already.

Trees are built in blocks of ``arity ** levels`` leaves. A block is one row of a table: its
digests, level by level, and its states. A block's top is a leaf of a block of the next tier, so
the tiers are few and no task holds more than a block. Paths are handed down tier by tier, each
by a join on (tree, block)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodframe.llm.sha_states import compress, finish, fresh, hex_block
from moodframe.session import stage

BLOCK = 4096


@dataclass
class Manifest:
    """leaves: (tree, pos, n, digest and the carried columns); tiers: blocks of the trees, from
    the leaves up; tops: the same two of the tree over all trees; root: hex, None without rows."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top_leaves: DataFrame
    top_tiers: list[DataFrame]
    root: str | None
    arity: int


def value_text(*columns: Column) -> Column:
    """Each value as its number of UTF-8 bytes, a colon and itself, `-` if null; concatenated."""
    as_text = [c.cast("string") for c in columns]
    return F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in as_text])


def digest(*columns: Column) -> Column:
    """Raw SHA-256 of the values."""
    return F.unhex(F.sha2(F.encode(value_text(*columns), "UTF-8"), 256))


def heights(n: int, arity: int) -> int:
    """Levels above the leaves of a tree of n."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def block_levels(arity: int) -> int:
    levels = 1
    while arity ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """(pos, n) added to rows with a column ``tree``: the place in the tree by ``order`` and the
    tree's size. One shuffle into key ranges; tasks number their own rows, and one row of counts
    for each range and tree gives the rest. Equal rows may share a range border: their order does
    not matter to any result, so a running number parts them."""
    mixed = rows.withColumn("tie", F.monotonically_increasing_id())
    ranges = mixed.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    names = rows.columns

    def number(parts):
        from pyspark import TaskContext

        own, last, n = TaskContext.get().partitionId(), None, 0
        for batch in parts:
            trees = batch.column(names.index("tree"))
            new = np.ones(len(trees), bool)
            if len(trees) > 1:
                new[1:] = pc.not_equal(trees[1:], trees[:-1]).to_numpy(zero_copy_only=False)
            if len(trees) and trees[0].as_py() == last:
                new[0] = False
            starts = np.where(new, np.arange(len(trees)), -1)
            at = np.maximum.accumulate(starts)
            place = np.where(at < 0, np.arange(len(trees)) + n, np.arange(len(trees)) - at)
            if len(trees):
                last, n = trees[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(len(trees), own))], [*names, "place", "part"])

    schema = StructType([*ranges.schema.fields, *StructType.fromDDL("place long, part long").fields])
    numbered = stage(ranges.mapInArrow(number, schema), "leaves")
    counts = numbered.groupBy("part", "tree").agg(F.count("*").alias("own"))
    order_ = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "tree", F.coalesce(F.sum("own").over(order_), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy("tree")).alias("n"))
    return numbered.join(before, ["part", "tree"]).select(*names, (F.col("before") + F.col("place")).alias("pos"), "n")


def build_block(leaves: np.ndarray, levels: int, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """(digests of all levels, states before the slots 1, 2, ... of all parents, as rows of 32
    bytes). The last run of a level may be shorter, even one."""
    digests, states, level = [leaves], [], leaves
    for _ in range(levels):
        n, parents = len(level), -(-len(level) // arity)
        state, blocks = fresh(parents), hex_block(level)
        for slot in range(arity):
            if slot:
                states.append(state.T.copy().view(np.uint8))
            own = blocks[:, slot::arity]
            state[:, : own.shape[1]] = compress(state[:, : own.shape[1]], own)
        last = n - arity * (parents - 1)
        level = finish(state, arity)
        if last < arity:
            level[-1:] = finish(state[:, -1:], last)
        digests.append(level)
    return np.concatenate(digests), np.concatenate(states) if states else np.zeros((0, 32), np.uint8)


@dataclass
class Block:
    """A block read back: steps of its nodes on the way up."""

    size: int
    levels: int
    arity: int
    digests: np.ndarray
    states: np.ndarray

    @classmethod
    def of(cls, size: int, levels: int, arity: int, digests: bytes, states: bytes) -> Block:
        return cls(size, levels, arity, *(np.frombuffer(v, np.uint8).reshape(-1, 32) for v in (digests, states)))

    def shape(self):
        """(first digest, nodes, first state, parents) of each level."""
        at, kept, n = 0, 0, self.size
        for _ in range(self.levels):
            parents = -(-n // self.arity)
            yield at, n, kept, parents
            at, kept, n = at + n, kept + parents * (self.arity - 1), parents

    def fold(self, own: np.ndarray, changed: np.ndarray) -> np.ndarray:
        """Tops of the block if, each by itself, leaf own[i] were changed[i]."""
        for at, n, kept, parents in self.shape():
            parent, slot = own // self.arity, own % self.arity
            have = np.minimum(self.arity, n - parent * self.arity)
            state = fresh(len(own))
            later = np.flatnonzero(slot > 0)
            resumed = self.states[kept + (slot[later] - 1) * parents + parent[later]]
            state[:, later] = resumed.view(np.uint32).T
            state = compress(state, hex_block(changed))
            for right in range(1, self.arity):
                some = np.flatnonzero((slot < right) & (right < have))
                if len(some):
                    state[:, some] = compress(state[:, some], hex_block(self.digests[at + parent[some] * self.arity + right]))
            changed = np.empty((len(own), 32), np.uint8)
            for count in np.unique(have).tolist():
                some = np.flatnonzero(have == count)
                changed[some] = finish(state[:, some], count)
            own = parent
        return changed

    def steps(self, own: int) -> bytes:
        """Fixed-width steps of a leaf to the top: slot, children, state of the slot, siblings."""
        out = []
        for at, n, kept, parents in self.shape():
            parent, slot = divmod(own, self.arity)
            have = min(self.arity, n - parent * self.arity)
            state = self.states[kept + (slot - 1) * parents + parent].tobytes() if slot else fresh(1).astype(np.uint32).tobytes()
            near = [self.digests[at + parent * self.arity + k].tobytes() for k in range(have) if k != slot]
            out.append(slot.to_bytes(4, "little") + have.to_bytes(4, "little") + state + b"".join(near).ljust(32 * (self.arity - 1), b"\0"))
            own = parent
        return b"".join(out)

    def siblings(self, own: int) -> bytes:
        """The other members of the runs on the way up, level by level, left to right."""
        out = []
        for at, n, _, _ in self.shape():
            first = own // self.arity * self.arity
            out += [self.digests[at + k].tobytes() for k in range(first, min(first + self.arity, n)) if k != own]
            own //= self.arity
        return b"".join(out)


def read_steps(path: bytes, arity: int):
    """(slot, children, state (8, 1), siblings (children - 1, 32)) of each step."""
    width = 40 + 32 * (arity - 1)
    for at in range(0, len(path), width):
        slot, have = (int.from_bytes(path[at + k : at + k + 4], "little") for k in (0, 4))
        state = np.frombuffer(path[at + 8 : at + 40], np.uint32).reshape(8, 1)
        yield slot, have, state, np.frombuffer(path[at + 40 : at + 40 + 32 * (have - 1)], np.uint8).reshape(-1, 32)


def fold_steps(path: bytes, arity: int, changed: np.ndarray) -> np.ndarray:
    """Nodes at the end of a common path if its start were each of ``changed`` (k, 32)."""
    for slot, have, state, near in read_steps(path, arity):
        state = compress(np.repeat(state, len(changed), 1), hex_block(changed))
        for right in near[slot:]:
            state = compress(state, hex_block(right[None, :]))
        changed = finish(state, have)
    return changed


def block_builder(arity: int, tier: int):
    """The leaves of one block to its row."""
    most = block_levels(arity)

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy())
        digests = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 32)[order]
        n = table.column("n")[0].as_py()
        levels = min(most, heights(n, arity) - tier * most)
        found, states = build_block(digests, levels, arity)
        cells = [table.column("tree")[0].as_py(), n, table.column("block")[0].as_py(), len(digests), levels, found.tobytes(), states.tobytes(), found[-1].tobytes()]
        kinds = [pa.string(), *[pa.int64()] * 4, *[pa.binary()] * 3]
        return pa.Table.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["tree", "n", "block", "size", "levels", "digests", "states", "top"])

    return build


def fold_tiers(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """Blocks of all trees, tier by tier: (tree, n, block, size, levels, digests, states, top).

    ``leaves`` has tree, pos, n and digest. A tree takes part in as many tiers as it needs, in
    the first at least; each tier is one shuffle by (tree, block) and written."""
    most, each = block_levels(arity), arity ** block_levels(arity)
    largest = leaves.agg(F.max("n")).first()[0]
    tiers, left = [], leaves.select("tree", "pos", "n", "digest")
    for tier in range(max(1, -(-heights(largest or 0, arity) // most))):
        blocked = left.withColumn("block", F.floor(F.col("pos") / each)).groupBy("tree", "block")
        blocks = blocked.applyInArrow(block_builder(arity, tier), "tree string, n long, block long, size long, levels long, digests binary, states binary, top binary")
        tiers.append(stage(blocks, "tier"))
        left = tiers[-1].where(F.col("n") > each ** (tier + 1)).select("tree", F.col("block").alias("pos"), "n", F.col("top").alias("digest"))
    return tiers


def tree_tops(tiers: list[DataFrame], arity: int) -> DataFrame:
    """(tree, tier, digest): the last node of each tree and the tier it lies in."""
    each = arity ** block_levels(arity)
    ends = [t.where(F.col("n") <= each ** (i + 1)).select("tree", F.lit(i).alias("tier"), F.col("top").alias("digest"), "n") for i, t in enumerate(tiers)]
    ends = [e if i == 0 else e.where(F.col("n") > each**i) for i, e in enumerate(ends)]
    return reduce(DataFrame.unionByName, ends).drop("n")


def build_manifest(leaves: DataFrame, order: list[str], arity: int = 2) -> Manifest:
    """The tree over rows with columns tree (string), digest (32 bytes) and those of ``order``.

    Trees follow each other by UTF-8 bytes of their names. Repeated rows are leaves each; rows
    equal in tree and order go by digest. An empty table has no root."""
    ranked = stage(placed(leaves, [*order, "digest"]), "placed")
    tiers = fold_tiers(ranked, arity)
    tops = stage(placed(tree_tops(tiers, arity).withColumnRenamed("tree", "name").withColumn("tree", F.lit("")), ["name"]), "tops")
    top_tiers = fold_tiers(tops, arity)
    root = top_tiers[-1].select(F.lower(F.hex("top"))).first()
    return Manifest(ranked, tiers, tops, top_tiers, root[0] if root else None, arity)


def handed_down(blocks: DataFrame, arity: int) -> DataFrame:
    """(tree, block, path, near, top_of): for each leaf of blocks that know their own way up, the
    way from it; ``top_of`` is carried along. Blocks are (tree, block, size, levels, digests,
    states, path, near, top_of)."""
    each = arity ** block_levels(arity)

    def run(parts):
        for batch in parts:
            rows = batch.to_pylist()
            for row in rows:
                own = Block.of(row["size"], row["levels"], arity, row["digests"], row["states"])
                for first in range(0, own.size, 256):
                    places = range(first, min(first + 256, own.size))
                    columns = [
                        pa.array([row["tree"]] * len(places), pa.string()), pa.array([row["block"] * each + i for i in places], pa.int64()),
                        pa.array([own.steps(i) + row["path"] for i in places], pa.binary()), pa.array([own.siblings(i) + row["near"] for i in places], pa.binary()), pa.array([row["top_of"]] * len(places), pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "block", "path", "near", "top_of"])

    return blocks.select("tree", "block", "size", "levels", "digests", "states", "path", "near", "top_of").mapInArrow(run, "tree string, block long, path binary, near binary, top_of binary")


def block_paths(tiers: list[DataFrame], ways: DataFrame, arity: int) -> DataFrame:
    """The blocks of the first tier with the ways of their tops to the root. ``ways`` has one row
    for each tree: (tree, tier, path, near, top_of) of its last node."""
    below = None
    for tier in reversed(range(len(tiers))):
        own = ways.where(F.col("tier") == tier).select("tree", F.lit(0).cast("long").alias("block"), "path", "near", "top_of")
        known = own if below is None else own.unionByName(below)
        blocks = tiers[tier].join(known, ["tree", "block"])
        if tier == 0:
            return blocks
        below = stage(handed_down(blocks, arity), "ways")
    raise ValueError("no tiers")


def proofs(manifest: Manifest, changed: str | None = None) -> DataFrame:
    """All columns of the leaves, then subroot (32 bytes), siblings (the other members of the
    runs on the way to the root, 32 bytes each, level by level and left to right), and folded:
    the root that comes out if the leaf were the digest in column ``changed``, or itself where
    that is null. Changes are judged one by one, with all siblings as they are."""
    arity = manifest.arity
    each = arity ** block_levels(arity)
    single = manifest.top_tiers[-1].withColumns({"path": F.lit(b""), "near": F.lit(b""), "top_of": F.lit(b""), "tier": F.lit(len(manifest.top_tiers) - 1)})
    tops = block_paths(manifest.top_tiers, single.select("tree", "tier", "path", "near", "top_of"), arity)
    ways = handed_down(tops, arity).select(F.col("block").alias("pos"), "path", "near")
    named = manifest.top_leaves.join(ways, "pos").select(F.col("name").alias("tree"), "tier", "path", "near", F.col("digest").alias("top_of"))
    blocks = block_paths(manifest.tiers, stage(named, "ways"), arity).select("tree", "block", "size", "levels", "digests", "states", "path", "near", "top_of")
    leaves = manifest.leaves.withColumn("block", F.floor(F.col("pos") / each))
    leaves = leaves.withColumn("changed_to", F.lit(None).cast("binary") if changed is None else F.col(changed))
    names = [c for c in leaves.columns if c not in ("block", "changed_to")]
    schema = StructType([*leaves.select(*names).schema.fields, *StructType.fromDDL("subroot binary, siblings binary, folded binary").fields])

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        own = Block.of(row["size"], row["levels"], arity, row["digests"], row["states"])
        at = left.column("pos").to_numpy() % each
        new = left.column("changed_to").to_pylist()
        values = own.digests[at].copy()
        for i in np.flatnonzero([v is not None for v in new]).tolist():
            values[i] = np.frombuffer(new[i], np.uint8)
        # every leaf goes its own way, changed or not: no stored top stands in for a fold
        folded = [v.tobytes() for v in fold_steps(row["path"], arity, own.fold(at, values))]
        near = [own.siblings(i) + row["near"] for i in at.tolist()]
        columns = [left.column(c) for c in names] + [pa.array([row["top_of"]] * len(at), pa.binary()), pa.array(near, pa.binary()), pa.array(folded, pa.binary())]
        return pa.Table.from_arrays(columns, [*names, "subroot", "siblings", "folded"])

    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(prove, schema)


def tree_name(column: Column) -> Column:
    """Names of trees in the order of the values, null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(docs: DataFrame, arity: int = 2) -> Manifest:
    """Trees by lang over leaves by doc_id (null first) of documents. Column ``tampered`` is the
    leaf with 1 added to n_chars where 7 divides crc32 of the doc_id and both are known.

    Nulls are values of their own, empty texts have length 0, repeated rows are leaves each, and
    other columns are not read. Texts never leave the scan's tasks."""
    values = {c: F.col(c) for c in FIELDS}
    more = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        tree_name(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(*values.values()).alias("digest"),
        F.when(hit, digest(*more.values())).alias("tampered"),
    )
    # written before the sort, whose sampling would read and hash all texts once more
    return build_manifest(stage(leaves, "digests"), ["doc_id"], arity)


def document_proofs(docs: DataFrame, arity: int = 2) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row
    of ``docs``: the proofs of the untampered manifest, and the root recomputed from the tampered
    leaf (from the leaf itself where nothing is tampered with)."""
    manifest = document_manifest(docs, arity)
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(manifest.root)
    return proofs(manifest, "tampered").select(
        "doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"), F.sha2(F.encode(text("siblings"), "UTF-8"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"), (text("folded") == root).alias("verified"),
    )


def _value_sql(*columns: str) -> str:
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in columns)


def _steps_sql(leaves: str, nodes: str, place: str, tree: str, first: int) -> str:
    """A row for each level that a leaf climbs: where its sibling stands, and the sibling."""
    return f"""SELECT l.tree, l.pos, {first} + o.lvl AS step, CASE WHEN o.i % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS s
      FROM {leaves} l JOIN {nodes} o ON o.n > 1 AND o.i = {place} >> o.lvl {tree} LEFT JOIN {nodes} s ON s.lvl = o.lvl AND s.i = xor(o.i, 1) AND s.tree = o.tree"""


_UP = "SELECT tree, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {0} WHERE n > 1 GROUP BY tree, lvl, i // 2, n"
SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_value_sql(*FIELDS)}) AS leaf,
    sha256({_value_sql(*(f'({c}::HUGEINT + 1)' if c == 'n_chars' else c for c in FIELDS))}) AS other,
    xor(4294967295, list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, d: xor(x >> 1, 3988292384 * (x & 1))))) % 7 = 0 AND n_chars IS NOT NULL AS hit FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
nodes(tree, lvl, i, h, n) AS (SELECT tree, 0::BIGINT, pos, leaf, n FROM leaves UNION ALL {_UP.format('nodes')}),
tops AS (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
top_nodes(tree, lvl, i, h, n) AS (SELECT '', 0::BIGINT, place, subroot, n FROM tops UNION ALL {_UP.format('top_nodes')}),
named AS (SELECT * FROM leaves JOIN tops ON name = tree),
steps AS ({_steps_sql('leaves', 'nodes', 'l.pos', 'AND o.tree = l.tree', 0)} UNION ALL {_steps_sql('named', 'top_nodes', 'l.place', '', 1000)}),
paths AS (SELECT tree, pos, list(s ORDER BY step) AS path FROM steps GROUP BY ALL),
done AS (SELECT doc_id, leaf, subroot, (SELECT h FROM top_nodes WHERE n = 1) AS root, coalesce(path, []) AS path, CASE WHEN hit THEN other ELSE leaf END AS start
  FROM named LEFT JOIN paths USING (tree, pos))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
  list_reduce([start] || path, lambda h, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || h ELSE h || s[2:] END)) AS folded_root,
  list_reduce([start] || path, lambda h, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || h ELSE h || s[2:] END)) = root AS verified
FROM done
"""
