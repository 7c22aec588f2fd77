"""Token-id files: length-limited canonical Huffman codes in independent blocks.

A block file holds blocks one after the other. A block: ``HEAD`` (magic, documents, tokens,
checkpoints, payload bytes), the documents' ids (64-bit) and token counts (64-bit), the bit
offset of every ``STEP``-th token (64-bit), and the codes, high bits first. The codebook file
holds one byte for each id, the length of its code; canonical codes follow from lengths.

Codes are limited to ``LIMIT`` bits by package-merge over the global counts, so one table
lookup decodes one token. A decoder walks all checkpoints of a block at once."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodframe.llm.shared_files import FileWriter, read_bytes
from moodframe.llm.token_ids import encoded_batches, worker_encoder
from moodframe.session import new_folder, stage

LIMIT, STEP = 18, 128
BLOCK_TOKENS = 1 << 19
FILE_BYTES = 256 << 20
HEAD = "<4sqqqq"
MAGIC = b"HTB1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits for each id (0: does not occur), at most ``limit``, with the least total."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        level = both[place]
        kinds.append(place < len(leaves))
    take = 2 * len(leaves) - 2
    for kind in reversed(kinds):
        own = int(kind[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: shorter codes first, equal lengths by id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(id, bits) for each of the 2 ** limit next bits."""
    ids, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    codes = canonical_codes(lengths)
    for i in np.flatnonzero(lengths):
        at = int(codes[i]) << (limit - int(lengths[i]))
        ids[at : at + (1 << (limit - int(lengths[i])))] = i
        bits[at : at + (1 << (limit - int(lengths[i])))] = lengths[i]
    return ids, bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bit offsets of every STEP-th id, payload)."""
    if not len(ids):
        return np.zeros(0, np.int64), b""
    size = lengths[ids].astype(np.int64)
    if not size.all():
        raise ValueError("an id without a code")
    ends = np.cumsum(size)
    at = ends - size
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    value = codes[ids] << (64 - size).astype(np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros(int(ends[-1] + 63 >> 6) + 1, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(value >> shift, first)
    over = np.flatnonzero(ends > (word + 1) << 6)
    out[word[over] + 1] |= value[over] << (np.uint64(64) - shift[over])
    return at[::STEP], out.astype(">u8").tobytes()[: int(ends[-1] + 7) >> 3]


def decode_block(payload: bytes, n: int, checkpoints: np.ndarray, ids: np.ndarray, bits: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The n ids of a block: all stretches between checkpoints are walked side by side."""
    body = payload + bytes(8 + STEP * limit // 8)
    windows = np.ndarray((len(body) - 3,), ">u4", body, strides=(1,))
    place = checkpoints.astype(np.int64).copy()
    out = np.empty((STEP, len(place)), np.uint32)
    last = len(body) * 8 - 40
    for k in range(STEP):
        seen = windows[place >> 3].astype(np.uint32)
        seen = (seen << (place & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[k] = ids[seen]
        place += bits[seen]
        np.minimum(place, last, out=place)
    return out.T.ravel()[:n]


def pack_block(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    checkpoints, payload = encode_block(ids, codes, lengths)
    head = struct.pack(HEAD, MAGIC, len(doc_ids), len(ids), len(checkpoints), len(payload))
    return head + doc_ids.astype("<i8").tobytes() + sizes.astype("<i8").tobytes() + checkpoints.astype("<i8").tobytes() + payload


def unpack_block(data: bytes, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, token ids) of one block."""
    magic, docs, tokens, checkpoints, size = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    parts = np.frombuffer(data, "<i8", 2 * docs + checkpoints, struct.calcsize(HEAD))
    at = struct.calcsize(HEAD) + 8 * len(parts)
    return parts[:docs], parts[docs : 2 * docs], decode_block(data[at : at + size], tokens, parts[2 * docs :], *table)


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, width: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(part, block, doc_ids, sizes, ids): whole documents in ascending doc_id order (then by
    text; null ids first, as -1), in blocks of about ``block_tokens``. Texts are
    range-partitioned by id; the ranges are found from the ids alone."""
    spark = docs.sparkSession
    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(parts):
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        encoder = worker_encoder(tokenizer, False, width)
        own_ids, own_sizes, bodies, total = [], [], [], 0

        def full():
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([block]), pa.array([np.array(own_ids, "<i8").tobytes()]), pa.array([np.array(own_sizes, "<i8").tobytes()]), pa.array([b"".join(bodies)]), pa.array([total])],
                ["part", "block", "doc_ids", "sizes", "ids", "n_tokens"],
            )

        for own, ids in encoded_batches(parts, 1, encoder, end_id):
            for doc, body in zip(own.column(0).to_pylist(), ids, strict=True):
                own_ids.append(doc)
                own_sizes.append(len(body) // width)
                bodies.append(body)
                total += len(body) // width
                if total >= block_tokens:
                    yield full()
                    block, own_ids, own_sizes, bodies, total = block + 1, [], [], [], 0
        if own_ids:
            yield full()

    return ordered.mapInArrow(run, "part long, block long, doc_ids binary, sizes binary, ids binary, n_tokens long")


def id_counts(blocks: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs; as long as the vocabulary, whatever the corpus."""

    def run(parts):
        total = np.zeros(0, np.int64)
        for batch in parts:
            for body in batch.column(0):
                own = np.bincount(np.frombuffer(body.as_buffer(), f"<u{width}"))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(int(max(rows.column("id").to_numpy(), default=0)) + 1, np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts


def write_token_files(blocks: DataFrame, folder: str, lengths: np.ndarray, width: int) -> DataFrame:
    """Writes the staged ``blocks`` as block files and the codebook below ``folder``; returns
    the written index (part, block, n_tokens, path, offset, size, start), start being the number
    of tokens in all blocks before."""
    book = FileWriter(folder, "codebook.bin")
    book.write(lengths.tobytes())
    book.close()

    def run(parts):
        codes = canonical_codes(lengths)
        writer, before, pending = None, None, []

        def finish():
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*pending, strict=True)], ["part", "block", "n_tokens", "path", "offset", "size"])

        for batch in parts:
            for i in range(batch.num_rows):
                part, block, docs, sizes, ids, n = (batch.column(k)[i] for k in range(6))
                key = (part.as_py(), block.as_py())
                # blocks of a file ascend; what arrives out of order opens a new file
                if writer is not None and (key < before or writer.size > FILE_BYTES):
                    yield finish()
                    writer, pending = None, []
                if writer is None:
                    writer = FileWriter(folder, f"tokens-{key[0]:06d}-{key[1]:06d}.bin")
                before = key
                data = pack_block(np.frombuffer(docs.as_buffer(), "<i8"), np.frombuffer(sizes.as_buffer(), "<i8"), np.frombuffer(ids.as_buffer(), f"<u{width}"), codes, lengths)
                pending.append((*key, n.as_py(), writer.path, writer.write(data), len(data)))
        if writer is not None:
            yield finish()

    index = stage(blocks.mapInArrow(run, "part long, block long, n_tokens long, path string, offset long, size long"), "index")
    # blocks are few beside documents: their totals by part, then inside each part
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("words"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return index.join(bases, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("base")


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the block files."""

    def run(parts):
        table = decode_table(np.frombuffer(read_bytes(f"{folder}/codebook.bin"), np.uint8))
        for batch in parts:
            for path, offset, size, start in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                docs, sizes, ids = unpack_block(read_bytes(path, offset, size), table)
                ends = np.cumsum(sizes)
                body = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = index.select("path", "offset", "size", "start").repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = 2) -> DataFrame:
    """Writes all documents' ids to token files and reads them back."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    token_blocks(docs, tokenizer, end_id, width).write.option("compression", "zstd").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = code_lengths(id_counts(blocks, width))
    index = stage(write_token_files(blocks, f"{path}/files", lengths, width), "index")
    return read_token_files(index, f"{path}/files")
