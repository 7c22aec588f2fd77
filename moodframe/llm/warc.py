"""WARC archives: writing pages with segments, revisits and chunked bodies, and reading them.

An archive is a row of gzip members, one record each. Payloads above ``SEGMENT`` bytes are cut
into continuation records. The reader groups continuations by their origin, orders them by
segment number, verifies the total length, decodes the chunked transfer framing and compares
the payload with its digest."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.shared_files import FileWriter, file_system
from moodframe.session import new_folder, stage

SEGMENT = 32 << 10
CHUNK = 8 << 10
ARCHIVE_BYTES = 64 << 20
MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        own = payload[at : at + size]
        parts += [b"%x\r\n" % len(own), own, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload inside chunked framing; extensions and trailers are read over."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        own = body[end + 2 : end + 2 + size]
        if len(own) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(own)
        at = end + 4 + size


def record(fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(body)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def page_records(page_id, url: str, payload: bytes, digest: str, refers_to, number: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response with continuations."""
    own = f"<urn:page:{page_id}:{number}>"
    named = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-ID", str(page_id)), ("Content-Type", "application/http;msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to)), *named], http)]
    body = http + chunked(payload)
    if len(body) <= segment:
        return [record([("WARC-Type", "response"), *named], body)]
    out = [record([("WARC-Type", "response"), *named, ("WARC-Segment-Number", "1")], body[:segment])]
    starts = range(segment, len(body), segment)
    for k, at in enumerate(starts, 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k))]
        if at == starts[-1]:
            fields.append(("WARC-Segment-Total-Length", str(len(body))))
        out.append(record(fields, body[at : at + segment]))
    return out


def revisits(hashed: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload of at least ``least`` bytes equals
    that of a page with a smaller id. Minima by digest, combined before the shuffle; the join
    back on a hot digest can be split."""
    long = hashed.where(F.col("bytes") >= least)
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return long.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = MIN_REVISIT, segment: int = SEGMENT) -> DataFrame:
    """Writes a record for each page below ``folder``; returns (path, size) of the archives.

    Null html is an empty payload, a null url an empty field. A page with a null id is always
    a response. Rows that repeat an id and its payload are all written alike."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    plain = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(body, "UTF-8").alias("payload"))
    hashed = plain.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    rows = hashed.join(revisits(hashed.select("page_id", "digest", "bytes"), least), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(parts):
        from pyspark import TaskContext

        part, writer, archives, count = TaskContext.get().partitionId(), None, [], 0
        for batch in parts:
            for i in range(batch.num_rows):
                page_id, url, digest, refers_to = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                if writer is not None and writer.size > ARCHIVE_BYTES:
                    writer.close()
                    writer = None
                if writer is None:
                    writer = FileWriter(folder, f"pages-{part:06d}-{len(archives):04d}.warc.gz")
                    archives.append(writer)
                count += 1
                url = url.replace("\r", "%0D").replace("\n", "%0A")
                for own in page_records(page_id, url, batch.column(2)[i].as_py(), digest, refers_to, f"{part}:{count}", segment):
                    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                    writer.write(pack.compress(own) + pack.flush())
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([w.path for w in archives], pa.string()), pa.array([w.size for w in archives], pa.int64())], ["path", "size"])

    return rows.mapInArrow(run, "path string, size long")


def archive_records(stream):
    """(fields, body) of each record of an open gzip archive, read in pieces of a megabyte."""
    unpack, text = zlib.decompressobj(31), b""
    more = True
    while True:
        end = text.find(b"\r\n\r\n")
        if end >= 0:
            lines = text[:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            size = end + 4 + int(fields["content-length"])
            if len(text) >= size + 4:
                yield fields, text[end + 4 : size]
                text = text[size + 4 :]
                continue
        if not more:
            if text:
                raise ValueError("an archive is cut short")
            return
        packed = stream.read(1 << 18)
        more = bool(packed)
        parts = [text]
        while packed:
            parts.append(unpack.decompress(packed))
            packed = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
        text = b"".join(parts)


def payload_of(body: bytes) -> bytes:
    head, _, rest = body.partition(b"\r\n\r\n")
    return unchunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page in the
    archives (path). A revisit's bytes are those of the response it refers to. Raises on a
    payload that differs from its digest, a missing segment or a wrong total length."""

    def run(parts):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "origin", "segment", "total", "body"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in parts:
            for path in batch.column(0).to_pylist():
                system, inner = file_system(path)
                rows, held = [], 0
                with system.open_input_stream(inner, compression=None) as stream:
                    for fields, body in archive_records(stream):
                        kind, segment = fields["warc-type"], int(fields.get("warc-segment-number", 0))
                        page = fields.get("warc-page-id", "None")
                        page = None if page == "None" else int(page)
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        if segment:
                            origin = fields.get("warc-segment-origin-id", fields.get("warc-record-id"))
                            total = int(fields.get("warc-segment-total-length", 0)) or None
                            rows.append((page, None, digest, kind, None, origin, segment, total, body))
                            held += len(body)
                        elif kind == "revisit":
                            rows.append((page, None, digest, kind, int(fields["warc-refers-to-page-id"]), None, None, None, None))
                        else:
                            payload = payload_of(body)
                            rows.append((page, len(payload), checked(payload, digest), kind, None, None, None, None, None))
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    found = stage(archives.select("path").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, f"{PAGE}, origin string, segment long, total long, body binary"), "records")

    def join_segments(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        body = b"".join(r["body"] for r in rows)
        if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] != len(body):
            raise ValueError(f"segments of {rows[0]['origin']} are missing")
        payload = payload_of(body)
        own = [rows[0]["page_id"], len(payload), checked(payload, rows[0]["payload_digest"]), rows[0]["record_type"], None]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(own, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    pages = [c.split()[0] for c in PAGE.split(", ")]
    joined = found.where("origin is not null").groupBy("origin").applyInArrow(join_segments, PAGE)
    whole = stage(found.where("origin is null and record_type = 'response'").select(pages).union(joined), "responses")
    again = found.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    sizes = whole.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("payload_bytes")).distinct()
    return whole.union(again.join(sizes, ["refers_to", "payload_digest"], "left").select(pages))


def checked(payload: bytes, digest: str | None) -> str:
    own = hashlib.sha256(payload).hexdigest()
    if digest and own != digest:
        raise ValueError("a payload differs from its digest")
    return own


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages (page_id, url, html) to archives in the shared folder and reads them."""
    return read_archives(stage(write_archives(pages, new_folder(pages.sparkSession, "warc")), "archives"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
