"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames of whole records, closed by a skippable frame that
holds the seek table (compressed and raw size of every frame). Any reader of the format can seek in
it; the record index adds, for every record, its bundle, frame and offset within the raw frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .store import file_size, read_range, write_file

#: Fixed values of the seekable format: skippable-frame number, footer number, footer size.
SKIPPABLE, FOOTER, FOOTER_SIZE = 0x184D2A5E, 0x8F92EAB1, 9
#: Raw bytes that close a frame, compressed bytes that close a bundle, and full frames a reading task gets.
FRAME, BUNDLE, FRAMES = 1 << 20, 64 << 20, 8
#: Payloads below so many bytes are never revisits; copies of a hot payload spread over SALTS tasks.
LEAST, SALTS = 1000, 64


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for ``(compressed, raw)`` sizes; no checksums."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(uri: str) -> list[tuple[int, int, int]]:
    """``(offset, compressed, raw)`` of every frame, from the footer of a bundle."""
    size = file_size(uri)
    count, flags, number = struct.unpack("<IBI", read_range(uri, size - FOOTER_SIZE, FOOTER_SIZE))
    if number != FOOTER:
        raise ValueError(f"no seek table at the end of {uri}")
    entry = 12 if flags & 0x80 else 8
    table = read_range(uri, size - FOOTER_SIZE - count * entry, count * entry)
    out, at = [], 0
    for i in range(count):
        packed, raw = struct.unpack_from("<II", table, i * entry)
        out.append((at, packed, raw))
        at += packed
    return out


def record(record_id: str, kind: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit names its original and carries no payload."""
    block = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {datetime(2024, 1, 1, tzinfo=timezone.utc):%Y-%m-%dT%H:%M:%SZ}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(url.splitlines()))
    lines += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at an offset of a raw frame."""
    head = raw.index(b"\r\n\r\n", at)
    lines = raw[at:head].decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    start, size = head + 4, int(fields["Content-Length"])
    return fields, raw[start : start + size], start + size + 4


def _deduplicated(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Pages with digest, record type and the page that a revisit refers to.

    Equal payloads meet in a salted join of digests, so that copies of one payload are shared out.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_digest": F.sha1(F.encode("html", "UTF-8")), "payload_bytes": F.octet_length("html").cast("long"), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS))})
    large = rows.filter(F.col("payload_bytes") >= LEAST).groupBy(F.col("payload_digest").alias("d")).agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1")
    large = scratch.table(large, "originals").select("d", "original", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("s"))
    joined = rows.join(large, (F.col("payload_digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "html", "payload_digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("original")).alias("refers_to"))


def write_bundles(rows: DataFrame, uri: str) -> DataFrame:
    """Write the records of ``rows`` and give their index: ``page_id, bundle, frame, offset, size``.

    Call it under an action that runs once, such as a table write: a repeated task writes bundles
    of another name, and only those of the attempt whose index rows were kept are ever read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        task = TaskContext.get()
        number, done, frames, raw, index, pending = 0, [], [], bytearray(), [], []

        def name() -> str:
            return f"{uri}/bundle-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"

        def close_frame() -> None:
            packed = packer.compress(bytes(raw))
            done.append(packed)
            frames.append((len(packed), len(raw)))
            index.extend((page, name(), len(frames) - 1, at, size) for page, at, size in pending)
            raw.clear()
            pending.clear()

        def close_bundle() -> pa.RecordBatch:
            write_file(name(), [*done, seek_table(frames)])
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "bundle", "frame", "offset", "size"])
            for x in (done, frames, index):
                x.clear()
            return out

        for batch in batches:
            for at in range(len(batch)):
                page, url, html, digest, kind, original = (c[at].as_py() for c in batch.columns)
                one = record("" if page is None else str(page), kind, url or "", html.encode(), digest, None if original is None else str(original))
                pending.append((page, len(raw), len(one)))
                raw += one
                if len(raw) >= FRAME:
                    close_frame()
                    if sum(p for p, _ in frames) >= BUNDLE:
                        yield close_bundle()
                        number += 1
        if raw:
            close_frame()
        if frames:
            yield close_bundle()

    return rows.select("page_id", "url", "html", "payload_digest", "kind", "refers_to").mapInArrow(run, "page_id long, bundle string, frame int, offset long, size long")


def read_bundles(spark: SparkSession, bundles: DataFrame) -> DataFrame:
    """Records of the ``bundles(bundle)``: header fields, and the digest of responses' payloads.

    Tasks share the frames of the seek tables, as many as the frames' raw bytes ask for, so one large
    bundle is read by many tasks.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                table = read_seek_table(uri)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(table), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*table, strict=True))], ["bundle", "start", "packed", "raw"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                raw = opener.decompress(read_range(r["bundle"], r["start"], r["packed"]), max_output_size=r["raw"])
                at, out = 0, []
                while at < len(raw):
                    f, block, end = parse_record(raw, at)
                    page, refers = (f.get(k, "<urn:page:>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    whole = f["WARC-Type"] == "response"
                    digest = hashlib.sha1(block).hexdigest() if whole else f["WARC-Payload-Digest"][5:]
                    out.append((int(page) if page else None, len(block) if whole else int(f["WARC-Payload-Length"]), digest, f["WARC-Type"], int(refers) if refers else None, f.get("WARC-Target-URI"), block.decode() if whole else None))
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"])

    listed = bundles.select("bundle").distinct().mapInArrow(frames, "bundle string, start long, packed long, raw long")
    listed = Scratch(spark, "warc-frames").table(listed, "frames")
    tasks = max(1, -(-(listed.agg(F.sum("raw")).first()[0] or 0) // (FRAMES * FRAME)))
    return listed.repartition(int(tasks), "bundle", "start").mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def read_record(index_row: dict) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record through its index row: one frame is read and unpacked."""
    import zstandard

    start, packed, raw = read_seek_table(index_row["bundle"])[index_row["frame"]]
    frame = zstandard.ZstdDecompressor().decompress(read_range(index_row["bundle"], start, packed), max_output_size=raw)
    return parse_record(frame, index_row["offset"])[:2]


def archive_pages(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write ``pages(page_id, url, html)`` as bundles; the records read back and the record index.

    Null html is an empty payload; a null url has no target line; null page_ids have an empty
    record id and are never the original that revisits name. Pages that repeat a page_id and the
    payload are all the same kind. Extra columns are ignored.
    """
    scratch = Scratch(spark, "warc")
    index = scratch.table(write_bundles(_deduplicated(pages, scratch), scratch.path("bundles")), "index")
    return read_bundles(spark, index), index
