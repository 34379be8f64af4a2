"""WARC archives with individually compressed records and an embedded Zstandard dictionary.

A dictionary is built from a bounded sample of the records to be archived. Every archive starts with a skippable frame that
holds it, so that a file can be read alone; then comes one Zstandard frame for each record. Of records with equal payloads of
at least min_bytes, the one with the largest page_id is a response and the others are revisits of it.

Tasks write archives straight to a folder that driver and executors share, under names that no other attempt uses, and return
a manifest; only files in the manifest count, so a lost executor or a repeated task leaves at most unused files.

Null html: empty payload. Null url: empty. Repeated rows: equal payload and page_id, so one of them is the response by page_id
and rows with that page_id are all responses. Rows without a page_id revisit the response of their payload; if none of its rows has
one, all are responses. Empty table: no archives, no rows. Extra columns are ignored. A payload lies in
memory whole, once for each task.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, cumulative_hash_fraction, fresh_path, saved

#: Skippable frame of an embedded dictionary, and of its size. Fixed value.
DICTIONARY_MAGIC = 0x184D2A5D
#: The beginnings of at most so many records, of at most so many bytes each, are gathered to build a dictionary of at most DICTIONARY_BYTES.
SAMPLE_RECORDS, SAMPLE_RECORD_BYTES, DICTIONARY_BYTES = 500, 16_384, 112_640
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or plain content where there is too little to train on; empty without samples."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the digest and length of its payload, not the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages (page_id, url, html, digest, bytes) with refers_to: the page_id of the response to revisit, or null.

    Payloads that make up HEAVY_SHARE of the records or more are at most 1 / HEAVY_SHARE many; their rows stay where they are and
    look the response up in a broadcast. The others are joined by digest.
    """
    sized = pages.where(F.col("bytes") >= min_bytes)
    groups = saved(sized.groupBy(F.col("digest").alias("g")).agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1"), "warc-copies")
    limit = max(2.0, (pages.count()) * HEAVY_SHARE)
    heavy = F.broadcast(groups.where(F.col("n") >= limit).select("g", "kept"))
    light = groups.where(F.col("n") < limit).select("g", "kept")
    found = pages.join(heavy, F.col("digest") == F.col("g"), "left").drop("g").withColumnRenamed("kept", "kept_heavy")
    rest = found.where(F.col("kept_heavy").isNull()).join(light, F.col("digest") == F.col("g"), "left").drop("g", "kept_heavy")
    both = rest.unionByName(found.where(F.col("kept_heavy").isNotNull()).withColumnRenamed("kept_heavy", "kept"))
    own = F.col("kept").eqNullSafe(F.col("page_id")) | (F.col("bytes") < min_bytes)
    return both.withColumn("refers_to", F.when(~own, F.col("kept"))).drop("kept")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives all rows of pages (page_id, url, html) under folder; returns the manifest: path, records, bytes."""
    spark = pages.sparkSession
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    total = rows.count()
    drawn = rows.where(cumulative_hash_fraction(F.lit(5), "page_id", "url", "digest") * max(total, 1) < SAMPLE_RECORDS)
    drawn = drawn.select("page_id", F.left("url", F.lit(1000)).alias("url"), F.left("html", F.lit(SAMPLE_RECORD_BYTES // 4)).alias("html"), "digest")
    samples = [record(r.page_id, r.url, r.html.encode(), r.digest, None, date) for r in drawn.limit(SAMPLE_RECORDS).collect()]
    shared = spark.sparkContext.broadcast(build_dictionary(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        dictionary = _dictionary(shared.value)
        if dictionary is not None:
            dictionary.precompute_compress(level=3)
        packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True) if dictionary is not None else zstandard.ZstdCompressor(level=3, write_checksum=True)
        out, path, done, size, count = None, "", [], 0, 0
        for b in batches:
            for row in zip(*(b.column(k) for k in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out, size, count = store.open_output_stream(path, compression=None), 0, 0
                    if shared.value:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(shared.value)) + shared.value)
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                frame = packer.compress(record(page_id, url, html.encode(), digest, refers_to, date))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return saved(revisits(rows, min_bytes).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class _Stream:
    """Reads an archive record by record."""

    def __init__(self, raw: pa.NativeFile):
        head = raw.read(8)
        data = b""
        if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
            data = raw.read(struct.unpack("<II", head)[1])
        else:
            raw.seek(0)
        dictionary = _dictionary(data)
        reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary is not None else zstandard.ZstdDecompressor()
        self.reader, self.buffer = reader.stream_reader(raw, read_across_frames=True), b""

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                more = self.reader.read(1 << 16)
                if not more:
                    return
                self.buffer += more
            lines = self.buffer[:end].decode().split("\r\n")
            head = dict(x.split(": ", 1) for x in lines[1:])
            parts, need = [self.buffer[end + 4 :]], int(head["Content-Length"]) + 4
            have = len(parts[0])
            while have < need:
                parts.append(self.reader.read(max(1 << 16, need - have)))
                if not parts[-1]:
                    raise ValueError("archive ends within a record")
                have += len(parts[-1])
            rest = b"".join(parts)
            self.buffer = rest[need:]
            yield head, rest[: need - 4]


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload (null for revisits) of every record.

    The digest of a response is computed from the payload read back and must agree with its header.
    """
    shape = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_file(path) as raw:
                    rows, held = [], 0
                    for head, block in _Stream(raw):
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if head["WARC-Type"] == "response" else None
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} in {path} does not match its digest")
                        size = int(head["X-Payload-Length"]) if payload is None else len(payload)
                        to = head.get("X-Refers-To-Page-Id")
                        rows.append((int(head["X-Page-Id"]) if head["X-Page-Id"] else None, head["WARC-Target-URI"], head["WARC-Type"], size, digest, int(to) if to else None, *([payload] if with_payload else [])))
                        held += len(payload or b"") if with_payload else 200
                        if held > 4 << 20:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, with_payload)

    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("path").repartition(n).mapInArrow(run, shape)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if with_payload else [])]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Archives pages to a new folder among the shared ones and reads the archives back, without payloads."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, write_archives(pages, folder, min_bytes), folder, with_payload=False)
