"""WARC archives in Zstandard: one frame a record, behind a skippable frame that holds the dictionary.

Archives are written by tasks into a folder that all share and listed in a manifest; only files that a finished task lists are
read.  Readers stream: they hold one record, whatever the archive's size.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import scratch, settle

# Fixed values of the format.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

DATE = "2000-01-01T00:00:00Z"
# An archive is closed at so many bytes of records; its dictionary is trained on its first records.
ARCHIVE_BYTES, TRAINING_RECORDS, DICTIONARY_BYTES = 64 << 20, 200, 16 << 10
CHUNK = 1 << 20
# Tasks that read archives at most.
READERS = 10_000


class WarcError(ValueError):
    """An archive that is not what it says."""


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, size: int, digest32: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record.  A revisit holds the response's headers only; its digest and length are those of the whole payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]-._"),
        "WARC-Payload-Digest": f"sha1:{digest32}",
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items() if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields and payload of a record; wrong versions, fields, lengths and digests raise ``WarcError``."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise WarcError("a record does not begin with its version and headers")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError(f"header without a colon: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := [m for m in MANDATORY if m not in fields]:
        raise WarcError(f"headers missing: {missing}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"a block of {len(rest) - 4} bytes says {length}")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or len(sizes) != 1:
        raise WarcError("a block without HTTP headers")
    algorithm, _, digest32 = fields.get("warc-payload-digest", "").partition(":")
    if fields["warc-type"] == "response":
        if sizes[0] != len(payload) or (algorithm, digest32) != ("sha1", digest(payload)):
            raise WarcError("a payload differs from its length or digest")
    elif fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields:
        raise WarcError(f"a record of type {fields['warc-type']} that can't be read")
    return {"fields": fields, "payload": payload, "size": sizes[0], "digest": digest32}


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on records; None if there are too few for a dictionary to be trained."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) > 8 else None
    except zstandard.ZstdError:
        return None


def write_archive(path: str, records: list[bytes]) -> None:
    """The records in their order, each in a frame of its own, after the dictionary that they are compressed with."""
    trained = dictionary(records[:TRAINING_RECORDS])
    compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True)
    raw = trained.as_bytes() if trained else b""
    system, place = filesystem(path)
    with system.open_output_stream(place, compression=None) as out:
        out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for one in records:
            out.write(compressor.compress(one))


def read_archive(path: str) -> Iterator[dict]:
    """Parsed records of an archive.  The leading skippable frame holds the dictionary, plain or compressed, or nothing."""
    system, place = filesystem(path)
    with system.open_input_stream(place, compression=None) as source:
        start = source.read(8)
        if len(start) < 8 or struct.unpack("<II", start)[0] != SKIPPABLE:
            raise WarcError("an archive does not begin with a dictionary frame")
        raw = source.read(struct.unpack("<II", start)[1])
        if raw.startswith(FRAME):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        frame, parts, data = None, [], source.read(CHUNK)
        while data:
            if frame is None:
                frame, parts = decompressor.decompressobj(), []
            parts.append(frame.decompress(data))
            data = b""
            if frame.eof:
                data = frame.unused_data
                frame = None
                yield parsed(b"".join(parts))
            data = data or source.read(CHUNK)
        if frame is not None:
            raise WarcError("the last frame is cut off")


def _written(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def close() -> pa.RecordBatch:
        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        write_archive(path, held)
        return pa.record_batch([pa.array([path]), pa.array([len(held)], pa.int64())], names=["path", "records"])

    for batch in batches:
        for row in batch.to_pylist():
            payload = (row["html"] or "").encode() if row["kind"] == "response" else b""
            digest32 = base64.b32encode(bytes.fromhex(row["sha"])).decode()
            held.append(record(row["kind"], row["page_id"], row["url"], row["size"], digest32, payload, row["refers_to"]))
            size += len(held[-1])
            if size >= archive_bytes:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record a row of ``pages`` (page_id, url, html) into archives under ``folder``; returns their manifest (path, records).

    Of rows with equal payloads of ``least_bytes`` and more, the smallest page_id is the response, the others are revisits of it;
    shorter ones are responses.  A null html is an empty payload.  Rows that repeat the smallest page_id are responses, each of them;
    a null page_id never is referred to.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    plain = plain.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    firsts = settle(plain.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first")).where("first IS NOT NULL"))
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("first") == F.col("page_id"), F.lit(False))
    rows = plain.join(firsts, ["sha", "size"], "left").select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "sha", "size",
        F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"),
    )
    system, place = filesystem(folder)
    system.create_dir(place, recursive=True)
    return settle(rows.mapInArrow(lambda it: _written(it, folder, archive_bytes), "path string, records long"))


def _number(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def _read(batches: Iterator[pa.RecordBatch], bodies: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
            n, out = 0, []
            for one in read_archive(path):
                fields = one["fields"]
                n += 1
                out.append((
                    _number(fields["warc-record-id"]), one["size"], one["digest"], fields["warc-type"], _number(fields.get("warc-refers-to")),
                    fields.get("warc-target-uri"), one["payload"] if bodies else None,
                ))
                if len(out) == 256:
                    yield _batch(out)
                    out = []
            if n != records:
                raise WarcError(f"{path} holds {n} records and not {records}")
            if out:
                yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(manifest: DataFrame, bodies: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record of the archives listed.

    The payload of a revisit is null or empty: it is the one it refers to.  An archive that breaks the format, a length or a digest, or
    has not as many records as the manifest says, fails the job.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    # One archive a task: a manifest is so small that without a number all of it would be dealt to one.
    tasks = max(1, min(READERS, manifest.count()))
    return manifest.select("path", "records").repartition(tasks).mapInArrow(lambda it: _read(it, bodies), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """What ``read_archives`` finds in the archives that ``write_archives`` makes of ``pages``."""
    manifest = write_archives(pages, f"{scratch(pages.sparkSession)}-warc")
    return read_archives(manifest, bodies=False).drop("payload", "url")
