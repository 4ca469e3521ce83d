"""WARC archives in zstandard frames: one dictionary in the leading skippable frame, then one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import dictionary, open_input, open_output, shuffle_partitions, work_path, written
from emberline.llm.graph import small

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Upper half of record ids; the lower half is the page id. Rows without a page id have another upper half.
_PAGE_SPACE, _NO_PAGE_SPACE = 0x70616765_0000_4000, 0x70616765_0000_4001
READ_BYTES = 1 << 18
#: Pages that the dictionary is trained on are no longer than this.
SAMPLE_BYTES = 1 << 16


class WarcError(ValueError):
    pass


def record_id(page_id: int | None) -> str:
    high, low = (_NO_PAGE_SPACE, 0) if page_id is None else (_PAGE_SPACE, page_id % 2**64)
    return f"<{uuid.UUID(int=high << 64 | low).urn}>"


def page_of(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>")).int
    low = n % 2**64
    return None if n >> 64 == _NO_PAGE_SPACE else low - 2**64 if low >= 2**63 else low


def header_text(value: str) -> str:
    """A value that can't break out of its header line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or, if refers_to is given, a revisit of that page: HTTP head only, full length and digest told."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_text(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; WarcError if a header, a length or the digest is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no header: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"{fields['warc-record-id']}: its block has {len(rest) - 4} bytes, its header says {length}")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    if not found:
        raise WarcError(f"{fields['warc-record-id']}: no end of the HTTP head")
    told = [int(x.partition(b":")[2]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    digest = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    if len(told) != 1 or not revisit and len(payload) != told[0]:
        raise WarcError(f"{fields['warc-record-id']}: its payload has another length than its HTTP head says")
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise WarcError(f"{fields['warc-record-id']}: its payload has another digest")
    return {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_bytes": told[0], "payload_digest": digest, "refers_to": page_of(fields["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload}


class ArchiveWriter:
    def __init__(self, stream, content: bytes, level: int = 3):
        packed = zstandard.ZstdCompressor(level=19).compress(content)
        stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.stream, self.coder = stream, zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content))

    def add(self, raw: bytes) -> None:
        self.stream.write(self.coder.compress(raw))


def read_records(stream) -> Iterator[bytes]:
    """The records of an archive, one frame at a time; what is held is one record and a read buffer."""
    head = stream.read(8)
    if len(head) < 8:
        raise WarcError("the archive is empty")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise WarcError("the archive has no leading dictionary frame")
    content = stream.read(size)
    if len(content) != size:
        raise WarcError("the dictionary frame is cut off")
    if content[:4] == ZSTD_MAGIC:
        content = zstandard.ZstdDecompressor().decompress(content)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    left = b""
    while chunk := left or stream.read(READ_BYTES):
        frame, parts = decoder.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(chunk))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from e
            if frame.eof:
                left = frame.unused_data
                break
            chunk = stream.read(READ_BYTES)
            if not chunk:
                raise WarcError("the last frame is cut off")
        yield b"".join(parts)


def with_roles(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, refers_to: of pages with equal payloads of at least min_bytes, all but the largest page_id refer to it.

    Rows with that page_id are all responses; so are equal payloads of which none has a page_id.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha1("payload"))
    sized = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes)
    leads = sized.groupBy("digest").agg(F.max("page_id").alias("lead"), F.count("*").alias("copies")).where("copies > 1 AND lead IS NOT NULL").select("digest", "lead")
    return rows.join(small(written(leads, "leads")), "digest", "left").select("page_id", "url", F.encode("payload", "UTF-8").alias("payload"), F.when(~F.col("page_id").eqNullSafe(F.col("lead")), F.col("lead")).alias("refers_to"))


def write_archives(pages: DataFrame, *, path: str | None = None, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", sample_pages: int = 200, dictionary_bytes: int = 65_536, records_per_archive: int = 50_000) -> DataFrame:
    """Write pages(page_id, url, html) as archives below path, and return their manifest: path, records.

    Every task writes the archives of its own rows: no row with its html is shuffled, unless there are too many repeated
    digests to broadcast. A task that runs again writes other files: the manifest, which Spark commits, names those that
    count. The dictionary is trained on the sample_pages pages whose hashed ids come first, but for those of over 64 KB. A null html is an empty payload; a null url has no
    WARC-Target-URI.
    """
    spark = pages.sparkSession
    root = path or work_path(spark, "warc")
    chosen = pages.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    short = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) <= SAMPLE_BYTES
    sample = pages.join(F.broadcast(chosen), "page_id").where(short).select("page_id", "url", "html").limit(2 * sample_pages).collect()
    content = dictionary([record(r["page_id"], r["url"], (r["html"] or "").encode(), None, date) for r in sample], dictionary_bytes).as_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        done, stream, writer, n = [], None, None, 0

        def close() -> None:
            stream.close()
            done.append((final, n))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if stream is None:
                    final = f"{root}/{task.partitionId():05d}-{len(done):04d}-{task.taskAttemptId()}.warc.zst"
                    stream, n = open_output(final), 0
                    writer = ArchiveWriter(stream, content)
                writer.add(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date))
                n += 1
                if n == records_per_archive:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "records": [x[1] for x in done]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return written(with_roles(pages, min_bytes).mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits).

    Version line, needed headers, lengths, digests and the manifest's counts are checked; a mismatch fails the job.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen, held, size = 0, [], 0
                with open_input(row["path"]) as stream:
                    for raw in read_records(stream):
                        found = parse(raw)
                        held.append({n: found[n] for n in names})
                        seen, size = seen + 1, size + (len(raw) if payloads else 200)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if seen != row["records"]:
                    raise WarcError(f"{row['path']} has {seen} records, its manifest says {row['records']}")
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    ddl = ", ".join(f"{n} " + {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}.get(n, "string") for n in names)
    return manifest.repartition(shuffle_partitions(manifest.sparkSession), "path").mapInArrow(run, ddl)
