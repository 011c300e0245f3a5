"""WARC archives: writing, normalising gzip, reading by offset.

Crawlers may leave an archive as one gzip stream, in which no record can be found without
inflating all before it. The normaliser inflates such a file once, as a stream, writes every
record as a gzip member of its own, and a sidecar index with the offset and length of each member;
a reader then fetches any record alone. Files that hold several members already are normalised the
same way.

Files go to the shared folder through Arrow file systems, under a name of their own for each
attempt of a task; only names that a finished task returns are ever read. Memory holds one record
and a buffer.

Records: of equal payloads of at least ``REVISIT_BYTES``, that of the smallest ``page_id`` is a
``response`` and carries the payload, the others are ``revisit`` records without it. Results: a
null payload is the empty one. Rows without ``page_id`` are responses and nobody's original; rows
that repeat the smallest ``page_id`` of a payload are responses each. An empty table makes no file.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tactile.llm.common import small, store
from tactile.session import new_folder

REVISIT_BYTES = 100
ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 20
CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(page_id: int | None, payload: bytes, digest: str, refers_to: int | None, url: str | None) -> bytes:
    """One record, with its closing blank lines."""
    headers = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id),
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"WARC-Payload-Length: %d" % len(payload),
        b"Content-Type: application/http; msgtype=response",
    ]
    block = HTTP % len(payload)
    if refers_to is None:
        block += payload
    else:
        headers += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    headers.append(b"Content-Length: %d" % len(block))
    return CRLF.join(headers) + CRLF + CRLF + block + CRLF + CRLF


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members."""
    inflate = zlib.decompressobj(wbits=31)
    while data := source.read(CHUNK):
        while data:
            yield inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(wbits=31)
    yield inflate.flush()


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and all bytes of each record of an inflated stream."""
    buffer = bytearray()

    def fill(size: int) -> bool:
        while len(buffer) < size:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while fill(1):
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not fill(len(buffer) + 1):
                raise ValueError("the last record has no end")
        fields = header_fields(bytes(buffer[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        if not fill(size):
            raise ValueError("the last record is cut off")
        yield fields, bytes(buffer[:size])
        del buffer[:size]


def classified(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """``page_id, url, payload, digest, refers_to``. Payloads are not shuffled unless there are
    very many revisits: digests find the groups."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        (F.col(url) if url in pages.columns else F.lit(None)).cast("string").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = rows.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    large = store(large, "digests")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    firsts = store(firsts.where("n > 1").drop("n"), "originals")
    revisits = large.join(firsts, "digest").where("page_id <> refers_to").distinct()
    revisits = store(revisits, "revisits")
    return rows.join(small(revisits, revisits.count()), ["page_id", "digest"], "left")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(rows: DataFrame, level: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``classified`` rows as archives of one gzip stream each; ``path, records``, stored."""
    folder = new_folder(rows.sparkSession, "warc")

    def run(batches):
        from tactile.llm.warc import _open, record

        store_fs, base = _open(folder)
        store_fs.create_dir(base, recursive=True)
        out, count, size, done = None, 0, 0, []
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, deflate = store_fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, wbits=31)
                    count = size = 0
                data = record(*[column[c][i].as_py() for c in ("page_id", "payload", "digest", "refers_to", "url")])
                out.write(deflate.compress(data))
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.write(deflate.flush())
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.write(deflate.flush())
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["path", "records"]
        )

    rows = rows.select("page_id", "url", "payload", "digest", "refers_to")
    return store(rows.mapInArrow(run, "path string, records long"), "archives")


def _one_each(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()))


def normalise(archives: DataFrame, level: int = 4) -> DataFrame:
    """Rewrite each archive with a member per record, and a sidecar index (``.cdx`` beside it:
    offset, length, type, record id). Returns the index: ``path, offset, length, type, page_id``,
    stored."""

    def run(batches):
        from tactile.llm.warc import _open, inflated, records

        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                store_fs, base = _open(folder)
                target = f"{uuid.uuid4().hex}-{name}"
                index: list[tuple[int, int, str, int | None]] = []
                offset = 0
                with (
                    store_fs.open_input_stream(f"{base}/{name}", compression=None) as source,
                    store_fs.open_output_stream(f"{base}/{target}", compression=None) as out,
                ):
                    for fields, data in records(inflated(source)):
                        deflate = zlib.compressobj(level, wbits=31)
                        member = deflate.compress(data) + deflate.flush()
                        out.write(member)
                        ident = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                        index.append((offset, len(member), fields["warc-type"], int(ident) if ident else None))
                        offset += len(member)
                with store_fs.open_output_stream(f"{base}/{target}.cdx", compression=None) as out:
                    out.write("".join(f"{a} {b} {c} {'-' if d is None else d}\n" for a, b, c, d in index).encode())
                columns = list(zip(*index, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{folder}/{target}"] * len(index), pa.string()),
                        *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                    ],
                    ["path", "offset", "length", "type", "page_id"],
                )

    files = _one_each(archives.select("path"))
    return store(files.mapInArrow(run, "path string, offset long, length long, type string, page_id long"), "index")


def payload_of(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one inflated record."""
    end = data.index(b"\r\n\r\n")
    fields = header_fields(data[:end])
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def read_back(index: DataFrame) -> DataFrame:
    """``page_id, payload, payload_bytes, payload_digest, record_type, refers_to`` of the members
    that the sidecar indexes name, each inflated alone. The payload of a revisit is empty; its
    length and digest are those of the record it refers to."""

    def run(batches):
        from tactile.llm.warc import _open, payload_of

        def number(value: str | None) -> int | None:
            digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
            return int(digits) if digits else None

        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                store_fs, base = _open(folder)
                with store_fs.open_input_stream(f"{base}/{name}.cdx", compression=None) as sidecar:
                    spans = [tuple(map(int, line.split()[:2])) for line in io.BytesIO(sidecar.read())]
                rows, held = [], 0
                with store_fs.open_input_file(f"{base}/{name}") as members:
                    for offset, length in spans:
                        members.seek(offset)
                        fields, payload = payload_of(zlib.decompress(members.read(length), wbits=31))
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"the digest of {fields['warc-record-id']} does not fit")
                        rows.append(
                            {
                                "page_id": number(fields["warc-record-id"]),
                                "payload": payload,
                                "payload_bytes": int(fields["warc-payload-length"]),
                                "payload_digest": digest,
                                "record_type": fields["warc-type"],
                                "refers_to": number(fields.get("warc-refers-to")),
                            }
                        )
                        held += len(payload)
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema(
        [
            ("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ]
    )
    files = _one_each(index.select("path").distinct())
    return files.mapInArrow(
        run, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
