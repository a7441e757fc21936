"""WARC archives: monolithic gzip files, a normaliser that makes each record its own member, and indexed reads."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.components import shared_folder
from opsloom.session import cut_lineage

_CHUNK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open_folder(address: str) -> tuple[fs.FileSystem, str]:
    """The store of an address and the place in it; file:/x and /x are the same local or mounted folder."""
    return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+(?=[^/])", "file:///", address))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    """A header value cannot hold line ends or other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record_bytes(record_id: str, kind: str, url: str | None, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    """One record; a revisit has no payload of its own, but the size and digest of what it refers to."""
    block = _HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def duplicate_roles(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """The rows with their payload (null: empty) and _first, the key of the record that they revisit.

    Of equal payloads of at least `least_bytes`, the largest key is the response (_first is null), as are all rows
    that share that key; null keys are the smallest, and a group of null keys alone has responses only. Only payloads
    that occur again come into the join, so an unequal payload meets nothing there.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.withColumn("_body", body).withColumn("_digest", F.sha1("_body"))
    again = rows.filter(F.octet_length("_body") >= least_bytes).groupBy("_digest").agg(
        F.max(key).alias("_largest"), F.count(F.lit(1)).alias("_n")
    ).filter("_n > 1").drop("_n")
    joined = rows.join(again, "_digest", "left")
    first = F.when(~F.col(key).eqNullSafe(F.col("_largest")), F.col("_largest"))
    return joined.withColumn("_first", first).drop("_digest", "_largest")


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
    least_bytes: int = 0, archive_bytes: int = 64 << 20,
) -> DataFrame:
    """Archives of whole-file gzip streams, about `archive_bytes` of records each; (path, records) of every file.

    Every attempt of a task writes files of its own, and the rows returned name those of the attempt that counts.
    """
    rows = duplicate_roles(pages, key, payload, least_bytes).select(
        F.col(key).cast("string"), url, F.col("_first").cast("string"), "_body"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_folder(folder)
        store.create_dir(root, recursive=True)
        out, path, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for key_, url_, first, body in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    path, size, records = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                    press = zlib.compressobj(3, zlib.DEFLATED, 31)
                data, name, other = body.as_py(), key_.as_py(), first.as_py()
                record = record_bytes(
                    _urn(name), "response" if other is None else "revisit", url_.as_py(), payload_digest(data),
                    len(data), None if other is None else _urn(other), data,
                )
                out.write(press.compress(record))
                size, records = size + len(record), records + 1
                if size >= archive_bytes:
                    out.write(press.flush())
                    out.close()
                    out = None
                    done.append((path, records))
        if out is not None:
            out.write(press.flush())
            out.close()
            done.append((path, records))
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{p}" for p, _ in done], "records": [n for _, n in done]})

    return cut_lineage(rows.mapInArrow(write, "path string, records bigint"))


def _urn(key: str | None) -> str:
    return "urn:page:" + ("" if key is None else ":" + key)


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or more, read once and held a chunk at a time."""
    state = zlib.decompressobj(31)
    data = source.read(_CHUNK)
    while data:
        part = state.decompress(data, _CHUNK)
        if part:
            yield part
        if state.eof:
            data = state.unused_data or source.read(_CHUNK)
            state = zlib.decompressobj(31)
        else:
            data = state.unconsumed_tail or source.read(_CHUNK)
    if part := state.flush():
        yield part


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Callable[[], Iterator[bytes]]]]:
    """(headers, parts of the whole record) in the order of the stream; the parts must be read before the next one."""
    buffer = bytearray()

    def fill() -> bool:
        part = next(chunks, None)
        if part is None:
            return False
        buffer.extend(part)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill():
                if buffer.strip():
                    raise ValueError("archive ends inside a record's header")
                return
        headers = parse_headers(bytes(buffer[:end]))
        rest = end + 4 + int(headers["content-length"]) + 4

        def parts() -> Iterator[bytes]:
            left = rest
            while left:
                if not buffer and not fill():
                    raise ValueError("archive ends inside a record")
                part = bytes(buffer[:left])
                del buffer[: len(part)]
                left -= len(part)
                yield part

        yield headers, parts


INDEX = "record_id string, record_type string, path string, offset bigint, length bigint"


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The offset index (record_id, record_type, path, offset, length) of archives rewritten one member a record.

    Each archive is inflated once, a chunk at a time. Beside it goes a sidecar: a line of JSON for each record.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = _open_folder(path)
                _, root = _open_folder(folder)
                store.create_dir(root, recursive=True)
                name = f"norm-{uuid.uuid4().hex}.warc.gz"
                rows: dict[str, list] = {"record_id": [], "record_type": [], "path": [], "offset": [], "length": []}
                with (
                    store.open_input_stream(place, compression=None) as source,
                    store.open_output_stream(f"{root}/{name}", compression=None) as out,
                    store.open_output_stream(f"{root}/{name}.index.jsonl", compression=None) as sidecar,
                ):
                    offset = 0
                    for headers, parts in split_records(inflated(source)):
                        press, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                        for part in parts():
                            length += out.write(press.compress(part))
                        length += out.write(press.flush())
                        row = {
                            "record_id": headers["warc-record-id"].strip("<>"), "record_type": headers["warc-type"],
                            "path": f"{folder}/{name}", "offset": offset, "length": length,
                        }
                        sidecar.write(json.dumps(row).encode() + b"\n")
                        for c, v in row.items():
                            rows[c].append(v)
                        offset += length
                yield pa.RecordBatch.from_pydict(rows, schema=_INDEX)

    return cut_lineage(manifest.select("path").mapInArrow(rewrite, INDEX))


_INDEX = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_READ = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()),
    ]
)


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records at the index's places: record_id, record_type, payload_bytes, payload_digest, refers_to (a record id),
    and the payload if asked for. Size and digest are of the full payload: computed for a response, and for a
    revisit those that its header has of the response. A response that does not match its digest is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, source = None, None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _READ.names}
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != current:
                    if source is not None:
                        source.close()
                    store, place = _open_folder(path)
                    current, source = path, store.open_input_file(place)
                raw = zlib.decompress(source.read_at(length, offset), 31)
                end = raw.index(b"\r\n\r\n")
                headers = parse_headers(raw[:end])
                block = raw[end + 4 : end + 4 + int(headers["content-length"])]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(headers["x-payload-length"])
                if kind == "response":
                    if payload_digest(payload) != digest:
                        raise ValueError(f"digest of {headers['warc-record-id']} does not match its payload")
                    size = len(payload)
                refers = headers.get("warc-refers-to")
                row = (headers["warc-record-id"].strip("<>"), kind, size, digest, refers and refers.strip("<>"), payload if with_payload else None)
                for c, v in zip(_READ.names, row, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_READ)
        if source is not None:
            source.close()

    fields = "record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"
    return index.select("path", "offset", "length").mapInArrow(read, fields)


def archive_round_trip(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, folder: str | None = None
) -> DataFrame:
    """Writes all rows as records, normalises the archives, and reads every record back by the index.

    Per row: key, payload_bytes, payload_digest, record_type, refers_to (a key). A null payload is empty, a null url
    an empty header. Rows without a page give an empty table.
    """
    folder = folder or shared_folder(pages, "warc")
    manifest = write_archives(pages, f"{folder}/raw", key, url, payload, least_bytes)
    records = read_records(normalise_archives(manifest, f"{folder}/records"))
    kind = dict(pages.dtypes)[key]

    def key_of(urn: str):
        return F.regexp_extract(urn, "(?s)^urn:page::(.*)$", 1), F.col(urn).startswith("urn:page::")

    ids = {c: F.when(key_of(c)[1], key_of(c)[0]).cast(kind) for c in ("record_id", "refers_to")}
    return records.select(
        ids["record_id"].alias(key), "payload_bytes", "payload_digest", "record_type", ids["refers_to"].alias("refers_to")
    )
