"""Zstandard web archives (``.warc.zst``): reader and writer.

The file's first frame may be a skippable one that holds the dictionary, itself
raw or a zstd frame; after it each record is one frame. Records are streamed, so
memory is that of one record, and a file is a task: archives come in many files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, filesystem, materialize, shared_dir

_DICT_MAGIC = 0x184D2A5D
_FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: Bytes read at a time, and given to the decoder at a time: a frame of a few bytes can decode to a thousand times as many.
_READ, _FEED = 1 << 18, 1 << 12
#: Bytes that a record may have; a larger one has a status instead of a block.
MOST_BYTES = 1 << 30
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    """A frame or record that breaks the format."""


def read_dictionary(head: bytes) -> tuple[bytes | None, int]:
    """Dictionary of a leading skippable frame, and the frame's length (0: none)."""
    if len(head) < 8:
        return None, 0
    magic, size = struct.unpack("<II", head[:8])
    if magic != _DICT_MAGIC:
        return None, 0
    if len(head) < 8 + size:
        raise WarcError("dictionary frame is cut short")
    raw = head[8 : 8 + size]
    if raw[:4] == _FRAME_MAGIC:
        raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
    return raw, 8 + size


def frames(stream: BinaryIO, most: int = MOST_BYTES) -> Iterator[bytes | WarcError]:
    """Decoded frames of an archive, one after the other.

    A frame that decodes to more than ``most`` bytes is decoded to its end but not
    kept; an error stands in its place.
    """
    head = stream.read(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == _DICT_MAGIC:
        head += stream.read(struct.unpack("<I", head[4:])[0])
    raw, skip = read_dictionary(head)
    dec = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw)) if raw else zstd.ZstdDecompressor()
    rest = head[skip:]
    while True:
        rest = rest or stream.read(_READ)
        if not rest:
            return
        while len(rest) < 4:
            more = stream.read(_READ)
            if not more:
                raise WarcError("trailing bytes after the last frame")
            rest += more
        if rest[:4] != _FRAME_MAGIC:
            raise WarcError("no zstd frame where one must begin")
        one, parts, size = dec.decompressobj(), [], 0
        while not one.eof:
            if not rest:
                rest = stream.read(_READ)
                if not rest:
                    raise WarcError("the last frame is cut short")
            try:
                part = one.decompress(rest[:_FEED])
            except zstd.ZstdError as e:
                raise WarcError(f"frame can't be decoded: {e}") from e
            size += len(part)
            if size <= most:
                parts.append(part)
            else:
                parts.clear()
            rest = one.unused_data + rest[_FEED:] if one.eof else rest[_FEED:]
        yield b"".join(parts) if size <= most else WarcError(f"the record has {size} bytes, more than {most}")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; WarcError where invalid."""
    head, sep, block = data.partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("no blank line after the headers")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError(f"not a WARC version line: {lines[0][:20]!r}")
    headers: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:40]!r}")
        name = name.strip().lower()
        headers[name] = value.strip()
    missing = [h for h in _REQUIRED if h not in headers]
    if missing:
        raise WarcError(f"missing {', '.join(missing)}")
    if not re.fullmatch(r"[0-9]{1,18}", headers["content-length"]):
        raise WarcError("Content-Length is not a number of at most 18 digits")
    page = headers.get("x-page-id", "")
    if re.fullmatch(r"-?[0-9]+", page) and (len(page) > 20 or not -(1 << 63) <= int(page) < 1 << 63):
        raise WarcError("X-Page-Id has more than 64 bits")
    size = int(headers["content-length"])
    if block[size:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {size}, the block has {len(block) - 4} bytes or does not end the frame")
    block = block[:size]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and len(digest) == 45 and digest[5:] != hashlib.sha1(block).hexdigest():
        raise WarcError("WARC-Block-Digest differs")
    return headers, block


_OUT = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("block", pa.binary()), ("block_length", pa.int64()), ("status", pa.string())])


def _records(path: str, stream: BinaryIO, most: int = MOST_BYTES) -> Iterator[tuple]:
    seq, decoded = 0, frames(stream, most)
    while True:
        try:
            data = next(decoded)
        except StopIteration:
            return
        except WarcError as e:
            yield path, seq, None, None, None, None, None, None, str(e)
            return
        try:
            if isinstance(data, WarcError):
                raise data
            h, block = parse_record(data)
            page = h.get("x-page-id", "")
            yield path, seq, h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"), int(page) if re.fullmatch(r"-?[0-9]+", page) else None, block, len(block), "ok"
        except WarcError as e:
            yield path, seq, None, None, None, None, None, None, str(e)
        seq += 1


def read_archives(paths: DataFrame, path_col: str = "path", most: int = MOST_BYTES) -> DataFrame:
    """Records of the archives named in ``paths``, each file read by one task.

    ``path, seq, warc_type, record_id, uri, page_id, block, block_length, status``:
    an invalid record gives a row whose ``status`` says why, the other columns
    null, and so does one of more than ``most`` bytes; a broken frame ends its file
    with such a row, as frames can't be found again. Null paths are left out, a path named twice is read twice, an empty
    table or archive gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = filesystem(path)
                with where.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for row in _records(path, stream, most):
                        rows.append(row)
                        size += len(row[6] or b"") + 200
                        if size > 8 << 20:
                            yield _to_batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _to_batch(rows)

    ddl = "path string, seq bigint, warc_type string, record_id string, uri string, page_id bigint, block binary, block_length bigint, status string"
    bound_batches(paths.sparkSession)
    return paths.select(F.col(path_col).cast("string").alias("path")).where("path is not null").mapInArrow(run, ddl)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def encode_record(page_id: int | None, url: str | None, block: bytes) -> bytes:
    """A ``resource`` record; control characters of the URL are percent-encoded."""
    name = uuid.UUID(bytes=hashlib.md5(repr((page_id, url)).encode() + block).digest())
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_bytes(records: list[bytes], dict_size: int = 16384, level: int = 3, sample: int = 1000) -> bytes:
    """A whole archive of ``records``, all of them whole.

    The dictionary is trained on ``sample`` records at even distances; where the
    trainer finds too little to learn from there is none.
    """
    try:
        raw = zstd.train_dictionary(dict_size, records[:: max(1, len(records) // sample)]).as_bytes()
    except zstd.ZstdError:
        raw = b""
    if not raw:
        comp = zstd.ZstdCompressor(level=level)
        return b"".join(comp.compress(r) for r in records)
    packed = zstd.ZstdCompressor(level=level).compress(raw)
    comp = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(raw))
    return struct.pack("<II", _DICT_MAGIC, len(packed)) + packed + b"".join(comp.compress(r) for r in records)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = 16 << 20) -> DataFrame:
    """Write ``pages`` to archives of about ``shard_bytes`` in ``folder``; ``path, records``.

    A file is named by its content and moved into place whole, so a task that runs
    again writes the same file. A null html is an empty block; null ids and URLs
    leave their header out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        pend: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = archive_bytes(pend)
            name = f"{hashlib.sha256(data).hexdigest()[:40]}.warc.zst"
            part = f"{base}/.{name}.{uuid.uuid4().hex}"
            with where.open_output_stream(part, compression=None) as f:
                f.write(data)
            where.move(part, f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(pend)], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                rec = encode_record(page, url, (html or "").encode())
                pend.append(rec)
                size += len(rec)
                if size >= shard_bytes:
                    yield flush()
                    pend, size = [], 0
        if pend:
            yield flush()

    src = pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    bound_batches(pages.sparkSession)
    return src.mapInArrow(run, "path string, records bigint")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written as archives to the shared folder and read back from them."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    made = materialize(write_archives(pages, folder), "archives")
    files = made.count()
    rows = read_archives(made.repartition(max(1, files)))
    return rows.select("page_id", F.col("uri").alias("url"), F.decode("block", "UTF-8").alias("html"), "block_length", "status")
