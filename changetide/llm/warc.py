"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: rows become response records, or revisit records without a payload where an earlier record
holds the same payload. Each task writes archives of bounded size under names of its own into a
shared folder and returns their paths; only returned paths are read, so what a lost task leaves
behind counts for nothing. Reading walks over the frames of an archive with a buffer of one record,
decodes each and checks its version line, headers, lengths, digests and ending.

Null payloads are empty. Equal payloads of min_bytes or more have one response, the smallest id
(repeated rows of that id are all responses); a null id is never preferred and reads back as null. A
null url is left out; control characters in one are percent-encoded. Very long payloads are records of
their own size; one of more than RECORD_BYTES is refused when it is read. An empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetide.llm.scratch import drawn, folder, stored

# Fixed values of the formats.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_DICTIONARY = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

ARCHIVE_BYTES = 16 << 20
RECORD_BYTES = 1 << 30


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def block_of(payload: bytes, whole_bytes: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {whole_bytes}\r\n\r\n"
    return head.encode() + payload


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
           whole_bytes: int, payload_digest: str) -> bytes:
    block = block_of(b"" if revisit else payload, whole_bytes)
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0], safe=""), url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes], size: int = 32 << 10) -> bytes:
    """A dictionary, or nothing where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def _exactly(file, count: int, what: str) -> bytes:
    data = file.read(count)
    if len(data) != count:
        raise ValueError(f"the archive ends within {what}")
    return data


def frames(file) -> Iterator[tuple[int, bytes]]:
    """(magic, whole frame) of each frame; of skippable ones the content. Sizes come from the block headers."""
    while True:
        start = file.read(4)
        if not start:
            return
        if len(start) < 4:
            raise ValueError("the archive ends within a frame's magic number")
        (magic,) = struct.unpack("<I", start)
        if magic in SKIPPABLE:
            (size,) = struct.unpack("<I", _exactly(file, 4, "a skippable frame"))
            yield magic, _exactly(file, size, "a skippable frame")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame begins with {magic:#x}")
        parts = [start, descriptor := _exactly(file, 1, "a frame header")]
        flags = descriptor[0]
        single = flags >> 5 & 1
        sizes = (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        parts.append(_exactly(file, sizes, "a frame header"))
        last = 0
        while not last:
            head = _exactly(file, 3, "a block header")
            value = int.from_bytes(head, "little")
            last, kind, size = value & 1, value >> 1 & 3, value >> 3
            if kind == 3:
                raise ValueError("a block of the reserved kind")
            parts += [head, _exactly(file, 1 if kind == 1 else size, "a block")]
        if flags >> 2 & 1:
            parts.append(_exactly(file, 4, "a checksum"))
        yield magic, b"".join(parts)


def _headers(data: bytes, what: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"a malformed {what} header line: {line[:80]!r}")
        key = name.decode("ascii").lower()
        if key in found:
            raise ValueError(f"the {what} header {key} stands twice")
        found[key] = value.strip().decode("utf-8", "surrogatepass")
    return found


def _length(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    if not re.fullmatch("[0-9]+", value):
        raise ValueError(f"a {what} without a length")
    return int(value)


def parsed(data: bytes) -> dict:
    """One record, checked."""
    top, ends, rest = data.partition(b"\r\n\r\n")
    version, _, lines = top.partition(b"\r\n")
    if not ends or version not in (VERSION, b"WARC/1.0"):
        raise ValueError(f"no WARC record begins with {data[:40]!r}")
    headers = _headers(lines, "record")
    for needed in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest"):
        if needed not in headers:
            raise ValueError(f"a record without {needed}")
    length = _length(headers, "record")
    block, ending = rest[:length], rest[length:]
    if len(block) != length or ending != b"\r\n\r\n":
        raise ValueError("a record's length is not that of its block")
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + digest(block):
        raise ValueError("a block differs from its digest")
    http, ends, payload = block.partition(b"\r\n\r\n")
    if not ends:
        raise ValueError("a block without a payload")
    whole = _length(_headers(http.partition(b"\r\n")[2], "block"), "block")
    kind, name = headers["warc-type"], headers["warc-payload-digest"]
    if not name.startswith("sha1:"):
        raise ValueError("a payload digest of another kind")
    ids = {k: _page(headers.get(k)) for k in ("warc-record-id", "warc-refers-to")}
    if kind == "response":
        if len(payload) != whole or name != "sha1:" + digest(payload):
            raise ValueError("a payload differs from its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in headers or "warc-profile" not in headers:
        raise ValueError(f"not a valid record of type {kind}")
    return {
        "page_id": ids["warc-record-id"],
        "url": headers.get("warc-target-uri"),
        "payload_bytes": whole,
        "payload_digest": name[5:],
        "record_type": kind,
        "refers_to": ids["warc-refers-to"],
        "payload": payload if kind == "response" else None,
    }


def _page(value: str | None) -> int | None:
    if value is None:
        return None
    found = re.fullmatch(rf"<{URN}(null|-?[0-9]+)>", value)
    if not found:
        raise ValueError(f"no page is called {value}")
    return None if found[1] == "null" else int(found[1])


def records(file) -> Iterator[dict]:
    """The records of one archive; its dictionary is the content of a leading skippable frame."""
    decoder, first = zstandard.ZstdDecompressor(), True
    for magic, data in frames(file):
        if magic in SKIPPABLE:
            if first and magic == DICTIONARY_MAGIC:
                plain = data if data.startswith(ZSTD_DICTIONARY) else zstandard.ZstdDecompressor().decompress(data)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
            first = False
            continue
        first = False
        if zstandard.get_frame_parameters(data).content_size > RECORD_BYTES:
            raise ValueError("a frame without a length, or a record larger than is allowed")
        yield parsed(decoder.decompress(data))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha, revisit, refers_to): what becomes a response and what a revisit."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    keys = rows.where(F.length("payload") >= min_bytes).select("page_id", "sha")
    first = keys.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    # only ids and digests meet by digest, which many rows may share; payloads meet their plan by id
    later = keys.join(first, "sha").where("refers_to is not null and not (page_id <=> refers_to)").distinct()
    later = later.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to")
    joined = rows.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    return joined.select("page_id", "url", "payload", F.col("refers_to").isNotNull().alias("revisit"), "refers_to")


def write(pages: DataFrame, root: str, min_bytes: int = 0, samples: int = 400, sample_bytes: int = 8192) -> DataFrame:
    """Write archives under root; returns the stored table (path, n_records, n_bytes) of those that count."""
    store, place = _store(root)
    store.create_dir(place, recursive=True)
    payload = F.substring(F.col("html").cast("string"), 1, sample_bytes)
    sample = drawn(pages.where("html is not null").select("page_id", payload.alias("html")), samples, "page_id", "html")
    heads = [r["html"].encode("utf-8", "surrogatepass") for r in sample.collect()]
    dictionary = trained([block_of(h, len(h)) for h in heads])
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        target, top = _store(root)
        options = {"level": 3, "write_checksum": True, "write_content_size": True}
        if shared.value:
            options["dict_data"] = zstandard.ZstdCompressionDict(shared.value)
        encoder = zstandard.ZstdCompressor(**options)
        name, file, count, size = None, None, 0, 0

        def closed():
            file.close()
            return pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "n_records": [count], "n_bytes": [size]})

        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*batch.columns):
                if file is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    file = target.open_output_stream(f"{top}/{name}")
                    size += file.write(leading_frame(shared.value))
                body = payload.as_py()
                data = record(page_id.as_py(), url.as_py(), body, refers_to.as_py(), revisit.as_py(), len(body), digest(body))
                size += file.write(encoder.compress(data))
                count += 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    file = None
        if file is not None:
            yield closed()

    return stored(planned(pages, min_bytes).mapInArrow(run, "path string, n_records long, n_bytes long"))


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of archives (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _store(path)
                held, size = [], 0
                with store.open_input_stream(name, buffer_size=1 << 20) as file:
                    for found in records(io.BufferedReader(file, 1 << 20)):
                        held.append({k: found[k] for k in schema.names})
                        size += found["payload_bytes"] if payloads else 64
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = archives.select("path").repartition(parts, "path")
    return paths.mapInArrow(run, kinds + ", payload binary" * payloads)


def archived(pages: DataFrame, root: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) to archives and read these back, without the payloads themselves."""
    root = root or folder(pages.sparkSession)
    return read(write(pages, root, min_bytes), payloads=False).drop("url")
