"""WARC records in ZIP packages: a writer, and a reader that goes by the ZIP's directories and the index.

A package holds two stored members: the records, each a gzip member of its own, and an index with each record's place. The
reader parses the end record, the ZIP64 end record where there is one, and the central directory, finds both members'
bytes, and reads records by byte ranges; nothing is extracted. Folders are opened with pyarrow's file systems, so
they may be local, HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes after which a writer starts the next package, and records and bytes that a reader takes at once.
PACKAGE_BYTES, BLOCK_RECORDS, BLOCK_BYTES = 1 << 28, 256, 1 << 22

# Fixed values of the ZIP format: signatures and sizes of its records.
END, END_SIZE = b"PK\x05\x06", 22
END64, END64_SIZE = b"PK\x06\x06", 56
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
ZIP64_FIELD, FULL16, FULL32 = 1, 0xFFFF, 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else int(page_id)}>"


def _page(urn: str) -> int | None:
    number = urn.strip("<> ").rpartition(":")[2]
    return None if number == "null" else int(number)


def record(page_id, url: str | None, payload: bytes, sha: str, refers_to=None) -> bytes:
    """One WARC record, as a response with its payload, or as a revisit of refers_to with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _urn(page_id), "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{sha}"}
    if url:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is not None:
        fields |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": PROFILE}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return top.encode() + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload of a record; a response's digest is computed and must be the one recorded."""
    top, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(top)
    block = rest[: int(fields["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    recorded, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and digest(payload) != recorded:
        raise ValueError(f"{fields['warc-record-id']}: the payload does not have its recorded digest")
    revisit = kind == "revisit"
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page(fields["warc-refers-to"]) if revisit else None,
        "payload_bytes": int(_fields(head)["content-length"]) if revisit else len(payload), "payload_digest": recorded, "payload": None if revisit else payload,
    }


class _Package:
    """Writes one package to an output stream that cannot seek."""

    def __init__(self, stream):
        self.stream, self.zip, self.index, self.at = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True), [], 0
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)

    def add(self, page_id, url: str | None, data: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.member.write(packed)
        self.index.append(f"{_urn(page_id)} {json.dumps({'url': url, 'offset': self.at, 'length': len(packed)})}\n")
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.close()
        self.stream.close()


def _writer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = pafs.FileSystem.from_uri(folder)
        package, name, done = None, "", []

        def finish() -> None:
            package.close()
            done.append((f"{folder}/{name}", len(package.index)))

        for pdf in batches:
            pages, last = (pdf[c].astype("Int64").astype(object).where(pdf[c].notna(), None) for c in ("page_id", "last"))
            for page_id, url, html, last_id in zip(pages, pdf["url"], pdf["html"], last, strict=True):
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    system.create_dir(root, recursive=True)
                    package = _Package(system.open_output_stream(f"{root}/{name}"))
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                refers_to = None if last_id is None or last_id == page_id else last_id
                url = url if isinstance(url, str) else None
                package.add(page_id, url, record(page_id, url, payload, digest(payload), refers_to))
                if package.at >= PACKAGE_BYTES:
                    finish()
                    package = None
        if package is not None:
            finish()
        if done:
            yield pd.DataFrame(done, columns=["path", "records"])

    return run


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes packages under folder and returns their path and number of records, as a written table.

    One record for each row of pages (page_id, url, html); null html is an empty payload. Of rows with equal payloads of
    at least least_bytes bytes those with the largest page_id are responses and the others revisits of it (rows of one
    page_id and one payload are all responses). Rows with a null page_id revisit another page if there is one, else they
    are responses. Packages that a lost task leaves behind are not in the table.
    """
    sha = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    keys = pages.select("page_id", sha.alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= least_bytes)
    again = materialize(keys.groupBy("sha").agg(F.count("*").alias("c"), F.max("page_id").alias("last")).where("c > 1").select("sha", "last"), "equal-payloads")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", sha.alias("sha"))
    joined = rows.join(again, "sha", "left").select("page_id", "url", "html", "last")
    return materialize(joined.mapInPandas(_writer(folder), "path string, records long"), "packages")


def directory(source) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of the local header, stored bytes, method) from a seekable file's central directory, ZIP64 or not, with or without bytes before the first member or a comment after the end."""
    source.seek(0, io.SEEK_END)
    length = source.tell()
    tail = min(length, END_SIZE + LOCATOR_SIZE + FULL16)
    source.seek(length - tail)
    data = source.read(tail)
    at = data.rfind(END)
    while at >= 0 and (at + END_SIZE > len(data) or at + END_SIZE + struct.unpack_from("<H", data, at + END_SIZE - 2)[0] != len(data)):
        at = data.rfind(END, 0, at)  # a comment may hold the signature; the record is followed by its comment and nothing else
    if at < 0:
        raise ValueError("no end record: not a ZIP package")
    count, size, start = struct.unpack_from("<HII", data, at + 10)
    end = length - tail + at
    if at >= LOCATOR_SIZE and data[at - LOCATOR_SIZE : at - LOCATOR_SIZE + 4] == LOCATOR:
        end64 = struct.unpack_from("<Q", data, at - LOCATOR_SIZE + 8)[0]
        for place in (end64, end - LOCATOR_SIZE - END64_SIZE):  # the second where bytes were put before the package
            source.seek(place)
            block = source.read(END64_SIZE)
            if block[:4] == END64:
                count, size, start = struct.unpack_from("<QQQ", block, 32)
                end = place
                break
    before = end - size - start  # bytes put before the package
    source.seek(start + before)
    data, at, found = source.read(size), 0, {}
    for _ in range(count):
        if data[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, plain = struct.unpack_from("<II", data, at + 20)
        name_n, extra_n, comment_n = struct.unpack_from("<HHH", data, at + 28)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + ENTRY_SIZE : at + ENTRY_SIZE + name_n].decode("utf-8", "replace")
        extra = data[at + ENTRY_SIZE + name_n : at + ENTRY_SIZE + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == ZIP64_FIELD:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                _, packed, offset = (next(wide) if v == FULL32 else v for v in (plain, packed, offset))
            extra = extra[4 + n :]
        found[name] = (offset + before, packed, method)
        at += ENTRY_SIZE + name_n + extra_n + comment_n
    return found


def stored(source, entry: tuple[int, int, int]) -> tuple[int, int]:
    """First byte and length of a stored member's data."""
    offset, length, method = entry
    if method:
        raise ValueError("the member is not stored")
    source.seek(offset)
    head = source.read(LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError("no local header")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return offset + LOCAL_SIZE + name_n + extra_n, length


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path in pdf["path"]:
            system, place = pafs.FileSystem.from_uri(path)
            with system.open_input_file(place) as source:
                members = directory(source)
                base, _ = stored(source, members[RECORDS])
                first, length = stored(source, members[INDEX])
                source.seek(first)
                rows, run, size = [], [], 0
                for line in source.read(length).decode().splitlines():
                    entry = json.loads(line.partition(" ")[2])
                    if run and (len(run) == BLOCK_RECORDS or size + entry["length"] > BLOCK_BYTES):
                        rows.append(run)
                        run, size = [], 0
                    run.append((base + entry["offset"], entry["length"]))
                    size += entry["length"]
                rows += [run] if run else []
            yield pd.DataFrame({"path": [path] * len(rows), "starts": [[a for a, _ in r] for r in rows], "lengths": [[n for _, n in r] for r in rows]})


FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _reader(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, starts, lengths in zip(pdf["path"], pdf["starts"], pdf["lengths"], strict=True):
                system, place = pafs.FileSystem.from_uri(path)
                with system.open_input_file(place) as source:
                    source.seek(starts[0])
                    data = source.read(starts[-1] + lengths[-1] - starts[0])
                found = pd.DataFrame([parse(zlib.decompress(data[a - starts[0] : a - starts[0] + n], 31)) for a, n in zip(starts, lengths, strict=True)])
                found = found.astype({"page_id": "Int64", "refers_to": "Int64"})
                yield found if with_payload else found.drop(columns="payload")

    return run


def read(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of packages (a table with their path): page_id, url, record_type, refers_to, payload_bytes, payload_digest, and if asked for the payload (null for revisits). Each task reads byte ranges that the index gives. No packages give an empty result."""
    parallel = 4 * packages.sparkSession.sparkContext.defaultParallelism
    blocks = packages.select("path").mapInPandas(_blocks, "path string, starts array<long>, lengths array<long>").repartition(parallel)
    return blocks.mapInPandas(_reader(with_payload), FIELDS + ", payload binary" * with_payload)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    return read(write(pages, new_path(spark, "warc"), least_bytes))
