"""Media columns of MPEG audio: frames that carry bytes losslessly, and a reader of frames, tags and tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: kilobits a second and samples a second by their number in the frame header, the samples of a
# frame, and the bytes of side information, each by version (MPEG 1; 2 and 2.5) and layer.
KBPS_1 = {1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
KBPS_2 = {1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES_1, SAMPLES_2 = {1: 384, 2: 1152, 3: 1152}, {1: 384, 2: 1152, 3: 576}
POLYNOMIAL, START = 0x8005, 0xFFFF
XING_BYTES = 8 + 4 + 4 + 100 + 4

#: What the writer makes: MPEG 1 layer III, 48 kHz, mono, every frame but the table's with a checksum.
SIDE, TOP_KBPS, TABLE_KBPS = 17, 14, 5
#: A tag of the old kind, without texts: with it, no payload's bytes can be taken for one.
OLD_TAG = b"TAG" + bytes(124) + b"\xff"


def crc16(data: bytes) -> int:
    c = START
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ POLYNOMIAL if c & 0x8000 else c << 1) & 0xFFFF
    return c


def parse_header(data: bytes, at: int) -> dict | None:
    """Fields of the frame header at a place, or None if there is none (reserved values, free format)."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, protected = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3), not data[at + 1] & 1
    kbps_n, rate_n, padding, mono = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1, data[at + 3] >> 6 == 3
    if version == 1 or layer == 4 or rate_n == 3 or not 1 <= kbps_n <= 14:
        return None
    kbps = (KBPS_1 if version == 3 else KBPS_2)[layer][kbps_n - 1]
    rate, samples = RATES[version][rate_n], (SAMPLES_1 if version == 3 else SAMPLES_2)[layer]
    length = (12 * kbps * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padding
    side = 0 if layer < 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    if layer == 1:  # four bits a subband and channel; from the bound on, the channels of joint stereo share them
        bound = 4 * (data[at + 3] >> 4 & 3) + 4 if data[at + 3] >> 6 == 1 else 32
        side = 16 if mono else (4 * bound + 4 * 32) // 8
    return {"version": version, "layer": layer, "protected": protected, "kbps": kbps, "rate": rate, "samples": samples, "length": length, "side": side}


def _head(kbps_n: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, kbps_n << 4 | 1 << 2, 0xC0))


_CHECKSUMS: dict[bytes, int] = {}


def _checksum(covered: bytes) -> int:
    """crc16, remembered: silent frames of one rate cover the same bytes."""
    if covered not in _CHECKSUMS:
        if len(_CHECKSUMS) > 10_000:
            _CHECKSUMS.clear()
        _CHECKSUMS[covered] = crc16(covered)
    return _CHECKSUMS[covered]


def encode(payload: bytes) -> bytes:
    """An audio file that carries the payload: an ID3v2 tag with its length, a frame with the variable-rate table, then silent frames, the payload's bytes lying where their ancillary data lie, and an empty ID3v1 tag. All but the last have the top bit rate."""
    room = {k: 3 * KBPS_1[3][k - 1] - 6 - SIDE for k in range(1, 15)}
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        k = min((k for k in room if room[k] >= left), default=TOP_KBPS)
        head, silent = _head(k, True), bytes(SIDE)
        part = payload[at : at + room[k]]
        frames.append(head + struct.pack(">H", _checksum(head[2:] + silent)) + silent + part + bytes(room[k] - len(part)))
        at += room[k]
    size, offsets, place = sum(map(len, frames)), [], 0
    for f in frames:
        offsets.append(place)
        place += len(f)
    table = 3 * KBPS_1[3][TABLE_KBPS - 1]
    size += table
    toc = bytes(min(255, 256 * (table + offsets[p * len(frames) // 100]) // size) for p in range(100)) if frames else bytes(100)
    xing = _head(TABLE_KBPS, False) + bytes(SIDE) + b"Xing" + struct.pack(">III", 15, len(frames), size) + toc + struct.pack(">I", 0)
    text = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    frame = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    tag = b"ID3\x03\x00\x00" + bytes(len(frame) >> s & 0x7F for s in (21, 14, 7, 0)) + frame
    return tag + xing + bytes(table - len(xing)) + b"".join(frames) + OLD_TAG


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Texts of a leading ID3v2 (2.3, 2.4) tag and a trailing ID3v1 tag; where audio begins and ends."""
    found, begin, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
        begin, at = min(10 + size, len(data)), 10
        while at + 10 <= begin and data[at : at + 4].strip(b"\0"):
            n = struct.unpack_from(">I", data, at + 4)[0] if data[3] < 4 else sum((b & 0x7F) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
            name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + n]
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
                found |= dict([text.split("\0", 1)]) if name == "TXXX" and "\0" in text else {name: text}
            at += 10 + n
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        old = {k: data[end + a : end + a + 30].rstrip(b"\0 ").decode("latin-1") for k, a in (("title", 3), ("artist", 33))}
        found |= {k: v for k, v in old.items() if v}
    return found, begin, end


def probe(data: bytes) -> dict:
    """What an audio file holds: tags, frames, samples, rate, exact duration, offsets of frames, the variable-rate table, checksums and the bytes that frames carry.

    Reading goes from frame to frame; where no header stands, bytes are skipped up to the next header that another header of
    the same kind follows (or that ends the file). A cut last frame is not counted. Checksums of layers I and III are verified; what
    those of layer II cover hangs on tables of allocations that are not read here.
    """
    tags, at, end = _tags(data)
    offsets, carried, skipped, bad, checked, table, rate, samples = [], [], 0, 0, 0, None, 0, 0
    synced = False
    while at + 4 <= end:
        h = parse_header(data, at)
        if h and not synced:
            after = at + h["length"]
            following = parse_header(data, after)
            if after != end and not (following and (following["version"], following["layer"], following["rate"]) == (h["version"], h["layer"], h["rate"])):
                h = None
        if h is None or at + h["length"] > end:
            synced = False
            skipped += 1
            at += 1
            continue
        synced, body = True, at + 4 + 2 * h["protected"]
        place = body + h["side"]
        if not offsets and table is None and data[place : place + 4] in (b"Xing", b"Info"):
            flags, n = struct.unpack_from(">I", data, place + 4)[0], place + 8
            table = {"kind": data[place : place + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name] = struct.unpack_from(">I", data, n)[0]
                    n += 4
            if flags & 4:
                table["toc"] = data[n : n + 100]
        elif not offsets and table is None and data[at + 36 : at + 40] == b"VBRI":
            table = dict(zip(("bytes", "frames"), struct.unpack_from(">II", data, at + 46), strict=True)) | {"kind": "VBRI"}
        else:
            if h["protected"] and h["layer"] != 2:
                checked += 1
                bad += _checksum(data[at + 2 : at + 4] + data[body : body + h["side"]]) != struct.unpack_from(">H", data, at + 4)[0]
            offsets.append(at)
            samples, rate = samples + h["samples"], h["rate"]
            carried.append(data[body + h["side"] : at + h["length"]])
        at += h["length"]
    skipped += end - at
    payload = b"".join(carried)
    if "payload_bytes" in tags:
        payload = payload[: int(tags["payload_bytes"])]
    return {"tags": tags, "offsets": offsets, "samples": samples, "rate": rate, "duration_s": samples / rate if rate else 0.0, "table": table, "checked": checked, "bad": bad, "skipped": skipped, "payload": payload}


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 512):
            part = pdf.iloc[at : at + 512]
            raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(b) for b in raw], "media": [encode(b + bytes(-len(b) % 64 or (0 if b else 64))) for b in raw]})


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text of docs (doc_id, text) as UTF-8 with zero bytes up to a positive multiple of 64, carried by an audio file. A null text is empty. Repeated rows stay."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_store, "doc_id long, n_bytes long, media binary")


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for media in pdf["media"]:
            p = probe(media)
            seek = p["offsets"]
            t = p["table"] or {"kind": "none", "frames": -1, "bytes": -1}
            out.append({
                "payload_bytes": len(p["payload"]), "payload_sha256": hashlib.sha256(p["payload"]).hexdigest(), "tail_crc32": zlib.crc32(p["payload"][-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                "feature": f"frames={len(p['offsets'])};samples={p['samples']};rate={p['rate']};table={t['kind']}:{t.get('frames')}:{t.get('bytes')};checked={p['checked']};bad={p['bad']};skipped={p['skipped']};seek={','.join(map(str, seek))}",
                "n_frames": len(p["offsets"]), "duration_s": p["duration_s"], "seek_offsets": seek,
            })
        found = pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_s", "seek_offsets"])
        yield pd.concat([pdf[["doc_id", "n_bytes"]].astype({"doc_id": "Int64"}).reset_index(drop=True), found], axis=1)


def features(media: DataFrame) -> DataFrame:
    """Per row of media (doc_id, n_bytes, media): digests of the carried bytes and of the file, frames, exact duration, the byte offset of every frame, and all of it as one feature text. Repeated rows get equal results; an empty table gives an empty result."""
    return media.mapInPandas(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_s double, seek_offsets array<long>")
