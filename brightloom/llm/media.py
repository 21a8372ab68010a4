"""Media columns in the ISO base media format: write payloads as 8-bit samples, and read codec, duration, sample tables
and keyframe byte ranges from the boxes alone, without decoding a payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 192  #: bytes of a media sample; payloads are padded to a multiple
PER_CHUNK = 64  #: samples of a chunk
KEY_EVERY = 16  #: every so many samples one is a sync sample
TIMESCALE = 8000  #: units of time in a second; a byte is one unit
#: Boxes that hold boxes. Fixed values of the format.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: The unity transformation of the movie and track headers. Fixed value of the format.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

MEDIA = "media binary, payload_bytes long"
KEYFRAMES = "array<struct<sample: long, at: long, length: long>>"
PARSED = f"brand string, tracks array<struct<number: long, codec: string, handler: string, timescale: long, duration: long, chunks: long, samples: long, sample_bytes: long, keyframes: {KEYFRAMES}>>, problem string"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text and its unpadded length: UTF-8 and spaces up to a positive multiple of `UNIT`."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT)), len(data)


def mux(payload: bytes) -> bytes:
    """A file of one track of raw 8-bit samples, whose sample tables say where each unit of `payload` lies."""
    samples = len(payload) // UNIT
    chunks = -(-samples // PER_CHUNK)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    start = len(head) + (8 if len(payload) + 8 < 1 << 32 else 16)
    offsets = start + np.arange(chunks, dtype=np.int64) * PER_CHUNK * UNIT
    last = samples - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] if last == PER_CHUNK else [(1, PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)]
    sync = np.arange(1, samples + 1, KEY_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    tables = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, samples, UNIT)),
        full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", UNIT, samples)),
        full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()),
    )
    length = samples * UNIT
    minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables)
    mdia = box(
        b"mdia",
        full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, length, 0x55C4, 0), version=1),
        full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"),
        minf,
    )
    tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), MATRIX, bytes(8), version=1, flags=3)
    mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, length), struct.pack(">IH", 0x10000, 256), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    return head + box(b"mdat", payload) + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start and end of the body) of each box, outer ones first. ValueError if a box overruns what holds it."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise ValueError("cut header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("cut header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"{kind!r} overruns")
        yield (*path, kind), body, stop
        if kind in CONTAINERS and len(path) < 16:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def counted(data: memoryview, body: int, end: int, kind: str, columns: int, skip: int = 4) -> np.ndarray:
    """A table of `columns` numbers a row after its count, as int64."""
    (n,) = struct.unpack_from(">I", data, body + skip)
    if body + skip + 4 + n * columns * np.dtype(kind).itemsize > end:
        raise ValueError("table overruns its box")
    return np.frombuffer(data, kind, n * columns, body + skip + 4).astype(np.int64).reshape(n, columns)


def sample_table(view: memoryview, found: dict[bytes, tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sizes, places and keyframe numbers of the samples that a track's tables list, and the number of chunks."""
    body, end = found[b"stsz"]
    (same, n) = struct.unpack_from(">II", view, body + 4)
    sizes = np.full(n, same, np.int64) if same else counted(view, body, end, ">u4", 1, skip=8)[:, 0]
    offsets = counted(view, *found[b"co64"], ">u8", 1) if b"co64" in found else counted(view, *found[b"stco"], ">u4", 1)
    runs = counted(view, *found[b"stsc"], ">u4", 3)
    upto = np.append(runs[1:, 0], len(offsets) + 1)
    per_chunk = np.repeat(runs[:, 1], upto - runs[:, 0]) if len(runs) else np.zeros(0, np.int64)
    chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)[:n]
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    if len(chunk_of) < n:
        raise ValueError("samples lie outside the file")
    at = offsets[chunk_of, 0] + before - before[first[chunk_of]]
    if n and (at + sizes).max() > size:
        raise ValueError("samples lie outside the file")
    keys = counted(view, *found[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in found else np.arange(n)
    return sizes, at, keys[keys < n], len(offsets)


def optional(view: memoryview, at: int, flags: int, fields: list[tuple[int, str]]) -> tuple[dict[int, int], int]:
    """Values by flag of the fields that `flags` says are there, and where they end."""
    told = {}
    for flag, kind in fields:
        if flags & flag:
            (told[flag],) = struct.unpack_from(f">{kind}", view, at)
            at += struct.calcsize(f">{kind}")
    return told, at


def run_of(view: memoryview, body: int, end: int, header: dict, at: int) -> tuple[list[tuple[int, int, bool, int]], int]:
    """(size, place, key, duration) of each sample of a fragment's run, and where its data ends; `at` is where the run before ended."""
    flags, n = struct.unpack_from(">II", view, body)
    told, place = optional(view, body + 8, flags, [(0x1, "i"), (0x4, "I")])
    at = header["base"] + told[0x1] if 0x1 in told else at
    samples = []
    for k in range(n):
        own, place = optional(view, place, flags, [(0x100, "I"), (0x200, "I"), (0x400, "I"), (0x800, "I")])
        if place > end:
            raise ValueError("table overruns its box")
        length = own.get(0x200, header["size"])
        marks = own.get(0x400, told[0x4] if not k and 0x4 in told else header["flags"])
        if at + length > len(view):
            raise ValueError("samples lie outside the file")
        samples.append((length, at, not marks & 0x10000, own.get(0x100, header["duration"])))
        at += length
    return samples, at


def tracks(data: bytes) -> list[dict]:
    """What the boxes say of each track, fragments included; payload bytes aren't touched. ValueError for what is no whole file."""
    view, brand = memoryview(data), None
    boxes: list[dict[bytes, tuple[int, int]]] = []
    extends: dict[int, dict] = {}
    fragments: dict[int, list] = {}
    header, at, moof = {}, 0, 0
    for path, body, end in walk(view):
        if path == (b"ftyp",):
            brand = bytes(view[body : body + 4]).decode("latin-1")
        elif path == (b"moov", b"trak"):
            boxes.append({})
        elif path[:2] == (b"moov", b"trak"):
            boxes[-1][path[-1]] = (body, end)
        elif path == (b"moov", b"mvex", b"trex"):
            number, _, duration, size, flags = struct.unpack_from(">5I", view, body + 4)
            extends[number] = {"duration": duration, "size": size, "flags": flags}
        elif path == (b"moof",):
            moof = body - 8
        elif path == (b"moof", b"traf", b"tfhd"):
            flags, number = struct.unpack_from(">II", view, body)
            told, _ = optional(view, body + 8, flags & 0xFFFFFF, [(0x1, "Q"), (0x2, "I"), (0x8, "I"), (0x10, "I"), (0x20, "I")])
            usual = extends.get(number, {"duration": 0, "size": 0, "flags": 0})
            header = {"number": number, "base": told.get(0x1, moof), "duration": told.get(0x8, usual["duration"]), "size": told.get(0x10, usual["size"]), "flags": told.get(0x20, usual["flags"])}
            at = header["base"]
        elif path == (b"moof", b"traf", b"trun"):
            if not header:
                raise ValueError("a run without its header")
            samples, at = run_of(view, body, end, header, at)
            fragments.setdefault(header["number"], []).extend(samples)
    if not boxes or any(b"stsd" not in found for found in boxes):
        raise ValueError("no track")
    out = []
    for found in boxes:
        body = found[b"tkhd"][0]
        (number,) = struct.unpack_from(">I", view, body + (20 if view[body] == 1 else 12))
        body = found[b"mdhd"][0]
        timescale, duration = struct.unpack_from(">IQ", view, body + 20) if view[body] == 1 else struct.unpack_from(">II", view, body + 12)
        sizes, places, keys, chunks = sample_table(view, found, len(data))
        if more := fragments.get(number):
            length, where, key, lasts = (np.array(c, np.int64) for c in zip(*more, strict=True))
            keys = np.append(keys, len(sizes) + np.flatnonzero(key))
            sizes, places, duration = np.append(sizes, length), np.append(places, where), duration or int(lasts.sum())
        kind, handler = found[b"stsd"][0], found[b"hdlr"][0]
        out.append({
            "brand": brand, "number": number, "codec": bytes(view[kind + 12 : kind + 16]).decode("latin-1"), "handler": bytes(view[handler + 8 : handler + 12]).decode("latin-1"),
            "timescale": timescale, "duration": duration, "sizes": sizes, "at": places, "chunks": chunks, "keys": keys,
        })
    return out


def parse(data: bytes) -> dict:
    """What the boxes say of the first track."""
    return tracks(data)[0]


def keyframes_of(told: dict) -> list[dict]:
    keys = told["keys"]
    return [{"sample": k, "at": a, "length": n} for k, a, n in zip(keys.tolist(), told["at"][keys].tolist(), told["sizes"][keys].tolist(), strict=True)]


def payload_of(data: bytes, told: dict) -> bytes:
    """The samples' bytes in order, read from where the tables say they are."""
    at, ends = told["at"], told["at"] + told["sizes"]
    new = np.flatnonzero(np.append(True, at[1:] != ends[:-1])) if len(at) else np.zeros(0, int)
    return b"".join(data[at[a] : ends[b - 1]] for a, b in zip(new, np.append(new[1:], len(at)), strict=True))


def feature_of(told: dict) -> str:
    keys, at, sizes = told["keys"], told["at"], told["sizes"]
    spans = hashlib.sha256(np.stack([at[keys], sizes[keys]]).astype("<i8").tobytes()).hexdigest()[:16]
    return f"{told['codec']}/{told['handler']}/{told['timescale']}/{told['duration']}/{len(sizes)}/{told['chunks']}/{len(keys)}/{spans}"


def to_media(text: Column) -> Column:
    """The file that holds each whole text's payload (binary); null and empty ones are one unit of spaces, equal texts give equal files."""

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([mux(padded(t)[0]) for t in texts], dtype=object)

    return stored(text)


def read_boxes(df: DataFrame, media: str = "media", out: str = "file") -> DataFrame:
    """`df` with struct `out` of what each file's boxes say: brand, tracks and problem.

    Each track has its number, codec, handler, timescale, duration, samples, bytes, chunks and the byte range of each
    keyframe, samples of fragments included. Null, empty or broken files have no tracks and say why in `problem`.
    """

    @F.pandas_udf(PARSED)
    def parsed(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            row = {"brand": None, "tracks": [], "problem": None if data else "no bytes"}
            try:
                for told in tracks(data) if data else []:
                    row["brand"] = told["brand"]
                    row["tracks"].append({k: told[k] for k in ("number", "codec", "handler", "timescale", "duration", "chunks")} | {"samples": len(told["sizes"]), "sample_bytes": int(told["sizes"].sum()), "keyframes": keyframes_of(told)})
            except (ValueError, KeyError, IndexError, struct.error) as e:
                row |= {"tracks": [], "problem": str(e) or type(e).__name__}
            rows.append(row)
        return pd.DataFrame(rows)

    return df.withColumn(out, parsed(media))


def media_digest(df: DataFrame, media: str = "media", out: str = "digest") -> DataFrame:
    """`df` with struct `out`: sizes and digests of each file and of the payload that its sample tables lead to, a feature, and what the boxes say.

    A null or broken file has its problem told and null instead of what can't be read; a null one has no size or digest
    either. Repeated rows are digested each; an existing column `out` is replaced; an empty table stays empty.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "timescale", "duration", "keyframes", "problem"]

    @F.pandas_udf(f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, timescale long, duration long, keyframes {KEYFRAMES}, problem string")
    def digested(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            row = dict.fromkeys(names) | {"problem": None if data is not None else "no bytes"}
            if data is not None:
                row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                try:
                    told = parse(data)
                    payload = payload_of(data, told)
                    row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "feature": feature_of(told)}
                    row |= {"codec": told["codec"], "timescale": told["timescale"], "duration": told["duration"], "keyframes": keyframes_of(told)}
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    row["problem"] = str(e) or type(e).__name__
            rows.append(row)
        found = pd.DataFrame(rows, columns=names)
        whole = ["payload_bytes", "tail_crc32", "media_bytes", "timescale", "duration"]
        return found.astype({c: "Int64" for c in whole})

    return df.withColumn(out, digested(media))


def document_media(docs: DataFrame) -> DataFrame:
    """Each row of `docs` stored as a media file and read back: doc_id, n_bytes, the digest columns, codec, timescale, duration, keyframes.

    A null or empty text is one unit of spaces; repeated rows and null ids give their rows each; other columns don't
    matter; an empty table gives an empty one.
    """
    stored = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), to_media(F.col("text")).alias("media"))
    return media_digest(stored).select("doc_id", "n_bytes", "digest.*")
