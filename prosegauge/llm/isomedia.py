"""Media columns in ISO base media containers.

``write`` stores a payload losslessly as one track of unsigned 8-bit samples in an ISO container (ftyp, moov, mdat).
``probe`` walks the nested boxes of any such file, decodes the sample tables (stts, stsc, stsz or stz2, stco or co64,
stss) and returns codec, duration and the byte range that each keyframe and its dependent samples fill.  It never
reads what is in mdat; ``payload`` copies those ranges out, still without decoding.

The media column is made and read in one pass over bounded slices, without a shuffle; a task holds one text and its
container at a time.  Nulls and edge cases: a null text is an empty one, an empty payload is 64 zero bytes (one
sample); equal texts give equal containers, so repeated rows give equal rows; a file that is cut short, damaged or
fragmented (samples in moof boxes) gives a ``Probe`` whose ``error`` says why, never an exception.  An empty table gives an empty result.  Other columns
do not matter.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts_of

#: Bytes of a sample (an access unit of 64 frames of 8-bit mono), samples between keyframes, frames a second.
UNIT, GROUP, RATE = 64, 64, 8000
#: Boxes within boxes at most.
DEEPEST = 64
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write(payload: bytes) -> bytes:
    """A container with ``payload`` (a positive multiple of ``UNIT`` bytes) as the samples of one track."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of the unit")
    chunks = -(-units // GROUP)
    last = units - (chunks - 1) * GROUP
    runs = [(1, GROUP)] * (chunks > 1) + [(chunks, last)] * (last != GROUP or chunks == 1)
    wide = len(payload) + 4096 + 8 * chunks >= 1 << 32
    frames = len(payload)

    def moov(first: int) -> bytes:
        places = [first + i * GROUP * UNIT for i in range(chunks)]
        entry = box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, 0, struct.pack(">III", 1, units, UNIT)),
            full_box(b"stss", 0, 0, struct.pack(f">I{chunks}I", chunks, *range(1, units + 1, GROUP))),
            full_box(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, n, 1) for a, n in runs)),
            full_box(b"stsz", 0, 0, struct.pack(">II", UNIT, units)),
            full_box(b"co64" if wide else b"stco", 0, 0, struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *places)),
        )
        dinf = box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1)))
        minf = box(b"minf", full_box(b"smhd", 0, 0, b"\0" * 4), dinf, stbl)
        times = struct.pack(">QQIQ", 0, 0, RATE, frames)
        mdia = box(b"mdia", full_box(b"mdhd", 1, 0, times, struct.pack(">HH", 0x55C4, 0)), full_box(b"hdlr", 0, 0, b"\0" * 4, b"soun", b"\0" * 13), minf)
        tkhd = full_box(b"tkhd", 1, 3, struct.pack(">QQIIQ", 0, 0, 1, 0, frames), b"\0" * 8, struct.pack(">hhhH", 0, 0, 0x100, 0), MATRIX, b"\0" * 8)
        mvhd = full_box(b"mvhd", 1, 0, times, struct.pack(">iH", 0x10000, 0x100), b"\0" * 10, MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    mdat = box(b"mdat", payload)
    return head + moov(len(head) + len(moov(0)) + len(mdat) - len(payload)) + mdat


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    samples: int = 0
    #: (first sample, first byte, byte after the last) of each contiguous run that a keyframe begins.
    keyframes: list[tuple[int, int, int]] = field(default_factory=list)
    ranges: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Probe:
    brand: str = ""
    tracks: list[Track] = field(default_factory=list)
    boxes: list[str] = field(default_factory=list)
    error: str | None = None


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(path, first byte of the body, its end) of every box, in depth-first order."""
    todo = [(start, end, "")]  # what is left of each box that is open
    while todo:
        start, end, path = todo.pop()
        if start == end:
            continue
        if end - start < 8:
            raise ValueError(f"{end - start} stray bytes in {path or 'the file'}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a large size is cut short")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        here = f"{path}/{kind.decode('latin-1')}"
        yield here, start + head, start + size
        todo.append((start + size, end, path))
        if kind in CONTAINERS:
            if len(todo) > DEEPEST:
                raise ValueError(f"boxes are nested over {DEEPEST} deep")
            todo.append((start + head, start + size, here))


class Same:
    """So many equal sizes."""

    def __init__(self, size: int, n: int) -> None:
        self.size, self.n = size, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        return self.size


def _table(data: memoryview, at: int, end: int, form: str, skip: int = 4) -> list[tuple]:
    """The rows of a counted table whose count stands ``skip`` bytes into the box."""
    (n,) = struct.unpack_from(">I", data, at + skip)
    size = struct.calcsize(">" + form)
    if at + skip + 4 + n * size > end:
        raise ValueError("a sample table is cut short")
    return list(struct.iter_unpack(">" + form, data[at + skip + 4 : at + skip + 4 + n * size]))


def _sizes(data: memoryview, boxes: dict[str, tuple[int, int]]) -> Sequence[int] | Same:
    if "stsz" in boxes:
        at, end = boxes["stsz"]
        one, n = struct.unpack_from(">II", data, at + 4)
        if one and one * n > len(data):
            raise ValueError(f"{n} samples of {one} bytes are more than the file")
        return Same(one, n) if one else [x for (x,) in _table(data, at, end, "I", 8)]
    if "stz2" not in boxes:
        raise ValueError("no sample sizes")
    at, end = boxes["stz2"]
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    body = data[at + 12 : end]
    if bits not in (4, 8, 16) or len(body) * 8 < n * bits:
        raise ValueError("compact sample sizes are damaged")
    if bits == 4:
        return [body[i // 2] >> (4 if i % 2 == 0 else 0) & 15 for i in range(n)]
    return list(struct.unpack_from(f">{n}{'B' if bits == 8 else 'H'}", body))


def _track(data: memoryview, boxes: dict[str, tuple[int, int]]) -> Track:
    out = Track()
    if "hdlr" in boxes:
        out.handler = bytes(data[boxes["hdlr"][0] + 8 : boxes["hdlr"][0] + 12]).decode("latin-1")
    at, _ = boxes["mdhd"]
    out.timescale, out.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    at, end = boxes["stsd"]
    if struct.unpack_from(">I", data, at + 4)[0]:
        out.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    sizes = _sizes(data, boxes)
    offsets = [x for (x,) in (_table(data, *boxes["co64"], "Q") if "co64" in boxes else _table(data, *boxes["stco"], "I"))]
    runs = _table(data, *boxes["stsc"], "III")
    out.samples = len(sizes)
    times = _table(data, *boxes["stts"], "II")
    if not out.duration:
        out.duration = sum(n * d for n, d in times)
    keys = {n for (n,) in _table(data, *boxes["stss"], "I")} if "stss" in boxes else None
    sample, run = 0, -1
    for chunk, at in enumerate(offsets, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
            run += 1
        for _ in range(runs[run][1] if run >= 0 else 0):
            if sample == len(sizes):
                break
            end = at + sizes[sample]
            if end > len(data):
                raise ValueError(f"sample {sample + 1} lies beyond the file")
            sample += 1
            if keys is None or sample in keys:
                out.keyframes.append((sample, at, end))
            elif out.keyframes and out.keyframes[-1][2] == at:
                out.keyframes[-1] = (*out.keyframes[-1][:2], end)
            if out.ranges and out.ranges[-1][1] == at:
                out.ranges[-1] = (out.ranges[-1][0], end)
            else:
                out.ranges.append((at, end))
            at = end
    if sample != len(sizes):
        raise ValueError(f"chunks hold {sample} of {len(sizes)} samples")
    return out


def probe(media: bytes) -> Probe:
    """What the container says about its tracks.  Payload bytes are not read."""
    out, data = Probe(), memoryview(media)
    try:
        track: dict[str, tuple[int, int]] = {}
        tracks = []
        for path, at, end in walk(data, 0, len(data)):
            out.boxes.append(path)
            name = path.rpartition("/")[2]
            if name == "ftyp":
                out.brand = bytes(data[at : at + 4]).decode("latin-1")
            elif name == "trak":
                tracks.append(track := {})
            elif "/trak/" in path:
                track[name] = (at, end)
            elif name == "moof":
                raise ValueError("a fragmented file: its samples are not in sample tables")
        out.tracks = [_track(data, t) for t in tracks]
    except (ValueError, KeyError, IndexError, struct.error) as e:
        out.error = f"missing box {e}" if isinstance(e, KeyError) else str(e)
    return out


def payload(media: bytes, track: Track) -> bytes:
    return b"".join(media[a:b] for a, b in track.ranges)


def feature(found: Probe) -> str:
    """Codec, duration in seconds, samples and keyframe byte ranges of the first track, as JSON."""
    if found.error or not found.tracks:
        return json.dumps({"error": found.error or "no track"})
    t = found.tracks[0]
    seconds = t.duration / t.timescale if t.timescale else None
    return json.dumps({"brand": found.brand, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "seconds": seconds, "samples": t.samples, "keyframes": [[a, b] for _, a, b in t.keyframes]}, separators=(",", ":"))


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT if text else UNIT)


def media_column(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes of the text and ``media``, the container that stores its UTF-8 bytes."""

    def store(part: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode() for t in texts_of(part.column(1)).to_pylist()]
        media = [write(padded(t)) for t in raw]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), store, "doc_id long, n_bytes long, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Reads each container of ``media`` (doc_id, n_bytes, media) back: digests of payload and container, and its feature."""

    def digest(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in part.column(2).to_pylist():
            found = probe(data)
            body = payload(data, found.tracks[0]) if found.tracks and not found.error else b""
            rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(found)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_slices(media.select("doc_id", "n_bytes", "media"), digest, schema, 2)
