"""Signature sniffing of binary media columns.

An Aho-Corasick automaton finds the magic bytes of all known formats at once;
the format's validator then confirms structure and lengths at each hit.  A hit at
offset 0 corrects the declared type, hits further in are carved as embedded media.

A null or empty value has no media: type ``application/octet-stream``, nothing
carved.  Magic bytes that no validator confirms are ignored, so text which
happens to hold them is left alone.  Equal values give equal results.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

UNKNOWN = "application/octet-stream"


class Marks:
    """Places in a value that validators look ahead for, and places that are known to lead nowhere.

    Found once a value, so that the work of all hits together stays in
    proportion to its size.
    """

    def __init__(self, value: bytes):
        self.value = value
        self._at: dict[bytes, list[int]] = {}
        self.dead: set[tuple] = set()

    def next(self, pattern: bytes, start: int) -> int:
        """First match of ``pattern`` at or after ``start``, -1 if there is none."""
        if pattern not in self._at:
            self._at[pattern] = [m.start() for m in re.finditer(pattern, self.value)]
        at = self._at[pattern]
        k = bisect.bisect_left(at, start)
        return at[k] if k < len(at) else -1


class Found(NamedTuple):
    """A confirmed file inside a value: its type, extent, and the extent of its sample data if the format has such."""

    kind: str
    start: int
    length: int
    data_start: int = 0
    data_length: int = 0


def _wav(b: memoryview, at: int, marks: Marks) -> Found | None:
    if len(b) - at < 12 or bytes(b[at + 8 : at + 12]) != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    p, form, data = at + 12, False, None
    while p + 8 <= end:
        name, size = bytes(b[p : p + 4]), int.from_bytes(b[p + 4 : p + 8], "little")
        if p + 8 + size > end:
            return None
        form |= name == b"fmt " and size >= 16
        if name == b"data" and form:
            data = (p + 8, size)
        p += 8 + size + (size & 1)
    return Found("audio/wav", at, end - at, *data) if form and data else None


def _bmp(b: memoryview, at: int, marks: Marks) -> Found | None:
    if len(b) - at < 54:
        return None
    size, zero, first, head = struct.unpack_from("<IIII", b, at + 2)
    if zero or head < 40 or first < 14 + head or not first <= size <= len(b) - at:
        return None
    width, height, planes, bits, packing = struct.unpack_from("<iiHHI", b, at + 18)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packing or width <= 0 or not height:
        return None
    need = (width * bits + 31) // 32 * 4 * abs(height)
    return Found("image/bmp", at, size, at + first, need) if first + need <= size else None


def _png(b: memoryview, at: int, marks: Marks) -> Found | None:
    p, names = at + 8, []
    while p + 12 <= len(b):
        size, name = int.from_bytes(b[p : p + 4], "big"), bytes(b[p + 4 : p + 8])
        if p + 12 + size > len(b) or zlib.crc32(b[p + 4 : p + 8 + size]) != int.from_bytes(b[p + 8 + size : p + 12 + size], "big"):
            return None
        names.append(name)
        p += 12 + size
        if name == b"IEND":
            return Found("image/png", at, p - at) if names[0] == b"IHDR" and b"IDAT" in names else None
    return None


def _gif(b: memoryview, at: int, marks: Marks) -> Found | None:
    if len(b) - at < 14:
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    frames = 0
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return Found("image/gif", at, p + 1 - at) if frames else None
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
            frames += 1
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: memoryview, at: int, marks: Marks) -> Found | None:
    p, scan, met = at + 2, False, []
    while p + 2 <= len(b) and b[p] == 0xFF and ("jpeg", p, scan) not in marks.dead:
        met.append(("jpeg", p, scan))
        mark = b[p + 1]
        if mark == 0xD9:
            if scan:
                return Found("image/jpeg", at, p + 2 - at)
            break
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if p + 4 > len(b) or size < 2 or not 0xC0 <= mark <= 0xFE:
            break
        p += 2 + size
        if mark == 0xDA:  # what follows a scan's header runs up to the next marker that isn't stuffed or a restart
            scan = True
            p = marks.next(rb"\xff[^\x00\xd0-\xd7]", p)
            if p < 0:
                break
    marks.dead.update(met)  # what comes after a marker doesn't depend on where the file began
    return None


def _gzip(b: memoryview, at: int, marks: Marks) -> Found | None:
    if len(b) - at < 18 or b[at + 3] & 0xE0:
        return None
    d, size, p = zlib.decompressobj(31), 0, at
    try:
        while not d.eof and p < len(b):
            size += len(d.decompress(b[p : p + 65536]))
            p += 65536
    except zlib.error:
        return None
    return Found("application/gzip", at, min(p, len(b)) - len(d.unused_data) - at) if d.eof else None


def _zip(b: memoryview, at: int, marks: Marks) -> Found | None:
    p, met = at, []
    while len(b) - p >= 30 and bytes(b[p : p + 4]) == b"PK\x03\x04":
        met.append(("zip", p))
        flags, = struct.unpack_from("<H", b, p + 6)
        packed, _, names, extra = struct.unpack_from("<IIHH", b, p + 18)
        if flags & 8 or ("zip", p) in marks.dead:
            marks.dead.update(met)
            return None
        p += 30 + names + extra + packed
    while len(b) - p >= 46 and bytes(b[p : p + 4]) == b"PK\x01\x02":
        p += 46 + sum(struct.unpack_from("<HHH", b, p + 28))
    if len(b) - p < 22 or bytes(b[p : p + 4]) != b"PK\x05\x06":
        marks.dead.update(met)
        return None
    return Found("application/zip", at, p + 22 + int.from_bytes(b[p + 20 : p + 22], "little") - at)


def _pdf(b: memoryview, at: int, marks: Marks) -> Found | None:
    end, table = marks.next(b"%%EOF", at), marks.next(b"startxref", at)
    return Found("application/pdf", at, end + 5 - at) if 0 < table < end and bytes(b[at + 5 : at + 6]).isdigit() else None


#: Magic bytes of the formats, and their validators.
SIGNATURES: list[tuple[bytes, Callable[[memoryview, int, Marks], Found | None]]] = [
    (b"RIFF", _wav),
    (b"BM", _bmp),
    (b"\x89PNG\r\n\x1a\n", _png),
    (b"GIF87a", _gif),
    (b"GIF89a", _gif),
    (b"\xff\xd8\xff", _jpeg),
    (b"\x1f\x8b\x08", _gzip),
    (b"PK\x03\x04", _zip),
    (b"%PDF-", _pdf),
]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (magic, _) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), (k, len(magic)))
    a.make_automaton()
    return a


def sniff(value: bytes | None) -> list[Found]:
    """Confirmed files in order of their start; files inside another one are not carved again."""
    if not value:
        return []
    view, found, end, marks = memoryview(value), [], 0, Marks(value)
    hits = sorted((stop - size + 1, k) for stop, (k, size) in automaton().iter(value.decode("latin-1")))
    for start, k in hits:
        if start >= end and (f := SIGNATURES[k][1](view, start, marks)):
            found.append(f)
            end = f.start + f.length
    return found


def type_of(found: list[Found]) -> str:
    return found[0].kind if found and found[0].start == 0 else UNKNOWN


def wav_bytes(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM; a chunk of odd size gets its pad byte."""
    pad = b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes filled with 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def sniff_column(df: DataFrame, value: str = "media", declared: str = "declared_type") -> DataFrame:
    """``df`` with ``actual_type`` (the declared type corrected) and ``carved``: array of type, start, length.

    Columns of those two names in ``df`` are replaced.
    """
    kept = [c for c in df.columns if c not in ("actual_type", "carved")]
    at, of = kept.index(value), kept.index(declared)
    part = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("actual_type", T.StringType()), T.StructField("carved", T.ArrayType(part))])
    arrow_part = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sniff(v) for v in batch.column(at).to_pylist()]
            kinds = [type_of(f) if f and f[0].start == 0 else d for f, d in zip(found, batch.column(of).to_pylist(), strict=True)]
            carved = [[{"type": x.kind, "start": x.start, "length": x.length} for x in f if x.start] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(carved, arrow_part)], [f.name for f in schema])

    return df.select(*kept).mapInArrow(run, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Each text as an 8-bit WAV value whose samples are its payload, found again by sniffing the stored bytes.

    Returns the digests of the payload as read back, of the stored form, and a
    feature: the sniffed type, the number of files carved out of the payload and
    the mean sample.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]

    def one(text: str | None) -> tuple:
        size, payload = payload_of(text)
        media = wav_bytes(payload)
        found = sniff(media)
        f = found[0]
        back = media[f.data_start : f.data_start + f.data_length]
        feature = f"{type_of(found)};carved={len(sniff(back))};mean={sum(back) // len(back)}"
        return size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(one, batch.column(1).to_pylist()), strict=True)) or [[]] * 7
            types = [pa.int64() if isinstance(k, T.LongType) else pa.string() for k in kinds[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)
