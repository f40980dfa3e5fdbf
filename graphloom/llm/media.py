"""Media columns: signature sniffing.

An Aho-Corasick automaton locates all magic bytes in a value in one pass. At each place a validator for that format reads
the structure that should follow and confirms it, with its exact length, or rejects the place. The format confirmed at
byte 0 corrects the declared type; those confirmed further in are carved as embedded media.

Null and empty values give type ``application/octet-stream``, length 0 and no parts. A value whose format is cut short
fails its validator and stays unknown. Parts that lie inside a part already carved are not carved again. Repeated rows are
each sniffed; an empty table gives no rows. Validators of one value share what they have walked (``Scan``), so the time is
linear in its length, also where very long values repeat a magic without end. Extra columns play no part, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common

UNKNOWN = "application/octet-stream"
#: What stored texts are declared to be.
DECLARED = ("audio/wav", "text/plain", UNKNOWN, "image/bmp")


@dataclass(frozen=True)
class Part:
    kind: str
    start: int
    length: int


class Scan:
    """A value, and what validators have found out about its places."""

    def __init__(self, data: bytes):
        self.data = data
        self._ends: dict[Callable, dict[int, int]] = {}

    def follow(self, step: Callable[[Scan, int], tuple[int, bool] | None], here: int) -> int:
        """Where a chain of steps from a place ends, 0 if it breaks off; no place is stepped from twice. step: the next place and whether it is the end, or nothing."""
        ends, path = self._ends.setdefault(step, {}), []
        while True:
            if here in ends:
                end = ends[here]
                break
            path.append(here)
            found = step(self, here)
            if found is None or found[1]:
                end = found[0] if found else 0
                break
            here = found[0]
        for p in path:
            ends[p] = end
        return end

    @cached_property
    def marks(self) -> np.ndarray:
        """Places of 0xFF that begin a marker, in coded image data."""
        data = np.frombuffer(self.data, np.uint8)
        place = np.flatnonzero(data[:-1] == 0xFF)
        after = data[place + 1]
        return place[(after != 0) & ((after < 0xD0) | (after > 0xD7))]

    @cached_property
    def pdf_ends(self) -> dict[int, int]:
        """By header, the end of the last revision whose start of references, counted from that header, is a table or an object."""
        data = self.data
        targets = [m.start() for m in re.finditer(rb"(?<!start)xref|(?<!\d)\d{1,10} \d{1,5} obj", data)]
        known, headers = set(targets), [m.start() for m in re.finditer(rb"%PDF-\d", data)]
        found: dict[int, int] = {}
        for m in re.finditer(rb"startxref\s{1,4}(\d{1,10})\s{1,4}%%EOF", data):
            at, before = int(m[1]), bisect_left(targets, m.start())
            # The references lie just before the end, or near the beginning of the nearest header.
            near = {t - at for t in targets[max(0, before - 3) : before]}
            nearest = bisect_left(headers, m.start())
            near |= {h for h in headers[max(0, nearest - 1) : nearest] if h + at in known}
            for h in near:
                found[h] = max(found.get(h, 0), m.end())
        return found

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """By beginning, the end of an archive: its end record points back to a directory, and its comment is whole."""
        data, found = self.data, {}
        for m in re.finditer(rb"PK\x05\x06", data):
            end = m.start()
            if end + 22 <= len(data):
                size, start, note = struct.unpack_from("<IIH", data, end + 12)
                if end - size - start >= 0 and end + 22 + note <= len(data) and (size == 0 or data[end - size : end - size + 4] == b"PK\x01\x02"):
                    found[end - size - start] = end + 22 + note
        return found


def _wav(scan: Scan, at: int) -> int:
    """RIFF: the chunks must fill the declared size, with a format and a data chunk."""
    b = scan.data
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    names, here = set(), at + 12
    while here + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, here)
        names.add(name)
        here += 8 + n + (n & 1)
    return end - at if here == end and {b"fmt ", b"data"} <= names else 0


def _png_chunk(scan: Scan, here: int) -> tuple[int, bool] | None:
    b = scan.data
    if here + 12 > len(b):
        return None
    n, name = struct.unpack_from(">I4s", b, here)
    if here + 12 + n > len(b) or zlib.crc32(memoryview(b)[here + 4 : here + 8 + n]) != struct.unpack_from(">I", b, here + 8 + n)[0]:
        return None
    return here + 12 + n, name == b"IEND"


def _png(scan: Scan, at: int) -> int:
    """Chunks with right checksums from IHDR to IEND."""
    if scan.data[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return 0
    end = scan.follow(_png_chunk, at + 8)
    return end - at if end else 0


def _bmp(scan: Scan, at: int) -> int:
    """The header's size must hold the pixel rows that it announces."""
    b = scan.data
    if len(b) < at + 54:
        return 0
    total, zero, start, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    rows = (abs(width) * bits + 31) // 32 * 4 * abs(height)
    sound = zero == 0 and header == 40 and planes == 1 and bits in (1, 4, 8, 24, 32) and packed == 0 and start >= 54
    return total if sound and total == start + rows and at + total <= len(b) else 0


def _gif_data(scan: Scan, here: int) -> tuple[int, bool] | None:
    """A sub-block; the empty one ends its block."""
    if here >= len(scan.data):
        return None
    n = scan.data[here]
    return here + 1 + n, n == 0


def _gif_block(scan: Scan, here: int) -> tuple[int, bool] | None:
    b = scan.data
    if here >= len(b):
        return None
    if b[here] == 0x3B:
        return here + 1, True
    if b[here] == 0x21:
        here += 2
    elif b[here] == 0x2C and here + 9 < len(b):
        here += 11 + (3 << ((b[here + 9] & 7) + 1) if b[here + 9] & 128 else 0)
    else:
        return None
    end = scan.follow(_gif_data, here)
    return (end, False) if end else None


def _gif(scan: Scan, at: int) -> int:
    """Blocks from the screen descriptor to the trailer."""
    b = scan.data
    if len(b) < at + 13:
        return 0
    end = scan.follow(_gif_block, at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0))
    return end - at if end else 0


def _jpeg_segment(scan: Scan, here: int) -> tuple[int, bool] | None:
    b = scan.data
    if here + 2 > len(b) or b[here] != 0xFF:
        return None
    mark = b[here + 1]
    if mark == 0xD9:
        return here + 2, True
    if mark == 0xFF:
        return here + 1, False
    if here + 4 > len(b) or (n := struct.unpack_from(">H", b, here + 2)[0]) < 2:
        return None
    here += 2 + n
    if mark == 0xDA:
        # Coded data goes on to the next marker.
        at = int(np.searchsorted(scan.marks, here))
        if at == len(scan.marks):
            return None
        here = int(scan.marks[at])
    return here, False


def _jpeg(scan: Scan, at: int) -> int:
    """Segments from the start marker to the end marker."""
    end = scan.follow(_jpeg_segment, at + 2)
    return end - at if end else 0


def _pdf(scan: Scan, at: int) -> int:
    """A version, and the end mark of the last revision, which points to references that are there."""
    return max(0, scan.pdf_ends.get(at, 0) - at)


def _zip(scan: Scan, at: int) -> int:
    """An end record that points back to a central directory of this archive."""
    return max(0, scan.zip_ends.get(at, 0) - at)


#: Published magic bytes.
FORMATS: dict[bytes, tuple[str, Callable[[Scan, int], int]]] = {
    b"RIFF": ("audio/wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"BM": ("image/bmp", _bmp),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"%PDF-": ("application/pdf", _pdf),
    b"PK\x03\x04": ("application/zip", _zip),
}


class Sniffer:
    """An automaton of the magic bytes. Bytes are given to it as characters of the same numbers."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic in FORMATS:
            self.automaton.add_word(magic.decode("latin-1"), magic)
        self.automaton.make_automaton()

    def parts(self, value: bytes) -> list[Part]:
        """Confirmed media, in order and outside each other, but for a container at byte 0, whose parts are listed too."""
        found: list[Part] = []
        carved, scan = 0, Scan(value)
        places = sorted((end + 1 - len(magic), magic) for end, magic in self.automaton.iter(value.decode("latin-1")))
        for at, magic in places:
            if at >= carved and (n := FORMATS[magic][1](scan, at)):
                found.append(Part(FORMATS[magic][0], at, n))
                carved = at + n if at else 0
        return found

    def sniff(self, value: bytes | None) -> tuple[str, int, list[Part]]:
        """The type and length confirmed at byte 0, and what is embedded."""
        parts = self.parts(value or b"")
        head = parts.pop(0) if parts and parts[0].start == 0 else Part(UNKNOWN, 0, 0)
        return head.kind, head.length, parts


_kept: dict = {}
PARTS = "array<struct<kind:string,start:long,length:long,sha256:string>>"
_part = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])


def carved(value: bytes, parts: list[Part]) -> list[dict]:
    """Embedded media as rows, with a digest of what is cut out."""
    return [{"kind": p.kind, "start": p.start, "length": p.length, "sha256": hashlib.sha256(value[p.start : p.start + p.length]).hexdigest()} for p in parts]


def sniff_media(df: DataFrame, id_col: str, media_col: str, declared_col: str | None = None) -> DataFrame:
    """(id, declared, detected, corrected, length, trailing, parts) of every value of a binary column."""
    schema = f"id long, declared string, detected string, corrected boolean, length long, trailing long, parts {PARTS}"
    out = {"id": pa.int64(), "declared": pa.string(), "detected": pa.string(), "corrected": pa.bool_(), "length": pa.int64(), "trailing": pa.int64(), "parts": pa.list_(_part)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = common.worker_cache(_kept, "sniffer", Sniffer)
        for batch in common.pieces(batches, 64):
            values, declared = common.column_bytes(batch.column(2)), batch.column(1).to_pylist()
            found = [sniffer.sniff(v) for v in values]
            cut = [carved(v, parts) for v, (_, _, parts) in zip(values, found, strict=True)]
            yield common.record_batch(out, id=batch.column(0), declared=declared, detected=[k for k, _, _ in found], corrected=[d != k for d, (k, _, _) in zip(declared, found, strict=True)], length=[n for _, n, _ in found], trailing=[len(v) - n for v, (_, n, _) in zip(values, found, strict=True)], parts=cut)

    declared = F.col(declared_col) if declared_col else F.lit(None)
    rows = df.select(F.col(id_col).cast("long").alias("id"), declared.cast("string").alias("declared"), F.col(media_col).alias("media"))
    return common.map_arrow(rows, run, schema).withColumnRenamed("id", id_col)


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """A mono sound of 8-bit samples; an odd payload gets the pad byte that the format asks for."""
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def wav_payload(value: bytes) -> bytes:
    here, end = 12, 8 + struct.unpack_from("<I", value, 4)[0]
    while here < end:
        name, n = struct.unpack_from("<4sI", value, here)
        if name == b"data":
            return value[here + 8 : here + 8 + n]
        here += 8 + n + (n & 1)
    return b""


def text_media(docs: DataFrame, unit: int = 192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, declared, media): each text's UTF-8 with spaces up to a positive multiple of unit, as sound samples. What the values are declared to be goes by their digest and is mostly wrong."""
    out = {"id": pa.int64(), "n_bytes": pa.int64(), "declared": pa.string(), "media": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 64):
            texts = common.column_bytes(batch.column(1))
            media = [wav(t.ljust(max(1, -(-len(t) // unit)) * unit)) for t in texts]
            declared = [DECLARED[zlib.crc32(t) % len(DECLARED)] for t in texts]
            yield common.record_batch(out, id=batch.column(0), n_bytes=[len(t) for t in texts], declared=declared, media=media)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.map_arrow(rows, run, "id long, n_bytes long, declared string, media binary").withColumnRenamed("id", id_col)


def media_digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From stored sounds: what the sniffer says of them, the payload's digests and a feature text."""
    out = {"id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "detected": pa.string(), "corrected": pa.bool_(), "embedded": pa.int32(), "parts": pa.list_(_part)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = common.worker_cache(_kept, "sniffer", Sniffer)
        for batch in common.pieces(batches, 64):
            rows: list[tuple] = []
            for declared, value in zip(batch.column(2).to_pylist(), common.column_bytes(batch.column(3)), strict=True):
                kind, length, parts = sniffer.sniff(value)
                payload = wav_payload(value[:length]) if kind == "audio/wav" else value
                samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
                total, power = int(samples.sum()), int((samples * samples).sum())
                crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
                feature = f"{kind};samples={len(samples)};sum={total};power={power};peak={int(np.abs(samples).max(initial=0))};crossings={crossings}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(value), hashlib.sha256(value).hexdigest(), feature, kind, kind != declared, len(parts), carved(value, parts)))
            columns = zip(*rows, strict=True) if rows else [[]] * 10
            yield common.record_batch(out, id=batch.column(0), n_bytes=batch.column(1), **dict(zip(list(out)[2:], columns, strict=True)))

    rows = media.select(F.col(id_col).cast("long").alias("id"), "n_bytes", "declared", "media")
    schema = f"id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, detected string, corrected boolean, embedded int, parts {PARTS}"
    return common.map_arrow(rows, run, schema).withColumnRenamed("id", id_col)
