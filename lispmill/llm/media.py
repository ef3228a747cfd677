"""Media columns: signature sniffing with Aho-Corasick, format validators, type correction and carving.

``find_media`` looks for the magic bytes of all known formats in one pass over a binary value; a format says how far
its magic stands from the item's start (4 bytes for MP4, 257 for tar). A hit counts only if the format's validator
confirms the structure and gives a length that fits; text that merely holds a magic string does not. The
confirmed item at offset 0 that spans the value corrects the declared type; others are carved out as embedded
media, also those inside another confirmed item. Pages of an OGG stream and local headers of a zip archive are parts of
their container and no items. Formats without an end that can be told (FLAC, MP3) are not known.

Where a format ends at a mark (PDF, zip, JPEG), the marks are listed once for a value and looked up for each hit, and
chains of blocks (GIF) are walked once, so time is linear in the value. A PDF goes to the last end mark
before the next PDF's head, line ends behind it included; a gzip item holds all members in a row.

Null and empty values give no items. Ties (two formats confirmed at one offset) go to the longer item, then
to the name. Repeated rows give a row each; other columns are not read; an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lispmill.llm.common import map_rows, table

PAD = 64
WAV_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


class Places:
    """Places of a mark in a value, and ends of chains, found once."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.marks: dict[bytes, list[int]] = {}
        self.chains: dict[int, int] = {}
        self.archives: dict[int, int] | None = None

    def of(self, mark: bytes) -> list[int]:
        """All places of a pattern, ascending."""
        if mark not in self.marks:
            self.marks[mark] = [m.start() for m in re.finditer(mark, self.data)]
        return self.marks[mark]

    def next(self, mark: bytes, at: int) -> int:
        """The first place at or behind ``at``, or -1."""
        own = self.of(mark)
        k = bisect_left(own, at)
        return own[k] if k < len(own) else -1

    def before(self, mark: bytes, end: int) -> int:
        """The last place before ``end``, or -1."""
        own = self.of(mark)
        k = bisect_left(own, end)
        return own[k - 1] if k else -1

    def chain_end(self, at: int) -> int:
        """Behind the empty block that ends a chain of blocks led by their lengths (the value's end without one)."""
        d, walked = self.data, []
        while at < len(d) and d[at] and at not in self.chains:
            walked.append(at)
            at += d[at] + 1
        end = self.chains.get(at, min(at, len(d)) + 1)
        for p in walked:
            self.chains[p] = end
        return end


# --- validators: (data, offset of the item, its places) -> its length, or 0 if it is not one --------------
def _riff(form: bytes):
    def check(d: bytes, at: int, _: Places) -> int:
        if at + 12 > len(d) or d[at + 8 : at + 12] != form:
            return 0
        size = 8 + int.from_bytes(d[at + 4 : at + 8], "little")
        end, p, kinds = at + size, at + 12, set()
        if size < 20 or end > len(d):
            return 0
        while p + 8 <= end:
            kinds.add(d[p : p + 4])
            n = int.from_bytes(d[p + 4 : p + 8], "little")
            p += 8 + n + (n & 1)
        wanted = {b"fmt ", b"data"} if form == b"WAVE" else set()
        return size if p in (end, end + 1) and wanted <= kinds else 0

    return check


def _png(d: bytes, at: int, _: Places) -> int:
    p, first = at + 8, True
    while p + 12 <= len(d):
        n, kind = int.from_bytes(d[p : p + 4], "big"), d[p + 4 : p + 8]
        if p + 12 + n > len(d) or (first and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(d[p + 4 : p + 8 + n]) != int.from_bytes(d[p + 8 + n : p + 12 + n], "big"):
            return 0
        first, p = False, p + 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _gif(d: bytes, at: int, places: Places) -> int:
    p = at + 13
    if p > len(d):
        return 0
    p += 3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 0x80 else 0
    while p < len(d):
        kind = d[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(d):
            p += 11 + (3 << ((d[p + 9] & 7) + 1) if d[p + 9] & 0x80 else 0)
        else:
            return 0
        p = places.chain_end(p)
    return 0


def _jpeg(d: bytes, at: int, places: Places) -> int:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        kind, n = d[p + 1], int.from_bytes(d[p + 2 : p + 4], "big")
        if n < 2:
            return 0
        p += 2 + n
        if kind == 0xDA:
            end = places.next(rb"\xff\xd9", p)
            return end + 2 - at if end >= 0 else 0
    return 0


def _pdf(d: bytes, at: int, places: Places) -> int:
    head = rb"%PDF-[0-9]\.[0-9]"
    if places.next(head, at) != at:
        return 0
    follows = places.next(head, at + 1)
    end = places.before(rb"%%EOF", follows if follows >= 0 else len(d))
    table = places.next(rb"startxref", at)
    if end < at or not at < table < end:
        return 0
    end += 5
    while end < len(d) and d[end] in b"\r\n":
        end += 1
    return end - at


def _bmp(d: bytes, at: int, _: Places) -> int:
    if at + 54 > len(d):
        return 0
    size, zero, start, head = struct.unpack_from("<IIII", d, at + 2)
    ok = zero == 0 and head in (40, 108, 124) and 14 + head <= start <= size and at + size <= len(d)
    return size if ok and d[at + 26 : at + 28] == b"\x01\x00" else 0


def _gzip(d: bytes, at: int, _: Places) -> int:
    done, rest = 0, memoryview(d)[at:]
    while rest[:3] == b"\x1f\x8b\x08":
        z, own = zlib.decompressobj(31), rest
        try:
            while own and not z.eof:
                z.decompress(own, 1 << 20)
                own = z.unconsumed_tail
        except zlib.error:
            break
        if not z.eof:
            break
        done = len(d) - at - len(z.unused_data) if z.unused_data else len(d) - at - len(own)
        rest = memoryview(d)[at + done :]
    return done


def _zip(d: bytes, at: int, places: Places) -> int:
    if places.archives is None:  # where each end record says that its archive starts; the last one counts
        places.archives = {}
        for end in places.of(rb"PK\x05\x06"):
            if end + 22 <= len(d):
                size, start = struct.unpack_from("<II", d, end + 12)
                places.archives[end - size - start] = end
    end = places.archives.get(at, -1)
    if end < 0:
        return 0
    start = struct.unpack_from("<I", d, end + 16)[0]
    stop = end + 22 + int.from_bytes(d[end + 20 : end + 22], "little")
    return stop - at if d[at + start : at + start + 4] == b"PK\x01\x02" and stop <= len(d) else 0


#: Kinds of the boxes that stand at the top of an MP4 file.
BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"udta", b"moof", b"mfra", b"sidx", b"styp", b"meta", b"uuid", b"pdin")


def _mp4(d: bytes, at: int, _: Places) -> int:
    p, kinds = at, set()
    while p + 8 <= len(d) and d[p + 4 : p + 8] in BOXES and (p == at or d[p + 4 : p + 8] != b"ftyp"):
        n = int.from_bytes(d[p : p + 4], "big")
        n = int.from_bytes(d[p + 8 : p + 16], "big") if n == 1 else n or len(d) - p
        if n < 8 or p + n > len(d):
            break
        kinds.add(d[p + 4 : p + 8])
        p += n
    return p - at if b"ftyp" in kinds and kinds & {b"moov", b"moof"} else 0


def _ogg(d: bytes, at: int, _: Places) -> int:
    p, serial, number = at, d[at + 14 : at + 18], 0
    while d[p : p + 5] == b"OggS\0" and p + 27 <= len(d):
        flags, n = d[p + 5], d[p + 26]
        end = p + 27 + n + sum(d[p + 27 : p + 27 + n])
        if end > len(d) or d[p + 14 : p + 18] != serial or int.from_bytes(d[p + 18 : p + 22], "little") != number or bool(flags & 2) != (p == at):
            return 0
        p, number = end, number + 1
        if flags & 4:
            return p - at
    return 0


def _tiff(order: str):
    def check(d: bytes, at: int, _: Places) -> int:
        big, end, table = order == ">", 8, b""
        if at + 8 > len(d):
            return 0
        ifd, tables, has = struct.unpack_from(order + "I", d, at + 4)[0], 0, False
        while ifd and tables < 64:
            if ifd < end or at + ifd + 2 > len(d):
                return 0
            n = struct.unpack_from(order + "H", d, at + ifd)[0]
            table, end = d[at + ifd + 2 : at + ifd + 2 + 12 * n + 4], ifd + 2 + 12 * n + 4
            if not n or len(table) < 12 * n + 4:
                return 0
            found: dict[int, list[int]] = {}
            for k in range(n):
                tag, kind, count, value = struct.unpack_from(order + "HHII", table, 12 * k)
                size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}.get(kind, 0) * count
                if not size or (size > 4 and at + value + size > len(d)):
                    return 0
                end = max(end, value + size if size > 4 else 0)
                if tag in (273, 279, 324, 325) and kind in (3, 4):  # offsets and sizes of strips and tiles
                    place = at + value if size > 4 else at + ifd + 2 + 12 * k + 8
                    found[tag] = list(struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", d, place))
            for a, b in ((273, 279), (324, 325)):
                for start, size in zip(found.get(a, ()), found.get(b, ()), strict=False):
                    has, end = True, max(end, start + size)
            ifd, tables = struct.unpack_from(order + "I", table, 12 * n)[0], tables + 1
        return end if has and at + end <= len(d) and big == (d[at : at + 1] == b"M") else 0

    return check


def _tar(d: bytes, at: int, _: Places) -> int:
    p, members = at, 0
    while at >= 0 and p + 512 <= len(d):
        head = d[p : p + 512]
        if not any(head):
            return p + 1024 - at if members and not any(d[p + 512 : p + 1024]) and p + 1024 <= len(d) else 0
        try:
            size, check = int(head[124:136].strip(b" \0") or b"0", 8), int(head[148:156].strip(b" \0") or b"0", 8)
        except ValueError:
            return 0
        if sum(head) - sum(head[148:156]) + 8 * 32 != check:
            return 0
        p, members = p + 512 + -(-size // 512) * 512, members + 1
    return 0


#: type: magic bytes, how far they stand from the item's start, validator
FORMATS = {
    "audio/wav": (b"RIFF", 0, _riff(b"WAVE")),
    "image/webp": (b"RIFF", 0, _riff(b"WEBP")),
    "image/png": (b"\x89PNG\r\n\x1a\n", 0, _png),
    "image/gif": (b"GIF87a", 0, _gif),
    "image/gif+89a": (b"GIF89a", 0, _gif),
    "image/jpeg": (b"\xff\xd8\xff", 0, _jpeg),
    "image/tiff": (b"II*\0", 0, _tiff("<")),
    "image/tiff+be": (b"MM\0*", 0, _tiff(">")),
    "application/pdf": (b"%PDF-", 0, _pdf),
    "image/bmp": (b"BM", 0, _bmp),
    "application/gzip": (b"\x1f\x8b\x08", 0, _gzip),
    "application/zip": (b"PK\x03\x04", 0, _zip),
    "application/x-tar": (b"ustar", 257, _tar),
    "audio/ogg": (b"OggS\0\x02", 0, _ogg),
    "video/mp4": (b"ftyp", 4, _mp4),
}
#: Their further members have the magic of the first one and are no items.
IN_A_ROW = ("application/x-tar", "application/gzip")
_machine = None


def machine():
    """The automaton over all magic bytes, built once in each Python process."""
    global _machine
    if _machine is None:
        import ahocorasick

        by: dict[str, list[tuple[str, int]]] = {}
        for kind, (magic, shift, _) in FORMATS.items():
            by.setdefault(magic.decode("latin-1"), []).append((kind, shift))
        _machine = ahocorasick.Automaton()
        for magic, kinds in by.items():
            _machine.add_word(magic, (len(magic), tuple(kinds)))
        _machine.make_automaton()
    return _machine


def find_media(data: bytes | None) -> list[tuple[int, int, str]]:
    """Confirmed items as (offset, length, type), by offset."""
    found: dict[int, tuple[int, str]] = {}
    if not data:
        return []
    places, reach = Places(data), dict.fromkeys(IN_A_ROW, 0)
    for end, (n, kinds) in machine().iter(data.decode("latin-1")):
        for kind, shift in kinds:
            at = end - n + 1 - shift
            if at < reach.get(kind, 0):
                continue
            size = FORMATS[kind][2](data, at, places) if at >= 0 else 0
            if size:
                if kind in reach:
                    reach[kind] = at + size
                found[at] = max(found.get(at, (0, "")), (size, kind.split("+")[0]))
    return [(at, *found[at]) for at in sorted(found)]


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as the samples of an 8-bit mono WAV file."""
    n = len(payload)
    return WAV_HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def wav_samples(media: bytes) -> bytes:
    """The samples that a WAV file's data chunk holds."""
    p = 12
    while p + 8 <= len(media):
        n = int.from_bytes(media[p + 4 : p + 8], "little")
        if media[p : p + 4] == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """Each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a WAV file in a binary column."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in part:
            data = text or b""
            yield doc_id, len(data), declared, wav(data + bytes(-len(data) % PAD or (PAD if not data else 0)))

    return map_rows(docs, [id_col, text_col], rows, f"{id_col} long, n_bytes long, declared_type string, media binary")


def sniff(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """A row per confirmed item of each value: its true type, place, bytes, and if it corrects the declared type."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for row_id, declared, data in part:
            for k, (at, n, kind) in enumerate(find_media(data)):
                whole = at == 0 and n == len(data)
                yield row_id, k, at, n, kind, declared.decode() if isinstance(declared, bytes) else declared, whole and kind.encode() != declared, data[at : at + n]

    spec = "item int, offset long, length long, media_type string, declared_type string, corrected boolean, carved binary"
    return map_rows(media, [id_col, declared_col, media_col], rows, f"{id_col} long, {spec}")


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared_type", bytes_col: str = "n_bytes") -> DataFrame:
    """A row per stored value: checks of the samples read back, the corrected type, carved items and a feature string."""

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        for row_id, n_bytes, declared, data in part:
            items = find_media(data)
            kind = next((k for at, n, k in items if at == 0 and n == len(data or b"")), (declared or b"").decode())
            samples = wav_samples(data) if kind == "audio/wav" else data or b""
            x = np.frombuffer(samples, np.uint8)
            counts = np.bincount(x, minlength=256)
            crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
            total, square = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
            feature = f"{kind};frames={len(x)};sum={total};square={square};peak={int(x.max(initial=0))};zero={int(counts[0])};cross={crossings};distinct={int(np.count_nonzero(counts))}"
            carved = [(at, n, k) for at, n, k in items if at]
            yield (
                row_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(), feature,
                kind, kind.encode() != declared, ",".join(f"{k}:{at}:{n}" for at, n, k in carved),
            )

    spec = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, carved string"
    return map_rows(media, [id_col, bytes_col, declared_col, media_col], rows, f"{id_col} long, {spec}")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_text(table(spark, sf_dir, "documents")))
