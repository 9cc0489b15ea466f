"""Header parsing: markers, frame, tables, scan, EXIF. Every offset is checked; every failure is a status."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..plans.options import LEAST_BYTES, SUBSAMPLINGS, Status


class Bad(Exception):
    def __init__(self, status: Status, what: str = ""):
        super().__init__(what)
        self.status = status


@dataclass
class Component:
    id: int
    index: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Header:
    width: int = 0
    height: int = 0
    precision: int = 8
    sof: int = 0
    components: list[Component] = field(default_factory=list)
    scan: list[Component] = field(default_factory=list)
    quant: dict[int, list[int]] = field(default_factory=dict)
    huff: dict[tuple[int, int], tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    restart_interval: int = 0
    scan_start: int = 0
    scan_end: int = 63
    approx_low: int = 0
    approx_high: int = 0
    scan_offset: int = 0
    orientation: int = 0
    thumb_width: int | None = None
    thumb_height: int | None = None
    thumb_offset: int | None = None

    @property
    def progressive(self) -> bool:
        return self.sof == 0xC2

    @property
    def subsample(self) -> int:
        if len(self.components) == 1:
            return 0
        return (self.components[0].h << 4) | self.components[0].v

    @property
    def bpp(self) -> int:
        return self.precision * len(self.components)

    @property
    def has_thumb(self) -> bool:
        return self.thumb_offset is not None

    @property
    def mcu(self) -> tuple[int, int]:
        sub = self.subsample
        return (16 if sub in (0x21, 0x22) else 8), (16 if sub in (0x12, 0x22) else 8)

    @property
    def grid(self) -> tuple[int, int]:
        mw, mh = self.mcu
        return -(-self.width // mw), -(-self.height // mh)

    @property
    def luma_blocks(self) -> int:
        return {0x22: 4, 0x12: 2, 0x21: 2}.get(self.subsample, 1)


#: Tags of an image file directory; fixed values.
TAG_WIDTH, TAG_HEIGHT, TAG_ORIENTATION, TAG_THUMB = 256, 257, 274, 513
MOST_TAGS = 256


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, int], int]:
    """Values of the tags that count, and the offset of the next directory (0: none); nothing where it doesn't fit."""
    if at + 2 > len(data) or at < 0:
        return {}, 0
    n = int.from_bytes(data[at : at + 2], order)
    if not 1 <= n <= MOST_TAGS:
        return {}, 0
    tags = {}
    for k in range(n):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            return tags, 0
        tag, kind, count = (int.from_bytes(entry[a:b], order) for a, b in ((0, 2), (2, 4), (4, 8)))
        if tag in (TAG_WIDTH, TAG_HEIGHT, TAG_ORIENTATION, TAG_THUMB):
            tags[tag] = int.from_bytes(entry[8:10] if kind == 3 and count == 1 else entry[8:12], order)
    end = at + 2 + 12 * n
    return tags, int.from_bytes(data[end : end + 4], order) if end + 4 <= len(data) else 0


def _exif(header: Header, data: bytes, start: int, end: int) -> None:
    tiff = start + 6
    if data[start : start + 4] != b"Exif" or data[tiff : tiff + 2] not in (b"II", b"MM") or tiff + 8 > end:
        return
    order = "little" if data[tiff : tiff + 2] == b"II" else "big"
    body = data[tiff:end]
    first, following = directory(body, int.from_bytes(body[4:8], order), order)
    header.orientation = first.get(TAG_ORIENTATION, 0)
    if following:
        second, _ = directory(body, following, order)
        if second.get(TAG_THUMB):
            header.thumb_offset = tiff + second[TAG_THUMB]
            header.thumb_width, header.thumb_height = second.get(TAG_WIDTH), second.get(TAG_HEIGHT)


def _quant(header: Header, data: bytes, at: int, end: int) -> None:
    while at < end:
        wide, table = data[at] >> 4, data[at] & 15
        size = 128 if wide else 64
        if table > 3 or at + 1 + size > end:
            raise Bad(Status.DECODE_ERROR, "quantization table")
        step = 2 if wide else 1
        header.quant[table] = [int.from_bytes(data[at + 1 + k : at + 1 + k + step], "big") for k in range(0, size, step)]
        at += 1 + size


def _huffman(header: Header, data: bytes, at: int, end: int) -> None:
    while at < end:
        kind, table = data[at] >> 4, data[at] & 15
        lengths = tuple(data[at + 1 : at + 17])
        n = sum(lengths)
        if kind > 1 or table > 3 or len(lengths) < 16 or not 0 < n <= 256 or at + 17 + n > end:
            raise Bad(Status.DECODE_ERROR, "Huffman table")
        header.huff[kind, table] = lengths, tuple(data[at + 17 : at + 17 + n])
        at += 17 + n


def _frame(header: Header, data: bytes, at: int, end: int, sof: int) -> None:
    if at + 6 > end or at + 6 + 3 * data[at + 5] > end:
        raise Bad(Status.DECODE_ERROR, "frame")
    header.sof, header.precision = sof, data[at]
    header.height, header.width = int.from_bytes(data[at + 1 : at + 3], "big"), int.from_bytes(data[at + 3 : at + 5], "big")
    header.components = [Component(data[p], k, data[p + 1] >> 4, data[p + 1] & 15, data[p + 2]) for k, p in enumerate(range(at + 6, at + 6 + 3 * data[at + 5], 3))]
    if not header.width or not header.height or not header.components:
        raise Bad(Status.DECODE_ERROR, "empty frame")
    if any(c.quant > 3 for c in header.components):
        raise Bad(Status.DECODE_ERROR, "quantization table number")
    if header.precision != 8 or len(header.components) not in (1, 3) or header.subsample not in SUBSAMPLINGS:
        raise Bad(Status.UNSUPPORTED, "components")
    if any((c.h, c.v) != (1, 1) for c in header.components[1:]):
        raise Bad(Status.UNSUPPORTED, "chroma sampling")


def _scan(header: Header, data: bytes, at: int, end: int) -> None:
    n = data[at] if at < end else 0
    if not n or at + 4 + 2 * n > end:
        raise Bad(Status.DECODE_ERROR, "scan")
    by_id = {c.id: c for c in header.components}
    for p in range(at + 1, at + 1 + 2 * n, 2):
        if data[p] not in by_id:
            raise Bad(Status.DECODE_ERROR, "scan component")
        c = by_id[data[p]]
        c.dc, c.ac = data[p + 1] >> 4, data[p + 1] & 15
        header.scan.append(c)
    p = at + 1 + 2 * n
    header.scan_start, header.scan_end, header.approx_high, header.approx_low = data[p], data[p + 1], data[p + 2] >> 4, data[p + 2] & 15
    if [c.index for c in header.scan] != [*range(len(header.components))]:
        raise Bad(Status.UNSUPPORTED, "scan without all components")
    if header.progressive and (header.scan_start or header.approx_high):
        raise Bad(Status.UNSUPPORTED, "first scan")


def parse(data: bytes) -> Header:
    """The header up to the first scan; raises Bad."""
    if data is None or len(data) < LEAST_BYTES or data[:2] != b"\xff\xd8":
        raise Bad(Status.INVALID_FILE, "no image")
    header, at = Header(), 2
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 4 > len(data):
            raise Bad(Status.DECODE_ERROR, "no scan")
        marker = data[at + 1]
        if marker in (0xFF, 0x00) or 0xD0 <= marker <= 0xD8 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            raise Bad(Status.DECODE_ERROR, "no scan")
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        start, end = at + 4, at + 2 + size
        if size < 2 or end > len(data):
            raise Bad(Status.DECODE_ERROR, "marker length")
        if marker in (0xC0, 0xC1, 0xC2):
            if marker == 0xC1:
                raise Bad(Status.UNSUPPORTED, "extended frame")
            if header.sof:
                raise Bad(Status.DECODE_ERROR, "second frame")
            _frame(header, data, start, end, marker)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Bad(Status.UNSUPPORTED, "frame kind")
        elif marker == 0xC4:
            _huffman(header, data, start, end)
        elif marker == 0xDB:
            _quant(header, data, start, end)
        elif marker == 0xDD:
            if end - start < 2:
                raise Bad(Status.DECODE_ERROR, "restart interval")
            header.restart_interval = int.from_bytes(data[start : start + 2], "big")
        elif marker == 0xE1:
            _exif(header, data, start, end)
        elif marker == 0xDA:
            if not header.sof:
                raise Bad(Status.DECODE_ERROR, "scan before frame")
            _scan(header, data, start, end)
            if any(c.quant not in header.quant for c in header.components) or any((0, c.dc) not in header.huff or (not header.progressive and (1, c.ac) not in header.huff) for c in header.scan):
                raise Bad(Status.DECODE_ERROR, "missing table")
            header.scan_offset = end
            return header
        at = end


def bare(data: bytes, end: int) -> bytes:
    """The header up to ``end`` without its application and comment segments."""
    out, at = [data[:2]], 2
    while at + 4 <= end:
        if data[at] != 0xFF or data[at + 1] == 0xFF:
            at += 1
            continue
        after = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if not (0xE0 <= data[at + 1] <= 0xEF or data[at + 1] == 0xFE):
            out.append(data[at : min(after, end)])
        at = after
    return b"".join(out)
