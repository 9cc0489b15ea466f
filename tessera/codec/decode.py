"""From bytes to frames and tiles, one image at a time: what an Arrow function runs for each row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..plans.options import TILE_PIXELS, DecodeOptions, PixelType, Status
from .entropy import decode_scan
from .header import Bad, Header, parse
from .tables import samples_of

BITS = {PixelType.RGB565_LE: 16, PixelType.RGB565_BE: 16, PixelType.RGB8888: 32, PixelType.GRAY8: 8, PixelType.DITHER4: 4, PixelType.DITHER2: 2, PixelType.DITHER1: 1}


@dataclass
class Frame:
    """Pixels of the (cropped, scaled) image: an array (height, width) of the pixel type's values, or 8-bit gray before dithering."""

    status: Status
    width: int = 0
    height: int = 0
    pixels: np.ndarray | None = None
    header: Header | None = None
    shift: int = 0
    crop: tuple[int, int, int, int] = (0, 0, 0, 0)


def align_crop(header: Header, request: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    mw, mh = header.mcu
    x, y, w, h = request
    w, h = -(-w // mw) * mw, -(-h // mh) * mh
    x, y = min(max(x, 0), header.width - mw), min(max(y, 0), header.height - mh)
    w = header.width - mw if x + w > header.width else w
    h = header.height - mh if y + h > header.height else h
    return x // mw * mw, y // mh * mh, w, h


def _plane(blocks: np.ndarray, cx: int, cy: int, hs: int, vs: int) -> np.ndarray:
    """(mcus, blocks, n * n) samples to a plane."""
    n = int(blocks.shape[-1] ** 0.5)
    return blocks.reshape(cy, cx, vs, hs, n, n).transpose(0, 2, 4, 1, 3, 5).reshape(cy * vs * n, cx * hs * n)


def _pairs(p: np.ndarray, axis: int) -> np.ndarray:
    """Sums of neighbours."""
    return p[::2] + p[1::2] if axis == 0 else p[:, ::2] + p[:, 1::2]


def to_565(r, g, b):
    return ((r & 0xF8) << 8) | ((g & 0xFC) << 3) | (b >> 3)


def colour(lum12: np.ndarray, cb: np.ndarray, cr: np.ndarray):
    cb, cr = cb - 128, cr - 128
    return tuple(np.clip(v >> 12, 0, 255) for v in (lum12 + 5742 * cr, lum12 - 1409 * cb - 2925 * cr, lum12 + 7258 * cb))


def packed(kind: PixelType, r, g, b) -> np.ndarray:
    if kind is PixelType.RGB8888:
        return (r | (g << 8) | (b << 16) | (255 << 24)).astype("<u4")
    return to_565(r, g, b).astype("<u2" if kind is PixelType.RGB565_LE else ">u2")


def decode_frame(data: bytes, options: DecodeOptions) -> Frame:
    """Never raises for bad bytes. A scan that fails midway gives DECODE_ERROR with the whole MCUs before it; the rest is 0.

    A header that asks for far more blocks than its scan has bits gives DECODE_ERROR without pixels, an image whose
    coefficients would take more than entropy.MOST_BYTES gives ERROR_MEMORY.
    """
    try:
        return _decoded(data, options)
    except MemoryError:
        return Frame(Status.ERROR_MEMORY)


def _decoded(data: bytes, options: DecodeOptions) -> Frame:
    try:
        header = parse(data)
        if options.thumbnail:
            if not header.has_thumb:
                return Frame(Status.INVALID_PARAMETER, header=header)
            data = data[header.thumb_offset :]
            header = parse(data)
    except Bad as e:
        return Frame(e.status)
    shift = 3 if header.progressive else options.shift
    (mw, mh), (cx, cy) = header.mcu, header.grid
    crop = (0, 0, header.width, header.height)
    if options.crop:
        crop = align_crop(header, options.crop)
        if crop[2] <= 0 or crop[3] <= 0:
            return Frame(Status.INVALID_PARAMETER, header=header)
    last_row = min(cy, -(-(crop[1] + crop[3]) // mh)) - 1
    colourful = len(header.components) == 3 and not options.gray
    try:
        coefs, whole = decode_scan(data, header, colourful, shift == 3, (last_row + 1) * cx - 1)
    except Bad as e:
        return Frame(e.status, header=header)
    status = Status.SUCCESS if whole >= (last_row + 1) * cx else Status.DECODE_ERROR
    coefs[whole:] = 0
    # Only blocks of MCUs inside the crop are transformed.
    ys, xs = slice(crop[1] // mh, last_row + 1), slice(crop[0] // mw, min(cx, -(-(crop[0] + crop[2]) // mw)))
    coefs = coefs.reshape(last_row + 1, cx, *coefs.shape[1:])[ys, xs]
    ny, nx = coefs.shape[:2]
    luma, step = header.luma_blocks, 0 if shift == 1 else shift
    hs, vs = mw // 8, mh // 8
    precise = options.idct == "precise"

    def plane(first: int, n: int, table: int, h: int, v: int) -> np.ndarray:
        own = coefs[:, :, first : first + n].reshape(-1, coefs.shape[-1])
        return _plane(samples_of(own, np.array(header.quant[table]), step, precise).reshape(ny * nx, n, -1), nx, ny, h, v)

    y = plane(0, luma, header.components[0].quant, hs, vs)
    if shift == 1:
        y = _pairs(_pairs(y, 0), 1)
    if colourful:
        chroma = []
        for k in (1, 2):
            c = plane(luma + k - 1, 1, header.components[k].quant, 1, 1)
            rx, ry = hs, vs
            if shift == 1:
                if (hs, vs) == (1, 1):
                    c = (_pairs(_pairs(c, 0), 1) + 2) >> 2
                elif (hs, vs) == (1, 2):
                    c, ry = (_pairs(c, 1) + 1) >> 1, 1
                elif (hs, vs) == (2, 1):
                    c, rx = (_pairs(c, 0) + 1) >> 1, 1
                else:
                    rx = ry = 1
            chroma.append(np.repeat(np.repeat(c, ry, 0), rx, 1))
        pixels = packed(options.pixel_type, *colour(y << (10 if shift == 1 else 12), *chroma))
    else:
        y = (y + 2) >> 2 if shift == 1 else y
        pixels = y.astype(np.uint8) if options.gray else packed(options.pixel_type, y, y, y)
    scale = lambda v: (v + (1 << shift) - 1) >> shift
    wide, high = scale(min(crop[2], header.width - crop[0])), scale(min(crop[3], header.height - crop[1]))
    return Frame(status, wide, high, pixels[:high, :wide], header, shift, crop)


def dithered(gray: np.ndarray, bits: int) -> np.ndarray:
    """Error diffusion of an 8-bit image to bytes of packed levels, highest bits first, rows padded to whole bytes.

    The errors to the next row are kept in 8 bits, as the rule has it, and start at 0.
    """
    high, wide = gray.shape
    mask, down = (0xFF << (8 - bits)) & 0xFF, 8 - bits
    below = [0] * (wide + 2)  # below[x + 1]: what the row above has left for x
    levels = np.zeros((high, -(-wide * bits // 8) * 8 // bits), np.uint8)
    for y, row in enumerate(gray.tolist()):
        carry, out = 0, levels[y]
        for x, p in enumerate(row):
            p = min(255, p + carry)
            out[x] = p >> down
            v = p - (p & mask)
            h = v >> 1
            right = (7 * h) >> 3
            under = (5 * h) >> 3
            carry = (right + below[x + 2]) & 255
            below[x + 2] = h - right
            below[x + 1] = (below[x + 1] + under) & 255
            below[x] = (below[x] + h - under) & 255
    per = 8 // bits
    shifts = np.arange(per - 1, -1, -1) * bits
    return (levels.reshape(high, -1, per).astype(np.uint16) << shifts).sum(axis=2).astype(np.uint8)


def frame_bytes(frame: Frame, options: DecodeOptions) -> bytes:
    """Row-major pixels, rows without padding (dithered rows end on whole bytes)."""
    if frame.pixels is None:
        return b""
    if options.pixel_type.value > PixelType.GRAY8.value:
        return dithered(frame.pixels, BITS[options.pixel_type]).tobytes()
    return np.ascontiguousarray(frame.pixels).tobytes()


def tile_mcus(header: Header, options: DecodeOptions, shift: int, crop_w: int) -> int:
    mw, mh = header.mcu
    mw, mh, cx = mw >> shift, mh >> shift, header.grid[0]
    fits = TILE_PIXELS // (mw * mh)
    fits = fits // 2 if options.pixel_type is PixelType.RGB8888 else fits * 2 if options.pixel_type is PixelType.GRAY8 else fits
    fits = min(fits, cx)
    fits = options.max_mcus if fits > options.max_mcus else fits // 2 if options.dma else fits
    fits = cx if options.pixel_type.value > PixelType.GRAY8.value else fits
    if crop_w != header.width and fits * mw > crop_w:
        fits = crop_w // mw
    return max(1, fits)


def tiles(frame: Frame, options: DecodeOptions):
    """(seq, x, y, width, height, width_used, bits, pixels) of a frame, in the order a drawing callback would get them."""
    if frame.pixels is None:
        return
    mw, mh = (v >> frame.shift for v in frame.header.mcu)
    bits = BITS[options.pixel_type]
    step = tile_mcus(frame.header, options, frame.shift, frame.crop[2]) * mw
    dither = options.pixel_type.value > PixelType.GRAY8.value
    source = dithered(frame.pixels, bits) if dither else frame.pixels
    seq = 0
    for y in range(0, frame.height, mh):
        for x in range(0, frame.width, step):
            used = min(step, frame.width - x)
            part = source[y : y + mh] if dither else source[y : y + mh, x : x + used]
            yield seq, options.x + x, options.y + y, -(-used // mw) * mw, min(mh, frame.height - y), used, bits, np.ascontiguousarray(part).tobytes()
            seq += 1


def bmp(pixels: np.ndarray, kind: PixelType) -> bytes:
    """A bitmap file, bottom-up, lines padded to 4 bytes: 8 bits with a gray palette, 16 bits as 565, or 32 bits as BGRA."""
    high, wide = pixels.shape
    if kind is PixelType.RGB8888:
        bits, lines = 32, pixels.astype("<u4").view(np.uint8).reshape(high, wide, 4)[:, :, [2, 1, 0, 3]].reshape(high, -1)
    elif kind in (PixelType.RGB565_LE, PixelType.RGB565_BE):
        bits, lines = 16, pixels.astype("<u2").view(np.uint8).reshape(high, -1)
    else:
        bits, lines = 8, pixels.astype(np.uint8)
    lines = np.pad(lines, ((0, 0), (0, -lines.shape[1] % 4)))[::-1]
    word = lambda v, n=4: int(v).to_bytes(n, "little")
    extra = b"".join(bytes([v, v, v, 0]) for v in range(256)) if bits == 8 else word(0xF800) + word(0x07E0) + word(0x001F) if bits == 16 else b""
    at = 14 + 40 + len(extra)
    info = word(40) + word(wide) + word(high) + word(1, 2) + word(bits, 2) + word(3 if bits == 16 else 0) + word(lines.size) + word(2835) * 2 + word(256 if bits == 8 else 0) + word(0)
    return b"BM" + word(at + lines.size) + word(0) + word(at) + info + extra + lines.tobytes()


def client_dithered(green: np.ndarray) -> np.ndarray:
    """Six-bit green values of a tile to four levels, with error diffusion inside the tile."""
    high, wide = green.shape
    v = green.astype(int).tolist()
    for y in range(high):
        for x in range(wide):
            old = min(63, max(0, v[y][x]))
            new = old & 0x38
            v[y][x], left = new, old - new
            for dx, dy, part in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                if 0 <= x + dx < wide and y + dy < high:
                    v[y + dy][x + dx] += left * part // 16
    return np.clip(np.array(v) >> 4, 0, 3).astype(np.uint8)
