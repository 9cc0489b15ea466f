"""A small baseline encoder, for images made in memory: gray, 1x1, 1x2, 2x1, 2x2, restarts, EXIF thumbnails, a DC-only progressive scan."""

from __future__ import annotations

import math

import numpy as np

from .tables import DC_CHROMA, DC_LUMA, ZIGZAG_ARRAY, codes, flat_ac

_COS = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def quant_table(quality: int) -> list[int]:
    """Steps that grow with frequency; in zig-zag order."""
    return [max(1, min(255, (3 + (z // 8 + z % 8) * 3) * (110 - quality) // 40)) for z in ZIGZAG_ARRAY.tolist()]


class _Bits:
    def __init__(self):
        self.value, self.count, self.out = 0, 0, bytearray()

    def put(self, code: int, n: int) -> None:
        self.value, self.count = (self.value << n) | code, self.count + n
        while self.count >= 8:
            self.count -= 8
            byte = (self.value >> self.count) & 255
            self.out.append(byte)
            if byte == 255:
                self.out.append(0)
        self.value &= (1 << self.count) - 1

    def flush(self) -> None:
        if self.count:
            self.put((1 << (8 - self.count)) - 1, 8 - self.count)


def _signed(v: int) -> tuple[int, int]:
    n = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << n) - 1), n


def _marker(kind: int, body: bytes) -> bytes:
    return bytes([255, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def exif_segment(order: str, orientation: int, thumb: bytes | None, thumb_size: tuple[int, int] = (0, 0)) -> bytes:
    """An APP1 segment with orientation and, if given, a thumbnail file within it."""
    short, long = (lambda v: v.to_bytes(2, order)), (lambda v: v.to_bytes(4, order))
    entry = lambda tag, kind, v: short(tag) + short(kind) + long(1) + (short(v) + b"\0\0" if kind == 3 else long(v))
    first = short(1) + entry(274, 3, orientation)
    head = (b"II" if order == "little" else b"MM") + short(42) + long(8)
    if thumb is None:
        return _marker(0xE1, b"Exif\0\0" + head + first + long(0))
    at = 8 + len(first) + 4
    size = 2 + 12 * 3 + 4
    second = short(3) + entry(256, 4, thumb_size[0]) + entry(257, 4, thumb_size[1]) + entry(513, 4, at + size) + long(0)
    return _marker(0xE1, b"Exif\0\0" + head + first + long(at) + second + thumb)


def encode(planes: list[np.ndarray], subsample: int, quality: int = 75, restart: int = 0, progressive: bool = False, app1: bytes = b"", wide_tables: bool = False) -> bytes:
    """planes: Y or Y, Cb, Cr at full size, uint8 (height, width). Chroma is averaged as the subsampling has it."""
    high, wide = planes[0].shape
    hs, vs = (1, 1) if subsample == 0 else (subsample >> 4, subsample & 15)
    mw, mh = 8 * hs, 8 * vs
    cx, cy = -(-wide // mw), -(-high // mh)
    full = [np.pad(p.astype(float), ((0, cy * mh - high), (0, cx * mw - wide)), "edge") for p in planes]
    full[1:] = [p.reshape(cy * 8, vs, cx * 8, hs).mean(axis=(1, 3)) for p in full[1:]]
    quant = np.array(quant_table(quality))
    natural = np.empty(64, int)
    natural[ZIGZAG_ARRAY] = quant

    def blocks(p):
        b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3) - 128
        f = np.einsum("ux,abxy,vy->abuv", _COS, b, _COS).reshape(*b.shape[:2], 64)
        return np.rint(f / natural).astype(int)[..., ZIGZAG_ARRAY]

    coefs = [blocks(p) for p in full]
    ac_table = flat_ac()
    dc, ac = [codes(*DC_LUMA), codes(*DC_CHROMA)], codes(*ac_table)
    bits, last, scans, made = _Bits(), [0] * len(planes), [], 0
    for my in range(cy):
        for mx in range(cx):
            if restart and made and made % restart == 0:
                bits.flush()
                scans.append(bytes(bits.out))
                bits, last = _Bits(), [0] * len(planes)
            made += 1
            for c in range(len(planes)):
                own = [(my * vs + v, mx * hs + h) for v in range(vs) for h in range(hs)] if c == 0 else [(my, mx)]
                for y, x in own:
                    block = coefs[c][y, x]
                    value, n = _signed(int(block[0]) - last[c])
                    last[c] = int(block[0])
                    bits.put(*dc[min(c, 1)][n])
                    bits.put(value, n)
                    if progressive:
                        continue
                    run = 0
                    for v in block[1:].tolist():
                        if not v:
                            run += 1
                            continue
                        while run > 15:
                            bits.put(*ac[0xF0])
                            run -= 16
                        value, n = _signed(v)
                        bits.put(*ac[(run << 4) | n])
                        bits.put(value, n)
                        run = 0
                    if run:
                        bits.put(*ac[0])
    bits.flush()
    scans.append(bytes(bits.out))
    body = scans[0] + b"".join(bytes([255, 0xD0 + k % 8]) + s for k, s in enumerate(scans[1:]))
    n = len(planes)
    tables = bytes([16]) + b"".join(int(q).to_bytes(2, "big") for q in quant) if wide_tables else bytes([0]) + bytes(quant.tolist())
    huff = bytes([0x00, *DC_LUMA[0], *DC_LUMA[1]]) + bytes([0x01, *DC_CHROMA[0], *DC_CHROMA[1]]) + bytes([0x10, *ac_table[0], *ac_table[1]])
    frame = bytes([8]) + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, (hs << 4 | vs) if c == 0 else 0x11, 0]) for c in range(n))
    scan = bytes([n]) + b"".join(bytes([c + 1, 0x10 * min(c, 1)]) for c in range(n)) + (bytes([0, 0, 0]) if progressive else bytes([0, 63, 0]))
    dri = _marker(0xDD, restart.to_bytes(2, "big")) if restart else b""
    return b"\xff\xd8" + app1 + _marker(0xDB, tables) + _marker(0xC2 if progressive else 0xC0, frame) + _marker(0xC4, huff) + dri + _marker(0xDA, scan) + body + b"\xff\xd9"


def picture(seed: int, wide: int, high: int) -> list[np.ndarray]:
    """A smooth picture with some texture: Y, Cb, Cr."""
    y, x = np.mgrid[0:high, 0:wide]
    draw = np.random.default_rng(seed)
    waves = [np.clip(128 + 90 * np.sin(x / (9 + seed % 7 + 5 * k) + k) * np.cos(y / (11 + seed % 5 + 3 * k)) + (draw.normal(0, 3, (high, wide)) if k == 0 else 0), 0, 255) for k in range(3)]
    return [w.astype(np.uint8) for w in waves]
