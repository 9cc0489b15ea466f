"""Tables of the baseline format and what is computed from them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..functions.blocks import AAN, PLACE, ZIGZAG

ZIGZAG_ARRAY, PLACE_ARRAY, AAN_ARRAY = np.array(ZIGZAG), np.array(PLACE), np.array(AAN, np.int64)

# The typical Huffman tables of the public standard (ITU-T T.81, annex K), as code counts by length and symbols.
DC_LUMA = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))
DC_CHROMA = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12)))


def flat_ac() -> tuple[tuple[int, ...], tuple[int, ...]]:
    """An AC table of our encoder: short codes for frequent (run, size) symbols, all symbols present."""
    symbols = sorted([(run << 4) | size for run in range(16) for size in range(1, 11)] + [0x00, 0xF0], key=lambda s: (0 if s == 0 else (s >> 4) * 2 + (s & 15), s))
    counts, room, left = [0] * 16, 1, len(symbols)
    for length in range(16):
        room *= 2
        counts[length] = left if left < room else room // 4  # a quarter of the free codes; all that is left once it fits, one code staying free
        room, left = room - counts[length], left - counts[length]
    return tuple(counts), tuple(symbols)


@lru_cache(256)
def decode_table(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> list[int]:
    """For every 16 bits that can come next: (code length << 8) | symbol; 0 where no code begins so. Raises on too many codes."""
    table, at, k = np.zeros(1 << 16, np.int32), 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            span = 1 << (16 - n)
            if at + span > 1 << 16 or k >= len(symbols):
                raise ValueError("too many codes")
            table[at : at + span] = (n << 8) | symbols[k]
            at, k = at + span, k + 1
    return table.tolist()


@lru_cache(256)
def skip_table(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> list[int]:
    """For every 16 bits: how far the AC codes go that fit in them whole, with their extra bits.

    bits | coefficients << 8 | (1 << 16 if the last is an end of block); 0 where not even one fits. For blocks of which
    nothing is stored: several codes are passed at a look-up.
    """
    one = np.array(decode_table(lengths, symbols), np.int64)
    window, bits, coefs = np.arange(1 << 16), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    ended, open_ = np.zeros(1 << 16, bool), np.ones(1 << 16, bool)
    while open_.any():
        entry = one[(window << bits) & 0xFFFF]
        symbol = entry & 255
        size = symbol & 15
        used = (entry >> 8) + size
        end = (symbol == 0) & (entry > 0)
        open_ &= (entry > 0) & (bits + used <= 16) & ((size > 0) | end | (symbol == 0xF0))
        bits[open_] += used[open_]
        coefs[open_] += np.where(end, 0, (symbol >> 4) + 1)[open_]
        ended |= open_ & end
        open_ &= ~end & (bits < 16)
    return (bits | (coefs << 8) | (ended.astype(np.int64) << 16)).tolist()


def codes(lengths, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def prescaled(quant_zigzag: np.ndarray) -> np.ndarray:
    """Natural order, transform factors folded in; each cut to an integer."""
    return (quant_zigzag.astype(np.int64)[PLACE_ARRAY] * AAN_ARRAY) >> 12


def clip(v: np.ndarray) -> np.ndarray:
    return np.clip((((v & 1023) + 512) & 1023) - 512 + 128, 0, 255)


def _pass(x):
    m = lambda a, k: (a * k) >> 8
    a, b, c = x[0] + x[4], x[0] - x[4], x[2] + x[6]
    d = m(x[2] - x[6], 362) - c
    e0, e3, e1, e2 = a + c, a - c, b + d, b - d
    z13, z10, z11, z12 = x[5] + x[3], x[5] - x[3], x[1] + x[7], x[1] - x[7]
    o7, z5 = z11 + z13, m(z10 + z12, 473)
    o6 = m(z10, -669) + z5 - o7
    o5 = m(z11 - z13, 362) - o6
    o4 = m(z12, 277) - z5 + o5
    return np.stack([e0 + o7, e1 + o6, e2 + o5, e3 - o4, e3 + o4, e2 - o5, e1 - o6, e0 - o7])


def idct(dequant: np.ndarray, extra_bits: int = 0) -> np.ndarray:
    """(n, 64) dequantized coefficients to (n, 64) samples; extra_bits: of fraction in the input beyond the usual 5 less 2."""
    x = dequant.reshape(-1, 8, 8).astype(np.int64)
    columns = _pass([x[:, r, :] for r in range(8)])
    if not extra_bits:
        columns = ((columns + 32768) & 65535) - 32768
    rows = _pass([columns[:, :, c] for c in range(8)])  # (column, row, n)
    return clip(rows.transpose(2, 1, 0) >> (5 + extra_bits)).reshape(-1, 64)


def samples_of(coefs: np.ndarray, quant_zigzag: np.ndarray, shift: int, precise: bool = False) -> np.ndarray:
    """Blocks of natural-order coefficients to their 64, 64, 4 or 1 samples at the scale 1, 1/2, 1/4, 1/8 (halves are averaged later)."""
    quant = prescaled(quant_zigzag)
    if shift == 3:
        return clip((coefs[:, :1] * quant[0]) >> 5)
    if shift == 2:
        p, q, r, s = (coefs[:, k].astype(np.int64) * quant[k] for k in (0, 8, 1, 9))
        t0, t2, t1, t3 = p + q, p - q, r + s, r - s
        return clip(np.stack([t0 + t1, t0 - t1, t2 + t3, t2 - t3], 1) >> 5)
    out = np.empty((len(coefs), 64), np.int64)
    flat = ~coefs[:, 1:].any(axis=1)
    if precise:
        full = coefs.astype(np.int64) * (quant_zigzag.astype(np.int64)[PLACE_ARRAY] * AAN_ARRAY)
        return idct(full >> 4, 8)
    out[flat] = clip((coefs[flat, :1] * quant[0]) >> 5)
    if not flat.all():
        out[~flat] = idct(coefs[~flat] * quant)
    return out
