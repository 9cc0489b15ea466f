"""Entropy decoding of one restart segment. Bit-serial within it; segments are independent of each other."""

from __future__ import annotations

import re

import numpy as np

from ..plans.options import Status
from .header import Bad, Header
from .tables import ZIGZAG_ARRAY, decode_table, skip_table

#: Bytes of coefficients that one image may take; blocks that a header may ask for, per bit of its scan, and beside those.
MOST_BYTES, MOST_BLOCKS_A_BIT, SPARE_BLOCKS = 512 << 20, 16, 1024

_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")
_OTHER = re.compile(rb"\xff+[\x01-\xcf\xd8-\xfe]")


def unstuff(data: bytes) -> bytes:
    """FF 00 to FF; other markers vanish."""
    if b"\xff" not in data:
        return data
    return re.sub(rb"\xff(?:\x00|\xff*[\x01-\xfe]|\xff*$)", lambda m: b"\xff" if m[0] == b"\xff\x00" else b"", data)


def segments(data: bytes, header: Header) -> list[bytes]:
    """The scan's restart segments, without stuffing. Any other marker ends the scan."""
    end = None
    for m in _OTHER.finditer(data, header.scan_offset):
        end = m.start()
        break
    scan = data[header.scan_offset : end]
    parts = _RESTART.split(scan) if header.restart_interval else [scan]
    return [unstuff(part) for part in parts]


def decode_segment(data: bytes, header: Header, n_mcus: int, keep_chroma: bool = True, dc_only: bool = False) -> tuple[np.ndarray, int]:
    """(mcus, blocks, 64) coefficients in natural order with DC still as differences, and how many MCUs are whole.

    With dc_only, and in progressive images, the DC alone is stored: (mcus, blocks, 1). A segment that ends early, or a code that doesn't exist, ends the
    decoding after the last whole MCU.
    """
    plan = []
    for c in header.scan:
        for _ in range(header.luma_blocks if c.index == 0 else 1):
            dc = decode_table(*header.huff[0, c.dc])
            ac = None if header.progressive else decode_table(*header.huff[1, c.ac])
            keep = c.index == 0 or keep_chroma
            plan.append((dc, ac, None if header.progressive or keep and not dc_only else skip_table(*header.huff[1, c.ac]), keep))
    out = np.zeros((n_mcus, len(plan), _stored(header, dc_only)), np.int32)
    # 16 bits at every byte place, so that a code is one look-up; the padding reads as ones, as encoders pad.
    n_bits = 8 * len(data)
    padded = data + b"\xff" * 8
    word = int.from_bytes
    low, natural = header.approx_low if header.progressive else 0, ZIGZAG_ARRAY.tolist()
    at = 0
    for m in range(n_mcus):
        for b, (dc, ac, skip, keep) in enumerate(plan):
            byte = at >> 3
            if byte > len(data):
                return out, m
            window = word(padded[byte : byte + 6], "big") << (at & 7) & 0xFFFFFFFFFFFF
            entry = dc[window >> 32]
            if not entry:
                return out, m
            size, used = entry & 255, entry >> 8
            if size > 15:
                return out, m
            if size:
                v = (window << used & 0xFFFFFFFFFFFF) >> (48 - size)
                if v < 1 << (size - 1):
                    v -= (1 << size) - 1
                if keep:
                    out[m, b, 0] = v << low
            at += used + size
            if ac is None:
                continue
            k = 1
            while k < 64:
                byte = at >> 3
                if byte > len(data):
                    return out, m
                window = word(padded[byte : byte + 6], "big") << (at & 7) & 0xFFFFFFFFFFFF
                if skip and (entry := skip[window >> 32]) and k + (entry >> 8 & 255) <= 64:
                    at += entry & 255
                    k += entry >> 8 & 255
                    if entry >> 16:
                        break
                    continue
                entry = ac[window >> 32]
                if not entry:
                    return out, m
                symbol, used = entry & 255, entry >> 8
                size = symbol & 15
                at += used + size
                if not size:
                    if symbol == 0xF0:
                        k += 16
                        continue
                    if symbol:
                        return out, m
                    break
                k += symbol >> 4
                if k > 63:
                    return out, m
                if skip is None:
                    v = (window << used & 0xFFFFFFFFFFFF) >> (48 - size)
                    out[m, b, natural[k]] = v if v >= 1 << (size - 1) else v - (1 << size) + 1
                k += 1
        if at > n_bits:
            return out, m
    return out, n_mcus


def _stored(header: Header, dc_only: bool) -> int:
    return 1 if dc_only or header.progressive else 64


def checked(header: Header, scan_bytes: int, n_mcus: int, dc_only: bool = False) -> None:
    """Raises where a header asks for far more than its bytes can hold (a block takes a bit at least), or for too much."""
    blocks = n_mcus * (header.luma_blocks + (2 if len(header.components) == 3 else 0))
    if blocks > MOST_BLOCKS_A_BIT * 8 * scan_bytes + SPARE_BLOCKS:
        raise Bad(Status.DECODE_ERROR, "the scan can't hold an image of this size")
    if blocks * _stored(header, dc_only) * 4 > MOST_BYTES:
        raise Bad(Status.ERROR_MEMORY, "an image of this size takes too much memory")


def decode_scan(data: bytes, header: Header, keep_chroma: bool = True, dc_only: bool = False, last_mcu: int | None = None) -> tuple[np.ndarray, int]:
    """All segments' coefficients with DC predicted, and the number of leading MCUs that are whole. MCUs after last_mcu aren't read."""
    cx, cy = header.grid
    total = cx * cy
    wanted = total if last_mcu is None else min(total, last_mcu + 1)
    checked(header, len(data) - header.scan_offset, wanted, dc_only)
    try:
        parts = segments(data, header)
        # Rows of MCUs below the last wanted one have no place at all.
        out = np.zeros((-(-wanted // cx) * cx, header.luma_blocks + (2 if len(header.components) == 3 else 0), _stored(header, dc_only)), np.int32)
        done, step = 0, header.restart_interval or total
        for k, first in enumerate(range(0, wanted, step)):
            n = min(step, len(out) - first)
            if k >= len(parts):
                break
            found, whole = decode_segment(parts[k], header, n, keep_chroma, dc_only)
            out[first : first + n] = found
            luma = header.luma_blocks
            out[first : first + n, :luma, 0] = np.cumsum(found[:, :luma, 0].reshape(-1)).reshape(n, luma)
            for c in range(luma, out.shape[1]):
                out[first : first + n, c, 0] = np.cumsum(found[:, c, 0])
            if done == first:
                done += whole
        return out, min(done, wanted)
    except ValueError as e:
        raise Bad(Status.UNSUPPORTED, str(e)) from e
