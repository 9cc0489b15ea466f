"""Arithmetic on 8 x 8 blocks, as expressions on arrays of 64 integers in natural (row-major) order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixels import range_clip

#: Natural positions in zig-zag order: along anti-diagonals, every other one upwards.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
#: Zig-zag place of each natural position.
PLACE = sorted(range(64), key=ZIGZAG.__getitem__)

_S = [1.0] + [math.sqrt(2) * math.cos(k * math.pi / 16) for k in range(1, 8)]
#: The AAN transform's factors with 14 fractional bits, in natural order.
AAN = [round(16384 * _S[i // 8] * _S[i % 8]) for i in range(64)]

#: The transform's multipliers over 256; fixed values.
M362, M473, M669, M277 = 362, 473, 669, 277


def _literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def to_natural(zigzag: Column) -> Column:
    """Zig-zag to natural order."""
    return F.transform(_literal(PLACE), lambda k: F.element_at(zigzag, k + 1))


def to_zigzag(natural: Column) -> Column:
    return F.transform(_literal(ZIGZAG), lambda k: F.element_at(natural, k + 1))


def prescaled(quant_zigzag: Column) -> Column:
    """A quantization table in natural order with the transform's factors folded in."""
    return F.zip_with(to_natural(quant_zigzag), _literal(AAN), lambda q, f: F.shiftright(q * f, 12))


def dequantized(coefs: Column, quant: Column) -> Column:
    return F.zip_with(coefs, quant, lambda c, q: c * q)


def dc_sample(dc: Column, quant0: Column) -> Column:
    return range_clip(F.shiftright(dc * quant0, 5))


def dc_fill(dc: Column, quant0: Column, samples: int = 64) -> Column:
    """The block of a DC coefficient alone."""
    return F.array_repeat(dc_sample(dc, quant0), samples)


def _wrap16(v: Column) -> Column:
    return (v + 32768).bitwiseAND(F.lit(65535)) - 32768


def _m(a: Column, k: int) -> Column:
    return F.shiftright(a * k, 8)


def _pass(lines: Column) -> Column:
    """The one-dimensional transform of each struct x0..x7, as arrays of 8. Steps are transforms of transforms, so that nothing is written twice."""

    def first(s):
        return F.struct(
            (s["x0"] + s["x4"]).alias("a"), (s["x0"] - s["x4"]).alias("b"), (s["x2"] + s["x6"]).alias("c"), (s["x2"] - s["x6"]).alias("n"),
            (s["x5"] + s["x3"]).alias("z13"), (s["x5"] - s["x3"]).alias("z10"), (s["x1"] + s["x7"]).alias("z11"), (s["x1"] - s["x7"]).alias("z12"),
        )

    def second(s):
        return F.struct(
            (s["a"] + s["c"]).alias("e0"), (s["a"] - s["c"]).alias("e3"), s["b"].alias("b"), (_m(s["n"], M362) - s["c"]).alias("d"), (s["z11"] + s["z13"]).alias("o7"),
            _m(s["z10"] + s["z12"], M473).alias("z5"), _m(s["z10"], -M669).alias("z10"), _m(s["z12"], M277).alias("z12"), _m(s["z11"] - s["z13"], M362).alias("t5"),
        )

    def third(s):
        return F.struct(*[s[k].alias(k) for k in ("e0", "e3", "o7", "z5", "z12", "t5")], (s["b"] + s["d"]).alias("e1"), (s["b"] - s["d"]).alias("e2"), (s["z10"] + s["z5"] - s["o7"]).alias("o6"))

    def fourth(s):
        return F.struct(*[s[k].alias(k) for k in ("e0", "e1", "e2", "e3", "o6", "o7", "z5", "z12")], (s["t5"] - s["o6"]).alias("o5"))

    def last(s):
        o4 = s["z12"] - s["z5"] + s["o5"]
        return F.array(s["e0"] + s["o7"], s["e1"] + s["o6"], s["e2"] + s["o5"], s["e3"] - o4, s["e3"] + o4, s["e2"] - s["o5"], s["e1"] - s["o6"], s["e0"] - s["o7"])

    for step in (first, second, third, fourth, last):
        lines = F.transform(lines, step)
    return lines


def _lines(pick) -> Column:
    return F.transform(_literal(range(8)), lambda k: F.struct(*[pick(k, j).alias(f"x{j}") for j in range(8)]))


def idct(dequant: Column) -> Column:
    """The full 8 x 8 transform to samples: columns, cut to 16 bits, then rows."""
    columns = F.transform(_pass(_lines(lambda c, j: F.element_at(dequant, c + (8 * j + 1)))), lambda line: F.transform(line, _wrap16))
    return F.transform(
        F.array(columns),
        lambda cols: F.flatten(F.transform(_pass(_lines(lambda r, j: F.element_at(F.element_at(cols, j + 1), r + 1))), lambda line: F.transform(line, lambda v: range_clip(F.shiftright(v, 5))))),
    )[0]


def idct_quarter(dequant: Column) -> Column:
    """2 x 2 samples of a block from its four lowest coefficients."""
    p, q, r, s = (F.element_at(dequant, k + 1) for k in (0, 8, 1, 9))
    t0, t2, t1, t3 = p + q, p - q, r + s, r - s
    return F.transform(F.array(t0 + t1, t0 - t1, t2 + t3, t2 - t3), lambda v: range_clip(F.shiftright(v, 5)))


def column_mask(coefs: Column) -> Column:
    """A bit for each column of a block that has a coefficient beyond the first."""
    marks = F.transform(coefs, lambda v, k: F.when((v != 0) & (k > 0), F.call_function("shiftleft", F.lit(1), k % 8)).otherwise(0))
    return F.aggregate(marks, F.lit(0), lambda acc, v: acc.bitwiseOR(v))


def last_place(coefs_zigzag: Column) -> Column:
    """The zig-zag place of the last coefficient that isn't 0; 0 for an empty block."""
    return F.aggregate(F.transform(coefs_zigzag, lambda v, k: F.when(v != 0, k).otherwise(0)), F.lit(0), lambda acc, v: F.greatest(acc, v))
