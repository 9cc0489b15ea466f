"""What a decode can be asked for, and how it can end."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum


class PixelType(Enum):
    RGB565_LE = 0
    RGB565_BE = 1
    RGB8888 = 2
    GRAY8 = 3
    DITHER4 = 4
    DITHER2 = 5
    DITHER1 = 6


class Status(IntEnum):
    SUCCESS = 0
    INVALID_PARAMETER = 1
    DECODE_ERROR = 2
    UNSUPPORTED = 3
    INVALID_FILE = 4
    ERROR_MEMORY = 5


class Mode(Enum):
    PERMISSIVE = "permissive"
    DROPMALFORMED = "dropmalformed"
    FAILFAST = "failfast"


#: Y sampling as hex digits h, v of the luma against chroma; 0 is gray.
SUBSAMPLINGS = (0x00, 0x11, 0x12, 0x21, 0x22)
#: Pixels of 16 bits that a tile buffer holds.
TILE_PIXELS = 2048
#: The placement that means: in the middle.
CENTRE = -2
#: A signature's and a frame header's least size.
LEAST_BYTES = 256


@dataclass(frozen=True)
class DecodeOptions:
    """``scale``: 1, 2, 4 or 8; ``crop``: x, y, w, h in source pixels; ``max_mcus``: of a tile; ``thumbnail``: the EXIF one."""

    pixel_type: PixelType = PixelType.RGB565_LE
    scale: int = 1
    crop: tuple[int, int, int, int] | None = None
    luma_only: bool = False
    thumbnail: bool = False
    max_mcus: int = 1000
    dma: bool = False
    mode: Mode = Mode.PERMISSIVE
    idct: str = "parity"
    x: int = 0
    y: int = 0

    def __post_init__(self):
        if self.scale not in (1, 2, 4, 8):
            raise ValueError("scale is 1, 2, 4 or 8")
        if self.max_mcus < 1:
            raise ValueError("max_mcus is 1 or more")
        if self.idct not in ("parity", "precise"):
            raise ValueError("idct is parity or precise")

    @property
    def shift(self) -> int:
        return self.scale.bit_length() - 1

    @property
    def gray(self) -> bool:
        """Does the output need no chroma? Then chroma is never stored, transformed or converted."""
        return self.luma_only or self.pixel_type.value >= PixelType.GRAY8.value
