"""Round trips through our own encoder, broken files, and metadata."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.codec.decode import bmp, client_dithered, decode_frame, dithered, frame_bytes, tiles
from tessera.codec.encoder import encode, exif_segment, picture
from tessera.codec.entropy import unstuff
from tessera.codec.header import Bad, parse
from tessera.plans.options import DecodeOptions, PixelType, Status

SUBS = [0x00, 0x11, 0x12, 0x21, 0x22]


def image(sub, wide=61, high=43, seed=3, **more):
    planes = picture(seed, wide, high)
    return planes, encode(planes[:1] if sub == 0 else planes, sub, 90, **more)


@pytest.mark.parametrize("sub", SUBS)
@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("wide_tables", [False, True])
def test_gray_round_trip(sub, restart, wide_tables):
    planes, data = image(sub, restart=restart, wide_tables=wide_tables)
    frame = decode_frame(data, DecodeOptions(pixel_type=PixelType.GRAY8, idct="precise"))
    assert frame.status is Status.SUCCESS and (frame.width, frame.height) == (61, 43)
    assert ((frame.pixels.astype(int) - planes[0]) ** 2).mean() ** 0.5 < 4
    assert decode_frame(data, DecodeOptions(luma_only=True)).pixels.shape == (43, 61)


@pytest.mark.parametrize("sub", SUBS)
def test_colour_round_trip(sub):
    planes, data = image(sub, 64, 48)
    p = decode_frame(data, DecodeOptions(pixel_type=PixelType.RGB8888)).pixels
    y, cb, cr = (x.astype(float) for x in planes) if sub else (planes[0].astype(float), 128.0, 128.0)
    want = [y + 1.402 * (cr - 128), y - 0.344 * (cb - 128) - 0.714 * (cr - 128), y + 1.772 * (cb - 128)]
    for k, w in enumerate(want):
        assert np.abs(((p >> (8 * k)) & 255).astype(int) - np.clip(w, 0, 255)).mean() < 12
    assert ((p >> 24) == 255).all()
    le, be = (decode_frame(data, DecodeOptions(pixel_type=k)) for k in (PixelType.RGB565_LE, PixelType.RGB565_BE))
    assert (le.pixels == be.pixels).all() and frame_bytes(le, DecodeOptions())[0] == frame_bytes(be, DecodeOptions(pixel_type=PixelType.RGB565_BE))[1]


@pytest.mark.parametrize("sub", SUBS)
@pytest.mark.parametrize("scale", [2, 4, 8])
def test_scales_are_means(sub, scale):
    planes, data = image(sub, 64, 48)
    full = decode_frame(data, DecodeOptions(pixel_type=PixelType.GRAY8)).pixels.astype(float)
    small = decode_frame(data, DecodeOptions(pixel_type=PixelType.GRAY8, scale=scale))
    assert (small.width, small.height) == (64 // scale, 48 // scale)
    means = full.reshape(48 // scale, scale, 64 // scale, scale).mean(axis=(1, 3))
    assert np.abs(means - small.pixels).mean() < (1 if scale == 2 else 9)
    assert decode_frame(data, DecodeOptions(scale=scale)).pixels.shape == small.pixels.shape


@pytest.mark.parametrize("sub", SUBS)
def test_crop_is_a_part_of_the_whole(sub):
    _, data = image(sub, 100, 80)
    whole, part = (decode_frame(data, DecodeOptions(crop=c)) for c in (None, (17, 20, 30, 25)))
    x, y, w, h = part.crop
    assert x % 8 == y % 8 == w % 8 == h % 8 == 0 and x <= 17 and y <= 20
    assert (part.pixels == whole.pixels[y : y + h, x : x + w]).all() and part.pixels.size


def test_luma_only_is_less_work():
    _, data = image(0x22, 64, 48)
    from tessera.codec.entropy import decode_scan

    coefs, _ = decode_scan(data, parse(data), keep_chroma=False)
    assert not coefs[:, 4:].any() and coefs[:, :4].any()


@pytest.mark.parametrize("sub", SUBS)
def test_skipped_codes_end_where_read_ones_do(sub):
    """DC values, and the number of whole MCUs of a cut file, don't depend on whether AC codes are stored."""
    from tessera.codec.entropy import decode_scan

    _, data = image(sub, 90, 70, restart=4)
    for size in range(len(data) - 900, len(data), 37):
        full, whole = decode_scan(data[:size], parse(data[:size]))
        dc, same = decode_scan(data[:size], parse(data[:size]), dc_only=True)
        assert whole == same and (full[:whole, :, 0] == dc[:whole, :, 0]).all() and not dc[:, :, 1:].any()


def test_progressive_gives_an_eighth():
    planes, data = image(0x22, 64, 48, progressive=True)
    frame = decode_frame(data, DecodeOptions(pixel_type=PixelType.GRAY8))
    assert frame.header.progressive and (frame.width, frame.height) == (8, 6)
    assert np.abs(planes[0].reshape(6, 8, 8, 8).mean(axis=(1, 3)) - frame.pixels).mean() < 4


@pytest.mark.parametrize("order", ["little", "big"])
def test_thumbnail_and_orientation(order):
    thumb = encode(picture(9, 32, 24), 0x22)
    _, data = image(0x22, app1=exif_segment(order, 6, thumb, (32, 24)))
    h = parse(data)
    assert (h.orientation, h.has_thumb, h.thumb_width, h.thumb_height) == (6, True, 32, 24)
    frame = decode_frame(data, DecodeOptions(thumbnail=True))
    assert (frame.status, frame.width, frame.height) == (Status.SUCCESS, 32, 24)
    assert (frame.pixels == decode_frame(thumb, DecodeOptions()).pixels).all()
    _, plain = image(0x22, app1=exif_segment(order, 3, None))
    assert parse(plain).orientation == 3 and not parse(plain).has_thumb
    assert decode_frame(plain, DecodeOptions(thumbnail=True)).status is Status.INVALID_PARAMETER


def test_tiles_cover_the_frame():
    _, data = image(0x22, 150, 70)
    for options in (DecodeOptions(max_mcus=3), DecodeOptions(pixel_type=PixelType.RGB8888), DecodeOptions(crop=(20, 20, 60, 30), dma=True), DecodeOptions(scale=2)):
        frame = decode_frame(data, options)
        seen = np.zeros((frame.height, frame.width), int)
        for _, x, y, w, h, used, bits, pixels in tiles(frame, options):
            seen[y : y + h, x : x + used] += 1
            assert len(pixels) == used * h * bits // 8 and used <= w
        assert (seen == 1).all()


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_dithering_keeps_the_mean_and_the_range(bits):
    gray = np.full((40, 61), 100, np.uint8)
    packed = dithered(gray, bits)
    assert packed.shape == (40, -(-61 * bits // 8))
    per = 8 // bits
    levels = np.stack([(packed >> (8 - bits * (k + 1))) & ((1 << bits) - 1) for k in range(per)], 2).reshape(40, -1)[:, :61]
    assert abs(levels.mean() * (256 >> bits) - 100) < 4
    assert set(np.unique(client_dithered(np.full((8, 8), 30, np.uint8)))) <= {0, 1, 2, 3}


def test_bitmaps():
    for kind, bits in ((PixelType.RGB8888, 32), (PixelType.RGB565_LE, 16), (PixelType.GRAY8, 8)):
        _, data = image(0x11, 13, 9)
        file = bmp(decode_frame(data, DecodeOptions(pixel_type=kind)).pixels, kind)
        assert file[:2] == b"BM" and int.from_bytes(file[2:6], "little") == len(file) and int.from_bytes(file[28:30], "little") == bits


def test_statuses():
    _, data = image(0x22)
    assert decode_frame(b"", DecodeOptions()).status is Status.INVALID_FILE
    assert decode_frame(b"GIF89a" + data[6:], DecodeOptions()).status is Status.INVALID_FILE
    assert decode_frame(data.replace(b"\xff\xc0", b"\xff\xc9", 1), DecodeOptions()).status is Status.UNSUPPORTED
    cut = decode_frame(data[: len(data) * 3 // 4], DecodeOptions())
    assert cut.status is Status.DECODE_ERROR and cut.pixels is not None
    with pytest.raises(Bad):
        parse(data[:300])


@given(st.binary(max_size=200))
def test_unstuffing_undoes_stuffing(data):
    assert unstuff(data.replace(b"\xff", b"\xff\x00")) == data


_, FUZZED = image(0x22, 40, 40, restart=2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, len(FUZZED) - 1), st.integers(0, 255)), min_size=1, max_size=3))
def test_any_damage_gives_a_status(changes):
    data = bytearray(FUZZED)
    for at, value in changes:
        data[at] = value
    try:
        header = parse(bytes(data))
    except Bad as e:
        assert e.status is not Status.SUCCESS
        return
    if header.width * header.height < 1 << 16:
        assert isinstance(decode_frame(bytes(data), DecodeOptions()).status, Status)


def test_every_inverted_header_byte():
    for at in range(2, 600, 5):
        data = bytearray(FUZZED)
        data[at] ^= 255
        try:
            header = parse(bytes(data))
        except Bad:
            continue
        if header.width * header.height < 1 << 16:
            decode_frame(bytes(data), DecodeOptions())


def claiming(data, wide, high):
    at = next(k for k in range(len(data)) if data[k : k + 2] in (b"\xff\xc0", b"\xff\xc2"))
    return data[: at + 5] + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + data[at + 9 :]


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("size", [(65535, 65535), (20000, 20000), (65535, 8)])
def test_small_files_cannot_ask_for_much(size, progressive):
    """A status at each scale, and little memory on the way."""
    import tracemalloc

    small = claiming(image(0x22, 16, 16, progressive=progressive)[1], *size)
    tracemalloc.start()
    for scale in (1, 2, 4, 8):
        frame = decode_frame(small, DecodeOptions(scale=scale))
        assert frame.status is Status.DECODE_ERROR and (frame.pixels is None or frame.pixels.size < 1 << 21)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_too_large_for_memory(monkeypatch):
    from tessera.codec import entropy

    monkeypatch.setattr(entropy, "MOST_BYTES", 1000)
    assert decode_frame(image(0x11)[1], DecodeOptions()).status is Status.ERROR_MEMORY


def test_bare_headers_decode_alike():
    from tessera.codec.header import bare

    app1 = exif_segment("big", 6, encode(picture(1, 16, 16), 0x11), (16, 16))
    _, data = image(0x21, app1=app1)
    h = parse(data)
    short = bare(data, h.scan_offset)
    assert len(short) == h.scan_offset - len(app1) and b"Exif" not in short
    again = parse((short + data[h.scan_offset :]).ljust(256, b"\0"))
    assert again.scan_offset == len(short) and again.huff == h.huff and again.quant == h.quant and again.grid == h.grid
