"""JPEG images against an encoder of the same standard, written out plainly."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from terrazzo.sources import jpeg, scenes


def encoded(planes, factors, every=0, step=2, transform=True, apart=False, bands=None):
    """A baseline JPEG of planes (already in its colours), with codes of 8 bits for all symbols; of
    `bands` (components, first, last, high, low), a progressive one of these scans."""
    height, width = planes[0].shape
    most_v, most_h = max(v for v, _ in factors), max(h for _, h in factors)
    grid = -(-height // (8 * most_v)), -(-width // (8 * most_h))
    blocks = []
    for plane, (v, h) in zip(planes, factors):
        small = np.pad(plane.astype(float), ((0, grid[0] * 8 * most_v - height), (0, grid[1] * 8 * most_h - width)), mode="edge")
        ky, kx = most_v // v, most_h // h
        small = small.reshape(small.shape[0] // ky, ky, small.shape[1] // kx, kx).mean(axis=(1, 3))
        tiles = small.reshape(grid[0] * v, 8, grid[1] * h, 8).transpose(0, 2, 1, 3) - 128
        x, u = np.mgrid[:8, :8]
        basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, 8**-0.5, 0.5)
        blocks.append(np.rint(np.einsum("xu,abxy,yv->abuv", basis, tiles, basis) / step).astype(int))
    walk = [(0, 0)]
    while walk[-1] != (7, 7):
        i, j = walk[-1]
        up = (i + j) % 2 == 0
        walk.append((i, j + 1) if up and i == 0 and j < 7 or not up and i == 7 else (i + 1, j) if up and j == 7 or not up and j == 0 else (i - 1, j + 1) if up else (i + 1, j - 1))
    symbols = [r << 4 | s for r in range(16) for s in range(12)][:200]
    code = {s: f"{k:08b}" for k, s in enumerate(symbols)}

    def number(x):
        size = int(abs(x)).bit_length()
        return size, f"{x if x > 0 else x + (1 << size) - 1:0{size}b}" if size else ""

    def packed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    def banded(first, last, high, low):
        """Bits of one block after another in a progressive scan; of None, those still held back."""
        held = {"run": 0, "bits": "", "dc": {}}

        def blanks():
            n, power = held["run"], held["run"].bit_length() - 1
            out = code[power << 4] + (f"{n - (1 << power):0{power}b}" if power else "") + held["bits"] if n else ""
            held["run"], held["bits"] = 0, ""
            return out

        def code_block(values, k):
            if values is None:
                return blanks()
            if first == 0:
                now = values[0] >> low
                if high:
                    return str(now & 1)
                size, tail = number(now - held["dc"].get(k, 0))
                held["dc"][k] = now
                return code[size] + tail
            small = [(abs(x) >> low) * (1 if x > 0 else -1) for x in values]
            newest = max((i for i in range(first, last + 1) if abs(small[i]) == 1 or not high and small[i]), default=0)
            out, run, corrections = "", 0, ""
            for i in range(first, last + 1):
                x = small[i]
                if x == 0:
                    run += 1
                    continue
                while run > 15 and i <= newest:
                    out, run, corrections = out + blanks() + code[0xF0] + corrections, run - 16, ""
                if high and abs(x) > 1:
                    corrections += str(abs(x) & 1)
                    continue
                size, tail = number(x)
                out += blanks() + code[run << 4 | (1 if high else size)] + (("1" if x > 0 else "0") if high else tail) + corrections
                run, corrections = 0, ""
            if run or corrections:
                held["run"], held["bits"] = held["run"] + 1, held["bits"] + corrections
                if held["run"] == 32767:
                    out += blanks()
            return out

        return code_block

    def scan(which, band=None):
        units = [[(k, r * factors[k][0] + y, c * factors[k][1] + x) for k in which for y in range(factors[k][0]) for x in range(factors[k][1])] for r in range(grid[0]) for c in range(grid[1])]
        if len(which) == 1:
            v, h = factors[which[0]]
            units = [[(which[0], r, c)] for r in range(-(-(-(-height * v // most_v)) // 8)) for c in range(-(-(-(-width * h // most_h)) // 8))]
        out, marks = b"", 0
        for start in range(0, len(units), every or len(units)):
            bits, last, coder = "", {}, banded(*band) if band else None
            for unit in units[start : start + (every or len(units))]:
                for k, r, c in unit:
                    values = [int(blocks[k][r, c, i, j]) for i, j in walk]
                    if coder:
                        bits += coder(values, k)
                        continue
                    size, tail = number(values[0] - last.get(k, 0))
                    last[k] = values[0]
                    bits += code[size] + tail
                    run = 0
                    end = max((i for i in range(64) if values[i]), default=0)
                    for x in values[1 : max(end, 0) + 1]:
                        if x == 0:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + code[0xF0], run - 16
                        size, tail = number(x)
                        bits, run = bits + code[run << 4 | size] + tail, 0
                    if end < 63:
                        bits += code[0]
            out += packed(bits + (coder(None, None) if coder else ""))
            if every and start + every < len(units):
                out += bytes([0xFF, 0xD0 + marks % 8])
                marks += 1
        head = bytes([len(which)]) + b"".join(bytes([k + 1, 0]) for k in which) + bytes([band[0], band[1], band[2] << 4 | band[3]] if band else [0, 63, 0])
        return b"\xff\xda" + struct.pack(">H", len(head) + 2) + head + out

    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    counts = bytes([0] * 7 + [len(symbols)] + [0] * 8)
    data = b"\xff\xd8" + segment(0xFE, b"a comment") + segment(0xDB, bytes([0] + [step] * 64))
    data += segment(0xC2 if bands else 0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (v, h) in enumerate(factors)))
    data += segment(0xC4, bytes([0]) + counts + bytes(symbols)) + segment(0xC4, bytes([16]) + counts + bytes(symbols))
    if not transform:
        data += segment(0xEE, b"Adobe" + bytes([0, 100, 0, 0, 0, 0, 0]))
    if every:
        data += segment(0xDD, struct.pack(">H", every))
    if bands:
        return data + b"".join(scan(which, band) for which, *band in bands) + b"\xff\xd9"
    return data + b"".join(scan(w) for w in ([[k] for k in range(len(planes))] if apart else [list(range(len(planes)))])) + b"\xff\xd9"


def smooth(shape, seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: shape[0], : shape[1]]
    return np.clip(128 + 60 * np.sin(x / rng.uniform(5, 9)) + 50 * np.cos(y / rng.uniform(5, 9)), 0, 255)


def test_grey_images():
    for shape in ((8, 8), (17, 23), (40, 9)):
        image = smooth(shape, 1)
        assert np.abs(jpeg.read_jpeg(encoded([image], [(1, 1)], step=1)).astype(float) - image).max() <= 3


@pytest.mark.parametrize("every", [0, 3])
@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("factors", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]])
def test_colour_images(factors, apart, every):
    y, blue, red = smooth((29, 37), 2), np.full((29, 37), 90.0), np.full((29, 37), 160.0)
    got = jpeg.read_jpeg(encoded([y, blue, red], factors, every, apart=apart)).astype(float)
    want = np.stack([y + 1.402 * 32, y - 0.344136 * -38 - 0.714136 * 32, y + 1.772 * -38], axis=2)
    assert got.shape == (29, 37, 3) and np.abs(got - np.clip(want, 0, 255)).max() <= 6


def test_untransformed_colours_and_noise():
    rng = np.random.default_rng(3)
    planes = [rng.integers(0, 256, (16, 16)).astype(float) for _ in range(3)]
    got = jpeg.read_jpeg(encoded(planes, [(1, 1)] * 3, step=1, transform=False))
    assert np.abs(got - np.stack(planes, axis=2)).max() <= 4


@pytest.mark.parametrize("every", [0, 3])
@pytest.mark.parametrize("factors", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)]])
def test_progressive_images_equal_sequential_ones(factors, every):
    rng = np.random.default_rng(len(factors))
    planes = [np.clip(smooth((45, 52), k) + rng.normal(size=(45, 52)) * 12 * (np.arange(52) > 25), 0, 255) for k in range(len(factors))]
    all_ = list(range(len(factors)))
    bands = [(all_, 0, 0, 0, 1)] + [([k], *band) for k in all_ for band in ((1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1))] + [(all_, 0, 0, 1, 0)] + [([k], 1, 63, 1, 0) for k in all_]
    want = jpeg.read_jpeg(encoded(planes, factors, every, step=3))
    assert np.array_equal(jpeg.read_jpeg(encoded(planes, factors, every, step=3, bands=bands)), want)
    coarse = jpeg.read_jpeg(encoded(planes, factors, every, step=3, bands=bands[: 1 + len(all_)]))  # as far as it came
    assert coarse.shape == want.shape and not np.array_equal(coarse, want)


def test_other_files_are_refused():
    good = encoded([smooth((16, 16), 1)], [(1, 1)])
    for bad, why in ((b"png", "not a JPEG"), (good.replace(b"\xff\xc0", b"\xff\xc2"), "sequential"), (b"\xff\xd8\xff\xd9", "without an image")):
        with pytest.raises(ValueError, match=why):
            jpeg.read_jpeg(bad)


def test_colour_frames_of_a_scene(spark, tmp_path):
    (tmp_path / "000004.jpg").write_bytes(encoded([smooth((8, 16), 5)] * 3, [(1, 1)] * 3, transform=False, step=1))
    (tmp_path / "000005.png").write_bytes(scenes.formats.write_png(np.full((1, 2, 3), 255, np.uint8)))
    rows = scenes.color_pixels(spark, str(tmp_path)).collect()
    assert {r["frame"]: 0 for r in rows}.keys() == {4, 5} and len(rows) == 8 * 16 + 2
    assert all(abs(r["r"] * 255 - smooth((8, 16), 5)[r["v"], r["u"]]) <= 4 for r in rows if r["frame"] == 4)
