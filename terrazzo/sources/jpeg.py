"""Reading of sequential and progressive JPEG images in numpy, after ITU-T T.81; colours by JFIF.

Entropy-coded values are read one by one, all transforms run over whole images. A progressive image
fills its coefficients scan by scan: bands of them, and then bit after bit. Chroma is enlarged by
repetition. Lossless, hierarchical and arithmetic-coded images are refused.
"""

from __future__ import annotations

import struct

import numpy as np

SIZE = 8
#: Places of a block in the order in which they are coded: along diagonals, back and forth.
ZIGZAG = sorted(range(SIZE * SIZE), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
#: Rows are the cosines of the transform, at unit length.
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 8**-0.5) for x in range(SIZE)] for u in range(SIZE)])

# fixed values of the format
START_SEQUENTIAL, START_PROGRESSIVE = (0xC0, 0xC1), 0xC2
OTHER_STARTS = tuple(m for m in range(0xC3, 0xD0) if m not in (0xC4, 0xC8, 0xCC))


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For each 16 bits that may come next, the length of the code they start with and its symbol."""
    table = [(0, 0)] * 65536
    code = at = 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            first = code << 16 - length
            table[first : first + (1 << 16 - length)] = [(length, symbols[at])] * (1 << 16 - length)
            code, at = code + 1, at + 1
        code <<= 1
    return table


class _Bits:
    """Bits of one stretch of entropy-coded data; behind its end come ones, as encoders pad."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def _fill(self) -> None:
        part = self.data[self.at : self.at + 32]
        self.at += 32
        self.held = self.held << 256 | int.from_bytes(part + b"\xff" * (32 - len(part)), "big")
        self.count += 256

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.count < 16:
            self._fill()
        length, symbol = table[self.held >> self.count - 16 & 0xFFFF]
        if not length:
            raise ValueError("a code that the table doesn't hold")
        self.count -= length
        self.held &= (1 << self.count) - 1
        return symbol

    def value(self, size: int) -> int:
        """A number of `size` bits, whose first bit tells its sign."""
        if not size:
            return 0
        x = self.plain(size)
        return x if x >> size - 1 else x - (1 << size) + 1

    def plain(self, size: int) -> int:
        """The next `size` bits as they are."""
        if self.count < size:
            self._fill()
        self.count -= size
        x = self.held >> self.count
        self.held &= (1 << self.count) - 1
        return x


def _block(bits: _Bits, out: np.ndarray, before: int, dc: list, ac: list) -> int:
    """Read one block of coefficients; its first one, which the next block's is told from."""
    first = before + bits.value(bits.symbol(dc))
    out[0] = first
    k = 1
    while k < 64:
        symbol = bits.symbol(ac)
        run, size = symbol >> 4, symbol & 15
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a block runs over its end")
        out[ZIGZAG[k]] = bits.value(size)
        k += 1
    return first


class _Band:
    """Progressive scans: the coefficients first to last of each block, down to bit `low`; the bits above
    `high` (0: none yet) are there from earlier scans."""

    def __init__(self, first: int, last: int, high: int, low: int):
        if first == 0 and last or first > last or last > 63:
            raise ValueError("a band as only a sequential image has it")
        self.first, self.last, self.high, self.low = first, last, high, low
        self.blank = 0  # blocks to come in which nothing new begins

    def read(self, bits: _Bits, out: np.ndarray, before: int, dc: list | None, ac: list | None) -> int:
        if self.first == 0:
            if self.high:
                out[0] |= bits.plain(1) << self.low
                return 0
            value = before + bits.value(bits.symbol(dc))
            out[0] = value << self.low
            return value
        if self.high:
            self._refine(bits, out, ac)
        else:
            self._begin(bits, out, ac)
        return 0

    def _blanks(self, bits: _Bits, power: int) -> int:
        return (1 << power) + (bits.plain(power) if power else 0)

    def _begin(self, bits: _Bits, out: np.ndarray, ac: list) -> None:
        if self.blank:
            self.blank -= 1
            return
        k = self.first
        while k <= self.last:
            symbol = bits.symbol(ac)
            run, size = symbol >> 4, symbol & 15
            if not size and run < 15:
                self.blank = self._blanks(bits, run) - 1
                return
            k += run
            if size:
                if k > self.last:
                    raise ValueError("a block runs over its end")
                out[ZIGZAG[k]] = bits.value(size) * (1 << self.low)
            k += 1

    def _correct(self, bits: _Bits, out: np.ndarray, place: int) -> None:
        """One bit more of a coefficient that isn't 0."""
        if bits.plain(1) and not abs(int(out[place])) >> self.low & 1:
            out[place] += (1 if out[place] > 0 else -1) << self.low

    def _refine(self, bits: _Bits, out: np.ndarray, ac: list) -> None:
        k = self.first
        while not self.blank and k <= self.last:
            symbol = bits.symbol(ac)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:
                self.blank = self._blanks(bits, zeros)
                break
            new = (1 if bits.plain(1) else -1) * (1 << self.low) if size else 0
            while k <= self.last:
                if out[ZIGZAG[k]]:
                    self._correct(bits, out, ZIGZAG[k])
                elif zeros:
                    zeros -= 1
                else:
                    break
                k += 1
            if new:
                if k > self.last:
                    raise ValueError("a block runs over its end")
                out[ZIGZAG[k]] = new
            k += 1
        if self.blank:
            for place in ZIGZAG[k : self.last + 1]:
                if out[place]:
                    self._correct(bits, out, place)
            self.blank -= 1


def read_jpeg(data: bytes) -> np.ndarray:
    """Pixels as uint8: height x width of a grey image, height x width x 3 (RGB) of one in colour."""
    if not data.startswith(b"\xff\xd8"):
        raise ValueError("not a JPEG file")
    quantum: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], list] = {}
    parts: list[dict] = []
    height = width = every = 0
    plain = progressive = False
    at = 2
    while at + 4 <= len(data):
        marker = data[at + 1]
        if data[at] != 0xFF or marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker in OTHER_STARTS:
            raise ValueError(f"a JPEG of kind {marker:#x} isn't sequential or progressive")
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                length = 128 if wide else 64
                table = np.empty(64)
                table[ZIGZAG] = np.frombuffer(body[1 : 1 + length], ">u2" if wide else "u1")
                quantum[number], body = table.reshape(SIZE, SIZE), body[1 + length :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            (every,) = struct.unpack(">H", body)
        elif marker == 0xEE and body.startswith(b"Adobe") and len(body) >= 12:
            plain = body[11] == 0  # colours that were not transformed
        elif marker in (*START_SEQUENTIAL, START_PROGRESSIVE):
            progressive = marker == START_PROGRESSIVE
            depth, height, width, count = struct.unpack_from(">BHHB", body)
            if depth != 8 or not height or not width:
                raise ValueError("a JPEG of 8 bits and known size is needed")
            parts = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(count)]
            most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
            across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for p in parts:
                p["blocks"] = np.zeros((down * p["v"], across * p["h"], 64), np.int32)
                # blocks of a scan of this component alone
                p["own"] = -(-(-(-height * p["v"] // most_v)) // 8), -(-(-(-width * p["h"] // most_h)) // 8)
        elif marker == 0xDA:
            chosen = []
            for k in range(body[0]):
                part = next(p for p in parts if p["id"] == body[1 + 2 * k])
                part["dc"], part["ac"] = tables.get((0, body[2 + 2 * k] >> 4)), tables.get((1, body[2 + 2 * k] & 15))
                chosen.append(part)
            stretches, at = _stretches(data, at)
            first, last, bit = body[1 + 2 * body[0] :][:3]
            _scan(chosen, stretches, every, across, down, (first, last, bit >> 4, bit & 15) if progressive else None)
    if not parts:
        raise ValueError("a JPEG without an image")
    planes = []
    for p in parts:
        rows, columns = p["blocks"].shape[:2]
        whole = COSINES.T @ (p["blocks"].reshape(rows, columns, SIZE, SIZE) * quantum[p["q"]]) @ COSINES + 128
        plane = whole.transpose(0, 2, 1, 3).reshape(rows * SIZE, columns * SIZE)
        plane = plane.repeat(most_v // p["v"], axis=0).repeat(most_h // p["h"], axis=1)
        planes.append(plane[:height, :width])
    if len(planes) == 1:
        return np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)
    if len(planes) != 3:
        raise ValueError(f"a JPEG of {len(planes)} components")
    if not plain:
        y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue]
    return np.clip(np.rint(np.stack(planes, axis=2)), 0, 255).astype(np.uint8)


def _stretches(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded data between restart markers, and where the next other marker stands."""
    found, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*found, data[start:]], len(data)
        following = data[at + 1]
        if following == 0:
            at += 2
        elif 0xD0 <= following <= 0xD7:
            found.append(data[start:at])
            at = start = at + 2
        elif following == 0xFF:
            at += 1
        else:
            return [*found, data[start:at]], at


def _scan(parts: list[dict], stretches: list[bytes], every: int, across: int, down: int, band: tuple[int, int, int, int] | None = None) -> None:
    """Read the blocks of a scan (or a band of theirs), unit by unit; `every` units (0: never) the reading starts anew."""
    if len(parts) == 1:
        rows, columns = parts[0]["own"]
        units = [[(parts[0], r, c)] for r in range(rows) for c in range(columns)]
    else:
        units = [[(p, r * p["v"] + y, c * p["h"] + x) for p in parts for y in range(p["v"]) for x in range(p["h"])] for r in range(down) for c in range(across)]
    step = every or len(units)
    for number, start in enumerate(range(0, len(units), step)):
        if number >= len(stretches):
            raise ValueError("a JPEG that ends early")
        bits, before = _Bits(stretches[number]), {id(p): 0 for p in parts}
        read = _Band(*band).read if band else _block
        for unit in units[start : start + step]:
            for p, row, column in unit:
                before[id(p)] = read(bits, p["blocks"][row, column], before[id(p)], p["dc"], p["ac"])
