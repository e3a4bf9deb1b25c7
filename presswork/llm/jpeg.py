"""Progressive JPEG in numpy: a writer of coefficients, and a reader that gathers all scans and makes RGB.

Both work on many images at once. The reader treats every restart interval of every image as a lane and
moves all lanes a symbol at a time; a file without restart markers is one lane for each scan. It reads any
progressive 8-bit file with one or three components: DC and AC scans, spectral selection, successive
approximation, runs of ended blocks, any sampling factors up to 2.

The writer stores bytes as quantised coefficients, 64 to a block, so a payload comes back exactly.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from presswork.llm.textarrays import ragged

#: Payload bytes are stored less this value, which makes the commonest letters small coefficients.
CENTRE = 101
#: A comment that begins so says how long the stored payload is.
MARK = b"presswork payload\x00"
RESTART = 4

# Scans as (components, first, last, high, low), in the order in which they are written.
SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), 1, 5, 0, 1) for c in range(3)),
    *(((c,), 6, 63, 0, 0) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
    *(((c,), 1, 5, 1, 0) for c in range(3)),
]


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: diagonals, in alternating direction."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()


def _tables() -> tuple[list[list[int]], list[list[int]]]:
    """Symbols by code length (1 to 16) of the writer's DC and AC tables: short codes for coefficients without a run."""
    dc = [[] for _ in range(16)]
    dc[3] = list(range(12))
    ac = [[] for _ in range(16)]
    ac[3] = list(range(9))
    ac[9] = [r << 4 | s for r in range(16) for s in range(11) if r or s > 8]
    return dc, ac


def _codes(lengths: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code and its length by symbol."""
    code, codes, sizes = 0, np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for bits, symbols in enumerate(lengths, 1):
        for s in symbols:
            codes[s], sizes[s] = code, bits
            code += 1
        code <<= 1
    return codes, sizes


DC_TABLE, AC_TABLE = _tables()
DC_CODE, DC_SIZE = _codes(DC_TABLE)
AC_CODE, AC_SIZE = _codes(AC_TABLE)


_SIZES = np.array([i.bit_length() for i in range(2048)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, table: list[list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(map(len, table)) + bytes(s for row in table for s in row))


_QUANT = _segment(0xDB, bytes([0]) + bytes([1] * 64))
_HUFFMAN = _dht(0x00, DC_TABLE) + _dht(0x10, AC_TABLE)
_RESTARTS = _segment(0xDD, struct.pack(">H", RESTART))


def _sos(parts: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([first, last, high << 4 | low]))


def _size(values: np.ndarray) -> np.ndarray:
    """Bits of the magnitude of each value, which is under 2048."""
    return _SIZES[np.abs(values)]


def _extra(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.where(values < 0, values + (np.int64(1) << sizes) - 1, values)


def _ac_first(blocks: np.ndarray, first: int, last: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block number, code and code length of each item of a first AC scan."""
    width = last - first + 1
    band = np.zeros((len(blocks), width + 1), dtype=np.int16)
    band[:, :width] = blocks[:, first : last + 1]
    if low:
        band = np.sign(band) * (np.abs(band) >> low)
    # One more column stands for the end of a block whose last coefficient is zero.
    band[:, width] = band[:, width - 1] == 0
    place = np.flatnonzero(band)
    row = place // (width + 1)
    at = place - row * (width + 1)
    value = band.reshape(-1)[place].astype(np.int64)
    begin = np.ones(len(row), dtype=bool)
    begin[1:] = row[1:] != row[:-1]
    run = at.copy()
    run[1:] -= np.where(begin[1:], 0, at[:-1] + 1)
    ended = at == width
    run[ended] = value[ended] = 0
    size = _size(value)
    symbol = (run & 15) << 4 | size
    code = AC_CODE[symbol] << size | _extra(value, size)
    bits = AC_SIZE[symbol] + size
    far = run >> 4
    if far.any():
        # Each sixteen zeros before a coefficient are a symbol of their own.
        copies = far + 1
        row, code, bits = np.repeat(row, copies), np.repeat(code, copies), np.repeat(bits, copies)
        skip = np.ones(len(row), dtype=bool)
        skip[np.cumsum(copies) - 1] = False
        code[skip], bits[skip] = AC_CODE[0xF0], AC_SIZE[0xF0]
    return row, code, bits


def _ac_refine(blocks: np.ndarray, first: int, last: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a refining scan of a band of at most 15 coefficients."""
    n, width = len(blocks), last - first + 1
    code, bits = np.zeros((n, width + 1), dtype=np.int64), np.zeros((n, width + 1), dtype=np.int64)
    run, held, held_bits = (np.zeros(n, dtype=np.int64) for _ in range(3))
    for j in range(width):
        value = blocks[:, first + j].astype(np.int64)
        size = np.abs(value) >> low
        old, new = size > 1, size == 1
        symbol = run << 4 | 1
        whole = (AC_CODE[symbol] << 1 | (value > 0)) << held_bits | held
        code[:, j] = np.where(new, whole, 0)
        bits[:, j] = np.where(new, AC_SIZE[symbol] + 1 + held_bits, 0)
        held = np.where(old, held << 1 | size & 1, np.where(new, 0, held))
        held_bits = np.where(old, held_bits + 1, np.where(new, 0, held_bits))
        run = np.where(new, 0, run + (size == 0))
    ended = (run > 0) | (held_bits > 0)
    code[:, width] = np.where(ended, AC_CODE[0] << held_bits | held, 0)
    bits[:, width] = np.where(ended, AC_SIZE[0] + held_bits, 0)
    row, at = np.nonzero(bits)
    return row, code[row, at], bits[row, at]


def _entropy(unit: np.ndarray, code: np.ndarray, bits: np.ndarray, units: np.ndarray) -> list[bytes]:
    """Bytes of one scan of each image. unit: the unit (block or MCU) of each item, over all images; units: how many each image has."""
    intervals = -(-units // RESTART)
    first_unit, first_interval = np.cumsum(units) - units, np.cumsum(intervals) - intervals
    image = np.repeat(np.arange(len(units)), units)
    interval_of = first_interval[image] + (np.arange(len(image)) - first_unit[image]) // RESTART
    interval = interval_of[unit]
    total = np.bincount(interval, weights=bits, minlength=int(intervals.sum())).astype(np.int64)
    size = (total + 7) // 8
    begin = np.cumsum(size) - size
    before = np.cumsum(bits) - bits
    start = begin[interval] * 8 + before - (np.cumsum(total) - total)[interval]
    length = int(size.sum())
    # Items go to words of 32 bits; one may reach into the next word.
    shifted = code << (62 - (start & 31) - bits)
    at = start >> 5
    over = np.flatnonzero(shifted & 0x3FFFFFFF)
    words = np.bincount(at, weights=shifted >> 30, minlength=length // 4 + 2)
    words += np.bincount(at[over] + 1, weights=(shifted[over] & 0x3FFFFFFF) << 2, minlength=len(words))
    raw = words.astype(np.uint32).astype(">u4").view(np.uint8)[:length]
    spare = size * 8 - total
    has = size > 0
    raw[(begin + size - 1)[has]] |= ((1 << spare[has]) - 1).astype(np.uint8)
    # Stuff a zero after each FF, and put a marker after each interval but an image's last.
    grown = 1 + (raw == 0xFF)
    mark = np.ones(len(size), dtype=np.int64) * 2
    mark[first_interval + intervals - 1] = 0
    extra = np.zeros(length + 1, dtype=np.int64)
    np.add.at(extra, begin + size, mark)
    place = np.cumsum(grown) - grown + np.cumsum(extra[:-1])
    whole = np.zeros(int(grown.sum() + mark.sum()), dtype=np.uint8)
    whole[place] = raw
    stuffed = np.concatenate([[0], np.cumsum(grown)])
    ends = stuffed[begin + size] + np.cumsum(mark) - mark
    number = np.arange(len(size)) - np.repeat(first_interval, intervals)
    marked = mark > 0
    whole[ends[marked]] = 0xFF
    whole[ends[marked] + 1] = 0xD0 + number[marked] % 8
    last = first_interval + intervals - 1
    stops = ends[last].tolist()
    data = whole.tobytes()
    return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def write_payloads(payloads: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """A file for each payload (whole blocks of 64 bytes); `lengths`: what each was before padding, kept as a comment."""
    blocks = np.diff(offsets) // 64
    mcus = -(-blocks // 6)
    wide = np.ceil(np.sqrt(mcus)).astype(np.int64)
    high = -(-mcus // wide)
    units = wide * high
    room = units * 6
    coefficients = np.zeros((int(room.sum()), 64), dtype=np.int16)
    base = np.cumsum(room) - room
    coefficients[ragged(base, blocks)] = payloads.reshape(-1, 64).astype(np.int16) - CENTRE
    # An image's blocks are those of Y by row, then Cb, then Cr.
    where = {0: (ragged(base, units * 4), units * 4), 1: (ragged(base + units * 4, units), units), 2: (ragged(base + units * 5, units), units)}
    image = np.repeat(np.arange(len(units)), units)
    mcu = ragged(np.zeros(len(units), dtype=np.int64), units)
    x, y = mcu % wide[image], mcu // wide[image]
    corner = base[image] + 4 * y * wide[image] + 2 * x
    step = 2 * wide[image]
    woven = np.stack([corner, corner + 1, corner + step, corner + step + 1, base[image] + 4 * units[image] + mcu, base[image] + 5 * units[image] + mcu], axis=1)
    scans = []
    for parts, first, last, upper, low in SCRIPT:
        if first == 0:
            dc = coefficients[woven.ravel(), 0].astype(np.int64).reshape(-1, 6)
            if upper:
                code, bits = (dc >> low & 1).ravel(), np.ones(dc.size, dtype=np.int64)
            else:
                dc = dc >> low
                difference = dc.copy()
                difference[:, 1:4] -= dc[:, :3]
                fresh = mcu % RESTART == 0
                for column, source in ((0, 3), (4, 4), (5, 5)):
                    earlier = np.concatenate([[0], dc[:-1, source]])
                    difference[:, column] -= np.where(fresh, 0, earlier)
                difference = difference.ravel()
                size = _size(difference)
                code, bits = DC_CODE[size] << size | _extra(difference, size), DC_SIZE[size] + size
            scans.append(_entropy(np.repeat(np.arange(len(mcu)), 6), code, bits, units))
        else:
            rows, count = where[parts[0]]
            make = _ac_refine if upper else _ac_first
            scans.append(_entropy(*make(coefficients[rows], first, last, low), count))
    heads = [_sos(*s) for s in SCRIPT]
    files = []
    for i, (w, h, size) in enumerate(zip(wide.tolist(), high.tolist(), lengths.tolist(), strict=True)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, h * 16, w * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        note = _segment(0xFE, MARK + struct.pack(">QQ", size, int(offsets[i + 1] - offsets[i])))
        files.append(b"".join([b"\xff\xd8", note, _QUANT, frame, _HUFFMAN, _RESTARTS, *(x for head, scan in zip(heads, scans, strict=True) for x in (head, scan[i])), b"\xff\xd9"]))
    return files


@dataclass
class Image:
    """What the markers of a file say; `scans` has (components, first, last, high, low, tables, restart, from, to)."""

    width: int = 0
    height: int = 0
    parts: list = field(default_factory=list)
    quant: dict = field(default_factory=dict)
    scans: list = field(default_factory=list)
    note: bytes = b""
    base: list = field(default_factory=list)
    layout: list = field(default_factory=list)

    def lay_out(self) -> None:
        """Blocks of each component: stored rows and columns (whole MCUs), and rows and columns that its own scans have."""
        most_h, most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        mcu_x, mcu_y = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        self.layout = [(mcu_y * v, mcu_x * h, -(-(-(-self.height * v // most_v)) // 8), -(-(-(-self.width * h // most_h)) // 8)) for _, h, v, _ in self.parts]


def parse(data: bytes, origin: int, ends: list[int]) -> Image:
    """Reads the markers. origin: of the file in the batch's bytes; ends: places there of markers that end a scan's data."""
    image, at, restart, tables = Image(), 2, 0, {}
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC2:
            image.height, image.width, n = struct.unpack(">HHB", body[1:6])
            image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if body[0] != 8 or n not in (1, 3) or max(max(p[1:3]) for p in image.parts) > 2:
                raise ValueError("a kind of frame that isn't read here")
            image.lay_out()
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not progressive")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], dtype=">u2" if wide else "u1").astype(np.int64)
                image.quant[body[0] & 15] = values
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = bytes(body[1 : 17 + count])
                body = body[17 + count :]
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xFE:
            image.note = bytes(body)
        elif marker == 0xDA:
            names = [p[0] for p in image.parts]
            parts = tuple(names.index(body[1 + 2 * i]) for i in range(body[0]))
            first, last, approx = body[1 + 2 * body[0] :]
            own = tuple(tables.get((0x10 if first else 0) | (body[2 + 2 * i] >> 4 if not first else body[2 + 2 * i] & 15), b"") for i in range(body[0]))
            end = ends[bisect_left(ends, origin + at)] - origin
            image.scans.append((parts, first, last, approx >> 4, approx & 15, own, restart, origin + at, origin + end))
            at = end


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """Code length * 256 + symbol, by the next 16 bits."""
    if table not in _LOOKUPS:
        out, code, at = np.full(1 << 16, 16 << 8, dtype=np.int32), 0, 16
        for bits in range(1, 17):
            for _ in range(table[bits - 1]):
                low = code << (16 - bits)
                out[low : low + (1 << (16 - bits))] = bits << 8 | table[at]
                code, at = code + 1, at + 1
            code <<= 1
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


class Bits:
    """Bytes without stuffing and markers; 16 bits from any bit on."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
        self.words = padded[:-3] << np.uint32(24) | padded[1:-2] << np.uint32(16) | padded[2:-1] << np.uint32(8) | padded[3:]
        self.last = len(self.words) - 1

    def peek(self, at: np.ndarray) -> np.ndarray:
        return (self.words[np.minimum(at >> 3, self.last)] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF


def _value(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of `size` bits, the first bits of a peek."""
    bits = raw >> (16 - size)
    return np.where(bits < (np.int64(1) << size) >> 1, bits - (np.int64(1) << size) + 1, bits)


def _dc_lanes(bits: Bits, at: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray, part: np.ndarray, lookups: np.ndarray, high: int, low: int, out: np.ndarray) -> None:
    """order, part: the block and the component of each step of each lane, from first on."""
    before = np.zeros((3, len(at)), dtype=np.int64)
    lane = np.arange(len(at))
    for step in range(int(count.max())):
        lane = lane[count[lane] > step]
        here = first[lane] + step
        raw = bits.peek(at[lane])
        if high:
            out[order[here], 0] |= (raw >> 15 << low).astype(out.dtype)
            at[lane] += 1
            continue
        which = part[here]
        found = lookups[which, raw]
        length, size = found >> 8, found & 255
        value = _value(bits.peek(at[lane] + length), size.astype(np.int64))
        at[lane] += length + size
        before[which, lane] += value
        out[order[here], 0] = before[which, lane] << low


def _ac_lanes(bits: Bits, at: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray, lookup: np.ndarray, start: int, last: int, low: int, out: np.ndarray) -> None:
    flat = out.reshape(-1)
    block, stop, k = first.copy(), first + count, np.full(len(at), start, dtype=np.int64)
    while len(at):
        found = lookup[bits.peek(at)].astype(np.int64)
        symbol = found & 255
        at = at + (found >> 8)
        run, size = symbol >> 4, symbol & 15
        raw = bits.peek(at)
        plain = size > 0
        k = k + run
        some = np.flatnonzero(plain & (k <= last))
        flat[order[block[some]] * 64 + k[some]] = _value(raw[some], size[some]) << low
        at = at + size
        k += 1
        ends = np.flatnonzero(~plain & (run < 15))
        if len(ends):
            wide = run[ends]
            at[ends] += wide
            block[ends] += (np.int64(1) << wide) + (raw[ends] >> (16 - wide)) - 1
            k[ends] = last + 1
        over = k > last
        block += over
        k[over] = start
        alive = block < stop
        if not alive.all():
            at, block, stop, k = at[alive], block[alive], stop[alive], k[alive]


def _refine_lanes(bits: Bits, at: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray, lookup: np.ndarray, start: int, last: int, low: int, out: np.ndarray) -> None:
    """A coefficient of each lane at a time. run: zeros still to pass, or -1 if a symbol is due; ended: blocks that only get corrections."""
    flat = out.reshape(-1)
    block, stop, k = first.copy(), first + count, np.full(len(at), start, dtype=np.int64)
    run, new, ended = np.full(len(at), -1, dtype=np.int64), np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    while len(at):
        due = np.flatnonzero((run < 0) & (ended == 0))
        if len(due):
            found = lookup[bits.peek(at[due])].astype(np.int64)
            symbol, place = found & 255, at[due] + (found >> 8)
            raw, wide, size = bits.peek(place), symbol >> 4, symbol & 15
            end = (size == 0) & (wide < 15)
            ended[due] = np.where(end, (np.int64(1) << wide) + (raw >> (16 - wide)), 0)
            new[due] = np.where(size > 0, np.where(raw >> 15 == 1, 1, -1), 0)
            run[due] = wide
            at[due] = place + np.where(end, wide, (size > 0).astype(np.int64))
        where = order[block] * 64 + k
        value = flat[where].astype(np.int64)
        old = value != 0
        raw = bits.peek(at) >> 15
        flat[where] += np.where(old, np.sign(value) * (raw << low), 0).astype(out.dtype)
        at = at + old
        counting = ~old & (ended == 0)
        hit = counting & (run == 0)
        put = np.flatnonzero(hit & (new != 0))
        flat[where[put]] = new[put] << low
        run = np.where(counting, run - 1, run)
        k += 1
        over = k > last
        block += over
        ended -= over & (ended > 0)
        run[over & (ended == 0)] = -1
        k[over] = start
        alive = block < stop
        if not alive.all():
            at, block, stop, k, run, new, ended = (x[alive] for x in (at, block, stop, k, run, new, ended))


def read_coefficients(files: list[bytes], most_pixels: int | None = None) -> tuple[list[Image], np.ndarray]:
    """The images, and all their quantised coefficients in zigzag order; `Image.base` has each component's first block.

    Raises an error for a file that isn't one of these, or has more than `most_pixels`, before room is made for it.
    """
    data = np.frombuffer(b"".join(files), dtype=np.uint8)
    origins = np.cumsum([0, *map(len, files)])
    full = np.flatnonzero(data[:-1] == 0xFF)
    after = data[full + 1]
    ends = full[(after != 0) & (after != 0xFF) & ~((after >= 0xD0) & (after <= 0xD7))].tolist()
    restarts = full[(after >= 0xD0) & (after <= 0xD7)]
    images = [parse(f, int(o), ends) for f, o in zip(files, origins, strict=False)]
    blocks = 0
    for image in images:
        if not image.width or not image.height or not image.scans:
            raise ValueError("no image in the file")
        if most_pixels is not None and image.width * image.height > most_pixels:
            raise ValueError("too many pixels")
        for c in range(len(image.parts)):
            rows, columns, _, _ = image.layout[c]
            image.base.append(blocks)
            blocks += rows * columns
    out = np.zeros((blocks, 64), dtype=np.int16)
    for number in range(max((len(i.scans) for i in images), default=0)):
        alike: dict[tuple, list[Image]] = {}
        for image in images:
            if number < len(image.scans):
                scan = image.scans[number]
                alike.setdefault((len(scan[0]), *scan[1:6]), []).append(image)
        for (_, first, last, high, low, tables), own in alike.items():
            _scan(data, restarts, [(i, i.scans[number]) for i in own], first, last, high, low, tables, out)
    return images, out


def _scan(data, restarts, scans, first, last, high, low, tables, out) -> None:
    begins, stops, every = np.array([(s[7], s[8], s[6]) for _, s in scans]).T
    found = [_order(tuple(i.layout), tuple(i.parts), s[0]) for i, s in scans]
    per_unit = found[0][2]
    sizes = np.array([len(f[0]) for f in found])
    units = sizes // per_unit
    every = np.where(every > 0, every, units)
    low_mark = np.searchsorted(restarts, begins)
    marks = np.minimum(np.searchsorted(restarts, stops) - low_mark, -(-units // every) - 1)
    inner = restarts[ragged(low_mark, marks)]
    lanes = marks + 1
    top = np.cumsum(lanes) - lanes
    lows, highs = np.empty(int(lanes.sum()), dtype=np.int64), np.empty(int(lanes.sum()), dtype=np.int64)
    is_first, is_last = np.zeros(len(lows), dtype=bool), np.zeros(len(lows), dtype=bool)
    is_first[top] = is_last[top + lanes - 1] = True
    lows[is_first], lows[~is_first] = begins, inner + 2
    highs[is_last], highs[~is_last] = stops, inner
    image = np.repeat(np.arange(len(scans)), lanes)
    number = np.arange(len(lows)) - top[image]
    first_step = (np.cumsum(sizes) - sizes)[image] + number * every[image] * per_unit
    count = np.minimum(every[image], units[image] - number * every[image]) * per_unit
    order = np.concatenate([f[0] for f in found]) + np.repeat([i.base[0] for i, _ in scans], sizes)
    raw = data[ragged(lows, highs - lows)]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 0xFF))
    kept = np.concatenate([[0], np.cumsum(keep)])
    at = kept[np.cumsum(highs - lows) - (highs - lows)] * 8
    bits = Bits(raw[keep])
    if first == 0:
        lookups = np.stack([_lookup(t) if t else np.zeros(1 << 16, dtype=np.int32) for t in tables])
        _dc_lanes(bits, at, first_step, count, order, np.concatenate([f[1] for f in found]), lookups, high, low, out)
    elif high == 0:
        _ac_lanes(bits, at, first_step, count, order, _lookup(tables[0]), first, last, low, out)
    else:
        _refine_lanes(bits, at, first_step, count, order, _lookup(tables[0]), first, last, low, out)


@lru_cache(maxsize=1024)
def _order(layout: tuple, parts: tuple, which: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """The blocks of a scan in its order (from the image's first block on), the component of each (as numbered in the scan), and blocks to a unit."""
    bases = np.cumsum([0, *(rows * columns for rows, columns, _, _ in layout)])
    if len(which) == 1:
        _, columns, rows, own = layout[which[0]]
        order = bases[which[0]] + (np.arange(rows)[:, None] * columns + np.arange(own)).ravel()
        return order, np.zeros(len(order), dtype=np.int64), 1
    grids, numbers = [], []
    for i, c in enumerate(which):
        rows, columns, _, _ = layout[c]
        _, h, v, _ = parts[c]
        grid = bases[c] + np.arange(rows * columns).reshape(rows // v, v, columns // h, h)
        grids.append(grid.transpose(0, 2, 1, 3).reshape(-1, v * h))
        numbers += [i] * (v * h)
    order = np.concatenate(grids, axis=1)
    return order.ravel(), np.tile(numbers, len(order)), len(numbers)


def _basis() -> np.ndarray:
    """The inverse transform of a block as whole numbers (times 2 ** 22), so sums in doubles are exact and don't depend on their order."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.rint(np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5) * 2048)
    return np.kron(one, one)[:, ZIGZAG].T.copy()


BASIS = _basis()


def to_rgb(images: list[Image], coefficients: np.ndarray) -> list[np.ndarray]:
    """A height x width x 3 tensor of each image, its chroma brought to full size by repetition."""
    quantised = coefficients.astype(np.float64)
    tables = {}
    for image in images:
        for c in range(len(image.parts)):
            q = image.quant[image.parts[c][3]]
            if not (q == 1).all():
                rows, columns, _, _ = image.layout[c]
                tables[image.base[c]] = (rows * columns, q)
    for base, (n, q) in tables.items():
        quantised[base : base + n] *= q
    pixels = np.clip(np.floor(quantised @ BASIS / (1 << 22) + 0.5) + 128, 0, 255).astype(np.int32)
    out = []
    for image in images:
        planes = []
        most_h, most_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
        for c, (_, h, v, _) in enumerate(image.parts):
            rows, columns, _, _ = image.layout[c]
            plane = pixels[image.base[c] : image.base[c] + rows * columns].reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
            if h < most_h or v < most_v:
                plane = plane.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)
            planes.append(plane[: image.height, : image.width])
        if len(planes) == 1:
            rgb = np.stack(planes * 3, axis=-1)
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.stack([y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16)], axis=-1)
        out.append(np.clip(rgb, 0, 255).astype(np.uint8))
    return out


def payload_of(image: Image, coefficients: np.ndarray) -> tuple[int, np.ndarray] | None:
    """What write_payloads stored in this image: its length before padding, and the padded bytes; None for other images."""
    if len(image.note) != len(MARK) + 16 or not image.note.startswith(MARK):
        return None
    size, padded = struct.unpack(">QQ", image.note[len(MARK) :])
    base = image.base[0]
    if padded % 64 or size > padded or padded // 64 > sum(rows * columns for rows, columns, _, _ in image.layout):
        return None
    return size, (coefficients[base : base + padded // 64].reshape(-1) + CENTRE).astype(np.uint8)
