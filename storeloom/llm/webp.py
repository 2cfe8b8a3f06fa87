"""Lossless WebP (VP8L): a full decoder, a text-storing encoder, and operator 10.

``decode`` reads any VP8L stream into a pixel array: prefix codes (simple and
normal, meta prefix images), back-references with the near-pixel distance map, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms.
Streams whose one prefix-code group is complete decode in lockstep, a step
for a token in each of thousands of streams (``decode_many``).

Texts are stored as pixels of four bytes (alpha, red, green, blue), 16 pixels a
row, in files of ``TILE`` bytes of payload at most, one after the other, so that a long text fills as many
lanes as short ones do. Each file is written in the form that takes the fewest bytes: as it is, after
subtracting green, after a predictor (left or top), after a cross-colour transform, or under a
palette. All but the last have entropy-coded literals under one of two fixed prefix codes (of prose, of
differences), places in a colour cache, and back-references for runs of equal pixels; a palette
has codes of its own. Prose stays as it is; texts that repeat themselves and short ones do not.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, texts

# Fixed values of the format: order of code lengths; near-pixel distances (dx, dy).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS, DISTANCES = 24, 40
CACHE_FACTOR = 0x1E35A7BD


def canonical(lengths) -> list[tuple[int, int]]:
    """(code, length) of each symbol, the code's bits in stream order (first bit lowest)."""
    out, code = [(0, 0)] * len(lengths), 0
    for n in range(1, 16):
        for s, length in enumerate(lengths):
            if length == n:
                out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
                code += 1
        code <<= 1
    return out


class Prefix:
    """A prefix code as one lookup table of ``depth`` bits."""

    def __init__(self, lengths):
        used = [s for s, n in enumerate(lengths) if n]
        self.single = used[0] if len(used) == 1 else (0 if not used else None)
        self.depth = max([1, *lengths])
        if self.single is not None:
            return
        if sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
            raise ValueError("incomplete or oversubscribed prefix code")
        self.symbols = np.zeros(1 << self.depth, np.int32)
        self.sizes = np.zeros(1 << self.depth, np.int32)
        for s, (code, n) in enumerate(canonical(lengths)):
            if n:
                self.symbols[code :: 1 << n] = s
                self.sizes[code :: 1 << n] = n

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        at = bits.peek(self.depth)
        bits.at += int(self.sizes[at])
        return int(self.symbols[at])


class Bits:
    """Bits of a stream, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0
        self.end = len(data) * 8

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 6], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return out


def read_code(bits: Bits, size: int) -> Prefix:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    order = [0] * len(CODE_LENGTH_ORDER)
    for k in range(4 + bits.read(4)):
        order[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code, left = Prefix(order), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, previous = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            previous = s or previous
            continue
        value, times = (previous, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + times > size:
            raise ValueError("code lengths run over the alphabet")
        lengths[at : at + times] = [value] * times
        at += times
    return Prefix(lengths)


def prefix_value(symbol: int, bits: Bits) -> int:
    """A length or distance of which ``symbol`` is the prefix."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB integers, row after row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, meta, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        meta = read_pixels(bits, across, (height + (1 << shift) - 1) >> shift, False) >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    out, at, total = [0] * (width * height), 0, width * height
    cache = [0] * (1 << cache_bits) if cache_bits else None
    down = 32 - cache_bits
    group = codes[0]
    while at < total:
        if meta is not None:
            y, x = divmod(at, width)
            group = codes[int(meta[(y >> shift) * across + (x >> shift)])]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            made = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + LENGTHS:
            length = prefix_value(s - 256, bits)
            back = distance(prefix_value(group[4].read(bits), bits), width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            made = [out[at - back + k % back] for k in range(length)]
        else:
            made = [cache[s - 256 - LENGTHS]]
        out[at : at + len(made)] = made
        at += len(made)
        if cache is not None:
            for p in made:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> down] = p
    return np.array(out, np.uint32)


def channels(pixels: np.ndarray) -> np.ndarray:
    """uint8 (..., 4): alpha, red, green, blue."""
    return np.stack([pixels >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.uint8)


def join_channels(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    toward_left = np.abs(top - corner).sum()
    toward_top = np.abs(left - corner).sum()
    return left if toward_left < toward_top else top


def predict(mode: int, left, top, right, corner):
    """The predicted pixel of a mode; neighbours as int arrays of four channels (top right is ``right``)."""
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        # the format halves toward zero
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(int), 0, 255)
    return {
        0: lambda: np.array([255, 0, 0, 0]),
        1: lambda: left,
        2: lambda: top,
        3: lambda: right,
        4: lambda: corner,
        5: lambda: _average(_average(left, right), top),
        6: lambda: _average(left, corner),
        7: lambda: _average(left, top),
        8: lambda: _average(corner, top),
        9: lambda: _average(top, right),
        10: lambda: _average(_average(left, corner), _average(top, right)),
    }.get(mode, lambda: np.array([255, 0, 0, 0]))()


def inverse_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, shift: int) -> np.ndarray:
    if (modes == modes[0]).all() and modes[0] in (1, 2):
        # one mode that looks left or up only: sums of bytes, which wrap around
        image = channels(pixels.reshape(-1, width))
        image[0, 0] += np.array([255, 0, 0, 0], np.uint8)
        if modes[0] == 1:
            image[:, 0] = np.cumsum(image[:, 0], axis=0, dtype=np.uint8)
            image = np.cumsum(image, axis=1, dtype=np.uint8)
        else:
            image[0] = np.cumsum(image[0], axis=0, dtype=np.uint8)
            image = np.cumsum(image, axis=0, dtype=np.uint8)
        return join_channels(image).reshape(-1)
    image = channels(pixels.reshape(-1, width)).astype(int)
    across = (width + (1 << shift) - 1) >> shift
    black = np.array([255, 0, 0, 0])
    for y in range(len(image)):
        for x in range(width):
            if y == 0:
                guess = black if x == 0 else image[0, x - 1]
            elif x == 0:
                guess = image[y - 1, 0]
            else:
                # beyond the right edge stands the leftmost pixel of the same row
                right = image[y - 1, x + 1] if x + 1 < width else image[y, 0]
                guess = predict(int(modes[(y >> shift) * across + (x >> shift)]), image[y, x - 1], image[y - 1, x], right, image[y - 1, x - 1])
            image[y, x] = (image[y, x] + guess) & 255
    return join_channels(image).reshape(-1)


def inverse_cross_colour(pixels: np.ndarray, width: int, elements: np.ndarray, shift: int) -> np.ndarray:
    image = channels(pixels.reshape(-1, width))
    across = (width + (1 << shift) - 1) >> shift
    y, x = np.indices(image.shape[:2])
    each = channels(elements[(y >> shift) * across + (x >> shift)]).view(np.int8).astype(int)
    red_to_blue, green_to_blue, green_to_red = each[..., 1], each[..., 2], each[..., 3]
    green = image[..., 2].view(np.int8).astype(int)
    red = (image[..., 1] + (green_to_red * green >> 5)) & 255
    blue = (image[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * red.astype(np.uint8).view(np.int8).astype(int) >> 5)) & 255
    out = image.copy()
    out[..., 1], out[..., 3] = red, blue
    return join_channels(out).reshape(-1)


def inverse_green(pixels: np.ndarray) -> np.ndarray:
    c = channels(pixels)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return join_channels(c)


def inverse_palette(pixels: np.ndarray, width: int, full: int, table: np.ndarray, packed: int) -> np.ndarray:
    """packed: log2 of the pixels that a byte of green holds."""
    index = pixels >> 8 & 255
    if packed:
        each = 8 >> packed
        rows = index.reshape(-1, width)
        index = (rows[:, :, None] >> (np.arange(1 << packed) * each) & ((1 << each) - 1)).reshape(len(rows), -1)[:, :full].reshape(-1)
    held = np.zeros(256, np.uint32)
    held[: len(table)] = table
    return held[index]


def vp8l(data: bytes) -> bytes:
    """The VP8L chunk of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def _begin(data: bytes):
    """A file's bits after its transforms, width and height of the coded image, and the steps from its pixels to the picture's."""
    bits = Bits(vp8l(data))
    if bits.read(8) != 0x2F:
        raise ValueError("bad VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise ValueError("unknown VP8L version")
    steps, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            block = read_pixels(bits, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False)
            if kind == PREDICTOR:
                steps.append(lambda p, w=width, b=block, s=shift: inverse_predictor(p, w, b >> 8 & 15, s))
            else:
                steps.append(lambda p, w=width, b=block, s=shift: inverse_cross_colour(p, w, b, s))
        elif kind == SUBTRACT_GREEN:
            steps.append(inverse_green)
        else:
            n = bits.read(8) + 1
            deltas = channels(read_pixels(bits, n, 1, False))
            table = join_channels(np.cumsum(deltas, axis=0, dtype=np.uint8))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            before, width = width, (width + (1 << packed) - 1) >> packed
            steps.append(lambda p, w=width, f=before, t=table, k=packed: inverse_palette(p, w, f, t, k))
    if opaque:
        steps.insert(0, lambda p: p | np.uint32(0xFF000000))
    return bits, width, height, steps


def _finish(pixels: np.ndarray, steps) -> np.ndarray:
    for step in reversed(steps):
        pixels = step(pixels)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) alpha, red, green, blue of a lossless WebP file."""
    bits, width, height, steps = _begin(data)
    return channels(_finish(read_pixels(bits, width, height, True), steps).reshape(height, -1))


# --- the encoder of texts -------------------------------------------------------------------


def code_lengths(weights, longest: int) -> list[int]:
    """Lengths of an optimal prefix code; weights are flattened until none exceeds ``longest``."""
    weights = list(weights)
    while True:
        heap = [(w, i, (i,)) for i, w in enumerate(weights) if w]
        lengths = [0] * len(weights)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths) <= longest:
            return lengths
        weights = [w and w // 2 + 1 for w in weights]


def byte_weights() -> list[int]:
    """How often a byte of prose is expected: letters by their rank in European text, the rest by kind."""
    out = [2] * 256
    for rank, c in enumerate(b" etanorishdlucmgfpwbyvkqxjz"):
        out[c] = 6000 // (rank + 2)
    for kinds, weight in ((b".,\n", 60), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 20), (b"0123456789", 16), (b"-'!?:;()@\"", 10), (bytes(range(0x80, 0xC0)), 12), (b"\xc3", 200), (b"\0", 24)):
        for c in kinds:
            out[c] = weight
    return out


#: Pixels a row, and bytes of payload of the largest file.
WIDTH, TILE = 16, 1 << 14
#: A run this long of one pixel is a back-reference; longer ones are cut.
RUN_LEAST, RUN_MOST = 8, 4096
#: The colour cache's size, and how often a pixel is expected there (in parts of all green symbols).
CACHE_BITS, CACHED = 8, 0.1
DEPTH = 13
PLAIN, GREEN, LEFT, TOP, CROSS = range(5)
#: Pixels unlike their predecessor in the longest file that is tried under a palette.
CHANGES = 64
#: One block of a transform is the whole file.
_WHOLE = 7


def difference_weights() -> list[int]:
    return [4000 // (1 + min(d, 256 - d)) ** 2 + 4 for d in range(256)]


@lru_cache(maxsize=8)
def text_code(form: int = PLAIN):
    """A form's fixed code: literal bytes, run lengths, places in the cache, the distance of the pixel before; and the header that states it."""
    weights = difference_weights() if form else byte_weights()
    cached = [max(1, round(sum(weights) * CACHED / (1 - CACHED) / (1 << CACHE_BITS)))] * (1 << CACHE_BITS)
    green = code_lengths(weights + [1] * LENGTHS + cached, DEPTH)
    other = code_lengths(weights, DEPTH)
    writer = Writer()
    if form == GREEN:
        writer.put(1 | SUBTRACT_GREEN << 1, 3)
    elif form in (LEFT, TOP):
        writer.put(1 | PREDICTOR << 1 | _WHOLE << 3, 6)
        writer.pixel(0xFF000000 | (1 if form == LEFT else 2) << 8)
    elif form == CROSS:
        writer.put(1 | CROSS_COLOUR << 1 | _WHOLE << 3, 6)
        # red to blue by 32 / 32, no other
        writer.pixel(0xFF000000 | 32 << 16)
    writer.put(0, 1)  # no more transforms
    writer.put(1, 1)  # a colour cache
    writer.put(CACHE_BITS, 4)
    writer.put(0, 1)  # one group of codes
    for lengths in (green, other, other, other):
        writer.code(lengths)
    writer.single(1)  # distance prefix 1: the distance code 2, which is the pixel before
    return green, other, writer


class Writer:
    """A bit string under construction."""

    def __init__(self):
        self.bits = bytearray()

    def put(self, value: int, n: int) -> None:
        self.bits += bytes(value >> k & 1 for k in range(n))

    def single(self, symbol: int) -> None:
        self.put(1, 1)
        self.put(0, 1)
        self.put(symbol > 1, 1)
        self.put(symbol, 8 if symbol > 1 else 1)

    def pixel(self, value: int) -> None:
        """An image of one pixel: no cache, and codes of one symbol each."""
        self.put(0, 1)
        for shift in (8, 16, 0, 24):
            self.single(value >> shift & 255)
        self.single(0)

    def code(self, lengths) -> None:
        """A code of one or two symbols, or code lengths under a code of their own, with runs of zeros."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) <= 1:
            self.single(used[0] if used else 0)
            return
        if len(used) == 2 and used[1] < 256:
            self.put(0b111, 3)
            self.put(used[0], 8)
            self.put(used[1], 8)
            return
        # (symbol, extra bits, how many)
        tokens, at = [], 0
        while at < len(lengths):
            end = at
            while end < len(lengths) and not lengths[end] and end - at < 138:
                end += 1
            if end - at >= 11:
                tokens.append((18, end - at - 11, 7))
            elif end - at >= 3:
                tokens.append((17, end - at - 3, 3))
            else:
                end = at + 1
                tokens.append((lengths[at], 0, 0))
            at = end
        counts = [0] * 19
        for symbol, *_ in tokens:
            counts[symbol] += 1
        if sum(1 for c in counts if c) == 1:
            counts[0 if counts[0] == 0 else 1] += 1
        own = code_lengths(counts, 7)
        self.put(0, 1)
        self.put(19 - 4, 4)
        for k in CODE_LENGTH_ORDER:
            self.put(own[k], 3)
        self.put(0, 1)
        codes = canonical(own)
        for symbol, extra, n in tokens:
            self.put(*codes[symbol])
            self.put(extra, n)

    def bytes(self) -> bytes:
        return np.packbits(np.frombuffer(bytes(self.bits), np.uint8), bitorder="little").tobytes()


def length_prefix(n: int) -> tuple[int, int, int]:
    """(symbol, extra bits, how many) of a length."""
    if n <= 4:
        return n - 1, 0, 0
    top = (n - 1).bit_length() - 1
    half = (n - 1) >> (top - 1) & 1
    return 2 * top + half, (n - 1) & ((1 << (top - 1)) - 1), top - 1


@lru_cache(maxsize=8)
def _tables(form: int):
    green, other, header = text_code(form)
    g, o = canonical(green), canonical(other)
    arr = lambda x: np.array(x, np.uint64)
    return arr([c for c, _ in g]), arr([n for _, n in g]), arr([c for c, _ in o]), arr([n for _, n in o]), np.frombuffer(bytes(header.bits), np.uint8)


def shape(n: int) -> tuple[int, int]:
    """Width and height of the picture of n payload bytes (a multiple of 64), over all its files."""
    return WIDTH, n // (4 * WIDTH)


def pad(raw: bytes) -> bytes:
    """raw and bytes 0 up to a positive multiple of 64."""
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def _scatter(codes: np.ndarray, sizes: np.ndarray, total: int) -> np.ndarray:
    """Bits of codes (64 at most each), one after the other, as bytes."""
    ends = np.cumsum(sizes)
    at = (ends - sizes).astype(np.uint64)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = np.zeros(total // 64 + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(codes << shift, first)
    over = np.flatnonzero(shift + sizes.astype(np.uint64) > 64)
    out[word[over] + 1] |= codes[over] >> (np.uint64(64) - shift[over])
    return out.view(np.uint8)[: (total + 7) // 8]


def _rows(payload: bytes) -> np.ndarray:
    """(rows, WIDTH, 4) alpha, red, green, blue."""
    return np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 4)


def transformed(rows: np.ndarray, form: int, firsts=(0,)) -> np.ndarray:
    """What a form codes in place of the rows; a file begins at each of the rows ``firsts``."""
    if form == PLAIN:
        return rows
    out = rows.copy()
    if form == GREEN:
        out[..., 1] -= rows[..., 2]
        out[..., 3] -= rows[..., 2]
    elif form == CROSS:
        out[..., 3] -= rows[..., 1]
    else:
        firsts = np.asarray(firsts)
        if form == LEFT:
            out[:, 1:] -= rows[:, :-1]
            out[1:, 0] -= rows[:-1, 0]
        else:
            out[1:] -= rows[:-1]
            out[firsts, 1:] = rows[firsts, 1:] - rows[firsts, :-1]
        out[firsts, 0] = rows[firsts, 0] - np.array([255, 0, 0, 0], np.uint8)
    return out


def _riff(chunk: bytes) -> bytes:
    odd = len(chunk) & 1
    return b"RIFF" + (12 + len(chunk) + odd).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk + b"\0" * odd


def _top(width: int, height: int) -> int:
    """8 bits of signature, width, height, alpha used, version."""
    return 0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36


def write_file(rows: np.ndarray, form: int) -> bytes:
    """One WebP file of the rows in a form with a fixed code."""
    gc, gn, oc, on, header = _tables(form)
    px = transformed(rows, form).reshape(-1, 4)
    a, r, g, b = px.T
    gl, rl, bl = gn[g], on[r], on[b]
    codes = gc[g] | oc[r] << gl | oc[b] << (gl + rl) | oc[a] << (gl + rl + bl)
    sizes = (gl + rl + bl + on[a]).astype(np.int64)
    word = px.copy().view(">u4").ravel().astype(np.uint64)
    # a pixel is in the cache if the last one of its place there was equal to it
    place = (word * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)
    order = np.argsort(place, kind="stable")
    again = order[1:][(place[order[1:]] == place[order[:-1]]) & (word[order[1:]] == word[order[:-1]])]
    symbol = 256 + LENGTHS + place[again].astype(np.int64)
    shorter = gn[symbol] < sizes[again]
    codes[again[shorter]] = gc[symbol[shorter]]
    sizes[again[shorter]] = gn[symbol[shorter]]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    runs = np.diff(np.append(starts, len(word)))
    long = np.flatnonzero(runs > RUN_LEAST)
    if len(long):
        keep = np.ones(len(word), bool)
        for k in long:
            at, left = int(starts[k]) + 1, int(runs[k]) - 1
            while left:
                n = min(left, RUN_MOST)
                symbol, extra, size = length_prefix(n)
                codes[at] = gc[256 + symbol] | np.uint64(extra) << gn[256 + symbol]
                sizes[at] = int(gn[256 + symbol]) + size
                keep[at + 1 : at + n] = False
                at, left = at + n, left - n
        codes, sizes = codes[keep], sizes[keep]
    top = _top(WIDTH, len(rows))
    lead = np.concatenate([np.unpackbits(np.frombuffer(top.to_bytes(5, "little"), np.uint8), bitorder="little"), header])
    cut = len(lead) & 7
    tail = np.uint64(int.from_bytes(np.packbits(lead[len(lead) - cut :], bitorder="little").tobytes() or b"\0", "little"))
    codes, sizes = np.concatenate([[tail], codes]), np.concatenate([[cut], sizes])
    return _riff(np.packbits(lead[: len(lead) - cut], bitorder="little").tobytes() + _scatter(codes, sizes, int(sizes.sum())).tobytes())


def _small_image(writer: Writer, words: list[int], main: bool) -> None:
    """An image under codes of its own, runs as back-references to the pixel before."""
    writer.put(0, 2 if main else 1)
    tokens, at = [], 0
    while at < len(words):
        end = at
        while at and end < len(words) and words[end] == words[at - 1] and end - at < RUN_MOST:
            end += 1
        if end - at > 2:
            tokens.append(length_prefix(end - at))
            at = end
        else:
            tokens.append(words[at])
            at += 1
    tables = []
    for k, shift in enumerate((8, 16, 0, 24)):
        counts = [0] * (256 if k else 256 + LENGTHS)
        for t in tokens:
            if isinstance(t, int):
                counts[t >> shift & 255] += 1
            elif not k:
                counts[256 + t[0]] += 1
        several = sum(1 for c in counts if c) > 1
        lengths = code_lengths(counts, 15) if several else [int(c > 0) for c in counts]
        writer.code(lengths)
        tables.append((shift, canonical(lengths) if several else None))
    writer.single(1)
    for t in tokens:
        if isinstance(t, int):
            for shift, codes in tables:
                if codes:
                    writer.put(*codes[t >> shift & 255])
        else:
            writer.put(*tables[0][1][256 + t[0]])
            writer.put(t[1], t[2])


@lru_cache(maxsize=4096)
def write_palette(payload: bytes) -> bytes | None:
    """A WebP file of the payload under a palette, None if it has over 256 colours."""
    words = np.frombuffer(payload, ">u4")
    table, index = np.unique(words, return_inverse=True)
    if len(table) > 256:
        return None
    packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    each = index.reshape(-1, 1 << packed) << np.arange(1 << packed) * (8 >> packed)
    deltas = channels(table.astype(np.uint32))
    deltas[1:] -= deltas[:-1].copy()
    writer = Writer()
    writer.put(_top(WIDTH, len(words) // WIDTH), 40)
    writer.put(1 | PALETTE << 1, 3)
    writer.put(len(table) - 1, 8)
    _small_image(writer, join_channels(deltas).tolist(), False)
    writer.put(0, 1)
    _small_image(writer, (each.sum(1) << 8).tolist(), True)
    return _riff(writer.bytes())


def tiles(payload: bytes) -> list[bytes]:
    return [payload[a : a + TILE] for a in range(0, len(payload), TILE)]


def files(data: bytes) -> list[bytes]:
    """The files that stand one after the other in a stored form."""
    out, at = [], 0
    while at < len(data):
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        out.append(data[at:end])
        at = end
    return out


def _promising(parts: list[bytes]) -> np.ndarray:
    """(forms, parts) whether a form may be smaller than PLAIN, by the lengths of its literals outside of runs; the last row is for the palette."""
    rows = _rows(b"".join(parts))
    sizes = np.array([len(p) // (4 * WIDTH) for p in parts])
    firsts = np.cumsum(sizes) - sizes
    cost = np.empty((5, len(parts)))
    for form in range(5):
        _, gn, _, on, _ = _tables(form)
        px = transformed(rows, form, firsts).reshape(-1, 4)
        each = gn[px[:, 2]].astype(np.uint8) + on.astype(np.uint8)[px[:, 0]] + on.astype(np.uint8)[px[:, 1]] + on.astype(np.uint8)[px[:, 3]]
        word = np.ascontiguousarray(px).view(np.uint32).ravel()
        new = np.append(True, word[1:] != word[:-1])
        new[firsts * WIDTH] = True
        cost[form] = np.add.reduceat(np.where(new, each, 0), firsts * WIDTH, dtype=np.int64)
        if form == PLAIN:
            changes = np.add.reduceat(new.astype(np.int64), firsts * WIDTH)
    return np.vstack([cost < cost[PLAIN], changes <= CHANGES])


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload of a multiple of 64 bytes; the same payload gives the same form."""
    parted = [tiles(p) for p in payloads]
    flat = [t for parts in parted for t in parts]
    if not flat:
        return []
    hopeful = _promising(flat)
    made = []
    for k, tile in enumerate(flat):
        rows = _rows(tile)
        found = [write_file(rows, form) for form in (PLAIN, *np.flatnonzero(hopeful[:5, k]).tolist())]
        if hopeful[5, k] and (small := write_palette(tile)):
            found.append(small)
        # of equally short ones the first
        made.append(min(found, key=len))
    rest = iter(made)
    return [b"".join(next(rest) for _ in parts) for parts in parted]


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


# --- decoding many streams at once -----------------------------------------------------------


_known: dict[tuple[int, int, int], list] = {}


def _codes(bits: Bits, cache_bits: int):
    """The five codes that begin here; those of a header that was read before are reused."""
    at = bits.at
    for (raw, size, cache), codes in _known.items():
        if cache == cache_bits and int.from_bytes(bits.data[at >> 3 : (at + size + 7) >> 3], "little") >> (at & 7) & ((1 << size) - 1) == raw:
            bits.at += size
            return codes
    codes = [read_code(bits, n) for n in (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)]
    if len(_known) < 16 and all(c.single is None for c in codes[:4]):
        size = bits.at - at
        _known[int.from_bytes(bits.data[at >> 3 : (bits.at + 7) >> 3], "little") >> (at & 7) & ((1 << size) - 1), size, cache_bits] = codes
    return codes


#: Pixels that are decoded in lockstep at once.
LOCKSTEP = 1 << 22


def decode_many(data: list[bytes]) -> list[np.ndarray]:
    """The pixels (n, 4) of each file; those under one group of codes, of four that aren't of one symbol, decode in lockstep."""
    out: list = [None] * len(data)
    lanes: dict[int, list] = {}
    held = {}
    for i, file in enumerate(data):
        bits, width, height, steps = _begin(file)
        cache_bits = bits.read(4) if bits.read(1) else 0
        if cache_bits <= 11 and not bits.read(1):
            codes = _codes(bits, cache_bits)
            if all(c.single is None for c in codes[:4]):
                held[id(codes)] = codes, cache_bits
                lanes.setdefault(id(codes), []).append((i, bits.data[:-8], bits.at, width, height, steps))
                continue
        out[i] = decode(file).reshape(-1, 4)
    for key, group in lanes.items():
        group.sort(key=lambda x: x[3] * x[4])
        at = 0
        while at < len(group):
            end, room = at + 1, LOCKSTEP - group[at][3] * group[at][4]
            while end < len(group) and (room := room - group[end][3] * group[end][4]) >= 0:
                end += 1
            for (i, *_, steps), pixels in zip(group[at:end], _lockstep(*held[key], [x[1:5] for x in group[at:end]])):
                out[i] = channels(_finish(join_channels(pixels), steps)) if steps else pixels
            at = end
    return out


def _lockstep(codes, cache_bits: int, streams) -> list[np.ndarray]:
    """A token of each live stream a step; streams with more pixels come first, so that the live ones stay a prefix."""
    order = sorted(range(len(streams)), key=lambda k: -streams[k][2] * streams[k][3])
    totals = np.array([streams[k][2] * streams[k][3] for k in order], np.int64)
    chunks = [streams[k][0] for k in order]
    bases = np.cumsum([0] + [len(c) + 16 for c in chunks])[:-1]
    data = np.frombuffer(b"".join(c + b"\0" * 16 for c in chunks), np.uint8)
    at = np.array([streams[k][1] for k in order], np.int64) + bases * 8
    limit = bases * 8 + np.array([len(c) * 8 for c in chunks])
    widths = np.array([streams[k][2] for k in order], np.int64)
    # every unaligned 64-bit word of the data, by its first byte
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    depths = [np.uint64((1 << c.depth) - 1) for c in codes[:4]]
    ends = np.cumsum(totals)
    lead = ends - totals
    pixels = np.zeros(int(ends[-1]), np.uint32)
    place = lead.copy()
    slots = 1 << cache_bits if cache_bits else 0
    cache = np.zeros((len(order), max(slots, 1)), np.uint32)
    lanes = np.arange(len(order))
    down = np.uint32(32 - cache_bits)
    live = len(order)
    seven, three = np.uint64(7), np.int64(3)
    sizes = [c.sizes.astype(np.uint64) for c in codes[:4]]
    symbols = [c.symbols.astype(np.uint32) for c in codes[:4]]
    eight, sixteen, full = np.uint32(8), np.uint32(16), np.uint32(24)
    while live:
        p = at[:live]
        w = words[p >> three] >> (p.astype(np.uint64) & seven)
        k = w & depths[0]
        s, used = symbols[0][k], sizes[0][k]
        rest = w >> used
        k = rest & depths[1]
        made, n = symbols[1][k] << sixteen | s << eight, sizes[1][k]
        rest >>= n
        total = used + n
        k = rest & depths[2]
        made |= symbols[2][k]
        n = sizes[2][k]
        rest >>= n
        total += n
        k = rest & depths[3]
        made |= symbols[3][k] << full
        total += sizes[3][k]
        here = place[:live]
        step = np.ones(live, np.int64)
        special = np.flatnonzero(s >= 256)
        cached = special[s[special] >= 256 + LENGTHS]
        if len(cached):
            made[cached] = cache[cached, s[cached] - (256 + LENGTHS)]
            total[cached] = used[cached]
        pixels[here] = made
        if slots:
            key = made * np.uint32(CACHE_FACTOR) >> down
            if len(special) > len(cached):
                plain = np.flatnonzero((s < 256) | (s >= 256 + LENGTHS))
                cache[plain, key[plain]] = made[plain]
            else:
                cache[lanes[:live], key] = made
        for lane in special[s[special] < 256 + LENGTHS]:
            bits = Bits(chunks[lane])
            bits.at = int(p[lane] - bases[lane] * 8 + int(used[lane]))
            length = prefix_value(int(s[lane]) - 256, bits)
            back = distance(prefix_value(codes[4].read(bits), bits), int(widths[lane]))
            start = int(here[lane])
            if back > start - lead[lane] or start + length > ends[lane]:
                raise ValueError("a back-reference leaves the image")
            copied = pixels[start - back : start][np.arange(length) % back]
            pixels[start : start + length] = copied
            if slots:
                cache[lane, copied * np.uint32(CACHE_FACTOR) >> down] = copied
            step[lane] = length
            total[lane] = np.uint64(bits.at + int(bases[lane]) * 8 - int(p[lane]))
        at[:live] += total.astype(np.int64)
        place[:live] += step
        if (at[:live] > limit[:live]).any():
            raise ValueError("the stream ends too early")
        while live and place[live - 1] >= ends[live - 1]:
            live -= 1
        if live and (done := place[:live] >= ends[:live]).any():
            # a stream of runs ended before shorter ones: move it behind the live
            keep = np.concatenate([np.flatnonzero(~done), np.flatnonzero(done)])
            for x in (at, place, ends, widths, lead, bases, limit, cache):
                x[:live] = x[:live][keep]
            order[:live] = [order[j] for j in keep]
            chunks[:live] = [chunks[j] for j in keep]
            live -= int(done.sum())
    raw = pixels.astype(">u4").view(np.uint8).reshape(-1, 4)
    out: list = [None] * len(order)
    for j, k in enumerate(order):
        n = streams[k][2] * streams[k][3]
        out[k] = raw[int(ends[j]) - n : int(ends[j])]
    return out


SCHEMA = "doc_id long, n_bytes long, width int, height int, media binary"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, width, height and the lossless WebP files of every whole text, one after the other.

    A null text is an empty one, repeated rows give repeated rows, other columns are ignored; a text of any length
    takes files of TILE bytes at most.
    """

    def run(batches):
        for batch in slices(batches):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            padded = [pad(x) for x in raw]
            sides = [shape(len(p)) for p in padded]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([w for w, _ in sides], pa.int32()), pa.array([h for _, h in sides], pa.int32()), pa.array(encode_many(padded), pa.binary())], names=["doc_id", "n_bytes", "width", "height", "media"])

    return texts(docs).mapInArrow(run, SCHEMA)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold: the payload decoded from their pixels, digests, and a feature.

    feature: the picture's size and the mean of each channel of all its samples, in thousandths.
    """

    def run(batches):
        for batch in slices(batches, "media"):
            rows = batch.to_pydict()
            out = {k.split(" ")[0]: [] for k in FEATURES.split(", ")}
            parted = [files(x) for x in rows["media"]]
            decoded = iter(decode_many([f for parts in parted for f in parts]))
            for doc_id, n, w, h, media, parts in zip(*rows.values(), parted):
                digest, tail, size, total = hashlib.sha256(), b"", 0, np.zeros(4, np.int64)
                for _ in parts:
                    pixels = next(decoded)
                    tail = pixels.tobytes()
                    digest.update(tail)
                    size += len(tail)
                    total += pixels.sum(0, dtype=np.int64)
                means = total * 4000 // size
                values = (doc_id, n, size, digest.hexdigest(), zlib.crc32(tail[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{w}x{h}:" + ",".join(map(str, means)))
                for column, v in zip(out.values(), values):
                    column.append(v)
            yield pa.record_batch([pa.array(v, pa.string() if k.endswith("sha256") or k == "feature" else pa.int64()) for k, v in out.items()], names=list(out))

    return media.mapInArrow(run, FEATURES)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
