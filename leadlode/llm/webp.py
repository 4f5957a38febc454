"""Lossless WebP: a decoder of the whole bitstream and an encoder that can use all its parts.

Pixels are unsigned 32-bit values, alpha in the top byte, then red, green and blue.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

#: Values of the format, fixed: order of the lengths of the code that codes lengths, and
#: the places (x to the left, y above) that the first 120 distance codes stand for.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
BLACK = 0xFF000000
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
LONGEST_CODE, LONGEST_COPY = 12, 4096
#: Places of a copy from which later copies may be taken.
REMEMBERED = 8
#: Bits that are looked up at a time where a run of codes is decoded together.
STRETCH = 1 << 19
SIDE = 1 << 14


# --- colours -----------------------------------------------------------------------------------


def split(pixels: np.ndarray) -> np.ndarray:
    """Pixels as rows of alpha, red, green, blue."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def join(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _guess(mode: int, left, top, top_right, top_left):
    def mean(a, b):
        return (a + b) >> 1

    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(axis=1), np.abs(left - top_left).sum(axis=1)
        return np.where((to_left < to_top)[:, None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        middle = mean(left, top)
        change = middle - top_left
        return np.clip(middle + ((change + (change < 0)) >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), left.shape)


def _guesses(x, y, width: int, modes: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Predictions at (x, y) from the pixels before them."""
    at = y * width + x
    before = [np.maximum(at - back, 0) for back in (1, width, width - 1, width + 1)]
    left, top, top_right, top_left = (image[b] for b in before)
    mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, modes))
    out = np.empty((len(x), 4), np.int32)
    for m in np.unique(mode):
        own = mode == m
        out[own] = _guess(int(m), left[own], top[own], top_right[own], top_left[own])
    return out


def _modes(x, y, width: int, size_bits: int, blocks: np.ndarray) -> np.ndarray:
    across = (width + (1 << size_bits) - 1) >> size_bits
    return blocks[(y >> size_bits) * across + (x >> size_bits)]


def _unpredict(rest: np.ndarray, width: int, height: int, size_bits: int, blocks: np.ndarray) -> np.ndarray:
    """Along lines x + 2 y = t no pixel needs another, so each line is done at once."""
    image = split(rest)
    modes = (blocks >> np.uint32(8)) & np.uint32(15)
    for t in range(width + 2 * height - 2):
        y = np.arange(max(0, (t - width + 2) // 2), min(height - 1, t // 2) + 1)
        x = t - 2 * y
        at = y * width + x
        image[at] = (image[at] + _guesses(x, y, width, _modes(x, y, width, size_bits, modes), image)) & 255
    return join(image)


def _predicted(pixels: np.ndarray, width: int, size_bits: int, blocks: np.ndarray) -> np.ndarray:
    at = np.arange(len(pixels))
    x, y, image = at % width, at // width, split(pixels)
    modes = _modes(x, y, width, size_bits, (blocks >> np.uint32(8)) & np.uint32(15))
    return join(image - _guesses(x, y, width, modes, image))


def _delta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int8).astype(np.int32) * b.astype(np.int8).astype(np.int32)) >> 5


def _cross(pixels: np.ndarray, width: int, size_bits: int, blocks: np.ndarray, sign: int) -> np.ndarray:
    """Add (1: decode) or take away (-1) what green and red foretell of red and blue."""
    at = np.arange(len(pixels))
    c, e = split(pixels), split(_modes(at % width, at // width, width, size_bits, blocks))
    red = c[:, 1]
    changed = (red + sign * _delta(e[:, 3], c[:, 2])) & 255
    whole = changed if sign > 0 else red
    c[:, 3] += sign * (_delta(e[:, 2], c[:, 2]) + _delta(e[:, 1], whole))
    c[:, 1] = changed
    return join(c)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    both, sides = green << np.uint32(16) | green, np.uint32(0x00FF00FF)
    changed = (pixels & sides) + both if sign > 0 else (pixels & sides | np.uint32(0x01000100)) - both
    return (pixels & ~sides) | changed & sides


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# --- prefix codes ------------------------------------------------------------------------------


class Code:
    """A canonical prefix code, looked up by the next bits of the stream."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else -1
        self.last = int(used[-1]) if len(used) else 0
        self.longest = 0 if self.single >= 0 else int(lengths.max(initial=0))
        self.table = np.zeros(1 << self.longest, np.int32)
        if self.single >= 0:
            self.table[:] = self.single << 4
        else:
            for symbol, n, code in codes_of(lengths):
                self.table[code :: 1 << n] = symbol << 4 | n
        self.listed: list[int] | None = None


def codes_of(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """``symbol, length, code`` of a canonical code; codes as they stand in the stream, first bit lowest."""
    out, code, before = [], 0, 0
    used = np.flatnonzero(lengths)
    for symbol in used[np.argsort(lengths[used], kind="stable")].tolist():
        n = int(lengths[symbol])
        code <<= n - before
        out.append((symbol, n, int(f"{code:0{n}b}"[::-1], 2)))
        code, before = code + 1, n
    return out


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of a Huffman code; counts are levelled until none is longer than allowed."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        lengths[used[0]] = 1
        return lengths
    level = 1
    while used:
        heap = [(max(int(counts[s]), level), i, (s,)) for i, s in enumerate(used)]
        heapq.heapify(heap)
        depth, n = dict.fromkeys(used, 0), len(heap)
        parents: list[tuple] = []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parents.append((a[2], b[2]))
            heapq.heappush(heap, (a[0] + b[0], n, (-len(parents),)))
            n += 1
        depths = {-len(parents): 0}
        for k in range(len(parents), 0, -1):
            for child in parents[k - 1]:
                depths[child[0] if child[0] < 0 else child] = depths[-k] + 1
        depth = {s: depths[(s,)] for s in used}
        if max(depth.values()) <= longest:
            for s, d in depth.items():
                lengths[s] = d
            return lengths
        level = max(2 * level, int(counts.sum()) >> (longest + 2))
    return lengths


# --- decoder -----------------------------------------------------------------------------------


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bits(self, n: int) -> int:
        value = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, code: Code) -> int:
        if code.single >= 0:
            return code.single
        if code.listed is None:
            code.listed = code.table.tolist()
        found = code.listed[
            int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "little") >> (self.at & 7) & ((1 << code.longest) - 1)
        ]
        self.at += found & 15
        return found >> 4

    def value(self, prefix: int) -> int:
        """A length or distance from its prefix symbol."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.bits(extra) + 1

    def code(self, alphabet: int) -> Code:
        lengths = np.zeros(alphabet, np.int64)
        if self.bits(1):
            two = self.bits(1)
            lengths[self.bits(8 if self.bits(1) else 1)] = 1
            if two:
                lengths[self.bits(8)] = 1
            return Code(lengths)
        of_lengths = np.zeros(19, np.int64)
        for k in LENGTH_ORDER[: 4 + self.bits(4)]:
            of_lengths[k] = self.bits(3)
        coded = Code(of_lengths)
        left = alphabet
        if self.bits(1):
            left = 2 + self.bits(2 + 2 * self.bits(3))
        at, last = 0, 8
        while at < alphabet and left > 0:
            left -= 1
            s = self.symbol(coded)
            if s < 16:
                lengths[at] = s
                at += 1
                last = s or last
            else:
                times = self.bits((2, 3, 7)[s - 16]) + (3, 3, 11)[s - 16]
                lengths[at : at + times] = last if s == 16 else 0
                at += times
        return Code(lengths)

    def run(self, code: Code, n: int) -> np.ndarray:
        """The next n symbols of one code.

        The symbol at every bit is looked up, as if a code began there; pointers to the bit after it are
        then squared four times, so that only every sixteenth beginning has to be walked to.
        """
        if code.single >= 0:
            return np.full(n, code.single, np.int32)
        out, got = [], 0
        while got < n:
            first = self.at >> 3
            size = min(STRETCH // 8, (n - got) * code.longest // 8 + 2, len(self.data) - first + 2)
            raw = np.zeros(size + 3, np.uint32)
            part = np.frombuffer(self.data, np.uint8, min(size + 3, len(self.data) - first), first)
            raw[: len(part)] = part
            word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
            ahead = (word[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << code.longest) - 1)
            found = code.table[ahead.ravel()]
            end = 8 * size
            after = np.arange(end + 16, dtype=np.int32)
            after[:end] += found & 15
            far = after
            for _ in range(4):
                far = far[far]
            at, starts = self.at & 7, []
            while at < end:
                starts.append(at)
                at = int(far[at])
            places = np.empty((len(starts), 16), np.int32)
            here = np.array(starts, np.int32)
            for k in range(16):
                places[:, k] = here
                here = after[here]
            places = places.ravel()
            places = places[places < end]
            if len(places) > n - got:
                at = int(places[n - got])
                places = places[: n - got]
            out.append(found[places] >> 4)
            got += len(places)
            self.at = 8 * first + at
        return np.concatenate(out)

    def image(self, width: int, height: int, main: bool = False) -> np.ndarray:
        """An entropy-coded image."""
        cache_bits = self.bits(4) if self.bits(1) else 0
        meta, meta_bits, groups = None, 0, 1
        if main and self.bits(1):
            meta_bits = self.bits(3) + 2
            across = (width + (1 << meta_bits) - 1) >> meta_bits
            meta = (self.image(across, (height + (1 << meta_bits) - 1) >> meta_bits) >> np.uint32(8)) & np.uint32(0xFFFF)
            groups = int(meta.max()) + 1
        cache = 1 << cache_bits if cache_bits else 0
        sizes = (LITERALS + LENGTHS + cache, 256, 256, 256, DISTANCES)
        codes = [[self.code(n) for n in sizes] for _ in range(groups)]
        green, red, blue, alpha, _ = codes[0]
        plain = [c.single for c in (red, blue, alpha)]
        if groups == 1 and not cache and min(plain) >= 0 and green.last < LITERALS:
            other = np.uint32(plain[2] << 24 | plain[0] << 16 | plain[1])
            return self.run(green, width * height).astype(np.uint32) << np.uint32(8) | other
        return self._mixed_image(width, height, codes, meta, meta_bits, cache_bits)

    def _mixed_image(self, width, height, codes, meta, meta_bits, cache_bits) -> np.ndarray:
        """Literals, copies and cached colours, one after another."""
        out: list[int] = []
        total = width * height
        kept = [0] * (1 << cache_bits)
        known = 0  # pixels that the cache has taken in
        across = (width + (1 << meta_bits) - 1) >> meta_bits
        own = codes[0]
        while len(out) < total:
            if meta is not None:
                y, x = divmod(len(out), width)
                own = codes[int(meta[(y >> meta_bits) * across + (x >> meta_bits)])]
            green, red, blue, alpha, distance = own
            s = self.symbol(green)
            if s < LITERALS:
                r, b = self.symbol(red), self.symbol(blue)
                out.append(self.symbol(alpha) << 24 | r << 16 | s << 8 | b)
            elif s < LITERALS + LENGTHS:
                n = self.value(s - LITERALS)
                d = self.value(self.symbol(distance))
                if d > len(NEAR):
                    d -= len(NEAR)
                else:
                    x, y = NEAR[d - 1]
                    d = max(1, x + y * width)
                n = min(n, total - len(out))
                if d > len(out):
                    raise ValueError("a copy from before the image")
                piece = out[-d:] if n >= d else out[len(out) - d : len(out) - d + n]
                out.extend((piece * (n // len(piece) + 1))[:n])
            else:
                while known < len(out):
                    kept[(CACHE_FACTOR * out[known] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[known]
                    known += 1
                out.append(kept[s - LITERALS - LENGTHS])
        return np.array(out, np.uint32)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The pixels (height by width) of the file at the start of data, and the file's length."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    end = 8 + struct.unpack("<I", data[4:8])[0]
    at = 12
    while data[at : at + 4] != b"VP8L":
        at += 8 + (struct.unpack("<I", data[at + 4 : at + 8])[0] + 1 & ~1)
        if at >= end:
            raise ValueError("no lossless image")
    r = Reader(data[at + 8 : at + 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]])
    if r.bits(8) != 0x2F:
        raise ValueError("no lossless image")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    steps, across = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            blocks = r.image((across + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits)
            steps.append((kind, across, bits, blocks))
        elif kind == PALETTE:
            colours = r.bits(8) + 1
            table = join(np.cumsum(split(r.image(colours, 1)), axis=0))
            bits = _bundle_bits(colours)
            steps.append((kind, across, bits, table))
            across = (across + (1 << bits) - 1) >> bits
        else:
            steps.append((kind, across, 0, None))
    pixels = r.image(across, height, main=True)
    for kind, wide, bits, extra in reversed(steps):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, wide, height, bits, extra)
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, wide, bits, extra, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, 1)
        else:
            index = (pixels >> np.uint32(8)) & np.uint32(255)
            if bits:
                each = 8 >> bits
                places = np.arange(1 << bits, dtype=np.uint32) * np.uint32(each)
                index = (index.reshape(height, -1, 1) >> places) & np.uint32((1 << each) - 1)
                index = index.reshape(height, -1)[:, :wide].ravel()
            table = np.concatenate((extra, np.zeros(256, np.uint32)))  # an index past the table is transparent
            pixels = table[index]
    return pixels.reshape(height, width), end + (end & 1)


# --- encoder -----------------------------------------------------------------------------------


class Writer:
    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def bits(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._close()
        self.parts.append((values.astype(np.uint64), sizes.astype(np.int64)))

    def _close(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        self._close()
        values, sizes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        start = ends - sizes
        shifted = values << (start & 31).astype(np.uint64)
        word = start >> 5
        n = (total >> 5) + 2
        # Bits of different values never overlap, so adding is joining; sums stay exact below 2**53.
        low = np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        high = np.bincount(word + 1, (shifted >> np.uint64(32)).astype(np.float64), n)
        return (low + high).astype(np.uint64).astype("<u4").tobytes()[: (total + 7) // 8]

    def code(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write a code for symbols with these counts; its codes and their lengths by symbol."""
        values, sizes = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.int64)
        used = np.flatnonzero(counts).tolist() or [0]
        if len(used) <= 2 and used[-1] < 256:
            self.bits(1, 1)
            self.bits(len(used) - 1, 1)
            wide = used[0] > 1
            self.bits(int(wide), 1)
            self.bits(used[0], 8 if wide else 1)
            if len(used) == 2:
                self.bits(used[1], 8)
                values[used[1]] = 1
                sizes[used] = 1
            return values, sizes
        if len(used) == 1:
            counts = counts.copy()
            counts[0] += 1
        lengths = code_lengths(counts, LONGEST_CODE)
        tokens: list[tuple[int, int, int]] = []
        before = -1
        for s in [*np.flatnonzero(lengths).tolist(), len(lengths)]:
            gap = s - before - 1
            while gap > 0:
                zeros = min(gap, 138) if gap >= 11 else gap if gap >= 3 else 1
                tokens.append((18, zeros - 11, 7) if zeros >= 11 else (17, zeros - 3, 3) if zeros >= 3 else (0, 0, 0))
                gap -= zeros
            if s < len(lengths):
                tokens.append((int(lengths[s]), 0, 0))
            before = s
        of_lengths = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
        if np.count_nonzero(of_lengths) == 1:  # one symbol needs no bits
            inner = {int(np.flatnonzero(of_lengths)[0]): (0, 0)}
        else:
            inner = {s: (c, n) for s, n, c in codes_of(of_lengths)}
        self.bits(0, 1)
        many = max(4, max(i + 1 for i, k in enumerate(LENGTH_ORDER) if of_lengths[k]))
        self.bits(many - 4, 4)
        for k in LENGTH_ORDER[:many]:
            self.bits(int(of_lengths[k]), 3)
        self.bits(0, 1)
        for token, extra, n in tokens:
            self.bits(*inner[token])
            if n:
                self.bits(extra, n)
        for s, n, c in codes_of(lengths):
            values[s], sizes[s] = c, n
        return values, sizes

    def image(self, pixels: np.ndarray, main: bool = False, copies: bool = False, cache_bits: int = 0) -> None:
        self.bits(int(cache_bits > 0), 1)
        if cache_bits:
            self.bits(cache_bits, 4)
        if main:
            self.bits(0, 1)
        if copies or cache_bits:
            return self._mixed_image(pixels, copies, cache_bits)
        c = split(pixels)
        columns = [c[:, 2], c[:, 1], c[:, 3], c[:, 0]]
        made = [self.code(np.bincount(x, minlength=LITERALS + LENGTHS if k == 0 else 256)) for k, x in enumerate(columns)]
        self.code(np.zeros(DISTANCES, np.int64))
        busy = [(values[x], sizes[x]) for (values, sizes), x in zip(made, columns, strict=True) if sizes.any()]
        if busy:
            self.many(np.stack([v for v, _ in busy], axis=1).ravel(), np.stack([s for _, s in busy], axis=1).ravel())

    def _mixed_image(self, pixels: np.ndarray, copies: bool, cache_bits: int) -> None:
        tokens = list(_tokens(pixels.tolist(), copies, cache_bits))
        cache = 1 << cache_bits if cache_bits else 0
        counts = [np.zeros(n, np.int64) for n in (LITERALS + LENGTHS + cache, 256, 256, 256, DISTANCES)]
        for token in tokens:
            for k, symbol, *_ in token:
                counts[k][symbol] += 1
        made = [self.code(n) for n in counts]
        for token in tokens:
            for k, symbol, extra, n in token:
                self.bits(int(made[k][0][symbol]), int(made[k][1][symbol]))
                if n:
                    self.bits(extra, n)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    half = (value - 1) >> (top - 1) & 1
    return 2 * top + half, (value - 1) & ((1 << (top - 1)) - 1), top - 1


def _tokens(pixels: list[int], copies: bool, cache_bits: int):
    """Each token as (alphabet, symbol, extra bits, their number) of its symbols."""
    met: dict[tuple, int] = {}
    kept: dict[int, int] = {}
    at = 0
    while at < len(pixels):
        n = 0
        if copies:
            name = tuple(pixels[at : at + 4])
            before = met.get(name, -1)
            if before >= 0 and len(name) == 4:
                n = 4
                while n < LONGEST_COPY and at + n < len(pixels) and pixels[before + n] == pixels[at + n]:
                    n += 1
        if n:
            length, distance = _prefix(n), _prefix(at - before + len(NEAR))
            yield (0, LITERALS + length[0], *length[1:]), (4, *distance)
        else:
            n = 1
            p = pixels[at]
            slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and kept.get(slot) == p:
                yield ((0, LITERALS + LENGTHS + slot, 0, 0),)
            else:
                yield (0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)
        for k in range(at, at + min(n, REMEMBERED)):
            if copies:
                met[tuple(pixels[k : k + 4])] = k
        for k in range(at, at + n if cache_bits else at):
            kept[(CACHE_FACTOR * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
        at += n


def encode(
    pixels: np.ndarray,
    transforms: tuple[int, ...] = (),
    copies: bool = False,
    cache_bits: int = 0,
    size_bits: int = 3,
    blocks: dict[int, np.ndarray] | None = None,
) -> bytes:
    """A file of an image (height by width).

    ``transforms`` are used in the order given, each at most once, the palette alone or last.  ``blocks``
    holds the modes of the predictor and the multipliers of the cross-colour transform per block of
    ``1 << size_bits`` pixels (averages and no multipliers if not given).
    """
    height, width = pixels.shape
    if not (0 < height <= SIDE and 0 < width <= SIDE):
        raise ValueError("an image has 1 to 16384 pixels a side")
    flat = pixels.ravel()
    w = Writer()
    w.bits(0x2F, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(int((flat >> np.uint32(24) != 255).any()), 1)
    w.bits(0, 3)
    across = width
    for kind in transforms:
        w.bits(1, 1)
        w.bits(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            n = ((across + (1 << size_bits) - 1) >> size_bits) * ((height + (1 << size_bits) - 1) >> size_bits)
            own = (blocks or {}).get(kind)
            own = np.full(n, BLACK | (7 << 8 if kind == PREDICTOR else 0), np.uint32) if own is None else own
            w.bits(size_bits - 2, 3)
            w.image(own)
            flat = _predicted(flat, across, size_bits, own) if kind == PREDICTOR else _cross(flat, across, size_bits, own, -1)
        elif kind == SUBTRACT_GREEN:
            flat = _green(flat, -1)
        else:
            colours, index = np.unique(flat, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("over 256 colours")
            w.bits(len(colours) - 1, 8)
            table = split(colours)
            w.image(join(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.int32))))
            bits = _bundle_bits(len(colours))
            index = index.reshape(height, width).astype(np.uint32)
            if bits:
                index = np.pad(index, ((0, 0), (0, -width % (1 << bits)))).reshape(height, -1, 1 << bits)
                index = (index << (np.arange(1 << bits, dtype=np.uint32) * np.uint32(8 >> bits))).sum(axis=2, dtype=np.uint32)
                across = index.shape[1]
            flat = np.uint32(BLACK) | index.ravel() << np.uint32(8)
    w.bits(0, 1)
    w.image(flat, True, copies, cache_bits)
    body = w.bytes()
    body += b"\0" * (len(body) & 1)
    size = len(body)
    return b"RIFF" + struct.pack("<I", size + 12) + b"WEBPVP8L" + struct.pack("<I", size) + body
