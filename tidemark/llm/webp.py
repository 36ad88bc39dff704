"""Lossless WebP: a decoder to pixel arrays, an encoder for planes of 8-bit samples, and media columns made of them.

The decoder reads the published bitstream: simple and normal prefix codes, groups of codes chosen by an entropy image,
back-references with the near-pixel distance map, the colour cache, and the predictor, cross-colour, subtract-green and
palette transforms with their inverses. Where each prefix code of an image gives all its symbols equal lengths, the
pixels sit at a fixed stride and are read with array operations. Where only one channel varies and there is no cache,
array operations tell at each bit what a symbol that started there would be, and the decoder follows the chain of those
that do. Any other stream is read symbol by symbol.

The encoder works on one channel, and for each payload takes the shortest of these forms: a palette of the distinct values
(several samples to a pixel for small ones) with codes of equal length; prefix codes by frequency with back-references; the
same after a predictor, where the differences from the left or upper samples vary less than the samples do. A colour cache
can't win on one channel, as a pixel is one symbol anyhow, so the encoder asks for none. A payload is one file: rows are
``ROW`` samples wide, and twice as wide as often as a payload of more rows than the format allows needs it.

Many payloads are coded, and many files read, at a time, with array operations that serve them all: most texts are short, and
one by one the calls cost more than the samples. A file doesn't depend on those beside it.

Null and empty texts are stored as one row of zeros. Rows of null or repeated ids are stored like others. Equal texts give
equal bytes. An empty table gives no rows. Texts of more than 2**28 bytes don't fit the format and are an error.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.text import batches, texts, tidy

#: Samples in a row of a plane: payloads are padded with zeros to a positive multiple.
ROW = 64
#: Most rows, or samples in a row, of an image.
MOST_ROWS = 16_384
#: Least length of a copy, and its most; how far back copies reach; the most bits of a code that is written.
LEAST_COPY, MOST_COPY, REACH, CODE_BITS = 5, 4096, 1_000_000, 12
#: A predictor is tried where it brings the samples' entropy below this share.
PREDICTABLE = 0.9
#: Samples that are coded, or read, together, unless a single payload has more.
TOGETHER = 1 << 17
#: Bits that the decoder looks at together.
SEGMENT = 1 << 16

# Fixed values of the bitstream.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_CACHE_MULTIPLIER = 0x1E35A7BD
_GREEN_SYMBOLS, _DISTANCES = 256 + 24, 40

#: For symbols of lengths, how many bits follow, and the least repeats that they stand for.
_MORE, _LEAST = np.array([0] * 16 + [2, 3, 7]), np.array([0] * 16 + [3, 3, 11])
#: Where the length of each symbol of lengths is stored.
_LENGTH_PLACE = [_LENGTH_ORDER.index(s) for s in range(19)]

#: Offsets (x, y) that the shortest distance codes stand for: the 120 nearest pixels above or to the left.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)
)


class _Bits:
    """Reads bits from the least significant end on."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a, shift = self.at >> 3, self.at & 7
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream is too short")
        return int.from_bytes(self.data[a : a + (n + shift + 7 >> 3)], "little") >> shift & ((1 << n) - 1)


class _Code:
    """A prefix code from the lengths of the symbols that it uses, each with its symbol, in the symbols' order."""

    def __init__(self, used: list[tuple[int, int]]) -> None:
        self.only = used[0][1] if len(used) == 1 else None
        if not used:
            self.only = 0
        self.bits = 0 if self.only is not None else max(n for n, _ in used)
        self.flat = [s for _, s in used] if self.only is None and min(n for n, _ in used) == self.bits else None
        self.table: list[tuple[int, int]] = []
        if self.only is None:
            if sum(1 << self.bits - n for n, _ in used) != 1 << self.bits:
                raise ValueError("an incomplete prefix code")
            self.used = used

    def build(self) -> None:
        """For each value of the next bits, the symbol and its length."""
        self.table = [(0, 0)] * (1 << self.bits)
        code = last = 0
        for n, symbol in sorted(self.used):
            code <<= n - last
            last = n
            first = _SHORT[n][code] if n < 8 else int(format(code, f"0{n}b")[::-1], 2)
            for i in range(first, 1 << self.bits, 1 << n):
                self.table[i] = (symbol, n)
            code += 1

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        if not self.table:
            self.build()
        a, shift = bits.at >> 3, bits.at & 7
        got = int.from_bytes(bits.data[a : a + 3], "little") >> shift & ((1 << self.bits) - 1)
        symbol, n = self.table[got]
        bits.at += n
        return symbol


def _read_code(bits: _Bits, size: int) -> _Code:
    if bits.read(1):
        kind = bits.read(2)  # whether there are two symbols, and whether the first is wide
        symbols = {bits.read(8 if kind & 2 else 1), *([bits.read(8)] if kind & 1 else [])}
        return _Code([(1, s) for s in sorted(symbols)])
    lengths = [0] * size
    n = 4 + bits.read(4)
    stored = bits.read(3 * n)
    code = _Code([(m, s) for s, i in enumerate(_LENGTH_PLACE) if i < n and (m := stored >> 3 * i & 7)])
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if code.only is None:
        code.build()
    table, mask = code.table or [(code.only, 0)], (1 << code.bits) - 1
    first = bits.at >> 3
    ahead = int.from_bytes(bits.data[first : first + 2 * size + 8], "little") >> (bits.at & 7)  # 14 bits a length at most
    at, previous, used = 0, 8, 0
    while at < size and left:
        left -= 1
        symbol, n = table[ahead & mask]
        ahead >>= n
        used += n
        if symbol < 16:
            lengths[at] = symbol
            previous = symbol or previous
            at += 1
        else:
            more, least = ((2, 3), (3, 3), (7, 11))[symbol - 16]
            n = least + (ahead & (1 << more) - 1)
            ahead >>= more
            used += more
            if at + n > size:
                raise ValueError("more code lengths than symbols")
            if symbol == 16:
                lengths[at : at + n] = [previous] * n
            at += n
    bits.at += used
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream is too short")
    return _Code([(n, s) for s, n in enumerate(lengths) if n])


def _prefixed(bits: _Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol and the bits that follow."""
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + bits.read(extra) + 1


def _at_stride(bits: _Bits, codes: list[_Code], n: int) -> np.ndarray | None:
    """The pixels, if all codes give their symbols equal lengths and there are literals only."""
    if any(c.only is None and c.flat is None for c in codes[:4]) or (codes[0].flat or [codes[0].only])[-1] >= 256:
        return None
    width = sum(c.bits for c in codes[:4])
    out = np.zeros(n, np.uint32)
    if width:
        first = bits.at >> 3
        stream = np.frombuffer(bits.data, np.uint8, min(len(bits.data) - first, (n * width + 14) // 8), first)
        each = np.unpackbits(stream, bitorder="little")[bits.at & 7 :][: n * width]
        if len(each) < n * width:
            raise ValueError("the stream is too short")
        each = each.reshape(n, width)
        bits.at += n * width
    at = 0
    for code, shift in zip(codes[:4], (8, 16, 0, 24), strict=True):  # green, red, blue, alpha
        if code.only is not None:
            out |= np.uint32(code.only << shift)
            continue
        value = np.zeros(n, np.uint32)
        for i in range(at, at + code.bits):
            value = value << np.uint32(1) | each[:, i]
        at += code.bits
        out |= np.array(code.flat, np.uint32)[value] << np.uint32(shift)
    return out


def _reversed_bits(n: int) -> np.ndarray:
    """The numbers below 2**n with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


_REVERSED = [_reversed_bits(n) for n in range(16)]
_SHORT = [x.tolist() for x in _REVERSED[:8]]


def _table(code: _Code) -> np.ndarray:
    """For each value of the next ``code.bits`` bits the symbol, and its length in the least four bits."""
    if code.only is not None:
        return np.array([code.only << 4], np.uint16)
    both = np.array([symbol << 4 | n for n, symbol in sorted(code.used)], np.uint16)  # a code has at most 15 bits
    return np.repeat(both, 1 << code.bits - (both & 15).astype(np.int64))[_REVERSED[code.bits]]


#: For symbols of lengths and distances, how many bits follow, and the least value.
_PREFIXES = np.arange(max(_GREEN_SYMBOLS - 256, _DISTANCES))
_EXTRA = np.maximum(0, _PREFIXES - 2 >> 1)
_BASE = np.where(_PREFIXES < 4, _PREFIXES, 2 + (_PREFIXES & 1) << _EXTRA) + 1
_EIGHT = np.arange(8)


@functools.cache
def _near(width: int) -> np.ndarray:
    """The distances of the shortest distance codes, from 1 on."""
    return np.array([0, *(max(1, x + y * width) for x, y in NEAR)])


def _one_after_another(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables as one; the mask of the bits that each is for, and where it begins."""
    size = np.array([len(t) for t in tables])
    return np.concatenate(tables), size - 1, np.cumsum(size) - size


def _is_one_channel(codes: list[_Code]) -> bool:
    """Whether the other channels are constant, and each symbol takes bits."""
    return codes[0].bits > 0 and all(c.only is not None for c in codes[1:4])


def _one_channels(images: list[tuple[_Bits, list[_Code], int, int]]) -> list[np.ndarray]:
    """The pixels of images (bits, codes, number of pixels, width) of one channel without a cache: symbols of all offsets, then
    the chain of each image. Each array operation serves as many images as ``SEGMENT`` allows."""
    n = np.array([x[2] for x in images], np.int64)
    base, filled = np.cumsum(n) - n, np.zeros(len(n), np.int64)
    out = bytearray(int(n.sum()))
    samples, todo = np.frombuffer(out, np.uint8), list(range(len(images)))[::-1]
    tables = [(_table(codes[0]), _table(codes[4])) for _, codes, _, _ in images]
    while todo:
        some, data, looked, begin = [], [], [], []
        while todo and (not some or sum(looked) + len(images[todo[-1]][0].data) <= SEGMENT >> 3):
            bits = images[todo[-1]][0]
            some.append(todo.pop())
            data.append(bits.data[bits.at >> 3 : (bits.at >> 3) + (SEGMENT >> 3) + 16] + bytes(8))
            looked.append(min(SEGMENT >> 3, len(data[-1]) - 8))
            begin.append(bits.at & 7)
        sizes = np.array([len(d) for d in data])
        start = 8 * (np.cumsum(sizes) - sizes)  # the first bit of each image
        end = start + 8 * np.array(looked)
        of = np.repeat(np.arange(len(some)), sizes)
        green, green_mask, green_base = _one_after_another([tables[i][0] for i in some])
        far, far_mask, far_base = _one_after_another([tables[i][1] for i in some])
        word = np.ndarray(len(of), "<i8", b"".join(data) + bytes(8), 0, (1,)).copy()
        found = word[:, None] >> _EIGHT
        found &= green_mask[of, None]
        found += green_base[of, None]
        symbol = green.take(found.ravel())
        reach = len(symbol)
        next_ = np.arange(reach + 1)
        next_[:-1] += symbol & 15

        def peek(where: np.ndarray, mask: np.ndarray) -> np.ndarray:
            return word[np.minimum(where >> 3, len(word) - 1)] >> (where & 7) & mask  # noqa: B023

        def distance_code(where: np.ndarray, of: np.ndarray) -> np.ndarray:
            return far.take(peek(where, far_mask[of]) + far_base[of]).astype(np.int64)  # noqa: B023

        copies = np.flatnonzero(symbol >= 256 << 4)
        where = next_[copies] + _EXTRA[(symbol[copies] >> 4) - 256]
        code = distance_code(where, of[copies >> 3])
        next_[copies] = where + (code & 15) + _EXTRA[code >> 4]
        np.minimum(next_, reach, out=next_)
        jumps = [next_]  # 1, 2, 4 and 8 symbols on
        for _ in range(3):
            jumps.append(jumps[-1].take(jumps[-1]))
        step, heads, counts = memoryview(jumps.pop()), [], []
        for o, stop in zip((start + begin).tolist(), end.tolist(), strict=True):
            before = len(heads)
            while o < stop:
                heads.append(o)
                o = step[o]
            counts.append(8 * (len(heads) - before))
        chain, of = np.array(heads, np.int64), np.repeat(np.arange(len(some)), counts)
        for jump in reversed(jumps):
            chain = np.stack([chain, jump.take(chain)], 1).ravel()
        within = chain < end[of]
        chain, of = chain[within], of[within]
        value = symbol[chain] >> 4
        is_copy = np.flatnonzero(value >= 256)
        where, which = chain[is_copy] + (symbol[chain[is_copy]] & 15), value[is_copy].astype(np.int64) - 256
        length = _BASE[which] + peek(where, (1 << _EXTRA[which]) - 1)
        where += _EXTRA[which]
        code = distance_code(where, of[is_copy])
        where, which = where + (code & 15), code >> 4
        distance = _BASE[which] + peek(where, (1 << _EXTRA[which]) - 1)
        near = np.array([_near(images[i][3]) for i in some])[of[is_copy], np.minimum(distance, len(NEAR))]
        distance = np.where(distance <= len(NEAR), near, distance - len(NEAR))
        size = np.ones(len(chain), np.int64)
        size[is_copy] = length
        place = np.cumsum(size) - size
        head = of.searchsorted(np.arange(len(some)))
        if not len(of) or (np.bincount(of, minlength=len(some)) == 0).any():
            raise ValueError("the stream is too short")
        place += (filled[some] - place[head])[of]
        fits = place < n[some][of]  # tokens up to the one that fills the image
        copied = fits[is_copy]
        is_copy, length, distance = is_copy[copied], length[copied], distance[copied]
        last = np.append(head[1:], len(of)) - 1 - np.bincount(of, ~fits, len(some)).astype(np.int64)
        filled[some] = place[last] + size[last]
        if (filled > n).any() or (distance > place[is_copy]).any():
            raise ValueError("a back-reference out of the image")
        place += base[some][of]
        samples[place[fits]] = np.minimum(value[fits], 255)  # copies overwrite theirs
        for to, m, d in zip(place[is_copy].tolist(), length.tolist(), distance.tolist(), strict=True):
            if d >= m:
                out[to : to + m] = out[to - d : to - d + m]
            else:
                out[to : to + m] = (out[to - d : to] * (m // d + 1))[:m]
        for i, used in zip(some, (next_[chain[last]] - start).tolist(), strict=True):
            bits = images[i][0]
            bits.at = 8 * (bits.at >> 3) + used
            if bits.at > 8 * len(bits.data):
                raise ValueError("the stream is too short")
            if filled[i] < n[i]:
                todo.append(i)
    pixels = samples.astype(np.uint32) << np.uint32(8)
    rest = (np.uint32(c[3].only << 24 | c[1].only << 16 | c[2].only) for _, c, _, _ in images)
    return [pixels[at : at + m] | r for at, m, r in zip(base.tolist(), n.tolist(), rest, strict=True)]


def _one_channel(bits: _Bits, codes: list[_Code], n: int, width: int) -> np.ndarray | None:
    """The pixels, if the other channels are constant."""
    return _one_channels([(bits, codes, n, width)])[0] if _is_one_channel(codes) else None


#: What is ahead of an image's pixels: groups of codes, bits of the cache, which group is chosen where, and its blocks' size.
_Ahead = tuple[list[list[_Code]], int, np.ndarray | None, int]


def _ahead(bits: _Bits, width: int, height: int, main: bool) -> _Ahead:
    """Only the main image can choose among groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    chosen, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        side = _image(bits, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
        chosen = side >> np.uint32(8) & np.uint32(0xFFFF)
    sizes = (_GREEN_SYMBOLS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, _DISTANCES)
    groups = [[_read_code(bits, s) for s in sizes] for _ in range(1 if chosen is None else int(chosen.max()) + 1)]
    return groups, cache_bits, chosen, block


def _image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB pixels."""
    return _pixels(bits, width, height, _ahead(bits, width, height, main))


def _pixels(bits: _Bits, width: int, height: int, ahead: _Ahead) -> np.ndarray:
    groups, cache_bits, chosen, block = ahead
    n = width * height
    if len(groups) == 1 and not cache_bits:
        read = _at_stride(bits, groups[0], n)
        if read is None:
            read = _one_channel(bits, groups[0], n, width)
        if read is not None:
            return read.reshape(height, width)
    pixels, cache, at = [0] * n, [0] * (1 << cache_bits), 0
    filled = 0  # pixels before this are in the cache
    rows = None if chosen is None else chosen.tolist()
    while at < n:
        codes = groups[0] if rows is None else groups[rows[at // width >> block][at % width >> block]]
        symbol = codes[0].read(bits)
        if symbol < 256:
            red, blue, alpha = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            pixels[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < _GREEN_SYMBOLS:
            length = _prefixed(bits, symbol - 256)
            distance = _prefixed(bits, codes[4].read(bits))
            if distance > len(NEAR):
                distance -= len(NEAR)
            else:
                x, y = NEAR[distance - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > n:
                raise ValueError("a back-reference out of the image")
            for _ in range(length):
                pixels[at] = pixels[at - distance]
                at += 1
        else:
            for i in range(filled, at):
                cache[(_CACHE_MULTIPLIER * pixels[i] & 0xFFFFFFFF) >> 32 - cache_bits] = pixels[i]
            filled = at
            pixels[at] = cache[symbol - _GREEN_SYMBOLS]
            at += 1
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream is too short")
    return np.array(pixels, np.uint32).reshape(height, width)


def _channels(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green and blue along the last axis."""
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _joined(channels: np.ndarray) -> np.ndarray:
    a, r, g, b = (channels[..., i].astype(np.uint32) & np.uint32(255) for i in range(4))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def predicted(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """A pixel's prediction from its neighbours, channel by channel."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return ((left + top_right >> 1) + top) >> 1
    if mode == 6:
        return left + top_left >> 1
    if mode == 7:
        return left + top >> 1
    if mode == 8:
        return top_left + top >> 1
    if mode == 9:
        return top + top_right >> 1
    if mode == 10:
        return (left + top_left >> 1) + (top + top_right >> 1) >> 1
    if mode == 11:
        nearer_left = np.abs(top - top_left).sum() < np.abs(left - top_left).sum()
        return left if nearer_left else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = left + top >> 1
        return np.clip(mean + np.trunc((mean - top_left) / 2).astype(np.int32), 0, 255)
    return np.array([255, 0, 0, 0], np.int32)


def _unpredict(argb: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    out = _channels(argb)
    height, width = argb.shape
    which = (modes >> np.uint32(8) & np.uint32(15)).tolist()
    out[0, 0] = (out[0, 0] + [255, 0, 0, 0]) & 255
    out[0] = np.cumsum(out[0], 0) & 255  # the first row is predicted from the left
    if (modes == modes.flat[0]).all() and which[0][0] in (1, 2):  # left or top everywhere: sums along rows or columns
        if which[0][0] == 1:
            out[:, 0] = np.cumsum(out[:, 0], 0)
            out[1:] = np.cumsum(out[1:], 1)
            return _joined(out & 255)
        return _joined(np.cumsum(out, 0) & 255)
    for y in range(1, height):
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        for x in range(1, width):
            right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
            mode = which[y >> block][x >> block]
            out[y, x] = (out[y, x] + predicted(mode, out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], right)) & 255
    return _joined(out)


def _uncross(argb: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    out = _channels(argb)
    height, width = argb.shape
    by = _channels(factors)[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    signed = lambda x: (x & 255 ^ 128) - 128
    delta = lambda factor, colour: signed(factor) * signed(colour) >> 5
    green = out[..., 2]
    red = (out[..., 1] + delta(by[..., 3], green)) & 255
    blue = out[..., 3] + delta(by[..., 2], green) + delta(by[..., 1], red)
    return _joined(np.stack([out[..., 0], red, green, blue], -1))


def _uncut(argb: np.ndarray, palette: np.ndarray, packed: int, width: int) -> np.ndarray:
    """Pixels from their places in a palette; ``packed``: the logarithm of the places in one pixel."""
    place = argb >> np.uint32(8) & np.uint32(255)
    if packed:
        each = 8 >> packed
        shifts = np.arange(1 << packed, dtype=np.uint32) * np.uint32(each)
        place = (place[..., None] >> shifts & np.uint32((1 << each) - 1)).reshape(len(argb), -1)[:, :width]
    padded = np.zeros(256, np.uint32)
    padded[: len(palette)] = palette
    return padded[place]


#: A file up to its pixels: bits, width and height of the main image, what is ahead of its pixels, and the transforms.
_Opened = tuple[_Bits, int, int, _Ahead, list[tuple]]


def _opened(data: bytes) -> _Opened:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    bits = _Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            block = bits.read(3) + 2
            side = _image(bits, (inner + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            undo.append((_unpredict if kind == 0 else _uncross, side, block))
        elif kind == 2:
            undo.append((None, None, 0))
        else:
            size = bits.read(8) + 1
            palette = _joined(np.cumsum(_channels(_image(bits, size, 1, False)[0]), 0) & 255)
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((_uncut, palette, (packed, inner)))
            inner = (inner + (1 << packed) - 1) >> packed
    return bits, inner, height, _ahead(bits, inner, height, True), undo


def _undone(argb: np.ndarray, undo: list[tuple]) -> np.ndarray:
    for inverse, side, how in reversed(undo):
        if inverse is None:
            c = _channels(argb)
            argb = _joined(np.stack([c[..., 0], c[..., 1] + c[..., 2], c[..., 2], c[..., 3] + c[..., 2]], -1))
        elif inverse is _uncut:
            argb = _uncut(argb, side, *how)
        else:
            argb = inverse(argb, side, how)
    return argb


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels of a lossless WebP file, as an array of height by width."""
    bits, width, height, ahead, undo = _opened(data)
    return _undone(_pixels(bits, width, height, ahead), undo)


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """``decode`` for each; files of one channel with codes of unequal lengths are read together."""
    opened, found = [_opened(data) for data in files], {}
    for i, (bits, width, height, (groups, cache_bits, *_), _) in enumerate(opened):
        if len(groups) == 1 and not cache_bits and groups[0][0].flat is None and _is_one_channel(groups[0]):
            found[i] = (bits, groups[0], width * height, width)
    found = dict(zip(found, _one_channels(list(found.values())), strict=True))
    out = []
    for i, (bits, width, height, ahead, undo) in enumerate(opened):
        argb = found[i].reshape(height, width) if i in found else _pixels(bits, width, height, ahead)
        out.append(_undone(argb, undo))
    return out


def _field(*fields: tuple[int, int]) -> tuple[int, int]:
    """Values and widths as one value and width, the first in the least bits."""
    whole = n = 0
    for value, width in fields:
        whole |= value << n
        n += width
    return whole, n


def _bit_array(*fields: tuple[int, int]) -> np.ndarray:
    """Values and widths as bits, least significant first."""
    whole, n = _field(*fields)
    return np.unpackbits(np.frombuffer(whole.to_bytes(n + 7 >> 3, "little"), np.uint8), count=n, bitorder="little")


#: A code of one symbol: 0, or 255.
_ZERO, _FULL = _field((1, 1), (0, 1), (0, 1), (0, 1)), _field((1, 1), (0, 1), (1, 1), (255, 8))


def _equal_lengths(width: int) -> np.ndarray:
    """A normal code of 2**width symbols of equal lengths, all others unused."""
    if width == 0:
        return _bit_array(_ZERO)
    tokens = [width]  # the length itself, or 16: again 3 to 6 times
    left = (1 << width) - 1
    while left >= 3:
        n = min(6, left)
        tokens.append((16, n - 3))
        left -= n
    tokens += [width] * left
    of_lengths = [1 if s in (width, 16) else 0 for s in _LENGTH_ORDER]
    n = 19 - next(i for i, x in enumerate(reversed(of_lengths)) if x)
    n = max(n, 4)
    fields = [(0, 1), (n - 4, 4), *((x, 3) for x in of_lengths[:n])]
    size = 2 * max(1, -(-(len(tokens) - 2).bit_length() // 2)) if len(tokens) > 2 else 2
    fields += [(1, 1), ((size - 2) // 2, 3), (len(tokens) - 2, size)]
    for t in tokens:
        fields += [(0, 1)] if t == width else [(1, 1), (t[1], 2)]  # symbols of length 1: the length is before 16
    return _bit_array(*fields)


_EQUAL = [_equal_lengths(w) for w in range(9)]


def _lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code for symbols that occur so often, ``CODE_BITS`` at most; 0 for those that don't."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    n, k = counts[order].tolist(), len(used)
    while True:
        # Leaves and inner nodes both come in ascending order, so the two least are at the heads of two queues.
        weight, parent, leaf, inner = n + [0] * (k - 1), [0] * (2 * k - 1), 0, k
        for at in range(k, 2 * k - 1):
            for _ in (0, 1):
                if leaf < k and (inner >= at or n[leaf] <= weight[inner]):
                    least, leaf = leaf, leaf + 1
                else:
                    least, inner = inner, inner + 1
                weight[at] += weight[least]
                parent[least] = at
        depth = [0] * (2 * k - 1)
        for i in range(2 * k - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:k]) <= CODE_BITS:
            out[order] = depth[:k]
            return out
        n = [c + 1 >> 1 for c in n]  # flatter, and so shallower


def _words(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, its first bit the least; a row is a code."""
    order = np.argsort(lengths, axis=1, kind="stable")
    n = np.take_along_axis(lengths, order, 1)
    space = np.where(n > 0, 1 << 15 - n, 0)
    start = np.cumsum(space, 1) - space  # codes ascend with their lengths
    out = np.zeros_like(lengths)
    np.put_along_axis(out, order, _REVERSED[15][start] & (1 << n) - 1, 1)
    return out


#: Fields of a stream, in its order: the image that each is of (ascending), its value and its bits, 64 at most.
_Fields = tuple[np.ndarray, np.ndarray, np.ndarray]


def _packed(parts: list[_Fields], images: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of each image one after another, as words of 32 bits; its first word and its bits."""
    bits = np.array([np.bincount(of, n, images) for of, _, n in parts]).astype(np.int64)
    total = bits.sum(0)
    words = total + 31 >> 5
    first = np.cumsum(words) - words
    begin = 32 * first + np.cumsum(bits, 0) - bits
    out = np.zeros(int(words.sum()) + 2)  # sums of floats are exact below 2**53

    def put(at: np.ndarray, value: np.ndarray) -> None:
        """Values of 32 bits start in a word and end in it or the next."""
        value = value << (at & 31).astype(np.uint64)
        at = at >> 5
        np.add(out, np.bincount(at, value & np.uint64(0xFFFFFFFF), len(out)), out=out)
        out[1:] += np.bincount(at, value >> np.uint64(32), len(out))[:-1]

    for (of, value, n), start, each in zip(parts, begin, bits, strict=True):
        if len(of) == 0:
            continue
        at = np.cumsum(n) - n
        at += (start - (np.cumsum(each) - each))[of]
        value = value.astype(np.uint64)
        wide = np.flatnonzero(n > 32)
        if len(wide):
            put(at[wide] + 32, value[wide] >> np.uint64(32))
            value &= np.uint64(0xFFFFFFFF)
        put(at, value)
    return out.astype("<u4"), first, total


def _headers(lengths: np.ndarray) -> list[_Fields]:
    """What tells a decoder the lengths of a code; a row is a code."""
    used = lengths > 0
    count, size = used.sum(1), lengths.shape[1]
    first, last = used.argmax(1), size - 1 - used[:, ::-1].argmax(1)
    last[count == 0] = 0
    simple = (count == 0) | (count <= 2) & (last < 256)
    of = np.flatnonzero(simple)
    pair = count[of] == 2
    out = [(of, np.where(pair, 7 | first[of] << 3 | last[of] << 11, 5 | first[of] << 3), np.where(pair, 19, 11))]
    rows = np.flatnonzero(~simple)
    if not len(rows):
        return out
    # Runs of equal lengths, each as a length, if not 0, repeats of the most that one can stand for, and what is left.
    within = np.arange(size) <= last[rows, None]
    value, row = lengths[rows][within], np.nonzero(within)[0]
    begin = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])]))
    run = np.diff(begin, append=len(value))
    value, row = value[begin], row[begin]
    lead = (value > 0).astype(np.int64)
    most = np.where(value > 0, 6, 138)
    full, rest = np.divmod(run - lead, most)
    tokens = lead + full + np.where(rest >= 3, 1, rest)
    which = np.repeat(np.arange(len(tokens)), tokens)
    place = np.arange(len(which)) - (np.cumsum(tokens) - tokens + lead)[which]
    value, row, full, rest = value[which], row[which], full[which], rest[which]
    repeats = np.where((place >= 0) & (place < full), most[which], np.where((place >= full) & (rest >= 3), rest, 0))
    symbol = np.where(repeats == 0, value, np.where(value > 0, 16, np.where(repeats <= 10, 17, 18)))
    more, least = _MORE[symbol], _LEAST[symbol]
    counts = np.bincount(19 * row + symbol, minlength=19 * len(rows)).reshape(-1, 19)
    of = np.empty_like(counts)
    for i, n in enumerate(counts):
        # At most 7 bits: these lengths are stored in 3.
        while (found := _lengths(n)).max() > 7:
            n = n + (n > 0) >> 1
        of[i] = found
    stored = of[:, _LENGTH_ORDER]
    n = np.maximum(4, 19 - (stored[:, ::-1] > 0).argmax(1))
    out.append((rows, n - 4 << 1, np.full(len(rows), 5)))
    out.append((rows, (stored << 3 * np.arange(19)).sum(1), 3 * n))
    tokens = np.bincount(row, minlength=len(rows)) - 2
    size = np.maximum(2, np.frexp(tokens)[1] + 1 >> 1 << 1).astype(np.int64)  # of the number of tokens
    out.append((rows, 1 | size - 2 | tokens << 4, 4 + size))
    words = _words(of)[row, symbol]
    of[(of > 0).sum(1) == 1] = 0
    n = of[row, symbol]
    out.append((rows[row], words | np.where(more > 0, repeats - least, 0) << n, n + more))
    return out


def _code_header(lengths: np.ndarray) -> np.ndarray:
    """The bits that tell a decoder the lengths of a code."""
    words, _, bits = _packed(_headers(lengths[None]), 1)
    return np.unpackbits(words.view(np.uint8), count=int(bits[0]), bitorder="little")


def _back(sample: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How far back in its image the last four samples are that equal a sample and its next three; 0: nowhere."""
    x = sample.astype(np.uint32)
    key = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    hashed = (key * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)  # numpy sorts these by their digits
    order = np.argsort(hashed, kind="stable")
    ranked = key[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    del x, key, hashed, ranked  # a text may be long
    here, distance = order[same + 1], order[same]
    del order, same
    least = np.repeat(start.astype(np.int32), np.diff(start, append=len(sample)))  # the start of each sample's image
    fits = distance >= least[here]
    np.subtract(here, distance, out=distance)
    fits &= distance <= REACH
    distance *= fits
    back = np.zeros(len(sample) - 2, np.int64)
    back[here] = distance
    back[start[1:, None] - [1, 2, 3]] = 0  # these four are not of one image
    return back


def _copies(sample: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where copies of earlier samples of an image begin, their lengths and distances, from left to right. ``start``:
    where images start; each has 4 samples or more."""
    back = _back(sample, start)
    change = back[1:] != back[:-1]
    until = np.append(np.flatnonzero(change) + 1, len(back))  # where the distance changes next
    starts = np.flatnonzero(back)  # not the last sample, so each is before an entry of ``change``
    length = until[np.cumsum(change, dtype=np.int32)[starts] - change[starts]]
    length -= starts - 3
    some = length >= LEAST_COPY
    starts, length = starts[some], np.minimum(length[some], MOST_COPY)
    after = memoryview(starts.searchsorted(starts + length))  # the next that begins where a copy has ended, or later
    taken, i, n = [], 0, len(starts)
    while i < n:
        taken.append(i)
        i = after[i]
    taken = np.array(taken, np.int64)
    begin = starts[taken]
    return begin, length[taken], back[begin]


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix symbols of lengths or distances, how many bits follow each, and their value."""
    symbol = _BASE.searchsorted(value, "right") - 1
    return symbol, _EXTRA[symbol], value - _BASE[symbol]


@functools.cache
def _near_codes(width: int) -> np.ndarray:
    """The shortest distance code of each distance, 0 for those without one."""
    near = np.zeros(8 * width + 16, np.int64)
    for i in range(len(NEAR) - 1, -1, -1):
        x, y = NEAR[i]
        if x + y * width >= 1:
            near[x + y * width] = i + 1
    return near


def _coded(sample: np.ndarray, start: np.ndarray, width: int, opaque: np.ndarray) -> list[_Fields]:
    """Images of one channel, each with prefix codes by frequency and back-references; alpha is 255 or, if predicted, 0."""
    images = np.arange(len(start))
    begin, size, distance = _copies(sample, start)
    near = _near_codes(width)
    code = np.where(distance < len(near), near[np.minimum(distance, len(near) - 1)], 0)
    (long, long_extra, long_rest), (far, far_extra, far_rest) = _prefix(size), _prefix(np.where(code > 0, code, distance + len(NEAR)))
    step = np.zeros(len(sample) + 1, np.int8)
    step[begin] += 1
    step[begin + size] -= 1
    token = np.cumsum(step[:-1], dtype=np.int8) == 0
    token[begin] = True
    place = np.flatnonzero(token)
    symbol = sample[place].astype(np.int64)
    which = place.searchsorted(begin)
    symbol[which] = 256 + long
    of = np.repeat(images, np.diff(place.searchsorted(start), append=len(place)))
    symbol += _GREEN_SYMBOLS * of
    far += _DISTANCES * of[which]
    green = np.bincount(symbol, minlength=_GREEN_SYMBOLS * len(start)).reshape(-1, _GREEN_SYMBOLS)
    away = np.bincount(far, minlength=_DISTANCES * len(start)).reshape(-1, _DISTANCES)
    green, away = np.array([_lengths(n) for n in green]), np.array([_lengths(n) for n in away])
    (full, full_bits), (zero, zero_bits) = (_field(_ZERO, _ZERO, a) for a in (_FULL, _ZERO))
    between = images, np.where(opaque, full, zero), np.where(opaque, full_bits, zero_bits)
    out = [*_headers(green), between, *_headers(away)]
    green_words, away_words = _words(green).ravel(), _words(away).ravel()
    green[np.count_nonzero(green, 1) == 1] = 0
    away[np.count_nonzero(away, 1) == 1] = 0
    value, bits = green_words[symbol], green.ravel()[symbol]
    # A copy's symbol is followed by three more numbers.
    for v, b in ((long_rest, long_extra), (away_words[far], away.ravel()[far]), (far_rest, far_extra)):
        value[which] |= v << bits[which]
        bits[which] += b
    return [*out, (of, value, bits)]


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of a sample, on average, under the best code for such counts; a row is an image."""
    n = counts.sum(1)
    return np.log2(n) - (counts * np.log2(np.maximum(counts, 1))).sum(1) / n


def _differences(plane: np.ndarray, first: np.ndarray, mode: int) -> np.ndarray:
    """The images less their predictions from the left (1) or from above (2). ``first``: each image's first row."""
    out = plane.copy()
    if mode == 1:
        out[:, 1:] -= plane[:, :-1]
        out[1:, 0] -= plane[:-1, 0]
    else:
        out[1:] -= plane[:-1]
        out[first, 1:] = plane[first, 1:] - plane[first, :-1]
    out[first, 0] = plane[first, 0]
    return out


def _palette_form(plane: np.ndarray) -> list[np.ndarray]:
    """Places in a palette of the plane's values, with codes of equal length."""
    height, width = plane.shape
    seen = np.bincount(plane.ravel(), minlength=256) > 0
    values, place = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.uint8)[plane]
    packed = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1 if len(values) <= 16 else 0
    if packed:
        each = 8 >> packed
        place = np.pad(place, ((0, 0), (0, -width % (1 << packed)))).reshape(height, -1, 1 << packed)
        place = np.bitwise_or.reduce(place << (np.arange(1 << packed, dtype=np.uint8) * each), 2).astype(np.uint8)
    symbol = int(place.max()).bit_length()
    # The palette: no cache; green differences of 8 bits; alpha 255 once, then 0, as a code of two symbols.
    head = [_bit_array((1, 1), (3, 2), (len(values) - 1, 8), (0, 1)), _EQUAL[8]]
    head += [_bit_array(_ZERO, _ZERO, (1, 1), (1, 1), (0, 1), (0, 1), (255, 8), _ZERO)]
    steps = np.diff(values.astype(np.int16), prepend=0).astype(np.uint8)
    entries = np.empty((len(values), 9), np.uint8)
    entries[:, :8] = steps[:, None] >> np.arange(7, -1, -1, dtype=np.uint8) & 1
    entries[:, 8] = 0
    entries[0, 8] = 1
    # The pixels: no more transforms, no cache, one group of codes; green of ``symbol`` bits, nothing else.
    body = [_bit_array((0, 3)), _EQUAL[symbol], _bit_array(_ZERO, _ZERO, _FULL, _ZERO)]
    pixels = place.reshape(-1, 1) >> np.arange(symbol - 1, -1, -1, dtype=np.uint8) & 1
    return [*head, entries.ravel(), *body, pixels.astype(np.uint8).ravel()]


@functools.cache
def _predictor_head(mode: int) -> tuple[int, int]:
    """One prediction everywhere. Alpha is predicted as well, so nothing is left of it."""
    # The modes: an image of blocks of 512 pixels with one green value, the mode, and no other bits.
    only = ((1, 1), (0, 2), (7, 3), (0, 1), (1, 1), (0, 1), (1, 1), (mode, 8))
    return _field(*only, _ZERO, _ZERO, _FULL, _ZERO, (0, 3))


def encode(planes: list[np.ndarray]) -> list[bytes]:
    """Lossless WebP files whose green channels are the planes of 8-bit samples, opaque and black otherwise.

    The planes are of one width, of ``ROW`` samples or more. All are coded together: each array operation serves them all.
    """
    n, width, plane = len(planes), planes[0].shape[1], np.concatenate(planes)
    rows = np.array([len(p) for p in planes])
    first = np.cumsum(rows) - rows

    def counts(samples: np.ndarray) -> np.ndarray:
        value = np.repeat(np.arange(n) << 8, rows * width)
        value += samples.ravel()
        return np.bincount(value, minlength=n << 8).reshape(n, 256)

    plain, changed = counts(plane), [_differences(plane, first, mode) for mode in (1, 2)]
    left, above = (_entropy(counts(d)) for d in changed)
    modes = np.where(left <= above, 1, 2)
    predicted = np.flatnonzero(np.minimum(left, above) < PREDICTABLE * _entropy(plain))
    samples = [plane.ravel(), *(changed[modes[i] - 1][first[i] : first[i] + rows[i]].ravel() for i in predicted)]
    size = width * np.concatenate([rows, rows[predicted]])
    heads = np.array([(0, 3)] * n + [_predictor_head(int(m)) for m in modes[predicted]])
    coded = _coded(np.concatenate(samples), np.cumsum(size) - size, width, np.arange(len(size)) < n)
    words, word, bits = _packed([(np.arange(len(size)), *heads.T), *coded], len(size))
    data, forms = words.tobytes(), {i: [i] for i in range(n)}
    for i, form in zip(predicted.tolist(), range(n, len(size)), strict=True):
        forms[i].append(form)
    equal = size[:n] * np.ceil(np.log2(np.count_nonzero(plain, 1)))
    out = []
    for i, height in enumerate(rows.tolist()):
        best = min(forms[i], key=bits.__getitem__)
        form = data[4 * word[best] : 4 * word[best] + (bits[best] + 7 >> 3)]
        if equal[i] <= bits[i]:  # no code is shorter than the palette's bits alone
            palette = np.concatenate(_palette_form(planes[i]))
            if len(palette) < bits[best]:
                form = np.packbits(palette, bitorder="little").tobytes()
        stream = b"\x2f" + (width - 1 | height - 1 << 14).to_bytes(4, "little") + form
        chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
        out.append(b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk)
    return out


def payload_bytes(n: int) -> int:
    """The bytes of a payload that holds ``n``: a positive multiple of ``ROW``."""
    return max(ROW, n + -n % ROW)


def _plane(data: bytes) -> np.ndarray:
    """The data, padded with zeros; rows are twice as wide as often as the height needs it."""
    n, width = payload_bytes(len(data)), ROW
    while n > width * MOST_ROWS:
        width *= 2
    if width > MOST_ROWS:
        raise ValueError("the data are too long for one image")
    return np.frombuffer(data + bytes(n + -n % width - len(data)), np.uint8).reshape(-1, width)


def encode_payloads(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """An image for each that holds the data, padded with zeros."""
    planes: list[np.ndarray] = []
    size = 0
    for plane in map(_plane, payloads):
        if planes and (size + plane.size > TOGETHER or plane.shape[1] != planes[0].shape[1]):
            yield from encode(planes)
            planes, size = [], 0
        planes.append(plane)
        size += plane.size
    if planes:
        yield from encode(planes)


def encode_payload(data: bytes) -> bytes:
    """An image that holds the data, padded with zeros."""
    return next(encode_payloads([data]))


def decode_payloads(media: Iterable[bytes], sizes: Iterable[int]) -> Iterator[bytes]:
    """The padded payloads of so many bytes of data from their images."""
    files: list[bytes] = []
    ends: list[int] = []

    def read() -> Iterator[bytes]:
        for argb, n in zip(decode_all(files), ends, strict=True):
            yield (argb >> np.uint32(8)).astype(np.uint8).tobytes()[:n]

    for data, n in zip(media, map(payload_bytes, sizes), strict=True):
        if files and sum(ends) + n > TOGETHER:
            yield from read()
            files, ends = [], []
        files.append(data)
        ends.append(n)
    yield from read()


def decode_payload(media: bytes, n: int) -> bytes:
    """The padded payload of ``n`` bytes of data from its image."""
    return next(decode_payloads([media], [n]))


def store(docs: DataFrame) -> DataFrame:
    """``doc_id``, the text's ``n_bytes`` and its stored form ``media``."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            found = texts(batch.column(1))
            distinct = dict.fromkeys(found)
            media = dict(zip(distinct, encode_payloads(distinct), strict=True))
            columns = {
                "doc_id": batch.column(0).cast(pa.int64()),
                "n_bytes": pa.array([len(t) for t in found], pa.int64()),
                "media": pa.array([media[t] for t in found], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Digests of each stored form and of the payload read back from it, and a histogram of the samples in 16 bins."""

    def row(media: bytes, payload: bytes) -> tuple:
        bins = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
        return (
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-64:]),
            len(media),
            hashlib.sha256(media).hexdigest(),
            "-".join(map(str, bins.tolist())),
        )

    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            sizes, media = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = list(zip(*map(row, media, decode_payloads(media, sizes)), strict=True)) or [()] * len(names)
            made = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "n_bytes", *names])

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string"
    )
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), schema)
