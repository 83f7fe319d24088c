"""Lossless WebP: decoder and encoder, from the public bitstream specification.

Pixels are ``(height, width)`` arrays of 32-bit ARGB.  The decoder reads every
feature of the format: simple and normal prefix codes, several code groups,
back-references, the colour cache and the four transforms.  The encoder writes
shortest prefix codes, back-references, and, where they are estimated to save
bits, a colour cache and one transform.

Of a stream with one code group the decoder first takes, by array operations,
the pixel that a literal would give at *every* bit of a window and the bit after
it; following these from bit to bit then costs one lookup a pixel.
"""

from __future__ import annotations

import struct
from array import array
from functools import cache

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
LARGEST_SIDE = 1 << 14
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000


class WebpError(ValueError):
    """A stream that breaks the format."""


class Bits:
    """Reads numbers of up to 24 bits, lowest bit first, from the value at every bit of a window of the stream."""

    WINDOW = 1 << 13  # bytes

    def __init__(self, data: bytes):
        self.data, self.at, self.end, self.base, self.reach = data, 0, 8 * len(data), 0, 0

    def look(self) -> None:
        """Moves the window to the present place: ``ahead[i]`` and ``peek[i]`` are the 24 bits from ``base + i`` on."""
        first = self.at >> 3
        n = max(1, min(self.WINDOW, len(self.data) - first))
        raw = np.frombuffer(self.data[first : first + n + 16].ljust(n + 16, b"\0"), np.uint8).astype(np.uint32)
        four = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        self.ahead = ((four[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0xFFFFFF)).view(np.int32).ravel()
        self.peek = array("i", self.ahead.tobytes())
        self.base, self.reach = first << 3, (first + n) << 3

    def spot(self) -> int:
        """Where the present place lies in the window."""
        if not self.base <= self.at < self.reach:
            self.look()
        return self.at - self.base

    def read(self, n: int) -> int:
        spot = self.spot()
        found = self.peek[spot] & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise WebpError("the stream ends too early")
        return found


#: The 15 bits of every number turned round.
TURNED = np.zeros(1 << 15, np.int32)
for _k in range(15):
    TURNED |= (np.arange(1 << 15, dtype=np.int32) >> _k & 1) << (14 - _k)


@cache
def _turned(n: int) -> np.ndarray:
    """Every number of ``n`` bits, turned round."""
    return TURNED[: 1 << n] >> (15 - n)


class Code:
    """A canonical prefix code; a single symbol takes no bits.

    ``table`` holds ``symbol * 16 + bits`` for every value of the next ``longest`` bits.
    """

    def __init__(self, used: list[int], sizes: list[int]):
        if not used:
            raise WebpError("a prefix code without symbols")
        self.only = used[0] if len(used) == 1 else None
        if self.only is not None:
            self.longest, self.table, self.largest = 0, np.array([self.only << 4], np.int32), self.only
        else:
            longest = self.longest = max(sizes)
            entries = [e for _, e in sorted([(n, u << 4 | n) for u, n in zip(used, sizes, strict=True)])]
            shares = [1 << longest >> (e & 15) for e in entries]
            if sum(shares) != 1 << longest:
                raise WebpError("a prefix code that is not complete")
            self.table, self.largest = np.repeat(np.array(entries, np.int32), shares)[_turned(longest)], used[-1]
        self.mask, self.listed = (1 << self.longest) - 1, None

    def read(self, bits: Bits) -> int:
        if self.listed is None:
            self.listed = self.table.tolist()
        spot = bits.spot()
        found = self.listed[bits.peek[spot] & self.mask]
        bits.at += found & 15
        if bits.at > bits.end:
            raise WebpError("the stream ends too early")
        return found >> 4


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        found = [bits.read(8 if bits.read(1) else 1)]
        if two:
            found.append(bits.read(8))
        if max(found) >= size:
            raise WebpError("a symbol outside its alphabet")
        found = sorted(set(found))
        return Code(found, [1] * len(found))
    steps = [(CODE_LENGTH_ORDER[i], bits.read(3)) for i in range(4 + bits.read(4))]
    how = Code(*([list(c) for c in zip(*sorted(p for p in steps if p[1]), strict=True)] or [[], []]))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if left > size:
        raise WebpError("more code lengths than symbols")
    at, before, used, sizes = 0, 8, [], []
    listed, mask, spot = how.table.tolist(), how.mask, bits.spot()
    peek, reach = bits.peek, bits.reach - bits.base
    while at < size and left:
        left -= 1
        if spot >= reach:
            bits.at = bits.base + spot
            spot = bits.spot()
            peek, reach = bits.peek, bits.reach - bits.base
        ahead = peek[spot]
        found = listed[ahead & mask]
        s, n = found >> 4, found & 15
        if s < 16:
            spot += n
            if s:
                used.append(at)
                sizes.append(s)
                before = s
            at += 1
            continue
        ahead >>= n
        if s == 16:
            more, n = 3 + (ahead & 3), n + 2
            used += range(at, at + more)
            sizes += [before] * more
        else:
            more, n = (3 + (ahead & 7), n + 3) if s == 17 else (11 + (ahead & 127), n + 7)
        spot += n
        at += more
        if at > size:
            raise WebpError("more code lengths than symbols")
    bits.at = bits.base + spot
    if bits.at > bits.end:
        raise WebpError("the stream ends too early")
    return Code(used, sizes)


#: Code groups read before, by cache size and their first 128 bits: size, all bits, codes.
_READ: dict[tuple[int, int], tuple[int, int, list[Code]]] = {}
READ_AT_MOST = 64


def _read_group(bits: Bits, cache_bits: int) -> list[Code]:
    """The five codes of a group; writers that use one code for many images have it built once."""
    first, turn = bits.at >> 3, bits.at & 7
    begin = bits.at
    key = cache_bits, int.from_bytes(bits.data[first : first + 17], "little") >> turn & ((1 << 128) - 1)
    known = _READ.get(key)
    if known and begin + known[0] <= bits.end and int.from_bytes(bits.data[first : (begin + known[0] + 7) >> 3], "little") >> turn & ((1 << known[0]) - 1) == known[1]:
        bits.at += known[0]
        return known[2]
    codes = [_read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    n = bits.at - begin
    if n >= 128 and not known:
        if len(_READ) >= READ_AT_MOST:
            _READ.clear()
        _READ[key] = n, int.from_bytes(bits.data[first : (bits.at + 7) >> 3], "little") >> turn & ((1 << n) - 1), codes
    return codes


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


@cache
def _near_away(width: int) -> np.ndarray:
    """Distances in pixels of the codes for places nearby."""
    return np.array([max(1, x + y * width) for x, y in NEAR], np.int64)


class _Ahead:
    """What the symbol at every bit of the window would give, for one code group, and the bit after it."""

    def __init__(self, bits: Bits, group: list[Code], width: int, count: int):
        self.bits, self.group, self.width, self.base, self.reach = bits, group, width, 0, 0
        self.most = min(count, 1 << 20) * (1 + sum(c.longest for c in group[:4])) + 8

    def _look(self) -> None:
        bits, (green, red, blue, alpha, far) = self.bits, self.group
        low = bits.spot()
        self.base, self.reach = bits.at, min(bits.reach - bits.at, self.most)
        high = low + self.reach
        ahead, at = bits.ahead, np.arange(low, high, dtype=np.int32)
        found = green.table.take(ahead[low:high] & green.mask)
        symbol = found >> 4
        at += found & 15
        colour = symbol << 8
        other = np.flatnonzero(symbol > 255) if green.largest > 255 else at[:0]
        beyond = at[other]
        for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
            if code.only is not None:
                colour |= np.array(code.only << shift, np.uint32).view(np.int32)
            else:
                found = code.table.take(ahead.take(at) & code.mask)
                colour |= (found >> 4) << shift
                at += found & 15
        at -= low
        if len(other):
            symbol = symbol[other]
            copies = np.flatnonzero(symbol < 280)
            here = beyond[copies]
            length, here = self._number(symbol[copies] - 256, here)
            found = far.table[ahead[here] & far.mask]
            away, here = self._number(found >> 4, here + (found & 15))
            beyond[copies] = here
            near = _near_away(self.width)
            self.lengths, self.aways = length.tolist(), np.where(away > len(NEAR), away - len(NEAR), near[np.minimum(away, len(NEAR)) - 1]).tolist()
            which = symbol - 280  # a slot of the cache, or past all slots the number of a copy
            which[copies] = 2048 + np.arange(len(copies))
            at[other], colour[other] = low - beyond - 1, which
        self.after, self.colour = array("i", at.tobytes()), array("I", colour.tobytes())

    def _number(self, prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths or distances of prefix symbols whose extra bits begin at ``at``, and the bits after them."""
        extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
        return base + (self.bits.ahead[at] & ((1 << extra) - 1)) + 1, (at + extra).astype(np.int32)

    def run(self, out: list[int], count: int, held: list[int], shift: int) -> None:
        """Appends all pixels up to ``count``."""
        bits, caching, add = self.bits, shift < 32, out.append
        while len(out) < count:
            if bits.at > bits.end:
                raise WebpError("the stream ends too early")
            self._look()
            spot, reach, after, colour = 0, self.reach, self.after, self.colour
            left = count - len(out)
            while left > 0 and spot < reach:
                if not caching:
                    path = []
                    for _ in range(left):
                        if spot >= reach or (then := after[spot]) < 0:
                            break
                        path.append(spot)
                        spot = then
                    out += map(colour.__getitem__, path)
                    left -= len(path)
                    if not left or spot >= reach:
                        break
                then, argb = after[spot], colour[spot]
                if then >= 0:
                    left -= 1
                elif argb < 2048:
                    then, argb = -then - 1, held[argb]
                    left -= 1
                else:
                    length, away, at = self.lengths[argb - 2048], self.aways[argb - 2048], count - left
                    if away > at or length > left:
                        raise WebpError("a back-reference outside the image")
                    new = out[at - away : at - away + length]
                    if away < length:  # it reaches into what it writes
                        new = (new * (length // away + 1))[:length]
                    out += new
                    left -= length
                    if caching:
                        for argb in new:
                            held[(CACHE_FACTOR * argb & 0xFFFFFFFF) >> shift] = argb
                    spot = -then - 1
                    continue
                spot = then
                add(argb)
                if caching:
                    held[(CACHE_FACTOR * argb & 0xFFFFFFFF) >> shift] = argb
            bits.at = self.base + spot
        if bits.at > bits.end:
            raise WebpError("the stream ends too early")


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("a colour cache of too many bits")
    block, which, groups = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        which = (_image(bits, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False) >> 8) & 0xFFFF
        groups = int(which.max()) + 1
        which = which.tolist()
    codes = [_read_group(bits, cache_bits) for _ in range(groups)]
    count = width * height
    out, held, shift = [], [0] * (1 << cache_bits), 32 - cache_bits
    group = codes[0]
    if which is None:
        _Ahead(bits, group, width, count).run(out, count, held, shift)
    while len(out) < count:
        at = len(out)
        if which is not None:
            group = codes[which[(at // width) >> block][(at % width) >> block]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _value(bits, s - 256)
            away = _value(bits, group[4].read(bits))
            if away > len(NEAR):
                away -= len(NEAR)
            else:
                x, y = NEAR[away - 1]
                away = max(1, x + y * width)
            if away > at or at + length > count:
                raise WebpError("a back-reference outside the image")
            new = out[at - away : at - away + length]
            if away < length:  # it reaches into what it writes
                new = (new * (length // away + 1))[:length]
        else:
            new = [held[s - 280]]
        out += new
        if cache_bits:
            for argb in new:
                held[(CACHE_FACTOR * argb & 0xFFFFFFFF) >> shift] = argb
    return np.array(out, np.uint32).reshape(height, width)


def _split(argb: int) -> tuple[int, int, int, int]:
    return argb >> 24, argb >> 16 & 255, argb >> 8 & 255, argb & 255


def _join(c) -> int:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clip(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """Predicted pixel from its neighbours: left, top, top left and top right."""
    if mode == 11:
        parts = list(zip(_split(left), _split(top), _split(corner), strict=True))
        to_left, to_top = sum(abs(t - c) for _, t, c in parts), sum(abs(f - c) for f, _, c in parts)
        return left if to_left < to_top else top
    if mode == 12:
        return _join([_clip(f + t - c) for f, t, c in zip(_split(left), _split(top), _split(corner), strict=True)])
    if mode == 13:
        return _join([_clip(m + int((m - c) / 2)) for m, c in zip(_split(_mean(left, top)), _split(corner), strict=True)])
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: _mean(_mean(left, right), top), 6: lambda: _mean(left, corner),
        7: lambda: _mean(left, top), 8: lambda: _mean(corner, top), 9: lambda: _mean(top, right), 10: lambda: _mean(_mean(left, corner), _mean(top, right)),
    }.get(mode, lambda: BLACK)()


def predicted(out: list[int], at: int, width: int, mode: int) -> int:
    """Prediction for pixel ``at`` from those before it in ``out``."""
    y, x = divmod(at, width)
    if not y:
        return out[at - 1] if x else BLACK
    if not x:
        return out[at - width]
    return predict(mode, out[at - 1], out[at - width], out[at - width - 1], out[at - width + 1])


def add(a: int, b: int) -> int:
    """Sum of each channel modulo 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0xFF00FF) + (b & 0xFF00FF)) & 0xFF00FF


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    kinds = (modes >> 8) & 15
    if (kinds == 1).all() or (kinds == 2).all():  # left or top throughout: running sums of each channel
        sums = np.ascontiguousarray(pixels).view(np.uint8).reshape(height, width, 4).copy()
        sums[0, 0, 3] += 255
        along = int(kinds[0, 0])
        edge = sums[:, 0] if along == 1 else sums[0]
        edge[:] = np.cumsum(edge, axis=0, dtype=np.uint8)
        return np.cumsum(sums, axis=along % 2, dtype=np.uint8).reshape(height, -1).view(np.uint32)
    kinds, rest = kinds.tolist(), pixels.ravel().tolist()
    for at in range(len(rest)):
        mode = kinds[(at // width) >> block][(at % width) >> block]
        rest[at] = add(rest[at], predicted(rest, at, width, mode))
    return np.array(rest, np.uint32).reshape(height, width)


def spread(blocks: np.ndarray, block: int, shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << block, 0), 1 << block, 1)[: shape[0], : shape[1]]


def colour_delta(factor: np.ndarray, channel: np.ndarray) -> np.ndarray:
    return (factor.astype(np.uint8).view(np.int8).astype(np.int32) * channel.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5


def _undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    f = spread(factors, block, pixels.shape)
    green = (pixels >> 8) & 255
    red = (((pixels >> 16) & 255).astype(np.int32) + colour_delta(f & 255, green)) & 255
    blue = (pixels & 255).astype(np.int32) + colour_delta((f >> 8) & 255, green) + colour_delta((f >> 16) & 255, red)
    return (pixels & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << np.uint32(16) | (blue & 255).astype(np.uint32)


def _undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> 8) & 255
    return (pixels & np.uint32(0xFF00FF00)) | ((((pixels >> 16) + green) & 255) << np.uint32(16)) | ((pixels + green) & 255)


def _undo_palette(pixels: np.ndarray, table: np.ndarray, packed: int, width: int) -> np.ndarray:
    green = (pixels >> 8) & 255
    x = np.arange(width)
    each = 8 >> packed
    index = (green[:, x >> packed] >> ((x & ((1 << packed) - 1)) * each).astype(np.uint32)) & ((1 << each) - 1)
    full = np.zeros(256, np.uint32)  # an index past the table is transparent black
    full[: len(table)] = table
    return full[index]


def packing(colours: int) -> int:
    """Log of the palette indices in a byte."""
    return 0 if colours > 16 else 1 if colours > 4 else 2 if colours > 2 else 3


def _riff(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The VP8L chunk of the file that begins at ``at``, and where that file ends."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
        raise WebpError("not a WebP file")
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        raise WebpError("the file ends too early")
    spot, found = at + 12, None
    while spot + 8 <= end:
        size = struct.unpack_from("<I", data, spot + 4)[0]
        if spot + 8 + size > end:
            raise WebpError("a chunk reaches past the file")
        if data[spot : spot + 4] == b"VP8L" and found is None:
            found = data[spot + 8 : spot + 8 + size]
        spot += 8 + size + (size & 1)
    if found is None:
        raise WebpError("no lossless image")
    return found, end


def decode_stream(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise WebpError("not a lossless stream")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise WebpError("a version that is not known")
    undo, seen, own = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform given twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            side = lambda n, b=block: (n + (1 << b) - 1) >> b
            part = _image(bits, side(own), side(height), False)
            undo.append((_undo_predictor if kind == PREDICTOR else _undo_cross_colour, (part, block)))
        elif kind == SUBTRACT_GREEN:
            undo.append((_undo_subtract_green, ()))
        else:
            size = bits.read(8) + 1
            steps = _image(bits, size, 1, False)[0]
            table = np.cumsum(steps[:, None].view(np.uint8).reshape(size, 4), axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
            packed = packing(size)
            undo.append((_undo_palette, (table, packed, own)))
            own = (own + (1 << packed) - 1) >> packed
    pixels = _image(bits, own, height, True)
    for f, more in reversed(undo):
        pixels = f(pixels, *more)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """Pixels of one WebP file with a lossless image."""
    return decode_stream(_riff(data)[0])


def decode_all(data: bytes) -> list[np.ndarray]:
    """Pixels of each of several files, one after the other."""
    out, at = [], 0
    while at < len(data):
        stream, at = _riff(data, at)
        out.append(decode_stream(stream))
    return out


def riff(stream: bytes) -> bytes:
    odd = b"\0" * (len(stream) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(stream) + len(odd), b"WEBP", b"VP8L", len(stream)) + stream + odd


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a shortest prefix code for two or more ``counts``; they are halved until the longest word has at most ``limit`` bits."""
    n, counts = len(counts), counts.tolist()
    order = sorted(range(n), key=counts.__getitem__)
    leaves = [counts[k] for k in order]
    while True:
        weights, parent, leaf, node = leaves[:], [0] * (2 * n - 1), 0, n
        for top in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (node == top or weights[leaf] <= weights[node]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, node = node, node + 1
                total += weights[k]
                parent[k] = top
            weights.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            break
        leaves = [(c + 1) >> 1 for c in leaves]
    out = np.zeros(n, np.int64)
    out[order] = depth[:n]
    return out


def _words(sizes: np.ndarray) -> np.ndarray:
    """Canonical code words for symbols with ``sizes`` bits, first bit lowest."""
    order = np.argsort(sizes, kind="stable")
    shares = 1 << (15 - sizes[order])
    out = np.zeros(len(sizes), np.int64)
    out[order] = TURNED[(np.cumsum(shares) - shares) & 0x7FFF]
    return out


class _Out:
    """Numbers and their sizes in bits, in order."""

    def __init__(self):
        self.values, self.sizes, self.parts = [], [], []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts += [(np.array(self.values, np.int64), np.array(self.sizes, np.int64)), (values, sizes)]
        self.values, self.sizes = [], []

    def done(self) -> bytes:
        self.extend(np.zeros(0, np.int64), np.zeros(0, np.int64))
        values, sizes = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        there = sizes > 0
        values, sizes = values[there].astype(np.int32), sizes[there]
        which = np.repeat(np.arange(len(sizes)), sizes)
        nth = np.arange(len(which), dtype=np.int32) - (np.cumsum(sizes) - sizes).astype(np.int32).take(which)
        return np.packbits((values.take(which) >> nth & 1).astype(np.uint8), bitorder="little").tobytes()


@cache
def _common() -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sizes by channel, header (values, sizes) and words of codes for common text: small letters by rank, then other signs."""
    weight = np.ones(256, np.int64)
    weight[0x80:0xC0], weight[0xC2:0xC4], weight[48:58], weight[65:91], weight[10], weight[44], weight[46], weight[32] = 3, 24, 12, 12, 100, 100, 100, 2000
    for rank, sign in enumerate(b"eaitnosrludcmpghvbfqzkwyjx"):
        weight[sign] = 1600 >> rank // 4
    copies = np.concatenate([weight, np.repeat([60, 1], [12, 12])])
    counts = [copies, weight, weight, np.bincount([255], minlength=256), np.repeat([1, 2, 8, 2], 10)]
    out = _Out()
    codes = [_write_code(out, c) for c in counts]
    return [n for _, n in codes], np.array(out.values, np.int64), np.array(out.sizes, np.int64), [w for w, _ in codes]


def _write_codes(out: _Out, counts: list[np.ndarray], choose: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Writes shortest codes for ``counts`` by channel, or the common ones where shortest ones aren't ``WORTH`` it."""
    if choose and len(counts[0]) == 280 and counts[3][:255].sum() == 0:
        sizes, header, widths, words = _common()
        common = int(widths.sum()) + sum(int(c @ n) for c, n in zip(counts, sizes, strict=True))
        used = np.concatenate([c[c > 0] for c in (counts[0], counts[1], counts[2], counts[4])]).astype(np.float64)
        own = sum(n * np.log2(max(n, 1)) for n in (int(c.sum()) for c in (counts[0], counts[1], counts[2], counts[4]))) - (used * np.log2(used)).sum() + 5 * len(used)
        if own >= WORTH * common:
            out.extend(header, widths)
            return list(zip(words, sizes, strict=True))
    return [_write_code(out, c) for c in counts]


def _write_code(out: _Out, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the code for symbols that occur ``counts`` times; words and sizes by symbol."""
    used = np.flatnonzero(counts)
    words, sizes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if not len(used):
        used = np.zeros(1, np.int64)
    if len(used) <= 2 and int(used[-1]) < 256:
        first, last = int(used[0]), int(used[-1])
        out.put(1 | (len(used) - 1) << 1 | (first > 1) << 2, 3)
        out.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            out.put(last, 8)
            words[last], sizes[used] = 1, 1
        return words, sizes
    given = code_lengths(counts[used], 15) if len(used) > 1 else np.ones(1, np.int64)
    steps, before = [], -1  # symbol of the code of lengths, extra bits, their number
    runs: list[list[int]] = []  # first symbol, length, symbols in a row that have it
    for at, n in zip(used.tolist(), given.tolist(), strict=True):
        if runs and runs[-1][1] == n and runs[-1][0] + runs[-1][2] == at:
            runs[-1][2] += 1
        else:
            runs.append([at, n, 1])
    for at, n, times in [*runs, [len(counts), 0, 0]]:
        gap, before = at - before - 1, at + times - 1
        while gap >= 3:
            k = min(gap, 138 if gap > 10 else 10)
            steps.append((18, k - 11, 7) if k > 10 else (17, k - 3, 3))
            gap -= k
        steps += [(0, 0, 0)] * gap
        if times:
            steps.append((n, 0, 0))
            times -= 1
        while times >= 3:
            k = min(times, 6)
            steps.append((16, k - 3, 2))
            times -= k
        steps += [(n, 0, 0)] * times
    kinds = np.bincount([s for s, _, _ in steps], minlength=19)
    there, by = np.flatnonzero(kinds), np.zeros(19, np.int64)
    by[there] = code_lengths(kinds[there], 7) if len(there) > 1 else 1
    last = max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if by[s]))
    out.put((last - 4) << 1, 5)
    out.values += [int(by[s]) for s in CODE_LENGTH_ORDER[:last]]
    out.sizes += [3] * last
    out.put(0, 1)
    word = [0] * 19
    for s, w in zip(there.tolist(), _words(by[there]).tolist(), strict=True):
        word[s] = w
    length = by.tolist() if len(there) > 1 else [0] * 19
    out.values += [word[s] | extra << length[s] for s, extra, _ in steps]
    out.sizes += [length[s] + n for s, _, n in steps]
    if len(used) > 1:
        words[used], sizes[used] = _words(given), given
    return words, sizes


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distances, their extra bits and the number of these."""
    v = values.astype(np.int64) - 1
    n = np.maximum(np.frexp(v.astype(np.float64))[1] - 2, 0)  # bits below the first two
    return np.where(v < 4, v, 2 * (n + 1) + (v >> n & 1)), np.where(v < 4, 0, v & ((1 << n) - 1)), np.where(v < 4, 0, n)


LONGEST_COPY, SHORTEST_COPY = 4096, 3
WORTH = 0.4  #: a cache, a transform or codes of its own are used where they leave at most this share of the bits, as each takes time to read


def _copies(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and distance of back-references: three pixels or more that came before, at the latest place."""
    n = len(flat) - SHORTEST_COPY + 1
    if n < 2:
        return []
    p = flat.astype(np.uint64)
    key = p[:n] * np.uint64(0x9E3779B97F4A7C15) ^ p[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ p[2 : n + 2] * np.uint64(0x165667B19E3779F9)
    mask = np.uint64((1 << n.bit_length()) - 1)
    key = np.sort((key & ~mask) | np.arange(n, dtype=np.uint64))  # places in the low bits, so equal keys are in order
    order, key = (key & mask).astype(np.int64), key & ~mask
    same = np.flatnonzero(key[1:] == key[:-1])
    if not len(same):
        return []
    here, there = order[same + 1], order[same]
    sure = (flat[here] == flat[there]) & (flat[here + 1] == flat[there + 1]) & (flat[here + 2] == flat[there + 2])
    if not sure.any():
        return []
    away = np.zeros(n, np.int64)
    away[here[sure]] = (here - there)[sure]
    begins = np.flatnonzero((away > 0) & (away != np.concatenate([[0], away[:-1]])))
    ends = np.flatnonzero((away > 0) & (away != np.concatenate([away[1:], [0]])))
    found, at = [], 0
    for begin, end, distance in zip(begins.tolist(), ends.tolist(), away[begins].tolist(), strict=True):
        at, stop = max(at, begin), end + SHORTEST_COPY
        while stop - at >= SHORTEST_COPY:
            k = min(stop - at, LONGEST_COPY)
            found.append((at, k, distance))
            at += k
    return found


def _costs(choices: list[list[np.ndarray]]) -> list[float]:
    """Estimated bits of each choice of channels, under one code a channel, with some for the code itself; symbols are under 2048."""
    sizes = [sum(len(c) * np.log2(max(len(c), 1)) for c in channels) for channels in choices]
    flat = [c.astype(np.int32) + ((4 * i + k) << 11) for i, channels in enumerate(choices) for k, c in enumerate(channels)]
    counts = np.bincount(np.concatenate(flat), minlength=len(choices) << 13)
    there = np.flatnonzero(counts)
    counts = counts[there].astype(np.float64)
    saved = np.bincount(there >> 13, counts * np.log2(counts) - 5, len(choices))
    return [float(a - b) for a, b in zip(sizes, saved, strict=True)]


def _channels(flat: np.ndarray) -> list[np.ndarray]:
    """Green, red, blue and alpha, in the order of the stream."""
    return [flat >> np.uint32(k) & np.uint32(255) for k in (8, 16, 0, 24)]


@cache
def _near(width: int) -> dict[int, int]:
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def _write_image(out: _Out, flat: np.ndarray, width: int, main: bool) -> None:
    copies, count = _copies(flat), len(flat)
    colours = [c.astype(np.int64) for c in _channels(flat)]
    free = np.ones(count, bool)
    for at, n, _ in copies:
        free[at : at + n] = False
    literal, cache_bits = free, min(10, max(1, count.bit_length() - 3))
    slots = (flat * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
    order = np.argsort(slots.astype(np.uint16), kind="stable")
    held = np.zeros(count, bool)
    held[order[1:]] = flat[order[1:]] == flat[order[:-1]]  # equal colours share a slot, and the one before it in the slot is what it holds
    with_cache = free & ~held
    plain, cached = (c[free] for c in colours[:3]), [c[with_cache] for c in colours[1:3]]
    costs = _costs([plain, [np.where(held, 256 + slots.astype(np.int64), colours[0])[free], *cached]]) if main and 3 * np.count_nonzero(held & free) > 2 * np.count_nonzero(free) else [0, 0]
    if costs[1] < WORTH * costs[0]:
        literal = with_cache
        out.put(1, 1), out.put(cache_bits, 4)
    else:
        cache_bits = 0
        out.put(0, 1)
    if main:
        out.put(0, 1)
    first = free.copy()
    first[[at for at, _, _ in copies]] = True
    place = np.flatnonzero(first)
    rows = np.cumsum(first) - 1
    symbols = np.where(literal, colours[0], 280 + slots.astype(np.int64))[place]
    at = rows[[a for a, _, _ in copies]] if copies else np.zeros(0, np.int64)
    length, more, more_bits = _prefixed(np.array([n for _, n, _ in copies], np.int64))
    near = _near(width)
    distance, far, far_bits = _prefixed(np.array([near.get(d, d + len(NEAR)) for _, _, d in copies], np.int64))
    symbols[at] = 256 + length
    counts = [np.bincount(symbols, minlength=280 + (1 << cache_bits if cache_bits else 0))]
    counts += [np.bincount(c[literal], minlength=256) for c in colours[1:]]
    codes = _write_codes(out, [*counts, np.bincount(distance, minlength=40)], main)
    values, sizes = np.zeros((len(place), 4), np.int64), np.zeros((len(place), 4), np.int64)
    values[:, 0], sizes[:, 0] = codes[0][0][symbols], codes[0][1][symbols]
    lit = rows[literal]
    for k in (1, 2, 3):
        if codes[k][1].any():
            these = colours[k][literal]
            values[lit, k], sizes[lit, k] = codes[k][0][these], codes[k][1][these]
    if copies:
        values[at, 1:], sizes[at, 1:] = np.stack([more, codes[4][0][distance], far], 1), np.stack([more_bits, codes[4][1][distance], far_bits], 1)
    out.extend(values.ravel(), sizes.ravel())


def _difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a - b`` in each channel modulo 256."""
    return (np.ascontiguousarray(a).view(np.uint8) - np.ascontiguousarray(b).view(np.uint8)).view(np.uint32)


def _residual(pixels: np.ndarray, mode: int) -> np.ndarray:
    """What predictor 1 (left) or 2 (top) leaves."""
    guess = np.full_like(pixels, BLACK)
    guess[0, 1:], guess[1:, 0] = pixels[0, :-1], pixels[:-1, 0]
    guess[1:, 1:] = pixels[1:, :-1] if mode == 1 else pixels[:-1, 1:]
    return _difference(pixels, guess)


def _less_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    return _difference(pixels, green << np.uint32(16) | green)


def _smooth(pixels: np.ndarray) -> bool:
    """Whether green explains red, or a neighbour green, in part; else no difference of samples is worth a try."""
    green, red = ((pixels >> np.uint32(k) & np.uint32(255)).astype(np.float64) for k in (8, 16))
    green -= green.mean()
    red -= red.mean()
    spread = lambda a: np.einsum("ij,ij->", a, a)
    most = 0.9 * spread(green)
    return bool(spread(green - red) < 0.9 * spread(red) or spread(green[:, 1:] - green[:, :-1]) < most or (len(green) > 1 and spread(green[1:] - green[:-1]) < most))


def _factors(pixels: np.ndarray) -> int:
    """Cross-colour multipliers: the slopes of red and blue over green where green explains a quarter of them or more, else 0."""
    green, red, blue, _ = (c.ravel().astype(np.uint8).view(np.int8).astype(np.float64) for c in _channels(pixels))
    spread_of, found = green.var(), 0
    for channel, shift in ((red, 0), (blue, 8)):
        both = ((green - green.mean()) * (channel - channel.mean())).mean()
        if spread_of > 0 and both * both >= spread_of * channel.var() / 4:
            found |= (int(np.clip(round(32 * both / spread_of), -128, 127)) & 255) << shift
    return found


def _less_colour(pixels: np.ndarray, factors: int) -> np.ndarray:
    green, red, blue, alpha = _channels(pixels)
    new_red = (red.astype(np.int32) - colour_delta(np.uint32(factors & 255), green)) & 255
    new_blue = (blue.astype(np.int32) - colour_delta(np.uint32(factors >> 8 & 255), green)) & 255
    return alpha << np.uint32(24) | new_red.astype(np.uint32) << np.uint32(16) | green << np.uint32(8) | new_blue.astype(np.uint32)


BLOCK = 9  # log of the side of a block of the predictor and cross-colour images, the largest there is


def _transform(out: _Out, pixels: np.ndarray) -> np.ndarray:
    """Writes the transform that is estimated to leave the fewest bits, if any, and returns what is left."""
    height, width = pixels.shape
    blocks = -(-width >> BLOCK) * -(-height >> BLOCK), -(-width >> BLOCK)
    choices, flat = [(pixels, None, 0)], pixels.ravel()
    if _smooth(pixels):
        choices += [(_less_green(pixels), SUBTRACT_GREEN, 0), *((_residual(pixels, mode), PREDICTOR, mode << 8) for mode in (1, 2))]
        if factors := _factors(pixels):
            choices.append((_less_colour(pixels, factors), CROSS_COLOUR, factors))
    table = np.sort(flat)
    table = table[np.concatenate([[True], table[1:] != table[:-1]])]
    few = len(table) <= min(256, len(flat) // 4)
    if not few and len(choices) == 1:
        return pixels
    channels = [_channels(left.ravel())[:3] for left, _, _ in choices]
    if few:
        packed, index = packing(len(table)), np.searchsorted(table, flat).astype(np.uint32)
        index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % (1 << packed))))
        index = (index.reshape(height, -1, 1 << packed) << (np.arange(1 << packed) * (8 >> packed)).astype(np.uint32)).sum(axis=2, dtype=np.uint32)
        steps = _difference(table, np.concatenate([np.zeros(1, np.uint32), table[:-1]]))
        choices.append((index << np.uint32(8) | np.uint32(BLACK), PALETTE, 0))
        channels.append([index.ravel(), *_channels(steps)[:3]])
    costs = _costs(channels)
    costs[1:] = [c / WORTH for c in costs[1:]]
    best, kind, how = choices[costs.index(min(costs))]
    if kind is None:
        return best
    out.put(1, 1), out.put(kind, 2)
    if kind in (PREDICTOR, CROSS_COLOUR):
        out.put(BLOCK - 2, 3)
        _write_image(out, np.full(blocks[0], BLACK | how, np.uint32), blocks[1], False)
    elif kind == PALETTE:
        out.put(len(table) - 1, 8)
        _write_image(out, steps, len(table), False)
    return best


def encode(rgb: np.ndarray) -> bytes:
    """One file for opaque ``(height, width, 3)`` samples."""
    height, width, _ = rgb.shape
    if not 1 <= height <= LARGEST_SIDE or not 1 <= width <= LARGEST_SIDE:
        raise WebpError("a side of no or more than 16384 pixels")
    samples = rgb.astype(np.uint32)
    pixels = samples[..., 0] << np.uint32(16) | samples[..., 1] << np.uint32(8) | samples[..., 2] | np.uint32(BLACK)
    out = _Out()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        out.put(value, n)
    left = _transform(out, pixels)
    out.put(0, 1)
    _write_image(out, left.ravel(), left.shape[1], True)
    return riff(out.done())
