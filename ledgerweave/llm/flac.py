"""A media column: bytes as 8-bit mono FLAC, decoded again with all frame checks.

Frames of many rows are coded side by side in numpy, ``RUN`` at once, so that a
long row takes no more memory than its bytes and one run.  The encoder takes,
per frame, the shortest of a constant, verbatim, fixed-predictor (orders 0 to 4)
or linear-predictor subframe (order ``ORDER``), with one Rice partition or
``PARTS``.  The decoder finds frames by their sync codes, numbers and checks, so
that it needs no seek points and believes none; it also reads escapes, wasted
bits and frames of other sizes.  Every frame's CRC-8 and CRC-16 and the stream's
MD5 are verified.  Seek points only speed up ``samples_at``.

Defined results: null is the empty text; the payload is padded with bytes 32 to
a positive multiple of ``UNIT``; equal payloads have equal streams; a damaged
stream, or one that is not 8-bit mono, raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import documents

UNIT = 192
#: Samples in a frame: a multiple of UNIT with a code of its own in the header.
BLOCK = 1152
RATE = 8000
#: Frames that are coded at once.
RUN = 1024
#: Coefficients of the linear predictor, and their bits.
ORDER, PRECISION = 6, 12
#: Rice partitions of a frame, as the power of two that the stream says.
PART_POWER = 3
PARTS = 1 << PART_POWER
_SIGNED = bytes(b ^ 0x80 for b in range(256))
_SYNC = re.compile(rb"\xff[\xf8\xf9]")


@lru_cache(maxsize=4)
def _crc_powers(poly: int, bits: int, length: int) -> np.ndarray:
    """table[d, b]: what byte b adds to the CRC when d bytes follow it."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    base = np.zeros(256, np.int64)
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        base[b] = c
    out = np.empty((length, 256), np.uint16)
    out[0] = row = base
    for d in range(1, length):
        row = ((row << 8) & mask) ^ base[row >> (bits - 8)]
        out[d] = row
    return out


def _crc(flat: np.ndarray, start: np.ndarray, end: np.ndarray, poly: int, bits: int) -> np.ndarray:
    """CRC of each byte range flat[start : end] (none empty)."""
    size = end - start
    longest = 1 << int(size.max() - 1).bit_length() if len(size) and size.max() > 1 else 1
    table = _crc_powers(poly, bits, max(longest, 16))
    at = _ranges(start, size)
    left = np.repeat(end, size) - at - 1
    first = np.cumsum(size) - size
    return np.bitwise_xor.reduceat(table[left, flat[at]], first)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    out = np.repeat(start - (ends - size), size)
    out += np.arange(len(out))
    return out


def _coded_number(n: int) -> bytes:
    """The frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    lead = (0xFF << (8 - k)) & 0xFF if k < 7 else 0xFE
    return bytes([lead | (n >> (6 * (k - 1))), *(0x80 | ((n >> (6 * j)) & 0x3F) for j in range(k - 2, -1, -1))])


@lru_cache(maxsize=1 << 14)
def _frame_header(number: int, size: int) -> bytes:
    code = 3 if size == BLOCK else 7  # 576 * 2, or the size in 16 bits
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _coded_number(number) + (b"" if code == 3 else (size - 1).to_bytes(2, "big"))
    raw = np.frombuffer(head, np.uint8)
    return head + bytes([int(_crc(raw, np.array([0]), np.array([len(raw)]), 0x07, 8)[0])])


def _stream_head(samples: int, frames: list[int], md5: bytes) -> bytes:
    """Marker, STREAMINFO and a SEEKTABLE of every frame; frames: their sizes in bytes."""
    last = samples - (len(frames) - 1) * BLOCK
    least = BLOCK if len(frames) > 1 else last
    info = max(least, 16).to_bytes(2, "big") + max(least, 16).to_bytes(2, "big") + min(frames).to_bytes(3, "big") + max(frames).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + md5
    offset, points = 0, []
    for k, n in enumerate(frames):
        points.append((k * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, samples - k * BLOCK).to_bytes(2, "big"))
        offset += n
    points = points[: (1 << 24) // 18 - 1]
    table = b"".join(points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each payload (none empty)."""
    frames = -(-np.array([len(p) for p in payloads], np.int64) // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = _ranges(np.zeros(len(frames), np.int64), frames)
    coded: list[list[bytes]] = [[] for _ in payloads]
    for a in range(0, len(owner), RUN):
        own, at = owner[a : a + RUN].tolist(), number[a : a + RUN].tolist()
        parts = [payloads[i][k * BLOCK : (k + 1) * BLOCK] for i, k in zip(own, at)]
        x = np.zeros((len(parts), BLOCK), np.int32)
        for row, part in zip(x, parts):
            row[: len(part)] = np.frombuffer(part, np.uint8)
        x -= 128
        for i, raw in zip(own, _coded_frames(x, np.array([len(part) for part in parts]), at)):
            coded[i].append(raw)
    return [_stream_head(len(p), list(map(len, own)), hashlib.md5(p.translate(_SIGNED)).digest()) + b"".join(own) for p, own in zip(payloads, coded)]


class _Choice:
    """Zigzag residuals of all frames under one kind of predictor, and the cheapest Rice parameters for them."""

    def __init__(self, res: np.ndarray, order: np.ndarray, count: np.ndarray, head: np.ndarray):
        """order: samples that are kept as they are; head: bits before the residuals."""
        self.order, self.head = order, head
        at = np.arange(BLOCK)
        self.body = (at >= order[:, None]) & (at < count[:, None])
        self.coded = np.where(self.body, (res << 1) ^ (res >> 31), 0)
        one, k_one = self._parameters(1)
        full = count == BLOCK
        many, k_many = self._parameters(PARTS)
        self.parts = np.where(full & (many < one), PARTS, 1)
        self.cost = np.where(self.parts == 1, one, many) + head
        self.k = np.where((self.parts == 1)[:, None], k_one, k_many)

    def _parameters(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the residuals, and the parameter of each of ``PARTS`` partitions."""
        cells = self.coded.reshape(len(self.coded), parts, -1)
        n = self.body.reshape(cells.shape).sum(2)
        # the best parameter is beside the binary logarithm of the mean
        guess = np.log2(np.maximum(cells.sum(2, dtype=np.int64) / np.maximum(n, 1), 1)).astype(np.int32)
        best, chosen = None, None
        for step in (-1, 0, 1):
            k = np.clip(guess + step, 0, 14)
            bits = (cells >> k[:, :, None]).sum(2, dtype=np.int64) + n * (1 + k)
            if best is None:
                best, chosen = bits, k
            else:
                better = bits < best
                best, chosen = np.where(better, bits, best), np.where(better, k, chosen)
        return best.sum(1) + 4 * parts, np.broadcast_to(chosen, (len(chosen), parts)) if parts == PARTS else np.repeat(chosen, PARTS, 1)


def _fixed(x: np.ndarray, count: np.ndarray) -> _Choice:
    """The fixed predictor whose residuals are the smallest."""
    inside = np.arange(BLOCK) < count[:, None]
    cost, res = [], x
    for order in range(5):
        if order:
            res = np.diff(res, axis=1, prepend=0)
        size = np.abs(res)
        size[~inside] = 0
        size[:, :order] = 0
        cost.append(size.sum(1))
    order = np.stack(cost).argmin(0)
    res, out = x, x.copy()
    for o in range(1, 5):
        res = np.diff(res, axis=1, prepend=0)
        own = order == o
        out[own] = res[own]
    return _Choice(out, order, count, 14 + 8 * order)


def _linear(x: np.ndarray, count: np.ndarray) -> tuple[_Choice, np.ndarray, np.ndarray]:
    """Linear predictors by the autocorrelation method: the choice, the coefficients (frames, ORDER) and their shifts."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ft,ft->f", f[:, j:], f[:, : BLOCK - j]) for j in range(ORDER + 1)], 1).astype(np.float64)
    r[:, 0] = r[:, 0] * 1.0001 + 1
    a, error = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error *= 1 - k * k
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)), 0, 15).astype(np.int32)
    most = (1 << (PRECISION - 1)) - 1
    coef = np.clip(np.rint(a * (1 << shift)[:, None]), -most, most).astype(np.int32)
    guess = np.zeros((len(x), BLOCK - ORDER), np.int32)
    for j in range(ORDER):
        guess += coef[:, j, None] * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    res = x.copy()
    res[:, ORDER:] -= guess >> shift[:, None]
    order = np.full(len(x), ORDER)
    return _Choice(res, order, count, 14 + 8 * order + 9 + PRECISION * ORDER), coef, shift


def _coded_frames(x: np.ndarray, count: np.ndarray, number: list[int]) -> list[bytes]:
    """Whole frames, with header and checks."""
    fixed, (linear, coef, shift) = _fixed(x, count), _linear(x, count)
    inside = np.arange(BLOCK) < count[:, None]
    constant = ((x == x[:, :1]) | ~inside).all(1)
    cost = np.stack([np.where(constant, 0, 8 * count), fixed.cost, linear.cost])
    kind = cost.argmin(0)
    inner: list[bytes] = [b""] * len(x)
    for f in np.flatnonzero(kind == 0).tolist():
        own = x[f, : 1 if constant[f] else count[f]].astype(np.int8).tobytes()
        inner[f] = (b"\x00" if constant[f] else b"\x02") + own
    for which, choice in ((1, fixed), (2, linear)):
        rows = np.flatnonzero(kind == which)
        if len(rows):
            heads = []
            for f in rows.tolist():
                o = int(choice.order[f])
                head = (8 + o if which == 1 else 32 + o - 1) << 1
                for v in x[f, :o].tolist():
                    head = head << 8 | v & 0xFF
                if which == 2:
                    head = (head << 4 | PRECISION - 1) << 5 | int(shift[f])
                    for c in coef[f].tolist():
                        head = head << PRECISION | c & ((1 << PRECISION) - 1)
                heads.append(head << 6 | (PART_POWER if choice.parts[f] > 1 else 0))
            for f, raw in zip(rows.tolist(), _rice_bytes(choice, rows, count, heads)):
                inner[f] = raw
    body = [_frame_header(k, int(n)) + raw for k, n, raw in zip(number, count, inner)]
    size = np.array([len(b) for b in body])
    stop = np.cumsum(size)
    crc = _crc(np.frombuffer(b"".join(body), np.uint8), stop - size, stop, 0x8005, 16)
    return [b + int(c).to_bytes(2, "big") for b, c in zip(body, crc.tolist())]


def _rice_bytes(choice: _Choice, rows: np.ndarray, count: np.ndarray, heads: list[int]) -> list[bytes]:
    """Subframes: the head's bits, then by partition a parameter and the codes of its residuals, padded to bytes."""
    own, order, per = choice.body[rows], choice.order[rows], choice.body[rows].sum(1)
    value = choice.coded[rows][own]
    wide = (count // choice.parts)[rows]
    # samples at which a partition begins, by frame
    begins = np.arange(PARTS) * wide[:, None]
    begins = np.maximum(begins, order[:, None])[np.arange(PARTS) < choice.parts[rows][:, None]]
    which = np.repeat(np.arange(len(rows)), choice.parts[rows])
    firsts = np.cumsum(per) - per
    first = firsts[which] + begins - order[which]
    k = np.repeat(choice.k[rows][np.arange(PARTS) < choice.parts[rows][:, None]].astype(np.int32), np.diff(np.append(first, len(value))))
    q = value >> k
    length = q + 1 + k
    length[first] += 4
    head = choice.head[rows]
    size = -(-(np.add.reduceat(length, firsts, dtype=np.int64) + head) // 8)
    starts = np.cumsum(size) - size
    begin = np.cumsum(length, dtype=np.int64) - length
    begin += np.repeat(8 * starts + head - begin[firsts], per)
    bits = np.zeros(int(size.sum()) * 8, np.uint8)
    for j in range(4):
        bits[begin[first] + 3 - j] = (k[first] >> j) & 1
    stop = begin + q
    stop[first] += 4
    bits[stop] = 1
    for n in np.unique(k[k > 0]).tolist():  # the low bits of all codes with one parameter
        of = np.flatnonzero(k == n)
        place, low = stop[of], value[of]
        for j in range(n):
            bits[place + (n - j)] = (low >> j) & 1
    raw = np.packbits(bits).tobytes()
    out = []
    for a, n, h, value_of in zip(starts.tolist(), size.tolist(), head.tolist(), heads):
        pad = -h % 8
        top = (value_of << pad).to_bytes((h + pad) // 8, "big")
        out.append(top[:-1] + bytes([top[-1] | raw[a + len(top) - 1]]) + raw[a + len(top) : a + n])
    return out


class _Bits:
    """A reader of one lane, for headers."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        v = int.from_bytes(self.raw[a:b], "big") >> ((b << 3) - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v


class _Subframe:
    __slots__ = ("kind", "size", "order", "shift", "coef", "warm", "rice", "wasted", "escape", "at")


def _subframe(raw: bytes, at: int, size: int) -> _Subframe:
    """The head of a subframe; ``at`` is then the bit where samples or partitions begin."""
    b, s = _Bits(raw, at), _Subframe()
    if b.take(1):
        raise ValueError("subframe padding is set")
    code, s.wasted, s.size, s.order, s.shift, s.coef, s.rice = b.take(6), 0, size, 0, 0, None, None
    if b.take(1):
        s.wasted = 1
        while not b.take(1):
            s.wasted += 1
    depth = 8 - s.wasted
    if code == 0:
        s.kind, s.warm = "constant", [b.signed(depth)]
    elif code == 1:
        s.kind, s.warm = "verbatim", []
    elif 8 <= code <= 12 or code >= 32:
        s.kind = "predicted"
        s.order = code - 8 if code < 32 else code - 31
        s.warm = [b.signed(depth) for _ in range(s.order)]
        if code >= 32:
            precision = b.take(4) + 1
            s.shift = b.signed(5)
            s.coef = [b.signed(precision) for _ in range(s.order)]
        else:
            s.coef = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][s.order]
        method = b.take(2)
        if method > 1:
            raise ValueError("unknown residual coding")
        s.rice = (4 + method, b.take(4))
    else:
        raise ValueError("reserved subframe")
    s.at = b.at
    return s


class _Stream:
    """Where a stream's frames are: first byte, first byte after the header, end, first sample, samples."""

    def __init__(self, raw: bytes):
        self.raw = raw
        try:
            self._metadata()
        except IndexError as e:
            raise ValueError("the stream is cut off") from e

    def _metadata(self) -> None:
        raw = self.raw
        if raw[:4] != b"fLaC":
            raise ValueError("no stream marker")
        at, last, info, self.points = 4, False, None, []
        while not last:
            last, kind, n = bool(raw[at] & 0x80), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
            part = raw[at + 4 : at + 4 + n]
            if kind == 0:
                info = part
            elif kind == 3:
                self.points = [(int.from_bytes(part[k : k + 8], "big"), int.from_bytes(part[k + 8 : k + 16], "big")) for k in range(0, n - 17, 18)]
            at += 4 + n
        if info is None or len(info) != 34:
            raise ValueError("no stream information")
        word = int.from_bytes(info[10:18], "big")
        if word >> 41 & 7 or (word >> 36 & 31) != 7:
            raise ValueError("not 8-bit mono")
        self.begin, self.total, self.md5, self.block = at, word & ((1 << 36) - 1), info[18:34], int.from_bytes(info[:2], "big")

    def _header(self, a: int) -> tuple[int, int, int] | None:
        """(first sample, samples, first byte after the header) of a frame at byte a; None if there is none."""
        raw = self.raw
        try:
            code, rate, lead = raw[a + 2] >> 4, raw[a + 2] & 15, raw[a + 4]
            if raw[a] != 0xFF or raw[a + 1] & 0xFE != 0xF8 or not code or rate == 15 or raw[a + 3] & 0xF1 or raw[a + 3] >> 1 & 7 > 1 or 0x80 <= lead < 0xC0 or lead == 0xFF:
                return None
            width = 1 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length()
            number = lead if width == 1 else lead & ((1 << (7 - width)) - 1)
            for k in range(1, width):
                if raw[a + 4 + k] >> 6 != 2:
                    return None
                number = number << 6 | raw[a + 4 + k] & 0x3F
            h = a + 4 + width
            size = int.from_bytes(raw[h : h + 2], "big") + 1 if code == 7 else _block_size(code, raw[h])
            h += {6: 1, 7: 2}.get(code, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
            if _frame_header_crc(raw[a:h]) != raw[h]:
                return None
        except IndexError:
            return None
        return number if raw[a + 1] & 1 else number * self.block, size, h + 1

    def walk(self, at: int, careful: bool) -> Iterator[tuple[int, int, int, int, int]]:
        """Frames from byte ``at`` on.  A frame ends where the next sync has a header for the next sample; careful: and its check holds."""
        raw, head, expected = self.raw, self._header(at), None
        while True:
            if head is None or (expected is not None and head[0] != expected):
                raise ValueError("lost the frame sync")
            first, size, inner = head
            expected, end, head = first + size, len(raw), None
            if not self.total or expected < self.total:
                k = inner
                while m := _SYNC.search(raw, k):
                    k = m.start() + 1
                    found = self._header(m.start())
                    if found and found[0] == expected and not (careful and _one_crc(raw[at : m.start()])):
                        end, head = m.start(), found
                        break
            yield at, inner, end, first, size
            if end == len(raw):
                if self.total and expected < self.total:
                    raise ValueError("frames are missing")
                return
            at = end

    def frames(self) -> list[tuple[int, int, int, int, int]]:
        """All frames, their checks verified.  One whose bytes look like a next frame's header is found by the careful walk."""
        for careful in (False, True):
            try:
                found = list(self.walk(self.begin, careful))
                if all(not self._bad(found[a : a + RUN]) for a in range(0, len(found), RUN)):
                    return found
            except ValueError:
                if careful:
                    raise
        raise ValueError("frame check failed")

    def _bad(self, frames: list[tuple]) -> bool:
        a, z = frames[0][0], frames[-1][2]
        start, end = np.array([f[0] for f in frames]) - a, np.array([f[2] for f in frames]) - a
        return bool(_crc(np.frombuffer(self.raw[a:z], np.uint8), start, end, 0x8005, 16).any())


def _one_crc(raw: bytes) -> int:
    return int(_crc(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), 0x8005, 16)[0])


def _decoded(frames: list[tuple[bytes, int]]) -> list[bytes]:
    """Samples of some frames (bytes from the header's end on, samples), side by side."""
    flat = b"".join(raw for raw, _ in frames)
    subs, base = [], 0
    for raw, size in frames:
        sub = _subframe(raw, 0, size)
        sub.at += 8 * base
        subs.append(sub)
        base += len(raw)
    return [row[: s.size].tobytes() for s, row in zip(subs, _samples(np.frombuffer(flat, np.uint8), flat, subs))]


def blocks(streams: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(stream, sample offset, PCM) of every frame of all streams, in order; a run of frames is decoded at once."""
    run: list[tuple[int, int, bytes, int]] = []
    digests = {}

    def flush():
        try:
            decoded = _decoded([(raw, size) for _, _, raw, size in run])
        except IndexError as e:
            raise ValueError("the stream is cut off") from e
        for (i, first, _, _), samples in zip(run, decoded):
            stream, digest, _ = digests[i]
            digest.update(samples)
            digests[i][2] += len(samples)
            if digests[i][2] == stream.total and digest.digest() != stream.md5:
                raise ValueError("stream check failed")
            yield i, first, samples.translate(_SIGNED)

    for i, raw in enumerate(streams):
        stream = _Stream(raw)
        found = stream.frames()
        stream.total = stream.total or found[-1][3] + found[-1][4]
        if found[0][3] or found[-1][3] + found[-1][4] != stream.total:
            raise ValueError("stream check failed")
        digests[i] = [stream, hashlib.md5(), 0]
        for _, inner, end, first, size in found:
            run.append((i, first, raw[inner : end - 2] + bytes(8), size))
            if len(run) == RUN:
                yield from flush()
                run.clear()
    if run:
        yield from flush()


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads."""
    out = [bytearray() for _ in streams]
    for i, _, pcm in blocks(streams):
        out[i] += pcm
    return [bytes(x) for x in out]


def samples_at(raw: bytes, first: int, n: int) -> bytes:
    """n samples from one on.  A seek point is believed if a frame for its sample stands there; else frames are walked from the first on."""
    stream = _Stream(raw)
    at = stream.begin
    for sample, offset in stream.points:
        head = stream._header(stream.begin + offset) if sample <= first else None
        if head and head[0] == sample:
            at = max(at, stream.begin + offset)
    out, begin = b"", None
    for _, inner, end, place, size in stream.walk(at, True):
        if place + size > first:
            begin = place if begin is None else begin
            out += _decoded([(raw[inner : end - 2] + bytes(8), size)])[0]
        if place + size >= first + n:
            break
    return out.translate(_SIGNED)[first - (begin or 0) :][:n]


@lru_cache(maxsize=1 << 14)
def _frame_header_crc(head: bytes) -> int:
    raw = np.frombuffer(head, np.uint8)
    return int(_crc(raw, np.array([0]), np.array([len(raw)]), 0x07, 8)[0])


def _block_size(code: int, byte: int) -> int:
    if code == 6:
        return byte + 1
    return 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8)


def _samples(raw: np.ndarray, flat: bytes, subs: list[_Subframe]) -> list[np.ndarray]:
    """int8 samples of every subframe."""
    out: list[np.ndarray | None] = [None] * len(subs)
    lanes = []
    for k, s in enumerate(subs):
        if s.kind == "constant":
            out[k] = np.full(s.size, s.warm[0] << s.wasted, np.int8)
        elif s.kind == "verbatim":
            if s.wasted or s.at % 8:
                b = _Bits(flat, s.at)
                out[k] = np.array([b.signed(8 - s.wasted) << s.wasted for _ in range(s.size)], np.int8)
            else:
                out[k] = raw[s.at // 8 : s.at // 8 + s.size].view(np.int8)
        else:
            lanes.append(k)
    if lanes:
        residual = _residuals(raw, flat, [subs[k] for k in lanes], max(subs[k].size for k in lanes))
        for k, row in zip(lanes, _restore(residual, [subs[k] for k in lanes])):
            out[k] = row << subs[k].wasted if subs[k].wasted else row
    return out


def _restore(res: np.ndarray, subs: list[_Subframe]) -> np.ndarray:
    """res (samples, lanes) holds the residuals from each lane's order on; adds the predictions and returns int8 rows by lane."""
    order = np.array([s.order for s in subs])
    shift = np.array([s.shift for s in subs])
    if (shift < 0).any():
        raise ValueError("negative predictor shift")
    most = int(order.max())
    coef = np.zeros((most, len(subs)), res.dtype)  # of the sample most before, ..., of the one just before
    for k, s in enumerate(subs):
        res[: s.order, k] = s.warm
        if s.order:
            coef[most - s.order :, k] = s.coef[::-1]
    shift = shift.astype(res.dtype)
    for t in range(int(order[order > 0].min()) if most else len(res), len(res)):
        if t >= most:
            res[t] += (coef * res[t - most : t]).sum(0, dtype=res.dtype) >> shift
        else:
            guess = (coef[most - t :] * res[:t]).sum(0, dtype=res.dtype) >> shift
            res[t] += np.where(order <= t, guess, 0)
    return np.ascontiguousarray(res.T.astype(np.int8))


def _residuals(raw: np.ndarray, flat: bytes, subs: list[_Subframe], width: int) -> np.ndarray:
    """(samples, lanes), zero where a lane has none.  Each step decodes one Rice code of every lane."""
    n = len(subs)
    out = np.zeros((width, n), np.int32)
    at = np.array([s.at for s in subs], np.int64)
    size = np.array([s.size for s in subs])
    order = np.array([s.order for s in subs])
    bits = np.array([s.rice[0] for s in subs])
    part = np.array([s.size >> s.rice[1] for s in subs])
    padded = np.concatenate((raw, np.zeros(8, np.uint8))).astype(np.uint32)
    word = padded[:-4] << 24 | padded[1:-3] << 16 | padded[2:-2] << 8 | padded[3:-1]  # 32 bits from every byte on

    def peek(p, k):
        """k (25 at most) bits at each bit position."""
        return (word[p >> 3] << (p & 7).astype(np.uint32)) >> (32 - k).astype(np.uint32)

    lead = _leading_zeros()
    k = np.zeros(n, np.int64)
    escaped = np.full(n, -1, np.int64)
    boundary = order.copy()  # the sample at which the next partition begins
    index = np.arange(n)
    whole = bool((size == size[0]).all())
    uniform = whole and bool((part == size).all()) and bool((order == order[0]).all())
    for t in range(int(order.min()), width):
        live = index if whole else index[t < size]
        new = live[boundary[live] == t] if not uniform or t == order[0] else index[:0]
        if len(new):
            k[new] = peek(at[new], bits[new])
            at[new] += bits[new]
            escaped[new] = -1
            esc = new[k[new] == (1 << bits[new]) - 1]
            if len(esc):
                escaped[esc] = peek(at[esc], np.full(len(esc), 5))
                at[esc] += 5
            boundary[new] = np.where(t == order[new], part[new], boundary[new] + part[new])
        go = live if uniform else live[t >= order[live]]
        if escaped.any() and (escaped[go] >= 0).any():
            esc = go[escaped[go] >= 0]
            for lane in esc.tolist():
                b = _Bits(flat, int(at[lane]))
                out[t, lane] = b.signed(int(escaped[lane])) if escaped[lane] else 0
                at[lane] = b.at
            go = go[escaped[go] < 0]
        everyone = len(go) == n
        p, kk = (at, k) if everyone else (at[go], k[go])
        w = word[p >> 3] << (p & 7).astype(np.uint32)
        q = lead[w >> np.uint32(16)].astype(np.int64)
        long = np.flatnonzero(q + kk + 1 > 24)
        low = (w << (q + 1).astype(np.uint32)) >> np.maximum(32 - kk, 1).astype(np.uint32)
        value = (q << kk) | np.where(kk > 0, low, 0)
        step = q + 1 + kk
        for j in long.tolist():
            b = _Bits(flat, int(p[j]))
            zeros = 0
            while not b.take(1):
                zeros += 1
            value[j] = zeros << int(kk[j]) | b.take(int(kk[j]))
            step[j] = b.at - int(p[j])
        signed = (value >> 1) ^ -(value & 1)
        if everyone:
            out[t] = signed
            at += step
        else:
            out[t, go] = signed
            at[go] += step
    return out


@lru_cache(maxsize=1)
def _leading_zeros() -> np.ndarray:
    out = np.full(1 << 16, 32, np.uint8)
    for z in range(15, -1, -1):
        out[1 << (15 - z) : 1 << (16 - z)] = z
    return out


def payload(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def feature(samples: bytes) -> str:
    """Of the decoded samples: blocks, mean level, mean step between neighbours, sign changes around the mean."""
    x = np.frombuffer(samples, np.uint8)
    mean, steps, changes = x.mean(), 0, 0
    for a in range(0, len(x) - 1, 1 << 20):
        part = x[a : a + (1 << 20) + 1].astype(np.int16)
        side = part > mean
        steps += int(np.abs(np.diff(part)).sum(dtype=np.int64))
        changes += int((side[1:] != side[:-1]).sum())
    return f"{-(-len(x) // BLOCK)}:{mean:.3f}:{steps / (len(x) - 1):.3f}:{changes}"


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): every row's text as a stream."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1, 1 << 20):
                texts = b.column(1).cast(pa.binary()).to_pylist()
                sizes = pa.array([len(t or b"") for t in texts], pa.int64())
                streams = pa.array(encode([payload(t) for t in texts]), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), sizes, streams], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(streams: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, pcm): the decoded samples in blocks, to be read from any offset."""

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "block", "sample_offset", "pcm"])

        for whole in batches:
            for b in slices(whole, 1, 1 << 20):
                docs, rows = b.column(0).to_pylist(), []
                for i, first, pcm in blocks(b.column(1).to_pylist()):
                    rows.append((docs[i], first // BLOCK, first, pcm))
                    if len(rows) == RUN:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return streams.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, sample_offset long, pcm binary")


def described(streams: DataFrame) -> DataFrame:
    """Digests of what is read back from the stored streams, block by block, and features of it."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        for whole in batches:
            for b in slices(whole, 2, 1 << 20):
                stored, rows = b.column(2).to_pylist(), []
                docs, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
                for i, pcm in enumerate(decode(stored)):
                    s = stored[i]
                    rows.append((docs[i], sizes[i], len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-16:]), len(s), hashlib.sha256(s).hexdigest(), feature(pcm)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return streams.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op9_flac(spark, sf_dir: str) -> DataFrame:
    return described(media(documents(spark, sf_dir)))
