"""Media columns: FLAC streams of 8-bit mono samples, encoded and decoded for many rows at once.

Streams are stored as a table in the shared folder and read back from it, into PCM blocks with their sample offsets; what
is told of a text comes from those blocks.

Work goes in lockstep over frames: one numpy step handles one sample (or one checksum byte) of all frames of a chunk of
rows. Frames hold FRAME samples, the last of a stream the rest. A sample is a byte less CENTRE, the middle of what texts hold,
in the range of 8 bits. The encoder picks, for each frame, the cheapest of the constant, verbatim, fixed (orders
0 to 2) and linear-prediction forms, with Rice-coded residuals. The decoder reads any mono stream of up to 16 bits: every
block size, all predictor orders, Rice partitions and escape codes; it checks the CRC-8 of each header, the CRC-16 of each
frame and the MD5 of the samples. Seek points allow lanes to start inside a stream, and give PCM blocks their places.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, table

BLOCK, FRAME, RATE, LPC_ORDER, PRECISION = 192, 768, 8000, 2, 8
CENTRE, CHUNK = 104, 1 << 20
#: A seek table's length has 24 bits in the format: streams of more frames (690 MB) have a point for every few.
MAX_POINTS = 900_000
U64, I64 = np.uint64, np.int64


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, dtype=I64)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        out[i] = c
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), dtype=I64)
    for i in range(int(size.max(initial=0))):
        live = i < size
        crc = np.where(live, CRC8[crc ^ data[np.where(live, start + i, 0)]], crc)
    return crc


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    order = np.argsort(-size, kind="stable")
    crc, start, size = np.zeros(len(start), dtype=I64), start[order], size[order]
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i))  # lanes longer than i come first
        c = crc[:n]
        crc[:n] = (c << 8 & 0xFFFF) ^ CRC16[(c >> 8) ^ data[start[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# --- encoding ---------------------------------------------------------------------------------------------------------


def _number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8-like code: a (frames, 7) matrix of bytes and how many of them count."""
    size = np.searchsorted(np.array([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31]), n, side="right") + 1
    out = np.zeros((len(n), 7), dtype=I64)
    for k in range(1, 8):
        rows = size == k
        if rows.any():
            v = n[rows]
            lead = v if k == 1 else (0xFF << (8 - k) & 0xFF) | (v >> 6 * (k - 1))
            out[rows, 0] = lead
            for j in range(1, k):
                out[rows, j] = 0x80 | (v >> 6 * (k - 1 - j)) & 0x3F
    return out, size


def _pack(values: np.ndarray, sizes: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit fields of frames (a row each) as bytes, each frame from a byte on and with ``tail`` bytes left after it."""
    ends = np.cumsum(sizes, axis=1)
    length = (ends[:, -1] + 7) // 8 + tail
    start = np.concatenate([[0], np.cumsum(length)])
    last = (ends + start[:-1, None] * 8 - 1).ravel() + 32  # a spare word stands in front
    word = last >> 5
    bits = values.ravel().astype(U64) << (31 - (last & 31)).astype(U64)
    at = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    words = np.zeros(int(start[-1]) // 4 + 3, dtype=U64)
    words[word[at]] |= np.bitwise_or.reduceat(bits & U64(0xFFFFFFFF), at)
    words[word[at] - 1] |= np.bitwise_or.reduceat(bits >> U64(32), at)
    return words[1:].astype(">u4").view(np.uint8)[: start[-1]], start[:-1], length


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor of each frame (Levinson-Durbin on its autocorrelation): coefficients and shifts."""
    n = len(x)
    f = x.astype(np.float64)
    r = np.stack([(f[:, i:] * f[:, : x.shape[1] - i]).sum(axis=1) for i in range(order + 1)], axis=1)
    error, a = np.maximum(r[:, 0], 1e-9), np.zeros((n, order))
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    limit = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(limit / np.maximum(np.abs(a).max(axis=1), 1e-3))), 0, 15).astype(I64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit - 1, limit).astype(I64), shift


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of equally many signed samples (a row each) as bytes; the start and the length of each frame in them."""
    n, size = x.shape
    x = x.astype(I64)
    coef, shift = _lpc(x, LPC_ORDER)
    guess = sum(coef[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : size - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None]
    residuals = [x, np.diff(x, axis=1), np.diff(x, n=2, axis=1), x[:, LPC_ORDER:] - guess]
    orders = np.array([0, 1, 2, LPC_ORDER])
    extra = orders * 8 + np.array([0, 0, 0, 9 + LPC_ORDER * PRECISION])
    # bits of each form, with the best Rice parameter next to what the mean tells
    sums = np.stack([np.where(e >= 0, 2 * e, -2 * e - 1).sum(axis=1) for e in residuals], axis=1)
    mean = sums / (size - orders)
    k0 = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))), 0, 14).astype(I64)
    about = (size - orders) * (k0 + 1) + sums / (1 << k0) + extra
    form = about.argmin(axis=1)
    order = orders[form]
    u = np.zeros((n, size), dtype=I64)
    for i, e in enumerate(residuals):
        rows = form == i
        u[rows, orders[i] :] = np.where(e[rows] >= 0, 2 * e[rows], -2 * e[rows] - 1)
    coded = np.arange(size) >= order[:, None]
    tries = np.clip(k0[np.arange(n), form][:, None] + np.array([-1, 0, 1]), 0, 14)
    costs = np.stack([((u >> tries[:, i : i + 1]) * coded).sum(axis=1) + (size - order) * (tries[:, i] + 1) for i in range(3)], axis=1)
    k = tries[np.arange(n), costs.argmin(axis=1)]
    bits = costs.min(axis=1) + 6 + 4 + extra[form]
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (bits >= 8 * size)
    rice = ~constant & ~verbatim

    code, code_size = _number_bytes(number)
    # the block size stands behind the frame number, in 16 bits
    head = np.concatenate([np.broadcast_to(np.array([0xFF, 0xF8, 0x70, 0x02]), (n, 4)), code, np.zeros((n, 2), I64)], axis=1)
    head[np.arange(n), 4 + code_size], head[np.arange(n), 5 + code_size] = size - 1 >> 8, size - 1 & 0xFF
    head_size = 6 + code_size
    check = crc8(head.ravel(), np.arange(n) * head.shape[1], head_size)
    kind = np.select([constant, verbatim, form == 3], [0, 1, 32 + LPC_ORDER - 1], 8 + order) << 1
    is_lpc = rice & (form == 3)
    # columns: header, its checksum, subframe kind, predictor, residual head, samples
    low = 0xFF
    samples = np.where(rice[:, None] & coded, (u & ((1 << k) - 1)[:, None]) | (1 << k)[:, None], x & low)
    widths = np.where(rice[:, None] & coded, (u >> k[:, None]) + 1 + k[:, None], 8)
    widths[constant, 1:] = 0
    samples[constant, 1:] = 0
    pre = int(orders.max())
    fields = [(head, (np.arange(head.shape[1]) < head_size[:, None]) * 8), (check[:, None], 8), (kind[:, None], 8), (samples[:, :pre], np.where(rice[:, None] & (np.arange(pre) >= order[:, None]), 0, widths[:, :pre])),
              ((is_lpc * (PRECISION - 1))[:, None], is_lpc[:, None] * 4), ((shift * is_lpc)[:, None], is_lpc[:, None] * 5), ((coef & ((1 << PRECISION) - 1)) * is_lpc[:, None], np.broadcast_to(is_lpc[:, None] * PRECISION, coef.shape)),
              (np.zeros((n, 1), I64), rice[:, None] * 6), ((k * rice)[:, None], rice[:, None] * 4), (samples[:, :pre], np.where(rice[:, None] & (np.arange(pre) >= order[:, None]), widths[:, :pre], 0)), (samples[:, pre:], widths[:, pre:])]
    sizes = np.concatenate([np.broadcast_to(s, v.shape) for v, s in fields], axis=1).astype(I64)
    values = np.where(sizes > 0, np.concatenate([v for v, _ in fields], axis=1), 0)
    data, start, length = _pack(values, sizes, 2)
    total = crc16(data, start, length - 2)
    data[start + length - 2], data[start + length - 1] = total >> 8, total & 0xFF
    return data, start, length


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """FLAC streams of 8-bit payloads whose lengths are positive multiples of BLOCK: sample = byte - CENTRE, modulo 256."""
    if not payloads:
        return []
    signed = (np.concatenate(payloads) - np.uint8(CENTRE)).view(np.int8)
    total = np.array([len(p) for p in payloads])
    frames = -(-total // FRAME)
    first = np.concatenate([[0], np.cumsum(frames)])
    number = np.arange(first[-1]) - np.repeat(first[:-1], frames)
    size = np.minimum(np.repeat(total, frames) - number * FRAME, FRAME)
    begin = np.repeat(np.cumsum(total) - total, frames) + number * FRAME
    coded: list[bytes] = [b""] * len(size)
    for s in np.unique(size):
        of = np.flatnonzero(size == s)
        data, start, length = encode_frames(signed[begin[of][:, None] + np.arange(s)], number[of])
        raw = data.tobytes()
        for i, at, n in zip(of.tolist(), start.tolist(), length.tolist(), strict=True):
            coded[i] = raw[at : at + n]
    lengths = np.array([len(c) for c in coded])
    ends = np.cumsum(lengths)
    points = np.zeros(len(size), dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["sample"], points["offset"], points["n"] = number * FRAME, ends - lengths - np.repeat((ends - lengths)[first[:-1]], frames), size
    out = []
    for i, n in enumerate(frames):
        a, b = first[i], first[i + 1]
        pcm = signed[begin[a] : begin[a] + total[i]].tobytes()
        rate = (RATE << 44) | (7 << 36) | int(total[i])
        info = FRAME.to_bytes(2) * 2 + int(lengths[a:b].min()).to_bytes(3) + int(lengths[a:b].max()).to_bytes(3) + rate.to_bytes(8) + hashlib.md5(pcm).digest()
        seek = points[a : b : -(-int(n) // MAX_POINTS)].tobytes()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3) + seek + b"".join(coded[a:b]))
    return out


# --- decoding ---------------------------------------------------------------------------------------------------------


class _Bits:
    """Big-endian bit reads at many places of one buffer."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        n = len(data) + 8
        self.window = np.zeros(n, dtype=I64)
        for i in range(5):
            self.window |= self.data[i : i + n].astype(I64) << (8 * (4 - i))

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """``n`` (at most 32) bits from bit ``at`` on; places past the end read zeros."""
        at = np.minimum(at, 8 * len(self.window) - 8)
        return (self.window[at >> 3] >> (40 - (at & 7) - n)) & ((1 << np.asarray(n, dtype=I64)) - 1)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        v = self.peek(at, n)
        return v - ((v >> (np.maximum(n, 1) - 1) & 1) << n)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one bit."""
        v = self.peek(at, 32)
        zeros = 32 - np.frexp(v.astype(np.float64))[1].astype(I64)
        more = np.flatnonzero(v == 0)
        while len(more):
            if (at[more] + zeros[more] >= 8 * len(self.data)).any():
                raise ValueError("a residual runs past the end of its stream")
            w = self.peek(at[more] + zeros[more], 32)
            zeros[more] += 32 - np.frexp(w.astype(np.float64))[1].astype(I64)
            more = more[w == 0]
        return zeros


def decode_frames(bits: _Bits, start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One frame at each byte offset: samples (time first), block sizes, frame numbers and the offsets after the frames."""
    p = start * 8
    if (bits.peek(p, 15) != 0x7FFC).any():
        raise ValueError("no frame begins here")
    fixed_size = bits.peek(p + 15, 1) == 0
    size_code, rate_code, channel, depth_code = bits.peek(p + 16, 4), bits.peek(p + 20, 4), bits.peek(p + 24, 4), bits.peek(p + 28, 3)
    if (channel != 0).any():
        raise ValueError("only mono streams are read")
    p = p + 32
    lead = bits.peek(p, 8)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(more == 0, lead, lead & ((1 << np.maximum(6 - more, 0)) - 1))
    for j in range(int(more.max(initial=0))):
        number = np.where(j < more, number << 6 | bits.peek(p + 8 * (j + 1), 6 + 2) & 0x3F, number)
    p = p + 8 * (1 + more)
    size = np.select([size_code == 1, (size_code >= 2) & (size_code <= 5), size_code == 6, size_code == 7, size_code >= 8], [192, 576 << np.clip(size_code - 2, 0, 3), bits.peek(p, 8) + 1, bits.peek(p, 16) + 1, 256 << np.clip(size_code - 8, 0, 7)], 0)
    if (size == 0).any():
        raise ValueError("reserved block size")
    p = p + np.select([size_code == 6, size_code == 7], [8, 16], 0)
    p = p + np.select([rate_code == 12, (rate_code == 13) | (rate_code == 14)], [8, 16], 0)
    if (crc8(bits.data, start, p // 8 - start) != bits.peek(p, 8)).any():
        raise ValueError("CRC-8 of a frame header is wrong")
    p = p + 8
    depth = np.select([depth_code == 0, depth_code == 1, depth_code == 2, depth_code == 4], [depth, 8, 12, 16], 0)
    if (depth == 0).any():
        raise ValueError("only samples of 8, 12 or 16 bits, or as the stream says, are read")
    kind, wasted = bits.peek(p + 1, 6), bits.peek(p + 7, 1)
    if wasted.any():
        raise ValueError("wasted bits are not read")
    p = p + 8
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise ValueError("reserved subframe kind")
    order = np.select([fixed, lpc], [kind - 8, kind - 31], 0)
    most, n = int(size.max()), len(start)
    out = np.zeros((most, n), dtype=I64)
    for j in range(int(order.max(initial=0))):
        rows = j < order
        out[j] = np.where(rows, bits.signed(p, depth), 0)
        p = p + rows * depth
    coef, shift = np.zeros((int(order.max(initial=0)), n), dtype=I64), np.zeros(n, dtype=I64)
    for o, weights in enumerate(([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])):
        rows = fixed & (order == o)
        for j, w in enumerate(weights):
            if rows.any():
                coef[j, rows] = w
    precision = np.where(lpc, bits.peek(p, 4) + 1, 0)
    shift = np.where(lpc, bits.signed(p + 4, 5), 0)
    if (precision == 16).any() or (shift < 0).any():
        raise ValueError("reserved predictor precision or shift")
    p = p + lpc * 9
    for j in range(len(coef)):
        rows = lpc & (j < order)
        coef[j] = np.where(rows, bits.signed(p, np.maximum(precision, 1)), coef[j])
        p = p + rows * precision
    rice = fixed | lpc
    wide = np.where(rice, bits.peek(p, 2), 0)
    if (wide > 1).any():
        raise ValueError("reserved residual coding")
    parts = np.where(rice, bits.peek(p + 2, 4), 0)
    p = p + rice * 6
    span = size >> parts
    param, raw = np.zeros(n, dtype=I64), np.zeros(n, dtype=bool)
    raw_any, changes = False, bool((parts > 0).any())
    first = int(order.min(initial=0))
    value = bits.signed(p, depth)
    out[:, constant] = value[constant]
    p = p + constant * depth
    any_verbatim, all_full = bool(verbatim.any()), bool((size == most).all())
    max_order = len(coef)
    for t in range(most):
        live = rice & (t >= order) if all_full else rice & (t >= order) & (t < size)
        if any_verbatim:
            plain = verbatim & (t < size)
            out[t] = np.where(plain, bits.signed(p, depth), out[t])
            p = p + plain * depth
        if t < first:
            continue
        if t <= max_order or changes:
            fresh = live & ((t == order) | (t % span == 0))
            if fresh.any():
                width = 4 + wide
                if (fresh & (t == order) & (order == span) & (parts > 0)).any():  # an empty first partition
                    p = p + (fresh & (t == order) & (order == span) & (parts > 0)) * width
                param = np.where(fresh, bits.peek(p, width), param)
                p = p + fresh * width
                raw = np.where(fresh, param == (1 << width) - 1, raw)
                escape = fresh & raw
                if escape.any():
                    param = np.where(escape, bits.peek(p, 5), param)
                    p = p + escape * 5
                raw_any = bool(raw.any())
        code = live & ~raw if raw_any else live
        q = bits.unary(np.where(code, p, 0)) if not code.all() else bits.unary(p)
        u = q << param | bits.peek(p + q + 1, param)
        e = (u >> 1) ^ -(u & 1)
        step = q + 1 + param
        if raw_any:
            e = np.where(raw, np.where(param > 0, bits.signed(p, param), 0), e)
            step = np.where(raw, param, step)
        if max_order and t:
            guess = coef[0] * out[t - 1]
            for j in range(1, min(max_order, t)):
                guess += coef[j] * out[t - 1 - j]
            e = e + (guess >> shift)
        if live.all():
            out[t], p = e, p + step
        else:
            out[t] = np.where(live, e, out[t])
            p = p + live * step
    end = (p + 7) // 8
    if (end + 2 > len(bits.data) - 16).any() or (crc16(bits.data, start, end - start) != (bits.data[end].astype(I64) << 8 | bits.data[end + 1])).any():
        raise ValueError("CRC-16 of a frame is wrong")
    return out, size, np.where(fixed_size, number, -number - 1), end + 2


def _open(stream: bytes) -> tuple[dict, np.ndarray, int]:
    """Stream information, seek points and the place of the first frame."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, None, np.zeros((0, 2), dtype=I64)
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18])
            info = {"depth": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "rate": packed >> 44, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            table_ = np.frombuffer(body, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            table_ = table_[table_["sample"] != 0xFFFFFFFFFFFFFFFF]
            points = np.stack([table_["sample"].astype(I64), table_["offset"].astype(I64)], axis=1)
        at += 4 + size
    return info, points, at


def decode(streams: list[bytes], check_md5: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Signed samples of each stream and its frames as rows (sample offset, byte offset, samples).

    Each seek point starts a lane, which decodes frames up to the next one; a stream without points is one lane.
    """
    if not streams:
        return []
    opened = [_open(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    bits = _Bits(np.frombuffer(b"".join(streams), dtype=np.uint8))
    pos, stop, owner = [], [], []
    for i, (_, points, begin) in enumerate(opened):
        starts = np.unique(np.concatenate([[0], points[:, 1]])) + begin + base[i]
        starts = starts[starts < base[i + 1]]
        pos.append(starts)
        stop.append(np.append(starts[1:], base[i + 1]))
        owner.append(np.full(len(starts), i))
    pos, stop, owner = map(np.concatenate, (pos, stop, owner))
    depth = np.array([o[0]["depth"] for o in opened])
    found: list[list] = []
    lane, live = np.arange(len(pos)), pos < stop
    step = 0
    while live.any():
        lane, pos = lane[live], pos[live]
        out, size, _, end = decode_frames(bits, pos, depth[owner[lane]])
        found.append([lane, np.full(len(lane), step), pos, size, out])
        pos, live, step = end, end < stop[lane], step + 1
    result: list[tuple[np.ndarray, np.ndarray]] = []
    every_lane, every_step, every_pos, every_size = (np.concatenate([f[k] for f in found]) for k in range(4))
    order = np.lexsort((every_step, every_lane))
    bounds = np.searchsorted(owner[every_lane[order]], np.arange(len(streams) + 1))
    if len(found) == 1 and (every_size == len(found[0][4])).all():
        samples = np.ascontiguousarray(found[0][4].T).ravel()
    else:
        pieces = [out[: s, j] for _, _, _, size, out in found for j, s in enumerate(size)]
        samples = np.concatenate([pieces[j] for j in order])
    ends = np.concatenate([[0], np.cumsum(every_size[order])])
    for i, (info, _, _) in enumerate(opened):
        a, b = bounds[i], bounds[i + 1]
        part = samples[ends[a] : ends[b]]
        if len(part) != info["samples"]:
            raise ValueError("a stream has not as many samples as it says")
        if check_md5 and info["md5"] != bytes(16) and hashlib.md5(part.astype("<i1" if info["depth"] == 8 else "<i2").tobytes()).digest() != info["md5"]:
            raise ValueError("MD5 of the samples is wrong")
        result.append((part, np.stack([ends[a:b] - ends[a], every_pos[order[a:b]] - base[i], every_size[order[a:b]]], axis=1)))
    return result


# --- columns ----------------------------------------------------------------------------------------------------------


def padded(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Bytes 32 up to a positive multiple of ``block``."""
    size = max(1, -(-len(data) // block)) * block
    out = np.full(size, 32, dtype=np.uint8)
    out[: len(data)] = data
    return out


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square, zero crossings, peak and mean absolute step of signed samples."""
    s = samples.astype(np.int64)
    crossings = int(((s[1:] < 0) != (s[:-1] < 0)).sum())
    return f"mean={s.mean():.4f};rms={np.sqrt((s * s).mean()):.4f};zc={crossings};peak={int(np.abs(s).max())};step={np.abs(np.diff(s)).mean():.4f}"


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = tk.utf8(column)
    for a, b in tk.chunks(offsets, CHUNK):
        yield a, b, [data[offsets[i] : offsets[i + 1]] for i in range(a, b)]


def encode_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with a binary column ``media``: the FLAC stream of the padded UTF-8 bytes of each whole text.

    Null counts as empty; an empty text is one block of spaces. Equal texts give equal streams; an empty table stays
    empty; an input column of that name is replaced.
    """
    source = docs.drop(*[c for c in docs.columns if c.lower() == media.lower() and c != text])
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, rows in _chunks(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict({c: part.column(i) for i, c in enumerate(names)} | {media: pa.array(encode([padded(r) for r in rows]), type=pa.binary())})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields] + [f"`{media}` binary"]
    return source.mapInArrow(run, ", ".join(fields))


BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())]))


def decode_media(table_: DataFrame, media: str = "media", blocks: str = "blocks") -> DataFrame:
    """``table_`` with the PCM blocks of each stream in the place of ``media``: an array of (sample_offset, byte_offset, n_samples, pcm).

    ``pcm`` holds signed samples of 8 bits, or of 16 where the stream has more. A null stream has null blocks; a damaged one
    is an error, found by its checksums. A stream's blocks stay in its row, so nothing is shuffled.
    """
    keep = [c for c in table_.columns if c != media and c.lower() != blocks.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.pieces(batch, len(keep), CHUNK):
                streams = part.column(len(keep)).to_pylist()
                told = iter(decode([s for s in streams if s is not None]))
                out: list[list | None] = []
                for stream in streams:
                    if stream is None:
                        out.append(None)
                        continue
                    samples, frames = next(told)
                    width = 1 if samples.min(initial=0) >= -128 and samples.max(initial=0) <= 127 else 2
                    pcm = samples.astype(f"<i{width}").tobytes()
                    out.append([{"sample_offset": s, "byte_offset": at, "n_samples": n, "pcm": pcm[width * s : width * (s + n)]} for s, at, n in frames.tolist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(out, type=BLOCKS)], names=[*keep, blocks])

    fields = [f"`{c}` {table_.schema[c].dataType.simpleString()}" for c in keep] + [f"`{blocks}` array<struct<sample_offset:long,byte_offset:long,n_samples:long,pcm:binary>>"]
    return table_.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media}`")).mapInArrow(run, ", ".join(fields))


def pcm_blocks(table_: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row for each block of each stream: ``key, sample_offset, byte_offset, n_samples, pcm``, as ``decode_media`` tells them."""
    return decode_media(table_.select(key, media), media).select(key, F.inline("blocks"))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Store the stream of each whole text, read the stored streams into PCM blocks, and describe both; rows as in ``DIGEST``.

    Null counts as empty; repeated rows are streams of their own; an empty table gives an empty one.
    """
    stored = materialize(encode_media(docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))).drop("text"), "media")
    blocks = decode_media(stored.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            pcm, ends = column.flatten().field("pcm"), column.offsets.to_numpy() - column.offsets[0].as_py()
            data, at = tk.utf8(pcm)
            back = [data[at[a] : at[b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            payload = [(p + np.uint8(CENTRE)).tobytes() for p in back]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v) for v in (
                    np.array([len(p) for p in payload], dtype=np.int64), [hashlib.sha256(p).hexdigest() for p in payload], np.array([zlib.crc32(p[-16:]) for p in payload], dtype=np.int64))),
                    batch.column(2), batch.column(3), pa.array([feature(p.view(np.int8)) for p in back], pa.string())],
                names=[f.split()[0] for f in DIGEST.split(", ")],
            )

    return blocks.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, DIGEST)


def op4_flac_media(spark, sf_dir: str) -> DataFrame:
    """Every document's payload and stored stream, digested as read back, and features. A null or empty text is 192 blanks."""
    return media_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
