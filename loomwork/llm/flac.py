"""FLAC as a column: texts stored losslessly as 8-bit mono audio, checked, and read back as seekable PCM blocks.

The stored form is a plain FLAC stream: STREAMINFO, a SEEKTABLE with a point for every frame, and frames of 192 samples
with constant, verbatim, fixed-predictor or quantised linear-predictor subframes and Rice-coded residuals. The decoder also
takes predictors of other orders, several Rice partitions, 5-bit parameters, escaped partitions and streams without a seek
table. Streams of more than one channel or of other than 8 bits a sample are reported as errors, not read.

Within a task the frames of many rows are coded in step: the n-th sample of every frame at once, by numpy arrays.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_bytes, text_slices

BLOCK, RATE, PAD = 192, 8000, 32
#: Coefficients of the format's fixed predictors, by order.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: Order of the encoder's linear predictors, bits of a coefficient, and by how many bits a prediction is shifted.
ORDER, PRECISION, SHIFT = 4, 9, 6
LPC_BITS = 9 + ORDER * PRECISION


def _crc_table(bits: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = ((table << 1) ^ np.where(table >> (bits - 1) & 1, poly, 0)) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
LEADING = np.array([16 - int(i).bit_length() for i in range(1 << 16)], dtype=np.int64)
NUMBER_BYTES = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 8 + [5] * 4 + [6] * 2 + [7, 0], dtype=np.int64)


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans in step; the longest go first, so that those still open are a prefix."""
    order = np.argsort(-lengths, kind="stable")
    at, crc = starts[order], np.zeros(len(starts), dtype=np.int64)
    still = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
    for i, n in enumerate(still.tolist()):
        part = crc[:n]
        crc[:n] = ((part << 8) & 0xFFFF) ^ CRC16[(part >> 8) ^ data[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.insert(0, 0x80 | n & 63)
        n >>= 6
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *tail])


def _headers(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The frame headers of a stream up to a frame number, padded to one width, and their lengths."""
    rows, lengths = np.zeros((most + 1, 12), dtype=np.uint8), np.zeros(most + 1, dtype=np.int64)
    for n in range(most + 1):
        head = b"\xff\xf8\x14\x02" + _coded_number(n)
        crc = 0
        for byte in head:
            crc = int(CRC8[crc ^ byte])
        head += bytes([crc])
        rows[n, : len(head)], lengths[n] = np.frombuffer(head, dtype=np.uint8), len(head)
    return rows, lengths


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of each frame's linear predictor, by Levinson's recursion on exact autocorrelations, and the
    residuals of all samples but the first ORDER."""
    r = np.stack([(x[:, lag:].astype(np.int64) * x[:, : BLOCK - lag]).sum(axis=1) for lag in range(ORDER + 1)], axis=1).astype(np.float64)
    a, error = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for i in range(ORDER):
        left = r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)
        k = np.divide(left, error, out=np.zeros(len(x)), where=error > 0)
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error *= 1 - k * k
    half = 1 << (PRECISION - 1)
    q = np.clip(np.rint(a * (1 << SHIFT)), -half, half - 1).astype(np.int32)
    predicted = sum(q[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> SHIFT
    return q, x[:, ORDER:] - predicted


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of signed 8-bit ``samples`` (frames by BLOCK) one after another, and the length of each in bytes."""
    frames = len(samples)
    x = samples.astype(np.int32)
    best, cost, order = x, np.abs(x).sum(axis=1), np.zeros(frames, dtype=np.int64)
    best = best.copy()
    step = x
    for o in (1, 2):
        step = np.diff(step, axis=1)
        total = np.abs(step).sum(axis=1)
        better = total < cost
        best[better, o:] = step[better]
        cost, order = np.where(better, total, cost), np.where(better, o, order)
    coefs, left = _linear(x)
    total = np.abs(left).sum(axis=1)
    # a halved residual saves a bit a sample
    lpc = (BLOCK - ORDER) * np.log2((cost + 1) / (total + 1)) > LPC_BITS + 8 * (ORDER - order)
    best[lpc, ORDER:] = left[lpc]
    order[lpc] = ORDER
    u = ((best << 1) ^ (best >> 31)).astype(np.int64)
    for o in (1, 2, ORDER):
        u[order == o, :o] = 0
    extra = np.where(lpc, LPC_BITS, 0)
    count = BLOCK - order
    k0 = np.clip(np.log2(np.maximum(u.sum(axis=1) / count, 1)).astype(np.int64), 0, 14)
    bits = np.stack([(u >> k[:, None]).sum(axis=1) + count * (1 + k) for k in (np.maximum(k0 - 1, 0), k0)])
    k = np.where(bits[0] < bits[1], np.maximum(k0 - 1, 0), k0)
    bits = bits.min(axis=0)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (bits + 10 + extra + 8 * order >= 8 * BLOCK)
    coded = ~constant & ~verbatim

    rows, head_of = _headers(int(numbers.max(initial=0)))
    head = head_of[numbers]
    body = np.where(constant, 2, np.where(verbatim, 1 + BLOCK, 1 + order + (10 + extra + bits + 7) // 8))
    lengths = head + body + 2
    starts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())

    one = np.zeros(total * 8 + 1, dtype=np.uint8)
    c = np.flatnonzero(coded)
    if len(c):
        c = c[np.argsort(-k[c], kind="stable")]  # so that frames with a j-th remainder bit are a prefix
        uc, kc, oc = u[c], k[c][:, None], order[c]
        q = uc >> kc
        size = q + 1 + kc
        for o in (1, 2, ORDER):
            size[oc == o, :o] = 0
        first = (starts[c] + head[c] + 1 + oc) * 8 + extra[c]
        at = np.cumsum(size, axis=1) - size + (first + 10)[:, None] + q
        for o in (1, 2, ORDER):
            at[oc == o, :o] = total * 8  # warm-up samples have no code; what is put there falls beyond the end
        one[at] = 1
        for j in range(int(kc[0, 0])):
            n = int(np.searchsorted(-kc[:, 0], -j, side="left"))
            at[:n] += 1
            one[np.minimum(at[:n], total * 8, out=at[:n])] = (uc[:n] >> (kc[:n] - 1 - j)) & 1
        for j in range(4):
            one[first + 6 + j] = (kc[:, 0] >> (3 - j)) & 1
        w = np.flatnonzero(lpc[c])
        place = first[w] - LPC_BITS
        for value, width in ((np.full(len(w), PRECISION - 1), 4), (np.full(len(w), SHIFT), 5), *((coefs[c[w], j], PRECISION) for j in range(ORDER))):
            for j in range(width):
                one[place + j] = (value >> (width - 1 - j)) & 1
            place = place + width
    out = np.packbits(one[:-1])
    for i in range(rows.shape[1]):
        has = head > i
        out[(starts + i)[has]] = rows[numbers[has], i]
    sub = starts + head
    out[sub] = np.where(constant, 0, np.where(verbatim, 2, np.where(lpc, 31 + ORDER, 8 + order) << 1))
    raw = samples.view(np.uint8)
    out[sub[constant] + 1] = raw[constant, 0]
    if verbatim.any():
        out[(sub[verbatim] + 1)[:, None] + np.arange(BLOCK)] = raw[verbatim]
    for o in (1, 2, ORDER):
        for i in range(o):
            w = coded & (order == o)
            out[sub[w] + 1 + i] = raw[w, i]
    crc = crc16(out, starts, lengths - 2)
    out[starts + lengths - 2], out[starts + lengths - 1] = crc >> 8, crc & 0xFF
    return out, lengths


def stream(payload: bytes, frames: bytes, lengths: np.ndarray) -> bytes:
    """A whole FLAC stream around coded frames."""
    n, starts = len(lengths), np.cumsum(lengths) - lengths
    signed = np.frombuffer(payload, dtype=np.uint8) ^ np.uint8(128)
    info = struct.pack(">HH", BLOCK, BLOCK) + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed.tobytes()).digest()
    points = np.zeros(n, dtype=[("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
    points["sample"], points["offset"], points["count"] = np.arange(n) * BLOCK, starts, BLOCK
    table = points.tobytes()
    # the format holds lengths of up to 24 bits; a stream of more seek points is written without them
    seek = b"\x83" + len(table).to_bytes(3, "big") + table if len(table) < 1 << 24 else b""
    return b"fLaC" + (b"\x00" if seek else b"\x80") + len(info).to_bytes(3, "big") + info + seek + frames


class Bits:
    """Reads of up to 32 bits at many bit positions at once. ``data`` must end in 16 bytes of padding."""

    def __init__(self, data: np.ndarray):
        self.words = np.ndarray(shape=(len(data) - 8,), dtype=">u8", buffer=data, strides=(1,))
        self.last = (len(self.words) - 1) * 8

    def window(self, at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, self.last)
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def unsigned(self, at: np.ndarray, n) -> np.ndarray:
        n = np.asarray(n, dtype=np.uint64)
        return (self.window(at) >> np.uint64(1) >> (np.uint64(63) - n)).astype(np.int64)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        value, n = self.unsigned(at, n), np.asarray(n, dtype=np.int64)
        return value - np.where((n > 0) & (value >> np.maximum(n - 1, 0) & 1 == 1), np.int64(1) << n, 0)


def _rice(bits: Bits, at: np.ndarray, k: np.ndarray, n: int, out: np.ndarray) -> np.ndarray:
    """``n`` Rice codes from each position into the rows of ``out``; returns where they end."""
    ku = k.astype(np.uint64)
    for i in range(n):
        w = bits.window(at)
        q = LEADING[(w >> np.uint64(48)).astype(np.int64)]
        long = np.flatnonzero(q == 16)
        if len(long):
            where, more = long, at[long] + 16
            while len(where):
                z = LEADING[bits.unsigned(more, 16)]
                q[where] += z
                open_ = (z == 16) & (more < bits.last)
                where, more = where[open_], more[open_] + 16
            w[long] = bits.window(at[long] + q[long]) >> np.uint64(0)
            shift = q.copy()
            shift[long] = 0
        else:
            shift = q
        rest = (w << (shift + 1).astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - ku)
        u = (q << k) | rest.astype(np.int64)
        out[i] = (u >> 1) ^ -(u & 1)
        at = at + q + 1 + k
    return at


def decode_frames(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Frames that start at byte ``starts`` of ``data``: number, size, end, ok, and samples as rows padded to one width.

    ok: sync code, header and frame checksums hold and the frame uses what this decoder knows (mono, 8 bits).
    """
    limit = len(data) - 17
    bits, frames = Bits(data), len(starts)
    byte = lambda at: data[np.minimum(at, limit)].astype(np.int64)
    b2, b3 = byte(starts + 2), byte(starts + 3)
    ok = (byte(starts) == 0xFF) & (byte(starts + 1) == 0xF8) & (b3 >> 4 == 0) & np.isin(b3 >> 1 & 7, (0, 1)) & (b3 & 1 == 0)
    lead = byte(starts + 4)
    nbytes = NUMBER_BYTES[lead]
    ok &= nbytes > 0
    number = np.where(nbytes == 1, lead, lead & (0x7F >> np.maximum(nbytes, 1)))
    for j in range(1, 7):
        number = np.where(nbytes > j, number << 6 | byte(starts + 4 + j) & 63, number)
    at = starts + 4 + nbytes
    code = b2 >> 4
    size = np.where(code == 1, 192, np.where(code >= 8, 256 << np.maximum(code - 8, 0), 576 << np.clip(code - 2, 0, 3)))
    size = np.where(code == 6, byte(at) + 1, np.where(code == 7, (byte(at) << 8 | byte(at + 1)) + 1, size))
    at = at + (code == 6) + 2 * (code == 7)
    rate = b2 & 15
    at = at + (rate == 12) + 2 * ((rate == 13) | (rate == 14))
    ok &= code != 0
    crc = np.zeros(frames, dtype=np.int64)
    for i in range(int((at - starts).max(initial=0))):
        crc = np.where(starts + i < at, CRC8[crc ^ byte(starts + i)], crc)
    ok &= crc == byte(at)
    sub = at + 1
    head = byte(sub)
    kind = head >> 1
    ok &= (head & 1 == 0) & (head < 128) & ((kind <= 1) | ((kind >= 8) & (kind <= 12)) | (kind >= 32))
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    ok &= order < size
    samples = np.zeros((frames, int(size[ok].max(initial=0))), dtype=np.int32)
    end = sub + 1

    for i in np.flatnonzero(ok & (kind == 0)):
        samples[i, : size[i]] = np.int8(data[min(sub[i] + 1, limit)].astype(np.int8))
    end = np.where(kind == 0, sub + 2, np.where(kind == 1, sub + 1 + size, end))
    for n in np.unique(size[ok & (kind == 1)]):
        rows = np.flatnonzero(ok & (kind == 1) & (size == n))
        samples[rows, :n] = data[np.minimum((sub[rows] + 1)[:, None] + np.arange(n), limit)].view(np.int8)

    lpc = kind >= 32
    pos = (sub + 1 + order) * 8
    precision = np.where(lpc, bits.unsigned(pos, 4) + 1, 0)
    shift = np.where(lpc, bits.signed(pos + 4, 5), 0)
    coefs_at = pos + 9
    pos = np.where(lpc, pos + 9 + order * precision, pos)
    ok &= ~lpc | ((precision < 16) & (shift >= 0))
    method, parts = bits.unsigned(pos, 2), bits.unsigned(pos + 2, 4)
    predicted = ok & (kind >= 8)
    ok &= ~predicted | ((method < 2) & (size % (1 << parts) == 0) & (size >> parts >= order))
    predicted &= ok
    key = kind << 32 | size << 8 | method << 4 | parts
    for group in np.unique(key[predicted]):
        f = np.flatnonzero(predicted & (key == group))
        o, n, m, p = int(order[f[0]]), int(size[f[0]]), int(method[f[0]]), int(parts[f[0]])
        x = np.zeros((n, len(f)), dtype=np.int64)
        where, width = pos[f] + 6, 4 + m
        done = o
        for part in range(1 << p):
            k = bits.unsigned(where, width)
            where = where + width
            upto = (part + 1) * (n >> p)
            escaped = np.flatnonzero(k == (1 << width) - 1)
            plain = np.flatnonzero(k != (1 << width) - 1)
            if len(plain) == len(f):
                where = _rice(bits, where, k, upto - done, x[done:upto])
            else:
                got = np.zeros((upto - done, len(plain)), dtype=np.int64)
                where[plain] = _rice(bits, where[plain], k[plain], upto - done, got)
                x[done:upto, plain] = got
                raw = bits.unsigned(where[escaped], 5)
                w = where[escaped] + 5
                for i in range(done, upto):
                    x[i, escaped] = bits.signed(w, raw)
                    w = w + raw
                where[escaped] = w
            done = upto
        for i in range(o):
            x[i] = data[np.minimum(sub[f] + 1 + i, limit)].view(np.int8)
        if lpc[f[0]]:
            width = precision[f]
            coefs = [bits.signed(coefs_at[f] + i * width, width) for i in range(o)]
        else:
            coefs = FIXED[o]
        if o:
            by = shift[f]
            for i in range(o, n):
                x[i] += sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> by
        samples[f, :n] = x.T
        end[f] = (where + 7) >> 3
    inside = end + 2 <= limit + 1
    ok &= inside
    good = np.flatnonzero(ok)
    if len(good):
        ok[good] = crc16(data, starts[good], end[good] - starts[good]) == (byte(end[good]) << 8 | byte(end[good] + 1))
    return {"number": number, "size": size, "end": end + 2, "ok": ok, "samples": samples}


def _parse(media: bytes) -> dict:
    """What a stream's metadata says; ``frames`` is where its frames start."""
    if media[:4] != b"fLaC" or len(media) < 42:
        raise ValueError("not a FLAC stream")
    at, found = 4, {"points": None}
    while True:
        if at + 4 > len(media):
            raise ValueError("metadata is cut off")
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            if len(block) < 34:
                raise ValueError("STREAMINFO is cut off")
            packed = int.from_bytes(block[10:18], "big")
            found |= {"channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "total": packed & (1 << 36) - 1, "md5": block[18:34], "block": int.from_bytes(block[2:4], "big")}
        elif kind & 127 == 3:
            found["points"] = np.frombuffer(block[: len(block) // 18 * 18], dtype=[("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        at += 4 + size
        if kind & 128:
            break
    if (found.get("channels"), found.get("bits")) != (1, 8):
        raise ValueError("only 8-bit mono is read")
    return found | {"frames": at}


def decode_streams(media: list[bytes | None]) -> list[tuple[bytes | None, np.ndarray | None, str | None]]:
    """For each stream its bytes, its frames' (number, sample offset, byte offset, samples) rows, and what is wrong with it."""
    out: list = [(None, None, "null")] * len(media)
    heads, live, base, at = {}, [], {}, 0
    for i, m in enumerate(media):
        if m is None:
            continue
        try:
            heads[i] = _parse(m)
        except ValueError as error:
            out[i] = (None, None, str(error))
            continue
        live.append(i)
        base[i] = at
        at += len(m) + 16  # so that a damaged stream cannot be read on into the next one unnoticed
    data = np.zeros(at + 32, dtype=np.uint8)
    for i in live:
        data[base[i] : base[i] + len(media[i])] = np.frombuffer(media[i], dtype=np.uint8)
    chunks: dict[int, list] = {i: [] for i in live}
    wrong: dict[int, str] = {}

    tabled, rest = [], []
    for i in live:
        p = heads[i]["points"]
        whole = p is not None and len(p) and (p["sample"][0] == 0) and int(p["sample"][-1]) + int(p["count"][-1]) == heads[i]["total"] and (np.diff(p["sample"].astype(np.int64)) == p["count"][:-1]).all() and int(p["offset"].max()) < len(media[i])
        (tabled if whole else rest).append(i)
    if tabled:
        counts = [len(heads[i]["points"]) for i in tabled]
        starts = np.concatenate([heads[i]["points"]["offset"].astype(np.int64) + base[i] + heads[i]["frames"] for i in tabled])
        got = decode_frames(data, starts)
        to = 0
        for i, n in zip(tabled, counts):
            s = slice(to, to + n)
            to += n
            same = got["ok"][s].all() and (got["number"][s] == np.arange(n)).all() and (got["size"][s] == heads[i]["points"]["count"]).all() and int(got["end"][s][-1]) <= base[i] + len(media[i])
            if same:
                chunks[i] = [(got["number"][s], starts[s] - base[i], got["size"][s], got["samples"][s])]
            else:
                wrong[i] = "a frame fails its checks"
    open_ = {i: base[i] + heads[i]["frames"] for i in rest}
    turn = 0
    while open_:  # no seek table: where a frame ends is known once it is decoded, so streams go in step
        ids = list(open_)
        starts = np.array([open_[i] for i in ids], dtype=np.int64)
        got = decode_frames(data, starts)
        for r, i in enumerate(ids):
            if starts[r] >= base[i] + len(media[i]):
                del open_[i]
            elif not got["ok"][r] or got["number"][r] != turn or got["end"][r] > base[i] + len(media[i]):
                wrong[i] = "a frame fails its checks"
                del open_[i]
            else:
                chunks[i].append((got["number"][r : r + 1], starts[r : r + 1] - base[i], got["size"][r : r + 1], got["samples"][r : r + 1]))
                open_[i] = int(got["end"][r])
        turn += 1
    for i in live:
        if i in wrong:
            out[i] = (None, None, wrong[i])
            continue
        sizes = np.concatenate([c[2] for c in chunks[i]]) if chunks[i] else np.zeros(0, np.int64)
        pcm = [c[3][r, : c[2][r]] for c in chunks[i] for r in range(len(c[2]))] if len(set(sizes.tolist())) > 1 else [c[3][:, : int(sizes[0])].ravel() for c in chunks[i]] if len(sizes) else []
        signed = np.concatenate(pcm).astype(np.int8) if pcm else np.zeros(0, np.int8)
        if len(signed) != heads[i]["total"]:
            out[i] = (None, None, "samples are missing")
        elif any(heads[i]["md5"]) and hashlib.md5(signed.tobytes()).digest() != heads[i]["md5"]:
            out[i] = (None, None, "the samples' MD5 differs")
        else:
            table = np.stack([np.concatenate([c[0] for c in chunks[i]]), np.cumsum(sizes) - sizes, np.concatenate([c[1] for c in chunks[i]]), sizes], axis=1) if len(sizes) else np.zeros((0, 4), np.int64)
            out[i] = ((signed.view(np.uint8) ^ np.uint8(128)).tobytes(), table, None)
    return out


def encode_flac(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (of the text in UTF-8) and ``media``, a FLAC stream of the text padded with spaces to a
    positive multiple of 192 bytes.

    Null and empty texts give 192 spaces. Equal texts give equal streams. A row for every row, repeated or not; an empty
    table gives an empty result; further columns of ``df``, whatever their names, are left out.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            n = np.diff(offsets)
            frames = np.maximum(-(-n // BLOCK), 1)
            ends = np.cumsum(frames) * BLOCK
            padded = np.full(int(ends[-1]), PAD, dtype=np.uint8)
            padded[np.arange(len(raw)) + np.repeat(ends - frames * BLOCK - offsets[:-1], n)] = raw
            numbers = np.arange(int(frames.sum())) - np.repeat(np.cumsum(frames) - frames, frames)
            coded, lengths = encode_frames((padded ^ np.uint8(128)).view(np.int8).reshape(-1, BLOCK), numbers)
            upto = np.concatenate(([0], np.cumsum(lengths)))
            media, f = [], 0
            for i, k in enumerate(frames.tolist()):
                payload = padded[ends[i] - k * BLOCK : ends[i]].tobytes()
                media.append(stream(payload, coded[upto[f] : upto[f + k]].tobytes(), lengths[f : f + k]))
                f += k
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def features(payload: bytes) -> str:
    """Loudness, offset, zero crossings and peak of the samples, as text."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    n = max(len(x), 1)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum()) if len(x) else 0
    return f"rms={np.sqrt((x * x).sum() / n):.6f};mean={x.sum() / n:.6f};crossings={crossings};peak={int(np.abs(x).max(initial=0))}"


BLOCKS = T.ArrayType(T.StructType([*(T.StructField(c, T.LongType()) for c in ("block_no", "sample_offset", "byte_offset", "n_samples")), T.StructField("pcm", T.BinaryType())]), False)


def payload_of(blocks: Column) -> Column:
    """The bytes of all PCM blocks one after another."""
    return F.unhex(F.array_join(F.transform(blocks, lambda b: F.hex(b["pcm"])), ""))


def decode_flac(df: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of ``df`` with ``blocks``, the stream's PCM blocks in order, ``payload`` (their bytes), ``feature`` and
    ``error``.

    A block has its number, the ``sample_offset`` and ``byte_offset`` (in the stream) to seek by, ``n_samples``, and ``pcm``
    (unsigned 8-bit, as WAV files have it). Header and frame checksums, frame numbers, sample counts and the stream's MD5 are
    verified. A stream that fails, is empty or null, has null blocks, payload and feature, and ``error`` says why; it never
    fails the task. Equal and repeated rows have equal results, an empty table an empty one; streams are read whole. Of
    ``df``'s own columns, those with one of the four names are replaced.
    """
    kept = [c for c in df.columns if c not in ("blocks", "payload", "feature", "error")]
    fields = [df.schema[c] for c in kept] + [T.StructField("blocks", BLOCKS), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, media_col, 1 << 20):
            got = decode_streams(batch.column(media_col).to_pylist())
            good = [g for g in got if g[0] is not None]
            table = np.concatenate([np.zeros((0, 4), np.int64), *(g[1] for g in good)])
            # blocks follow each other in a stream's samples, and streams in a slice
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(table[:, 3])))
            pcm = pa.Array.from_buffers(pa.large_binary(), len(table), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(g[0] for g in good))]).cast(pa.binary())
            rows = pa.StructArray.from_arrays([*(pa.array(table[:, j]) for j in range(4)), pcm], [f.name for f in BLOCKS.elementType])
            upto = np.cumsum([0, *(len(g[1]) if g[0] is not None else 0 for g in got)])
            blocks = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rows, mask=pa.array([g[0] is None for g in got], pa.bool_()))
            more = [blocks, pa.array([None if g[0] is None else features(g[0]) for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], [f.name for f in fields])

    read = df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, T.StructType(fields))
    return read.withColumn("payload", payload_of(F.col("blocks")))


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for every frame: id, ``block_no``, ``sample_offset`` and ``byte_offset`` to seek by, ``n_samples`` and ``pcm``, as
    in ``decode_flac``. Streams that are null or fail their checks give none, repeated rows give theirs each; an empty table
    gives an empty result, and other columns of ``df``, whatever their names, are left out."""
    read = decode_flac(df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")))
    return read.select("id", F.explode("blocks").alias("b")).select(F.col("id").alias(id_col), "b.*")
