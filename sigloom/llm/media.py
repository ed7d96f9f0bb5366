"""Media columns: FLAC streams of one channel of 8-bit samples, in numpy.

Frames are coded and decoded side by side: a step handles one sample of every frame at hand. Streams carry a seek point for
each frame, so any frame can be decoded alone. Decoding reads Rice residuals, runs the linear predictors, and verifies each
header's CRC-8, each frame's CRC-16 and the stream's MD5.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.util import in_parts, small_batches

FRAME = 1152
ORDER = 4  # of the fitted predictor; fixed predictors have orders 0 and 1
PRECISION, SHIFT = 12, 9
#: Frames coded or decoded at once.
TOGETHER = 1024
#: Texts are padded with spaces to a positive multiple of so many bytes.
UNIT, PAD = 192, b"\x20"
SIGNED = np.bitwise_xor(np.arange(256), 128).astype(np.uint8)  # offset binary to two's complement
FIXED = {0: [0, 0, 0, 0], 1: [1, 0, 0, 0], 2: [2, -1, 0, 0], 3: [3, -3, 1, 0], 4: [4, -6, 4, -1]}


def crc_table(poly: int, width: int, distances: int) -> np.ndarray:
    """What a byte adds to the CRC when so many bytes follow it: distances x 256."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    c = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        c = np.where(c & top, (c << 1) ^ poly, c << 1) & mask
    rows = [c]
    for _ in range(distances - 1):
        last = rows[-1]
        rows.append(((last << 8) & mask) ^ c[last >> (width - 8)])
    return np.array(rows, dtype=np.uint16)


CRC8 = crc_table(0x07, 8, 16)
CRC16 = crc_table(0x8005, 16, FRAME + 64)


def crcs(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC of data[start:end] for each pair; none is empty."""
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(firsts, sizes)
    parts = table[np.repeat(sizes, sizes) - 1 - at, data[np.repeat(starts, sizes) + at]]
    return np.bitwise_xor.reduceat(parts, firsts)


def coded_number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        lead >>= 1
    return bytes([(0xFF ^ (lead * 2 + 1)) | n, *reversed(tail)])


def frame_header(number: int, size: int) -> bytes:
    body = bytes([0xFF, 0xF8, 0x30 if size == FRAME else 0x70, 0x02]) + coded_number(number)
    return body if size == FRAME else body + (size - 1).to_bytes(2, "big")


def put(bits: np.ndarray, values: np.ndarray, at: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (values >> (width - 1 - j)) & 1


def rice(residual: np.ndarray, used: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag codes, the best Rice parameter and the number of bits, for each frame."""
    u = ((residual << 1) ^ (residual >> 31)) * used
    mean = u.sum(axis=1) / np.maximum(counts, 1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 14).astype(np.int32)
    best, k_best = None, None
    for step in (-1, 0):
        k = np.clip(guess + step, 0, 14)
        size = (u >> k[:, None]).sum(axis=1) + counts * (1 + k)
        k_best = k if best is None else np.where(size < best, k, k_best)
        best = size if best is None else np.minimum(size, best)
    return u, k_best, best


def fitted(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of the linear predictor for each frame, by least squares on the autocorrelation."""
    f = x.astype(np.float32)
    lags = np.stack([np.einsum("ft,ft->f", f[:, k:], f[:, : f.shape[1] - k]) for k in range(ORDER + 1)], axis=1).astype(np.float64)
    matrix = lags[:, np.abs(np.subtract.outer(np.arange(ORDER), np.arange(ORDER)))]
    matrix += np.eye(ORDER) * (lags[:, :1, None] * 1e-5 + 1)
    solved = np.linalg.solve(matrix, lags[:, 1:, None])[:, :, 0]
    return np.clip(np.rint(solved * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)


def code_frames(frames: list[bytes], numbers: list[int]) -> list[bytes]:
    """Coded frames; each takes the smallest of its verbatim, constant, fixed and fitted forms."""
    sizes = np.array([len(f) for f in frames])
    n, most = len(frames), int(sizes.max())
    raw = np.frombuffer(b"".join(f + f[-1:] * (most - len(f)) for f in frames), dtype=np.uint8).reshape(n, most)
    x = raw.astype(np.int32) - 128
    inside = np.arange(most) < sizes[:, None]
    coef = fitted(np.where(inside, x, 0))
    choices = []
    for order, c in ((0, None), (1, None), (ORDER, coef)):
        residual = x.copy()
        if order == 1:
            residual[:, 1:] -= x[:, :-1]
        elif c is not None:
            guess = np.zeros_like(x[:, order:])
            for i in range(order):
                guess += c[:, i : i + 1] * x[:, order - 1 - i : most - 1 - i]
            residual[:, order:] -= guess >> SHIFT
        used = inside.astype(np.int32)
        used[:, :order] = 0
        u, k, bits = rice(residual, used, np.maximum(sizes - order, 0))
        extra = 8 * order + 10 + (9 + PRECISION * order if c is not None else 0)
        choices.append((order, u, k, bits + extra, used))
    cost = np.stack([sizes * 8, *(c[3] for c in choices)], axis=1)
    form = cost.argmin(axis=1)
    constant = (raw == raw[:, :1]).all(axis=1)
    body_bits = np.where(constant, 8, cost[np.arange(n), form]) + 8
    headers = [frame_header(number, int(size)) for number, size in zip(numbers, sizes)]
    head = np.array([len(h) + 1 for h in headers])
    total = head + (body_bits + 7) // 8 + 2
    starts = np.cumsum(total) - total
    bits = np.zeros(int(total.sum()) * 8, dtype=np.uint8)
    at = (starts + head) * 8
    kinds = np.where(constant, 0, np.select([form == 0, form == 1, form == 2], [1, 8, 9], 32 + ORDER - 1))
    put(bits, kinds << 1, at, 8)
    at = at + 8
    put(bits, x[constant, 0] & 255, at[constant], 8)
    verbatim = ~constant & (form == 0)
    if verbatim.any():
        cells = np.nonzero(inside & verbatim[:, None])
        put(bits, x[cells] & 255, at[cells[0]] + cells[1] * 8, 8)
    for choice, (order, u, k, _, used) in enumerate(choices, 1):
        rows = np.flatnonzero(~constant & (form == choice))
        if not len(rows):
            continue
        where = at[rows]
        for i in range(order):
            put(bits, x[rows, i] & 255, where, 8)
            where = where + 8
        if order == ORDER:
            put(bits, np.full(len(rows), ((PRECISION - 1) << 5) | SHIFT), where, 9)
            where = where + 9
            for i in range(ORDER):
                put(bits, coef[rows, i] & ((1 << PRECISION) - 1), where, PRECISION)
                where = where + PRECISION
        put(bits, k[rows], where + 6, 4)  # method 0 and partition order 0 are zeros before
        where = where + 10
        kk = k[rows][:, None]
        q = u[rows] >> kk
        ends = np.cumsum((q + 1 + kk) * used[rows], axis=1) + where[:, None]
        mask = used[rows] == 1
        k_flat, end_flat, u_flat = np.broadcast_to(kk, q.shape)[mask], ends[mask], u[rows][mask]
        bits[end_flat - k_flat - 1] = 1
        for j in range(int(k[rows].max())):
            some = k_flat > j
            bits[end_flat[some] - 1 - j] = (u_flat[some] >> j) & 1
    data = np.packbits(bits)
    for i, h in enumerate(headers):
        data[starts[i] : starts[i] + len(h)] = np.frombuffer(h, dtype=np.uint8)
    data[starts + head - 1] = crcs(CRC8, data, starts, starts + head - 1)
    check = crcs(CRC16, data, starts, starts + total - 2)
    data[starts + total - 2], data[starts + total - 1] = check >> 8, check & 255
    whole = data.tobytes()
    return [whole[s : s + t] for s, t in zip(starts.tolist(), total.tolist())]


def stream_of(payload: bytes, frames: list[bytes], rate: int = 8000) -> bytes:
    sizes = [len(f) for f in frames]
    blocks = [min(FRAME, len(payload) - s) for s in range(0, len(payload), FRAME)]
    signed = np.frombuffer(payload, dtype=np.uint8) ^ 128
    least, most = min(max(16, FRAME), len(payload)), min(FRAME, len(payload))
    info = least.to_bytes(2, "big") + most.to_bytes(2, "big") + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((rate << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(signed.tobytes()).digest()
    points, at = [], 0
    for i, (size, block) in enumerate(zip(sizes, blocks)):
        points.append((i * FRAME).to_bytes(8, "big") + at.to_bytes(8, "big") + block.to_bytes(2, "big"))
        at += size
    table = b"".join(points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of unsigned 8-bit samples; none is empty."""
    frames = [(i, n, p[s : s + FRAME]) for i, p in enumerate(payloads) for n, s in enumerate(range(0, len(p), FRAME))]
    coded: list[list[bytes]] = [[] for _ in payloads]
    for at in range(0, len(frames), TOGETHER):
        part = frames[at : at + TOGETHER]
        for (i, _, _), out in zip(part, code_frames([f for _, _, f in part], [n for _, n, _ in part])):
            coded[i].append(out)
    return [stream_of(p, c) for p, c in zip(payloads, coded)]


def seek_points(stream: bytes) -> tuple[list[tuple[int, int, int]], int, bytes]:
    """(first sample, start, samples) of each frame, the number of samples and the MD5, from the stream's metadata."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, info = 4, False, [], b""
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if (packed >> 36) & 31 != 7 or (packed >> 41) & 7:
        raise ValueError("only one channel of 8-bit samples is read")
    samples = packed & ((1 << 36) - 1)
    if sum(p[2] for p in points) != samples:
        raise ValueError("a seek point for each frame is needed")
    return [(first, at + offset, count) for first, offset, count in points], samples, info[18:34]


def decode_frames(frames: list[bytes], sizes: list[int]) -> list[bytes]:
    """Samples (unsigned) of each frame, after its header's and its own checksum have been verified."""
    order = sorted(range(len(frames)), key=lambda i: -sizes[i])
    lengths = np.array([len(frames[i]) for i in order])
    count = np.array([sizes[i] for i in order])
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join([frames[i] for i in order]) + bytes(8), dtype=np.uint8)
    if (crcs(CRC16, data, starts, starts + lengths) != 0).any():
        raise ValueError("a frame's checksum is wrong")
    if (data[starts] != 0xFF).any() or (data[starts + 1] != 0xF8).any() or (data[starts + 3] != 0x02).any():
        raise ValueError("a frame doesn't start as one of 8-bit samples")
    lead = data[starts + 4]
    number = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    head = starts + 4 + number + np.select([(data[starts + 2] >> 4) == 7, (data[starts + 2] >> 4) == 6], [2, 1], 0)
    if (crcs(CRC8, data, starts, head + 1) != 0).any():
        raise ValueError("a header's checksum is wrong")
    kind = data[head + 1] >> 1
    out = np.zeros((int(count.max()), len(order)), dtype=np.int32)
    first = head + 2
    for i in np.flatnonzero(kind == 0):
        out[:, i] = np.int8(data[first[i]].astype(np.int8))
    for i in np.flatnonzero(kind == 1):
        out[: count[i], i] = data[first[i] : first[i] + count[i]].view(np.int8)
    rows = np.flatnonzero(kind >= 8)
    if len(rows):
        decode_rice(data, out, rows, kind[rows].astype(np.int64), first[rows], count[rows])
    results: list[bytes] = [b""] * len(frames)
    samples = np.ascontiguousarray((out + 128).astype(np.uint8).T)
    for at, i in enumerate(order):
        results[i] = samples[at, : count[at]].tobytes()
    return results


def decode_rice(data: np.ndarray, out: np.ndarray, rows: np.ndarray, kind: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
    """Fill the columns rows of out; count falls along rows, so the frames still running come first."""
    fixed = kind < 32
    order = np.where(fixed, kind - 8, kind - 31)
    if (order > ORDER).any():
        raise ValueError("predictors beyond order 4 aren't read")
    bits = np.unpackbits(data)
    index = np.where(bits == 1, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    next_one = np.minimum.accumulate(index[::-1])[::-1]
    wide = np.zeros(len(data), dtype=np.int32)
    wide[:-2] = (data[:-2].astype(np.int32) << 16) | (data[1:-1].astype(np.int32) << 8) | data[2:]

    def read(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return (wide[at >> 3] >> (24 - (at & 7) - width)) & ((1 << width) - 1)

    at = (first * 8).astype(np.int64)
    n = len(rows)
    past = np.zeros((ORDER, n), dtype=np.int32)
    for i in range(ORDER):
        some = order > i
        value = read(at[some], 8)
        value = np.where(value > 127, value - 256, value)
        past[1:, some] = past[:-1, some]
        past[0, some] = value
        out[i, rows[some]] = value
        at[some] += 8
    coef, shift = np.zeros((ORDER, n), dtype=np.int32), np.zeros(n, dtype=np.int32)
    for o, c in FIXED.items():
        coef[:, fixed & (order == o)] = np.array(c)[:, None]
    free = np.flatnonzero(~fixed)
    if len(free):
        width = read(at[free], 4) + 1
        shift[free] = read(at[free] + 4, 5)
        at[free] += 9
        for i in range(ORDER):
            some = order[free] > i
            value = read(at[free[some]], width[some])
            coef[i, free[some]] = value - ((value >> (width[some] - 1)) << width[some])
            at[free[some]] += width[some]
    if (read(at, 6) != 0).any():
        raise ValueError("only Rice codes of one partition are read")
    k = read(at + 6, 4)
    at += 10
    low = (1 << k) - 1
    most = int(count.max())
    running = np.searchsorted(-count, -np.arange(most), side="left")
    for t in range(most):
        live = slice(0, int(running[t]))
        if t < ORDER:
            some = np.flatnonzero(order[live] <= t)
            if not len(some):
                continue
        else:
            some = live
        a, kk = at[some], k[some]
        stop = next_one[a]
        code = ((stop - a).astype(np.int32) << kk) | ((wide[(stop + 1) >> 3] >> (24 - ((stop + 1) & 7) - kk)) & low[some])
        at[some] = stop + 1 + kk
        guess = coef[0, some] * past[0, some]
        for i in range(1, ORDER):
            guess += coef[i, some] * past[i, some]
        value = ((code >> 1) ^ -(code & 1)) + (guess >> shift[some])
        out[t, rows[some]] = value
        for i in range(ORDER - 1, 0, -1):
            past[i, some] = past[i - 1, some]
        past[0, some] = value


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; raises where a checksum doesn't fit."""
    seen = [seek_points(s) for s in streams]
    frames = [(i, s[start : (points[n + 1][1] if n + 1 < len(points) else len(s))], size) for i, (s, (points, _, _)) in enumerate(zip(streams, seen)) for n, (_, start, size) in enumerate(points)]
    parts: list[list[bytes]] = [[] for _ in streams]
    for at in range(0, len(frames), TOGETHER):
        some = frames[at : at + TOGETHER]
        for (i, _, _), out in zip(some, decode_frames([f for _, f, _ in some], [n for _, _, n in some])):
            parts[i].append(out)
    payloads = [b"".join(p) for p in parts]
    for payload, (_, samples, md5) in zip(payloads, seen):
        if len(payload) != samples or hashlib.md5((np.frombuffer(payload, dtype=np.uint8) ^ 128).tobytes()).digest() != md5:
            raise ValueError("a stream's MD5 is wrong")
    return payloads


def padded(text: bytes) -> bytes:
    return text + PAD * ((-len(text) % UNIT) if text else UNIT)


def feature_of(payload: bytes) -> str:
    """Samples' mean and mean square in thousandths, crossings of the middle, and the peak."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    above = x >= 0
    return f"mean={int(x.sum() * 1000 // len(x))};power={int((x * x).sum() * 1000 // len(x))};crossings={int((above[1:] != above[:-1]).sum())};peak={int(np.abs(x).max())}"


def _batches(values: list[bytes], most: int = 2_000_000) -> Iterator[list[bytes]]:
    """Runs of values of about so many bytes."""
    some, held = [], 0
    for v in values:
        some.append(v)
        held += len(v)
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded, as a FLAC stream.

    A null or empty text has n_bytes 0 and one unit of padding. Whole texts are stored, repeated rows each on their own; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1, 2_000_000):
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            media = [m for some in _batches([padded(x) for x in texts]) for m in encode(some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary"))
    return source.mapInArrow(store, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """The stored streams decoded: doc_id, n_bytes, payload digests, the media's size and digest, and feature."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 2, 2_000_000):
            media = batch.column(2).to_pylist()
            payloads = [p for some in _batches(media) for p in decode(some)]
            rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(p)) for p, m in zip(payloads, media)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_blocks(stored: DataFrame, frames: int = 64) -> DataFrame:
    """The stored streams as blocks of PCM: doc_id, first_sample, samples, pcm; a block holds so many frames and can be found by first_sample."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 2, 2_000_000):
            for key, stream in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                pcm = decode([stream])[0]
                firsts = range(0, len(pcm), frames * FRAME)
                blocks = [pcm[s : s + frames * FRAME] for s in firsts]
                columns = [pa.array([key] * len(blocks), pa.int64()), pa.array(firsts, pa.int64()), pa.array(map(len, blocks), pa.int64()), pa.array(blocks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "first_sample", "samples", "pcm"])

    return stored.mapInArrow(read, "doc_id long, first_sample long, samples long, pcm binary")
