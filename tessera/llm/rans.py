"""Token ids in a binary format: static range asymmetric numeral system.

One frequency table, counted over all documents, serves every block.  A block
holds up to ``BLOCK`` consecutive ids, is coded by interleaved lanes and needs
nothing from other blocks.  Inside a block a checkpoint (lane states and word
position) starts each segment of ``SEGMENT`` steps, and each segment carries a
crc32, so blocks and segments decode in parallel and are verified on their own.

File: magic, then blocks, each ``length | header | words``; then the document
index (doc_id, start, n_tokens) and a trailer with its place.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

SCALE_BITS = 18            # frequencies sum to 2**18
LOW = np.uint64(1 << 31)   # lane states stay in [2**31, 2**63)
BLOCK = 1 << 20            # ids per block
LANE_STEPS = 256           # ids per lane at least, so lane states stay a small share
MAX_LANES = 4096
SEGMENT = 128              # steps between checkpoints
MAGIC = b"RANSIDS1"
_M = np.uint64(SCALE_BITS)
_MASK = np.uint64((1 << SCALE_BITS) - 1)
_32 = np.uint64(32)


def normalise(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum 2**SCALE_BITS; every counted symbol keeps at least 1."""
    counts = np.asarray(counts, dtype=np.float64)
    total, size = counts.sum(), 1 << SCALE_BITS
    freq = np.zeros(len(counts), dtype=np.int64)
    if total == 0:
        return freq
    seen = counts > 0
    if seen.sum() > size:
        raise ValueError("more symbols than the frequency table can tell apart")
    freq[seen] = np.maximum(1, np.floor(counts[seen] * size / total)).astype(np.int64)
    diff = size - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if diff > 0:
        freq[order[0]] += diff
    for i in order:            # give back what the floor of 1 has added, largest first
        if diff >= 0:
            break
        cut = min(-diff, int(freq[i]) - max(1, int(freq[i]) // 2))
        freq[i] -= cut
        diff += cut
    return freq


class Table:
    """Frequencies with their cumulative sums and the slot -> symbol map."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, dtype=np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.limit = ((LOW >> _M) << _32) * self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, dtype=np.int64))

    def encode(self, ids: np.ndarray) -> bytes:
        """One block: header, checkpoints, then the 32-bit words."""
        n = len(ids)
        lanes = int(min(MAX_LANES, max(1, n // LANE_STEPS)))
        steps = -(-n // lanes)
        tail = n - (steps - 1) * lanes if n else 0      # lanes used in the last step
        x = np.full(lanes, LOW, dtype=np.uint64)
        chunks, points = [], []
        for t in range(steps - 1, -1, -1):
            k = lanes if t < steps - 1 else tail
            s = ids[t * lanes:t * lanes + k]
            y, f = x[:k], self.freq[s]
            full = y >= self.limit[s]
            words = y[full]
            chunks.append((words & np.uint64(0xFFFFFFFF)).astype("<u4"))
            y = np.where(full, y >> _32, y)
            q = y // f
            x[:k] = (q << _M) + (y - q * f) + self.cum[s]
            if t % SEGMENT == 0:
                points.append((x.copy(), sum(map(len, chunks))))
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
        out = io.BytesIO()
        out.write(struct.pack("<IIII", n, lanes, len(points), len(words)))
        for i, (state, before) in enumerate(points[::-1]):
            seg = ids[i * SEGMENT * lanes:(i + 1) * SEGMENT * lanes]
            out.write(struct.pack("<II", len(words) - before, zlib.crc32(np.asarray(seg, "<u4").tobytes())))
            out.write(state.astype("<u8").tobytes())
        out.write(words.tobytes())
        return out.getvalue()

    def decode(self, block: bytes, segment: int | None = None) -> np.ndarray:
        """The ids of a block, or of one of its segments; raises on a bad checksum."""
        n, lanes, n_points, n_words = struct.unpack_from("<IIII", block)
        width = 8 + 8 * lanes
        words = np.frombuffer(block, "<u4", n_words, 16 + n_points * width)
        steps = -(-n // lanes) if n else 0
        tail = n - (steps - 1) * lanes
        parts = []
        for i in range(n_points) if segment is None else [segment]:
            at = 16 + i * width
            pos, crc = struct.unpack_from("<II", block, at)
            x = np.frombuffer(block, "<u8", lanes, at + 8).astype(np.uint64)
            first, last = i * SEGMENT, min(steps, (i + 1) * SEGMENT)
            out = np.empty((last - first) * lanes, dtype=np.uint32)
            for t in range(first, last):
                k = lanes if t < steps - 1 else tail
                y = x[:k]
                slot = y & _MASK
                s = self.symbol[slot]
                out[(t - first) * lanes:(t - first) * lanes + k] = s
                y = self.freq[s] * (y >> _M) + slot - self.cum[s]
                low = np.flatnonzero(y < LOW)
                y[low] = (y[low] << _32) | words[pos:pos + len(low)]
                pos += len(low)
                x[:k] = y
            out = out[:min(n, last * lanes) - first * lanes]
            # the lanes must end where the next checkpoint, or the encoder, began
            end = np.frombuffer(block, "<u8", lanes, at + width + 8) if i + 1 < n_points else LOW
            if zlib.crc32(out.astype("<u4").tobytes()) != crc or (x != end).any():
                raise ValueError("a segment does not match its checksum")
            parts.append(out)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_file(table: Table, runs, docs):
    """Yield the bytes of a file.  ``runs``: iterable of id arrays in order;
    ``docs``: list filled by the caller with (has_id, doc_id, start, n) while
    ``runs`` is consumed."""
    yield MAGIC
    at = len(MAGIC)
    held, size = [], 0

    def block(ids):
        b = table.encode(ids)
        return struct.pack("<I", len(b)) + b
    for run in runs:
        held.append(run)
        size += len(run)
        while size >= BLOCK:
            ids = np.concatenate(held)
            b = block(ids[:BLOCK])
            at += len(b)
            yield b
            held, size = [ids[BLOCK:]], size - BLOCK
    if size:
        b = block(np.concatenate(held))
        at += len(b)
        yield b
    yield struct.pack("<I", 0)
    index = np.array(docs, dtype=[("has", "<i8"), ("id", "<i8"), ("start", "<i8"), ("n", "<i8")])
    yield index.tobytes()
    yield struct.pack("<QQ", at + 4, len(index)) + MAGIC


def read_file(table: Table, source):
    """Yield (has_id, doc_id, start, ids) per document, reading the file once
    from front to end and holding one block at a time besides the index."""
    data = source.read()
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a complete file of this format")
    at_index, n_docs = struct.unpack_from("<QQ", data, len(data) - 24)
    index = np.frombuffer(data, [("has", "<i8"), ("id", "<i8"), ("start", "<i8"), ("n", "<i8")], n_docs, at_index)
    at, held = 8, np.zeros(0, np.uint32)
    for has, doc, start, n in index.tolist():
        parts, have = [held], len(held)
        while have < n:
            (size,) = struct.unpack_from("<I", data, at)
            ids = table.decode(data[at + 4:at + 4 + size])
            at += 4 + size
            parts.append(ids)
            have += len(ids)
        ids = np.concatenate(parts) if len(parts) > 1 else held
        held = ids[n:]
        yield has, doc, start, ids[:n]
