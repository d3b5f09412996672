"""Vectorised word splitting and rolling digests over Arrow string columns.

Everything works on the UTF-8 buffer of a whole Arrow batch, so no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_JOIN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are hashed in steps over all words at once; longer words are hashed one by one.
LONG_WORD = 256
#: Windows hashed at a time, so that the arrays stay in the processor's cache.
_SLAB = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text, so that arrays per byte stay small; one row at least."""
    ends = buffer_of(batch[column])[1]
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


class Words:
    """Words (runs of bytes other than blank, tab to carriage return) of many texts.

    starts, ends: byte range of each word. first: index of each text's first word, with one more at the end.
    """

    def __init__(self, column: pa.Array):
        self.data, self.offsets = buffer_of(column)
        data = self.data
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(_SPACE[data], out=inside[1:-1])
        opens = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        opens[cuts] = inside[cuts + 1]
        closes[cuts - 1] = inside[cuts]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def codes(self, seed: int = 0, key: int = 0) -> np.ndarray:
        """A 64-bit code for each word's bytes. Who doesn't know ``key`` can't make up words with equal codes."""
        secret = xxhash.xxh3_64_intdigest(seed.to_bytes(8, "little") + key.to_bytes(8, "little"))
        length = self.ends - self.starts
        out = mixed(length.astype(np.uint64) ^ np.uint64(secret))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", buffer=padded.data, strides=(1,))
        rest, at = np.flatnonzero(length <= LONG_WORD), 0
        while len(rest):
            left = length[rest] - at
            part = eight[self.starts[rest] + at]
            short = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
            part &= ~np.uint64(0) >> (np.uint64(64) - short)
            out[rest] = mixed(out[rest] ^ part)
            rest, at = rest[left > 8], at + 8
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), secret)
        return out

    def window_starts(self, length: int) -> np.ndarray:
        """Indexes of words at which a window of so many words of one text starts."""
        n = len(self.starts)
        if n < length:
            return np.zeros(0, np.int64)
        ok = np.ones(n, bool)
        for back in range(1, length):
            cut = self.first[1:] - back
            cut = cut[cut >= self.first[:-1]]
            ok[cut] = False
        return np.flatnonzero(ok)


def rolling(codes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Digests of codes[i:i+length] for every i; the last few, which would run over the end, are zero.

    Digests of 1, 2, 4, ... codes are made from two neighbours each, and those that add up to the length are chained.
    """
    out = np.zeros(len(codes), np.uint64)
    for at in range(0, len(codes) - length + 1, _SLAB):
        power = mixed(codes[at : at + _SLAB + length - 1] + np.uint64(seed))
        n, width, done, sofar = len(power) - length + 1, 1, 0, None
        while width <= length:
            if length & width:
                part = power[done : done + n]
                sofar = part if sofar is None else mixed(sofar * _JOIN + part)
                done += width
            power = mixed(power[:-width] * _JOIN + power[width:]) if 2 * width <= length else power
            width *= 2
        out[at : at + n] = sofar
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending distinct unsigned integers as fixed-width differences."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + raw.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    steps = steps.reshape(-1).view("<u8").astype(np.uint64)
    steps[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(steps, dtype=np.uint64)
