"""Removal of word windows that also occur earlier, over a whole corpus.

Documents are dealt by ``doc_id`` into ranges of bounded size ("chunks"). Chunks never send text to one another. They
exchange sorted, difference-coded sets of digests, cut by digest range into parts; whoever merges a part answers each
chunk with one bit per digest. A set holds a digest once, however many copies its chunk has, so a digest reaches a part
at most once per chunk and no group of copies is ever gathered or paired.

Anchors: which places of a chunk may lie in a repeat; the rule sees to it that every repeated window holds one.
Extension: for the windows around live anchors, which ones occur in an earlier chunk. Words' codes are made with a key
that is drawn anew for each run, so no text can be written to have equal codes, and window digests have 96 bits: of
10**13 windows a false match is met once in some 1,600 runs.
Applying: windows that occur in an earlier chunk, or earlier in the same chunk, cover the words to remove; touching
windows join into maximal repeats.

Each chunk sends a message to each part. Chunks and parts grow with the root of the corpus (4 MB of text up to 160 GB of
it, 100 MB at 100 TB), so that there are in all no more messages than the corpus has units of about 30 bytes.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.wordcodes import Words, pack_sorted, rolling, unpack_sorted

#: Least text bytes of a chunk; the square of a chunk's bytes is this many times the corpus's at least; rows sampled to
#: place the bounds of chunks (as a range partitioner does), and for each chunk.
CHUNK_BYTES, GROWTH, BOUND_ROWS, BOUND_ROWS_EACH = 4 << 20, 100, 200_000, 4
#: Chunks whose digests meet in one part.
PART_CHUNKS = 3
LAST = (1 << 63) - 1

RESULT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


@dataclass(frozen=True)
class FixedBlocks:
    """Non-overlapping blocks of each document are the index; every rolling window of a block's length probes it.

    A window of at least 2 * block - 1 words contains a whole block of its own document, wherever it starts.
    """

    block: int

    def probes(self, words: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests, whether each may anchor a match, and the word at which each starts."""
        at = words.window_starts(self.block)
        text = np.searchsorted(words.first, at, "right") - 1
        return rolling(codes, self.block)[at], (at - words.first[text]) % self.block == 0, at

    @property
    def span(self) -> int:
        return self.block


@dataclass(frozen=True)
class Chunk:
    """The texts of a chunk in order, with their word codes."""

    ids: pa.Array
    texts: pa.Array
    words: Words
    codes: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, key: int) -> Chunk:
        table = table.take(pc.sort_indices(table, sort_keys=[("place", "ascending"), ("tie", "ascending"), ("text", "ascending")]))
        texts = table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0)
        words = Words(texts)
        return cls(table["doc_id"].combine_chunks(), texts, words, words.codes(0, key))


@dataclass(frozen=True)
class Parts:
    """Into how many ranges digests are cut, to how many bits those of anchors (a chance match only costs work), the key."""

    count: int
    anchor_bits: int
    key: int

    def ranges(self, values: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
        """Each part that has some of the sorted values, with the range of their indexes."""
        step = -(-(1 << bits) // self.count)
        number = values // np.uint64(step)
        heads = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(values) else np.zeros(0, np.int64)
        return list(zip(number[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(values)], strict=True)) if len(values) else []


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def within(edges: tuple[np.ndarray, np.ndarray], place: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The number of (place, tie) edges at or below each row's."""
    low, high = (np.searchsorted(edges[0], place, side) for side in ("left", "right"))
    out = high.copy()
    for at in np.unique(place[low < high]).tolist():  # places that are edges themselves
        rows = place == at
        a, b = np.searchsorted(edges[0], [at]), np.searchsorted(edges[0], [at], "right")
        out[rows] = a[0] + np.searchsorted(edges[1][a[0] : b[0]], tie[rows], "right")
    return out


class BlockAnchors:
    """Digests of fixed blocks that occur at two or more places, found by an exchange of all chunks' digests."""

    def __init__(self, rule: FixedBlocks):
        self.rule, self.span = rule, rule.span

    def live(self, docs: DataFrame, parts: Parts) -> DataFrame:
        """(chunk, part, bits): for each chunk's digests, whether they are live."""
        found = docs.groupBy("chunk").applyInArrow(_on_group(self._send, parts), _SETS_SQL)
        return found.groupBy("part").applyInArrow(_merge_anchors, "chunk int, part int, bits binary")

    def _digests(self, own: Chunk, parts: Parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        digests, index, at = self.rule.probes(own.words, own.codes)
        return digests >> np.uint64(64 - parts.anchor_bits), index, at

    def _send(self, chunk: int, table: pa.Table, parts: Parts) -> Iterator[tuple]:
        digests, index, _ = self._digests(Chunk.of(table, parts.key), parts)
        values = np.sort(digests)
        heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        many = np.diff(np.append(heads, len(values))) > 1
        values = values[heads]
        indexed = np.isin(values, distinct(digests[index]), assume_unique=True)
        for part, a, b in parts.ranges(values, parts.anchor_bits):
            yield part, chunk, pack_sorted(values[a:b]), None, _bits(np.concatenate([indexed[a:b], many[a:b]]))

    def places(self, own: Chunk, replies: pa.Table, parts: Parts) -> np.ndarray:
        """First words of this chunk's own indexed anchors that occur elsewhere."""
        digests, index, at = self._digests(own, parts)
        values = distinct(digests)
        live, bits = np.zeros(len(values), bool), _by_part(replies)
        for part, a, b in parts.ranges(values, parts.anchor_bits):
            live[a:b] = _mask(bits[part], b - a)
        at, digests = at[index], digests[index]
        return at[live[np.searchsorted(values, digests)]]


class ExactRepeats:
    """Finds and removes words covered by a window of ``window`` words that also starts earlier in the corpus.

    ``anchors``: live(docs, parts) gives rows by chunk, places(own, rows, parts) the words of a chunk at which live
    anchors start; ``span`` words of an anchor lie in each repeated window.

    Earlier: in a document of smaller id, or further left in the same one. Rows of one id count as documents in the
    order of a hash of their texts; rows without an id come last, ordered alike. Chunks are cut between rows of one id
    too, so that neither many rows without an id nor many of one id meet in a task; only rows equal in id and text do.
    Null texts have no words. Every input row gives one output row. Other columns of the input are ignored.
    """

    def __init__(self, window: int, anchors, chunk_bytes: int | None = None):
        self.window, self.anchors, self.chunk_bytes = window, anchors, chunk_bytes

    def run(self, docs: DataFrame) -> DataFrame:
        """Columns of RESULT: kept words joined by one space, and the removed maximal ranges of words."""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(LAST))).withColumn("tie", F.xxhash64("text"))
        edges, size, chunk_bytes = self._edges(docs)
        key = int.from_bytes(os.urandom(7), "little")
        parts = Parts(max(32, size // (PART_CHUNKS * chunk_bytes)), min(64, 12 + max(20, int(size // 6).bit_length())), key)

        @F.pandas_udf("int")
        def chunk_of(place: pd.Series, tie: pd.Series) -> pd.Series:
            return pd.Series(within(edges, place.to_numpy(), tie.to_numpy()))

        docs = docs.withColumn("chunk", chunk_of("place", "tie"))
        live = self.anchors.live(docs, parts)
        spread = docs.groupBy("chunk").cogroup(live.groupBy("chunk")).applyInArrow(_on_pair(self._send_windows, parts), _SETS_SQL)
        seen = spread.groupBy("part").applyInArrow(_merge_windows(parts.count), "chunk int, part int, bits binary")
        return docs.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(_on_pair(self._apply, parts), RESULT)

    def _edges(self, docs: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int, int]:
        """First (place, tie) of all chunks but the first, the bytes of all texts, and the bytes of a chunk."""
        sized = docs.select("place", "tie", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b"))
        rows, size = sized.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
        chunk_bytes = self.chunk_bytes or max(CHUNK_BYTES, int((GROWTH * size) ** 0.5))
        if size <= chunk_bytes:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64)), size, chunk_bytes
        wanted = max(BOUND_ROWS, BOUND_ROWS_EACH * size // chunk_bytes)
        some = sized if rows <= wanted else sized.sample(wanted / rows / 1.05, 7)
        some = some.toPandas().sort_values(["place", "tie"])
        at = np.cumsum(some["b"].to_numpy()) * (size / max(1, some["b"].sum())) // chunk_bytes
        place, tie = some["place"].to_numpy(), some["tie"].to_numpy()
        first = np.flatnonzero((np.diff(at) > 0) & ((place[1:] != place[:-1]) | (tie[1:] != tie[:-1]))) + 1
        return (place[first], tie[first]), size, chunk_bytes

    def _windows(self, own: Chunk, wanted: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start words of the wanted windows, their number among distinct ones, and the distinct ones' two digests."""
        starts = np.flatnonzero(wanted)
        high = rolling(own.codes, self.window)[starts]
        low = rolling(own.words.codes(1, key), self.window, 1)[starts] & np.uint64(0xFFFFFFFF)
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return starts, number, high[order][new], low[order][new].astype("<u4")

    def _send_windows(self, chunk: int, table: pa.Table, replies: pa.Table, parts: Parts) -> Iterator[tuple]:
        own = Chunk.of(table, parts.key)
        wanted = np.zeros(len(own.codes) + 1, np.int32)
        at = self.anchors.places(own, replies, parts)
        np.add.at(wanted, np.maximum(at + self.anchors.span - self.window, 0), 1)
        np.add.at(wanted, at + 1, -1)
        possible = np.zeros(len(own.codes), bool)
        possible[own.words.window_starts(self.window)] = True
        possible &= np.cumsum(wanted)[:-1] > 0
        yield parts.count + chunk, chunk, _bits(possible), None, None
        _, _, high, low = self._windows(own, possible, parts.key)
        for part, a, b in parts.ranges(high, 64):
            yield part, chunk, pack_sorted(high[a:b]), low[a:b].tobytes(), None

    def _apply(self, chunk: int, table: pa.Table, replies: pa.Table, parts: Parts) -> pa.RecordBatch:
        own, replies = Chunk.of(table, parts.key), _by_part(replies)
        n = len(own.codes)
        wanted = _mask(replies[parts.count + chunk], n)
        starts, number, high, _ = self._windows(own, wanted, parts.key)
        earlier = np.zeros(len(high), bool)
        for part, a, b in parts.ranges(high, 64):
            earlier[a:b] = _mask(replies[part], b - a)
        first = np.full(len(high), n, np.int64)
        np.minimum.at(first, number, starts)
        gone = starts[earlier[number] | (first[number] != starts)]
        cover = np.zeros(n + 1, np.int32)
        cover[gone] += 1
        np.add.at(cover, gone + self.window, -1)
        removed = np.cumsum(cover)[:n] > 0
        return self._result(own, removed)

    def _result(self, own: Chunk, removed: np.ndarray) -> pa.RecordBatch:
        words, kept, spans, counts = own.words, [], [], []
        data, first = words.data.tobytes(), words.first
        for i in range(len(own.ids)):
            a, b = first[i], first[i + 1]
            gone = removed[a:b]
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            pieces, at = [], a
            for s, e in [*(edges + a).tolist(), (b, b)]:
                if s > at:
                    pieces += data[words.starts[at] : words.ends[s - 1]].split()
                at = e
            kept.append(b" ".join(pieces))
            spans.append([{"start": s, "end": e} for s, e in edges.tolist()])
            counts.append(int(gone.sum()))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [own.ids.cast(pa.int64()), pa.array(np.diff(first)), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind)],
            ["doc_id", "n_words", "n_removed", "kept_text", "spans"],
        )


_SETS_SQL = "part int, chunk int, high binary, low binary, flags binary"
_SETS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("flags", pa.binary())])
_REPLIES = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("bits", pa.binary())])


def _table(rows, schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _by_part(replies: pa.Table) -> dict[int, bytes]:
    return dict(zip(replies["part"].to_pylist(), replies["bits"].to_pylist(), strict=True))


def _on_group(send: Callable, parts: Parts) -> Callable[[pa.Table], pa.Table]:
    def f(table: pa.Table) -> pa.Table:
        return _table(send(table["chunk"][0].as_py(), table, parts), _SETS)

    return f


def _on_pair(act: Callable, parts: Parts) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def f(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = act(table["chunk"][0].as_py(), table, replies, parts)
        return pa.Table.from_batches([out]) if isinstance(out, pa.RecordBatch) else _table(out, _SETS)

    return f


def _merge_anchors(table: pa.Table) -> pa.Table:
    """For each chunk's digests, whether the digest is indexed anywhere and occurs twice or more."""
    table = table.sort_by("chunk")
    sets = [unpack_sorted(x) for x in table["high"].to_pylist()]
    flags = [_mask(x, 2 * len(s)).reshape(2, -1) for x, s in zip(table["flags"].to_pylist(), sets, strict=True)]
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(values[order]) != 0))
    number = np.empty(len(values), np.int64)
    number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(values))))
    indexed, many = np.concatenate(flags, axis=1)
    live = np.bincount(number[indexed], minlength=len(heads)) > 0
    live &= (np.diff(np.append(heads, len(values))) > 1) | (np.bincount(number[many], minlength=len(heads)) > 0)
    ends = np.cumsum([len(s) for s in sets])[:-1]
    bits = [_bits(x) for x in np.split(live[number], ends)]
    return _table(zip(table["chunk"].to_pylist(), table["part"].to_pylist(), bits, strict=True), _REPLIES)


def _merge_windows(parts: int) -> Callable[[pa.Table], pa.Table]:
    def f(table: pa.Table) -> pa.Table:
        """For each chunk's digests, whether an earlier chunk has the digest too."""
        if table["part"][0].as_py() >= parts:  # what a chunk sends to itself
            return _table(zip(table["chunk"].to_pylist(), table["part"].to_pylist(), table["high"].to_pylist(), strict=True), _REPLIES)
        table = table.sort_by("chunk")
        sets = [unpack_sorted(x) for x in table["high"].to_pylist()]
        high, low = np.concatenate(sets), np.concatenate([np.frombuffer(x, "<u4") for x in table["low"].to_pylist()])
        order = np.lexsort((low, high))  # stable: chunks stay in order
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        earlier = np.zeros(len(high), bool)
        earlier[order[1:]] = same
        ends = np.cumsum([len(s) for s in sets])[:-1]
        bits = [_bits(x) for x in np.split(earlier, ends)]
        return _table(zip(table["chunk"].to_pylist(), table["part"].to_pylist(), bits, strict=True), _REPLIES)

    return f
