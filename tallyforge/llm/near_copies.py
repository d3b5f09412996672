"""SimHash near-duplicates at a similarity of 0.8: wide fingerprints in blocks, checked by the sets of shingles.

Texts whose sets of shingles have a Jaccard similarity of 0.8 differ in 15 % of SimHash bits. No pair of 64-bit
fingerprints is sure to share a block of more than 5 bits at that rate, so fingerprints are as wide as the count of
texts asks for, and cut into so many blocks of so many bits that such a pair shares a block in 99.5 % of cases (pairs
above 0.8 more often). Fingerprints that share a block are compared in full; what lies within the distance is checked
by the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.components import components, with_one
from tallyforge.llm.rows import ROW, by_keys, row_key, small, unused
from tallyforge.llm.simhash_dedup import block_links
from tallyforge.llm.store import cut
from tallyforge.llm.wordcodes import Words, buffer_of, mixed, rolling, slices
from tallyforge.llm.workers import text_batches, tidy

SHINGLE, SIMILARITY = 5, 0.8
#: Chance that a pair at the similarity shares no block; deviations by which it may differ in more bits than expected;
#: fingerprints that share a block's value by chance, about; least and most bits of a block.
MISSED, DEVIATIONS, BY_CHANCE, BITS = 0.005, 4.0, 500, (6, 24)
#: Bytes of text whose shingles a worker holds at once.
SLICE = 1 << 19
#: Shingles compared at once, about 2,000 documents of common length; larger groups are cut into tiles that meet pairwise.
TILE = 500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Shape:
    """A fingerprint of 64 * lanes bits, its blocks, and the bits in which linked fingerprints differ at most."""

    lanes: int
    blocks: int
    bits: int
    distance: int

    @classmethod
    def of(cls, texts: int, similarity: float) -> Shape:
        """For so many texts. A bit differs between two sets at the angle of their indicator vectors, by pi."""
        apart = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
        bits = min(BITS[1], max(BITS[0], math.ceil(math.log2(max(texts, 1) / BY_CHANCE + 1))))
        blocks = max(8, math.ceil(math.log(MISSED) / math.log1p(-((1 - apart) ** bits))))
        lanes = max(3, -(-blocks * bits // 64))
        n = 64 * lanes
        return cls(lanes, n // bits, bits, math.ceil(n * apart + DEVIATIONS * math.sqrt(n * apart * (1 - apart))))


class Shingles:
    """Distinct codes of the texts' runs of ``shingle`` words (A-Z in any case); fewer words are one run, none no run.

    ``values``: the codes, text by text, ascending in each. ``first``: index of each text's first one, and the end.
    """

    def __init__(self, column: pa.Array, shingle: int = SHINGLE):
        data, offsets = buffer_of(column)
        n = len(offsets) - 1
        low = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_LOWER[data].tobytes()))
        self.words = words = Words(low)
        codes, counts = words.codes(), np.diff(words.first)
        at = words.window_starts(shingle)
        value, owner = [rolling(codes, shingle)[at]], [np.searchsorted(words.first, at, "right") - 1]
        for few in range(1, shingle):
            short = np.flatnonzero(counts == few)
            value.append(rolling(codes, few)[words.first[short]] if len(short) else np.zeros(0, np.uint64))
            owner.append(short)
        value, owner = np.concatenate(value), np.concatenate(owner)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.values, owner = value[new], owner[new]
        self.first = np.searchsorted(owner, np.arange(n + 1))

    def nodes(self) -> np.ndarray:
        """Two 64-bit hashes of each text's words; zeros for a text without."""
        words, data = self.words, self.words.data.tobytes()
        bounds = zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)
        raw = [xxhash.xxh3_128_digest(b" ".join(data[words.starts[a] : words.ends[b - 1]].split())) if b > a else bytes(16) for a, b in bounds]
        return np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)

    def fingerprints(self, lanes: int) -> np.ndarray:
        """A row of ``lanes`` numbers of 64 bits for each text: a bit is set that over half of its codes set."""
        n = len(self.first) - 1
        out = np.zeros((n, lanes), np.uint64)
        size = np.diff(self.first)
        some = np.flatnonzero(size)
        for lane in range(lanes if len(some) else 0):
            hashed = mixed(self.values + np.uint64((2 * lane + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            bits = np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, self.first[some], axis=0, dtype=np.int32)
            out[some, lane] = np.packbits(2 * sums > size[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
        return out


def block_values(prints: np.ndarray, shape: Shape) -> np.ndarray:
    """(fingerprints, blocks): each block's number and bits as one number."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : shape.blocks * shape.bits]
    values = bits.reshape(len(prints), shape.blocks, shape.bits) @ (np.int64(1) << np.arange(shape.bits))
    return values + (np.arange(shape.blocks) << shape.bits)


def with_prints(docs: DataFrame, shape: Shape, shingle: int) -> DataFrame:
    """row, node and other (two hashes of the words), n (distinct shingles) and fp (the fingerprint's bytes) of docs (row, text)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, most=SLICE)):
            found = Shingles(batch["text"], shingle)
            prints = [x.tobytes() for x in found.fingerprints(shape.lanes).astype("<u8")]
            node, other = (pa.array(x) for x in np.ascontiguousarray(found.nodes().T))
            columns = [batch["row"], node, other, pa.array(np.diff(found.first), pa.int64()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "node", "other", "n", "fp"])

    found = cut(docs.mapInArrow(tidy(f), f"row {ROW}, node long, other long, n long, fp binary"))
    # words that share one hash by chance: the second tells them apart
    odd = found.groupBy("node").agg(F.min("other").alias("_least"), F.max("other").alias("_most")).where("_least <> _most").select("node", "_least")
    if odd.isEmpty():
        return found.drop("other")
    marked = found.join(odd, "node", "left")
    return cut(marked.withColumn("node", F.when(F.col("other") != F.col("_least"), F.xxhash64("node", "other")).otherwise(F.col("node"))).drop("other", "_least"))


def _with_sets(shingle: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, most=SLICE)):
            found = Shingles(batch["text"], shingle)
            sets = pa.ListArray.from_arrays(pa.array(found.first, pa.int32()), pa.array(found.values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["node"], batch["part"], batch["tiles"], sets], ["node", "part", "tiles", "shingles"])

    return f


def similar(nodes: list, sets: list[np.ndarray], similarity: float) -> list[tuple]:
    """A spanning forest of the pairs whose sets have a Jaccard similarity of ``similarity`` or more."""
    if len(nodes) < 2:
        return []
    if len(nodes) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(nodes[0], nodes[1])] if both / (len(sets[0]) + len(sets[1]) - both) >= similarity else []
    size = np.array([len(s) for s in sets])
    edges = np.concatenate([[0], np.cumsum(size)])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(values)))])
    root, out = np.arange(len(sets)), []
    for i in range(len(sets)):
        mine = code[edges[i] : edges[i + 1]]
        many = at[mine + 1] - at[mine]
        where = np.repeat(at[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(owner[where], minlength=len(sets))
        near = np.flatnonzero(both / (size[i] + size - both) >= similarity)
        labels, first = np.unique(root[near], return_index=True)
        if len(labels) > 1:
            out += [(nodes[i], nodes[j]) for j in near[first].tolist() if j != i]
            root[np.isin(root, labels)] = labels[0]
            if (root == root[0]).all():
                break
    return out


def _part_links(similarity: float):
    """Links within each part (left and right are its tiles); rows come sorted by part, left and right."""

    def edges(pairs: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []
        for batch in batches:
            out = []
            rows = zip(*[batch[c].to_pylist() for c in ("part", "left", "right", "node")], batch["shingles"], strict=True)
            for part, left, right, node, shingles in rows:
                if key != (part, left, right):
                    out += similar(nodes, sets, similarity)
                    key, nodes, sets = (part, left, right), [], []
                if nodes and nodes[-1] == node:
                    continue  # a repeated row
                nodes.append(node)
                sets.append(shingles.values.to_numpy(zero_copy_only=False).copy())
            yield edges(out)
        yield edges(similar(nodes, sets, similarity))

    return f


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """row (as row_key() gives it), node (a hash of its words) and root for each row of docs.

    Rows of one root are copies, directly or through others. Rows link if their words are equal (A-Z in any case, any
    blanks between words), or if their sets of shingles have a Jaccard similarity of ``similarity`` or more; rows without words (null
    or blank) link with one another.

    Fingerprints that share a block are compared, and those within the distance form a part, directly or through others;
    sets are compared within parts only, so each text is sent once, or once for each tile of a part of over ``tile``
    shingles. Pairs are never written out. What is missed: pairs that share no block (0.5 % at the similarity itself).
    """
    text_batches(docs.sparkSession)
    kept = docs.select(row_key(docs["doc_id"], docs["text"]).alias("row"), F.col("text").cast("string").alias("text"))
    shape = Shape.of(kept.count(), similarity)
    prints = with_prints(kept, shape, shingle)
    links = block_links(prints.where("n > 0").select("fp").distinct(), lambda p: block_values(p, shape), shape.lanes, shape.distance)
    key = lambda c: F.xxhash64(c)  # noqa: E731; a fingerprint's number: two that share one by chance only are compared more
    roots = components(links.select(key("a").alias("a"), key("b").alias("b")))
    # parts of several texts: linked fingerprints, or one of several texts
    nodes = prints.where("n > 0").groupBy(key("fp").alias("fp"), "node").agg(F.min("row").alias("row"), F.first("n").alias("n"))
    nodes = cut(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("node", "row", "n", F.coalesce("root", "fp").alias("part")))
    parts = nodes.groupBy("part").agg(F.count("*").alias("size"), F.ceil(F.sum("n") / tile).cast("int").alias("tiles"))
    members = with_one(nodes, parts.where("size > 1").drop("size"), "part", "node").select("node", "row", "part", "tiles")
    texts = kept.join(small(cut(members)), "row")
    sets = texts.select("node", "part", "tiles", "text").mapInArrow(tidy(_with_sets(shingle)), "node long, part long, tiles int, shingles array<long>")
    dealt = sets.withColumn("side", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("part", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "node", "shingles")
    dealt = dealt.repartition("part", "left", "right").sortWithinPartitions("part", "left", "right", "node")
    found = components(dealt.mapInArrow(tidy(_part_links(similarity)), "a long, b long"))
    return prints.select("row", "node").join(found, "node", "left").select("row", "node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of each component of near copies, in all columns of docs: that of least doc_id, then of least hash.

    Rows without a doc_id come last. Of repeated rows one stays. Texts travel only if rows are dropped by too many keys
    to be broadcast, and where rows are repeated.
    """
    found = cut(near_copies(docs, **how).select("row", "root"))
    least = found.groupBy("root").agg(F.min("row").alias("row"), F.count("*").alias("size")).where("size > 1")
    stay = found.groupBy("row").agg(F.count("*").alias("times"))
    members = with_one(found, least.select("root", F.col("row").alias("least")), "root", "row")
    gone = cut(members.where("row <> least").select("row"))
    again = cut(stay.where("times > 1").select("row"))
    out = by_keys(docs, gone.union(again), "left_anti")
    if again.isEmpty():
        return out
    twice = by_keys(docs, again.join(gone, "row", "left_anti"), "left_semi")
    number = unused(docs, "_number")
    one = F.row_number().over(Window.partitionBy(row_key(F.col("doc_id"), F.col("text"))).orderBy(F.lit(1)))
    return out.union(twice.withColumn(number, one).where(F.col(number) == 1).drop(number))
