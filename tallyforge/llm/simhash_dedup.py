"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import components, with_one
from tallyforge.llm.rows import ROW, row_key
from tallyforge.llm.store import cut
from tallyforge.llm.wordcodes import mixed
from tallyforge.llm.workers import text_batches, tidy

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints compared with one another at once; larger groups are cut into tiles that meet pairwise.
TILE = 2048
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    values = np.array([digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    bytes_of = values.view(np.uint8).reshape(n, 8) + np.arange(0, 2048, 256)
    counts = (np.bincount(bytes_of.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, row (as row_key() gives it) and fp (the fingerprint as a signed long), a row for each input row.

    Null texts have no words.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(values)], ["doc_id", "row", "fp"])

    text_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.withColumn("row", row_key(F.col("doc_id"), F.col("text"))).mapInArrow(tidy(f), f"doc_id long, row {ROW}, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks - distance blocks; fingerprints within the distance agree on one at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(chosen) for chosen in combinations(masks, blocks - distance)]


def _linked(a: np.ndarray, b: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i of a and j of b (both with a column for each 64 bits) that differ in ``distance`` bits or fewer."""
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        apart = np.zeros((len(a[at : at + step]), len(b)), np.uint16)
        for x, y in zip(a[at : at + step].T, b.T, strict=True):
            apart += np.bitwise_count(x[:, None] ^ y[None, :])
        i, j = np.nonzero(apart <= distance)
        yield i + at, j


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a and b; b may be a itself. Indexes from len(a) on are b's."""
    root = np.arange(len(a) + len(b))
    for i, j in _linked(a, b, distance):
        while True:  # each round points roots at lesser roots
            x, y = root[i], root[j + len(a)]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
    child = np.flatnonzero(root != np.arange(len(root)))
    return child, root[child]


def as_numbers(column: pa.Array, lanes: int) -> np.ndarray:
    """Fingerprints (longs, or bytes of 8 * lanes) as a row of numbers of 64 bits each."""
    if pa.types.is_integer(column.type):  # bits of signed numbers are counted without the sign
        return column.to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), lanes)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    if a.shape[1] == 1:
        columns = [pa.array(x[:, 0].view(np.int64)) for x in (a, b)]
    else:
        columns = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (a, b)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def _bucket_links(distance: int, lanes: int):
    """Links within each group of rows of one (key, tile pair); rows come sorted by these."""

    def links(key: np.ndarray, left: np.ndarray, right: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        two = at[(size == 2) & (left[at] == right[at])]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]).sum(1, dtype=np.int64) <= distance]
        out = [(near, near + 1)]
        for s, n in zip(at.tolist(), size.tolist(), strict=True):
            if n > 2 or n == 2 and left[s] != right[s]:
                some, where = fp[s : s + n], side[s : s + n]
                if left[s] == right[s]:
                    pair = np.tile(np.arange(n), 2)
                    child, root = _forest(some, some, distance)
                else:
                    pair = np.concatenate([np.flatnonzero(where == left[s]), np.flatnonzero(where == right[s])])
                    child, root = _forest(some[where == left[s]], some[where == right[s]], distance)
                out.append((pair[child] + s, pair[root] + s))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return _edges(fp[a], fp[b])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        names = ["key", "left", "right", "side"]
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(batch[c].to_numpy(zero_copy_only=False) for c in names), as_numbers(batch["fp"], lanes)]
            if rest is not None:
                now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            cut_at = int(np.argmax(same))  # the last group may go on in the next batch
            rest = [x[cut_at:] for x in now]
            if cut_at:
                yield links(*[x[:cut_at] for x in now])
        if rest is not None:
            yield links(*rest)

    return f


def block_links(prints: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], lanes: int, distance: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between fingerprints of column fp: a spanning forest of the true links of each group of equal keys.

    keys_of: fingerprints as rows of numbers to a row of keys each. Groups of over ``tile`` fingerprints are cut into
    tiles by hash; each pair of tiles is compared as a group of its own, so no task holds more than two tiles of a group,
    and no link is lost. Pairs are never written out.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(as_numbers(batch["fp"], lanes)) if batch.num_rows else np.zeros((0, 1), np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([batch["fp"].take(at), pa.array(keys.ravel().astype(np.int64))], ["fp", "key"])

    kind = prints.schema["fp"].dataType.simpleString()
    keyed = prints.select("fp").mapInArrow(tidy(spread), f"fp {kind}, key long")
    counted = keyed.groupBy("key").count().where(F.col("count") > tile)
    hot = counted.select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = keyed.join(hot, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "side", "fp")
    dealt = dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return dealt.mapInArrow(tidy(_bucket_links(distance, lanes)), f"a {kind}, b {kind}")


def near_links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Links between distinct fingerprints (longs) of column fp that differ in ``distance`` bits or fewer.

    Fingerprints are cut into ``blocks`` blocks, by default so many as the count of fingerprints asks for. Those within the
    distance agree in all blocks but ``distance`` at least, so each choice of the others gives a key.
    """
    prints = cut(prints.select("fp").distinct())
    masks = np.array(block_masks(distance, blocks or blocks_for(prints.count(), distance, tile)), np.uint64)

    def keys(fp: np.ndarray) -> np.ndarray:
        return mixed((fp & masks) + (np.arange(len(masks), dtype=np.uint64) << np.uint64(56)) ^ mixed(masks)).view(np.int64)

    return block_links(prints, keys, 1, distance, tile)


def blocks_for(count: int, distance: int, tile: int) -> int:
    """The least number of blocks whose keys leave groups of ``tile`` at most, where fingerprints are spread evenly."""
    blocks = distance + 2
    while blocks < 4 * distance and count >> (64 * (blocks - distance) // blocks) > tile // 2:
        blocks += 1
    return blocks


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id, row, root for each row of docs.

    component_id is the least doc_id of the row's component, root its least fingerprint, row as row_key() gives it.

    Rows link if their fingerprints differ in ``distance`` bits or fewer; equal fingerprints always link, those of texts
    without words (null or blank: fingerprint 0) included. Rows without a doc_id link like others but name no component,
    unless all of its rows lack one: then component_id is null. Other columns of docs are ignored.
    """
    prints = cut(with_fingerprints(docs, shingle))
    roots = components(near_links(prints, distance, blocks, tile)).withColumnRenamed("node", "fp")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left")
    linked = cut(classes.where("root IS NOT NULL"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = with_one(linked, least, "root", "fp").select("fp", "root", "component_id")
    alone = classes.where("root IS NULL").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return prints.join(linked.union(alone), "fp").select("doc_id", "fp", "component_id", "row", "root")


def op10(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
