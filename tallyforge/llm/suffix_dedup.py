"""Suffix-array dedup over sparse suffixes at minimiser positions.

The array holds the suffixes that start at minimisers, in the order of their words: rows of first words, range-partitioned
and sorted by Spark, equal ones by their place, so that a much repeated passage spans partitions. Neighbours of the
array are compared; those with a common prefix of ``head`` words are extended left and right to whole repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.repeats import Chunk, ExactRepeats, Parts, distinct
from tallyforge.llm.wordcodes import rolling
from tallyforge.llm.workers import tidy

#: Words of the least repeat; of a minimiser's gram; grams from which it is the least; words by which suffixes sort.
WINDOW, GRAM, WIDTH, HEAD = 50, 6, 35, 16
#: Bytes of a head that are kept as they are; of a longer one the rest is a digest, so that a row stays short.
HEAD_BYTES = 1024


def minimisers(own: Chunk, gram: int, width: int, head: int) -> np.ndarray:
    """Words of the leftmost least gram digest among each ``width`` grams, where ``head`` words follow in the same text.

    A window of width + max(gram, head) - 1 words holds such a head, and equal windows hold it at the same place.
    """
    n = len(own.codes)
    starts = own.words.window_starts(width + max(gram, head) - 1)
    if not len(starts):
        return np.zeros(0, np.int64)
    best, arg = rolling(own.codes, gram), np.arange(n)
    reach = 1
    while reach < width:  # doubling: the leftmost least of the next 2, 4, ... grams
        step = min(reach, width - reach)
        other = best[step:] < best[: n - step]
        best[: n - step] = np.where(other, best[step:], best[: n - step])
        arg[: n - step] = np.where(other, arg[step:], arg[: n - step])
        reach += step
    return distinct(arg[starts])


def heads(own: Chunk, at: np.ndarray, head: int) -> list[bytes]:
    """The first ``head`` words of the suffixes at these words, joined by one space."""
    words = own.words
    low, high = words.starts[at], words.ends[at + head - 1]
    data, out = words.data.tobytes(), []
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        text = b" ".join(data[a:b].split())
        if len(text) > HEAD_BYTES:
            text = text[:HEAD_BYTES] + b"  " + xxhash.xxh3_128_digest(text)
        out.append(text)
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted run of suffixes (head, chunk, at): chunk and at of those whose head is a neighbour's.

    The run's first and last row may have their neighbour in the run before or after, so they always count: extension then
    finds what they share, if anything.
    """
    last, found = None, True  # the last row so far, and whether it counts already
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
        same = pc.equal(whole["head"][1:], whole["head"][:-1]).to_numpy(zero_copy_only=False)
        live = np.append(found, same) | np.append(same, False)
        found = bool(live[-1])
        yield whole.slice(0, whole.num_rows - 1).filter(pa.array(live[:-1])).select(["chunk", "at"])
        last = whole.slice(whole.num_rows - 1)
    if last is not None:
        yield last.select(["chunk", "at"])


class SuffixArray:
    """Anchors of ExactRepeats: suffixes at minimisers that share their first words with a neighbour in the array."""

    def __init__(self, gram: int, width: int, head: int):
        self.gram, self.width, self.span = gram, width, head

    def suffixes(self, docs: DataFrame, parts: Parts) -> DataFrame:
        """(head, chunk, at) of every suffix in the array, in no order."""

        def f(table: pa.Table) -> pa.Table:
            own = Chunk.of(table, parts.key)
            at = minimisers(own, self.gram, self.width, self.span)
            chunk = pa.array(np.full(len(at), table["chunk"][0].as_py()), pa.int32())
            return pa.table({"head": pa.array(heads(own, at, self.span), pa.binary()), "chunk": chunk, "at": pa.array(at, pa.int32())})

        return docs.groupBy("chunk").applyInArrow(f, "head binary, chunk int, at int")

    def live(self, docs: DataFrame, parts: Parts) -> DataFrame:
        """(chunk, at) of the suffixes that have their first words in common with a neighbour."""
        order = ["head", "chunk", "at"]
        array = self.suffixes(docs, parts).repartitionByRange(*order).sortWithinPartitions(*order)
        return array.mapInArrow(tidy(_neighbours), "chunk int, at int")

    def places(self, own: Chunk, rows: pa.Table, parts: Parts) -> np.ndarray:
        return np.unique(rows["at"].to_numpy()).astype(np.int64)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int = WIDTH, head: int = HEAD, chunk_bytes: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, spans (removed ranges of words).

    Every repeat of ``window`` words holds the first ``head`` words of a suffix of the array at the same place, so none
    is missed. Null and empty texts have no words; repeated rows and ids follow ``ExactRepeats``.
    """
    if width + max(gram, head) - 1 > window:
        raise ValueError("a window must hold a whole minimiser neighbourhood")
    return ExactRepeats(window, SuffixArray(gram, width, head), chunk_bytes).run(docs)


def op7(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"), "spans")


def _sql() -> str:
    from tallyforge.llm.substring_dedup import OP2_SQL

    return OP2_SQL.replace(" - 19)", " - 49)").replace(">= 20)", ">= 50)").replace("s + 19", "s + 49")


#: The same rows by comparing all windows as text.
OP7_SQL = _sql()
