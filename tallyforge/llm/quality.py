"""Quality classifier by importance resampling: ratios of hashed n-gram models, sampled by Gumbel top-k.

Texts become two streams of n-grams: words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased), with a mark
for a word that repeats the one before; and shapes (4-grams over classes of bytes, runs of one class counting once).
Bag models over hashed n-grams are counted for the raw corpus (every row) and for target text (rows labelled good).
A text's importance is the sum of its n-grams' log ratios. The classifier compares target text with the two kinds of
text labelled bad in the same way: low quality by the mean log ratio of shapes, toxic text by the certain
log ratios of its distinct words, on their average.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.rows import ROW, by_keys, row_key
from tallyforge.llm.store import cut
from tallyforge.llm.wordcodes import Words, buffer_of, mixed, rolling, slices
from tallyforge.llm.workers import text_batches, tidy

#: Buckets of words and of shapes; two more hold "a new word" and "the word before, again".
WORDS, SHAPES = 1 << 18, 1 << 14
SIZE = WORDS + SHAPES + 2
#: Labels by which the classifier is fitted: about so many at most, those of least hash, so few that they are broadcast;
#: of near copies one each, so that the words of a much copied text don't pass for words of its label. Share sampled; its seed.
FIT_ROWS, SHARE, SEED = 100_000, 0.5, 23
#: A false rejection weighs as so many missed ones when limits are set; a word's ratio counts at so many deviations.
WEIGHT, SURE = 3.0, 1.5
#: Distinct words added to a text's when its toxic evidence is divided by them.
EASE = 20
#: Bytes of text whose n-grams a worker holds at once.
SLICE = 1 << 20
#: Counts travel in pieces of so many buckets.
PIECE = 1 << 13

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1
_CLASS[[9, 11, 12, 13, 32]] = 4


class Grams:
    """n-grams of the texts of an Arrow column: bucket of each, and the text that has it."""

    def __init__(self, column: pa.Array):
        data, offsets = buffer_of(column)
        n = len(offsets) - 1
        low = _LOWER[data]
        spaced = np.where(_WORD[low], low, np.uint8(32))
        words = Words(pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(spaced.tobytes())))
        codes = words.codes()
        text = np.repeat(np.arange(n), np.diff(words.first))
        again = np.zeros(len(codes), bool)
        again[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
        kinds = _CLASS[data]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        new = np.ones(len(kinds), bool)
        new[1:] = (kinds[1:] != kinds[:-1]) | (owner[1:] != owner[:-1])
        kinds, owner = mixed(kinds[new] + np.uint64(1)), owner[new]
        shapes = rolling(kinds, 4)[: max(0, len(kinds) - 3)]
        inside = owner[3:] == owner[:-3] if len(owner) > 3 else np.zeros(0, bool)
        self.words, self.word_text = (codes % np.uint64(WORDS)).astype(np.int64), text
        self.shapes, self.shape_text = WORDS + (shapes[inside] % np.uint64(SHAPES)).astype(np.int64), owner[:-3][inside] if len(owner) > 3 else owner[:0]
        self.again = SIZE - 2 + again.astype(np.int64)
        self.n = n

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of each text's distinct words."""
        key = np.sort(self.word_text * WORDS + self.words)
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        return key // WORDS, key % WORDS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task: rows (model, piece, counts). Models: raw, good, low, and fold x word documents (good, toxic)."""
    sums: dict[str, np.ndarray] = {}

    def add(model: str, values: np.ndarray) -> None:
        if model not in sums:
            sums[model] = np.zeros(SIZE + 1, np.int64)
        sums[model] += np.bincount(values, minlength=SIZE + 1)

    for batch in (part for whole in batches for part in slices(whole, most=SLICE)):
        grams = Grams(batch["text"])
        kind = batch["kind"].to_numpy(zero_copy_only=False)
        fold = batch["fold"].to_numpy(zero_copy_only=False)
        add("raw", np.concatenate([grams.words, grams.shapes, grams.again]))
        for name, wanted in (("good", 1), ("low", 2)):
            if (kind == wanted).any():
                w, s = kind[grams.word_text] == wanted, kind[grams.shape_text] == wanted
                add(name, np.concatenate([grams.words[w], grams.shapes[s], grams.again[w]]))
        if (kind > 0).any():
            text, word = grams.distinct_words()
            for f in (0, 1):
                for name, some in (("good", (kind == 1) | (kind == 2)), ("toxic", kind == 3)):
                    if (rows := some & (fold == f)).any():
                        add(f"{name}{f}", np.append(word[rows[text]], np.full(int(rows.sum()), SIZE)))  # the last: documents
    for model, counts in sums.items():
        for at in range(0, SIZE + 1, PIECE):
            piece = counts[at : at + PIECE]
            if piece.any():
                yield pa.RecordBatch.from_pydict({"model": [model], "piece": pa.array([at // PIECE], pa.int32()), "counts": pa.array([piece.tolist()], pa.list_(pa.int64()))})


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, kind, a hash of the words and three min-hashes of their 3-grams, which near copies mostly share."""
    for batch in (part for whole in batches for part in slices(whole, most=SLICE)):
        words = Words(batch["text"])
        codes, grams = words.codes(), words.window_starts(3)
        text = np.searchsorted(words.first, grams, "right") - 1
        values, n = rolling(codes, 3)[grams], batch.num_rows
        out = [batch["doc_id"], batch["kind"]]
        for k in range(4):
            sketch = np.full(n, np.uint64(k))
            if k == 0:  # of all words in order
                np.add.at(sketch, np.repeat(np.arange(n), np.diff(words.first)), mixed(codes + (np.arange(len(codes)) - np.repeat(words.first[:-1], np.diff(words.first))).astype(np.uint64)))
            elif len(grams):
                heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                sketch[text[heads]] = np.minimum.reduceat(mixed(values ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))), heads)
            out.append(pa.array(sketch.view(np.int64)))
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "kind", "h", "m0", "m1", "m2"])


def _summed(counts: DataFrame) -> dict[str, np.ndarray]:
    """All models; their size is fixed, whatever the input's."""

    def f(table: pa.Table) -> pa.Table:
        total = sum(np.asarray(x) for x in table["counts"].to_numpy())
        return pa.table({"model": table["model"][:1], "piece": table["piece"][:1], "counts": pa.array([total.tolist()], pa.list_(pa.int64()))})

    schema = "model string, piece int, counts array<long>"
    spread = counts.withColumn("lane", F.spark_partition_id() % 16)
    first = spread.groupBy("model", "piece", "lane").applyInArrow(f, schema)
    models = {name: np.zeros(SIZE + 1) for name in ("raw", "good", "low", "good0", "good1", "toxic0", "toxic1")}
    for model, piece, values in first.groupBy("model", "piece").applyInArrow(f, schema).toLocalIterator():
        models[model][piece * PIECE : piece * PIECE + len(values)] = values
    return models


@dataclass(frozen=True)
class Ratios:
    """Log ratios by bucket: target to raw text, target to low quality, and toxic to other text by each fold and both."""

    importance: np.ndarray
    low: np.ndarray
    toxic: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, models: dict[str, np.ndarray]) -> Ratios:
        def log_share(x: np.ndarray, a: int, b: int) -> np.ndarray:
            part = x[a:b] + 1.0
            return np.log(part / part.sum())

        def ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            edges = ((0, WORDS), (WORDS, WORDS + SHAPES), (SIZE - 2, SIZE))
            return np.concatenate([log_share(x, a, b) - log_share(y, a, b) for a, b in edges]).astype(np.float32)

        def toxic(*folds: int) -> np.ndarray:
            bad, good = (sum(models[f"{kind}{f}"] for f in folds) for kind in ("toxic", "good"))
            least = np.maximum(bad[:WORDS] - SURE * np.sqrt(bad[:WORDS]), 0.0) / max(bad[SIZE], 1)
            most = (good[:WORDS] + SURE * np.sqrt(good[:WORDS] + 1) + 0.5) / max(good[SIZE], 1)
            return np.where(bad[:WORDS] >= 3, np.maximum(np.log(np.maximum(least, 1e-12) / most), 0.0), 0.0).astype(np.float32)

        return cls(ratio(models["good"], models["raw"]), ratio(models["good"], models["low"]), (toxic(0), toxic(1), toxic(0, 1)))

    def score(self, grams: Grams, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's log importance, mean log ratio to low quality, and toxic evidence by all and by the other fold."""
        total = lambda text, x: np.bincount(text, x, minlength=grams.n).astype(float)  # noqa: E731; counts of nothing are whole numbers
        weight = total(grams.word_text, self.importance[grams.words] + self.importance[grams.again]) + total(grams.shape_text, self.importance[grams.shapes])
        low = total(grams.shape_text, self.low[grams.shapes]) + total(grams.word_text, self.low[grams.again])
        count = np.bincount(grams.shape_text, minlength=grams.n) + np.bincount(grams.word_text, minlength=grams.n)
        text, word = grams.distinct_words()
        size = np.bincount(text, minlength=grams.n) + EASE
        other = np.where(fold[text] == 0, self.toxic[1][word], self.toxic[0][word])
        return weight, low / np.maximum(count, 1), total(text, self.toxic[2][word]) / size, total(text, other) / size


def limit(scores: np.ndarray, bad: np.ndarray, weight: float = WEIGHT) -> float:
    """The limit above which scores are rejected: least missed bad ones plus ``weight`` times rejected good ones.

    Of equally good limits the middle of the widest gap; infinite if nothing is bad.
    """
    if not bad.any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, b = scores[order], bad[order].astype(bool)
    cost = np.concatenate([[b.sum()], b.sum() - np.cumsum(b) + weight * np.cumsum(~b)])
    edges = np.concatenate([[s[0] + 1], s, [s[-1] - 1]])
    gaps = edges[:-1] - edges[1:]
    cost = np.where(gaps > 0, cost, np.inf)
    best = np.flatnonzero(cost == cost.min())
    at = best[np.argmax(gaps[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest of a column of doubles, exactly: four rounds of counts by 16 bits, each of 65,536 rows at most."""
    bits = F.col("_bits")
    keyed = df.select(_ordered(column).alias("_bits"))
    prefix, rest = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF))
        some = keyed if shift == 48 else keyed.where(F.shiftrightunsigned(bits, shift + 16) == prefix)
        counts = sorted(some.groupBy(digit.alias("d")).count().collect(), reverse=True)
        for d, n in counts:
            if rest <= n:
                prefix = prefix << 16 | d
                break
            rest -= n
    value = prefix ^ (1 << 63) if prefix >> 63 else ~prefix & ((1 << 64) - 1)
    return float(np.array([value], np.uint64).view(np.float64)[0])


@F.pandas_udf(T.LongType())
def _ordered(x: pd.Series) -> pd.Series:
    """Doubles as longs whose unsigned order is theirs."""
    raw = x.to_numpy(np.float64).view(np.uint64)
    top = np.uint64(1 << 63)
    return pd.Series(np.where(raw & top, ~raw, raw | top).view(np.int64))


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """row (as row_key() gives it), doc_id, kind (label: 0 none, 1 good, 2 low, 3 toxic) and the three scores of each row."""
    text_batches(docs.sparkSession)
    docs = docs.select(row_key(docs["doc_id"], docs["text"]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labels = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    kind = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).otherwise(1)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("kind"))
    part = min(1.0, fit_rows / max(labels.count(), 1))
    labels = labels.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) <= int(part * (1 << 53)))
    sketched = docs.drop("row").join(F.broadcast(labels), "doc_id").mapInArrow(tidy(_sketches), "doc_id long, kind int, h long, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        sketched = sketched.groupBy("kind", m).agg(F.min(F.struct("h", "doc_id", "m0", "m1", "m2")).alias("s")).select("kind", *[F.col(f"s.{c}").alias(c) for c in ("h", "doc_id", "m0", "m1", "m2")])
    fitted = cut(sketched.groupBy("doc_id").agg(F.max("kind").alias("kind")))
    rows = docs.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    counts = rows.join(F.broadcast(fitted), "doc_id", "left").select("text", "fold", F.coalesce("kind", F.lit(0)).alias("kind"))
    models = _summed(counts.mapInArrow(tidy(_counts), "model string, piece int, counts array<long>"))
    ratios = docs.sparkSession.sparkContext.broadcast(Ratios.of(models))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, most=SLICE)):
            weight, low, toxic, other = ratios.value.score(Grams(batch["text"]), batch["fold"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(weight), pa.array(-low), pa.array(toxic), pa.array(other)], ["row", "doc_id", "log_weight", "low_score", "toxic_score", "other_score"])

    schema = f"row {ROW}, doc_id long, log_weight double, low_score double, toxic_score double, other_score double"
    out = rows.select("row", "doc_id", "text", "fold").mapInArrow(tidy(f), schema)
    return cut(out.join(F.broadcast(fitted), "doc_id", "left").withColumn("kind", F.coalesce("kind", F.lit(0))))


def judged(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, row, log_weight, low_score, toxic_score, keep, gumbel_key, selected for each row of docs.

    low_score and toxic_score: evidence against the text; keep: neither is above its limit. The limits come from labelled texts,
    each scored for toxic words by the model of the half that lacks it. selected: among kept rows the ``share`` with the largest sums of
    log_weight and Gumbel noise seeded by row, which draws them without return in proportion to their importance (ties
    at the limit all belong). Null and empty texts have no n-grams and weight 0, and are kept. Rows without a doc_id have
    no label. Without labels all rows are kept. Of labels of one doc_id the worst counts. Other columns are ignored.
    """
    rows = scored(docs, labels, fit_rows)
    known = rows.where("kind > 0").groupBy("doc_id").agg(F.min(F.struct("row", "kind", "low_score", "other_score")).alias("r"))  # a row a label
    known = known.select("r.kind", "r.low_score", "r.other_score").toPandas()
    kind = known["kind"].to_numpy()
    toxic_limit = max(limit(known["other_score"].to_numpy(), kind == 3), 0.0)
    clear = (kind == 1) | (kind == 2)
    low_limit = limit(known["low_score"].to_numpy()[clear], kind[clear] == 2)
    keep = ~((F.col("toxic_score") > toxic_limit) | (F.col("low_score") > low_limit))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "row"), 11).cast("double") + 0.5) / float(1 << 53)
    rows = rows.withColumn("keep", keep).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    kept = rows.where("keep")
    k = int(np.ceil(share * kept.count()))
    least = kth_largest(kept, "gumbel_key", k) if k else float("inf")
    return rows.select("doc_id", "row", "log_weight", "low_score", "toxic_score", "keep", "gumbel_key", (F.col("keep") & (F.col("gumbel_key") >= least)).alias("selected"))


def kept_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, in all their columns whatever their names, that judged() keeps."""
    return by_keys(docs, cut(judged(docs, labels, fit_rows=fit_rows).where("NOT keep").select("row")), "left_anti")


def op6(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels).drop("row")
