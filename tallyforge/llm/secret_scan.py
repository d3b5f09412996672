"""Secret scan: fixed patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.store import cut
from tallyforge.llm.workers import text_batches, tidy

# Fixed patterns of the base kinds, with the least length of the group that counts, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: What every match of ASSIGN that counts contains; a quick look spares most texts the pattern.
_ASSIGN_SIGN = re.compile(r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""")

#: Runs of these are candidates of the battery; = only ends one, so a name before it is left out.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")
#: Pieces of a run that no alphabet holds as a whole: as base64 and as base64url.
PIECES = (re.compile(r"[A-Za-z0-9+/]{20,}=*"), re.compile(r"[A-Za-z0-9_-]{20,}=*"))
#: Encodings in the order in which they are inferred: the first whose alphabet holds all of a token.
ENCODINGS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {name: frozenset(letters) for name, letters in ENCODINGS.items()}
_RANK = {name: {c: i for i, c in enumerate(letters)} for name, letters in ENCODINGS.items()}
#: A token must look uniform: each test's p-value at least ALPHA. Share of false discoveries among added spans: RATE.
ALPHA, RATE = 1e-3, 0.01
#: p-values are counted in bins of 1 / BINS of a power of ten.
BINS = 20


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in KINDS: matches, leftmost and non-overlapping within each kind."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if _ASSIGN_SIGN.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def encoding_of(token: str) -> str | None:
    letters = set(token.rstrip("="))
    return next((name for name, known in _SETS.items() if letters <= known), None)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[str, int, float, float, float, float] | None:
    """(encoding, n, chi-squared statistic, and p-values of uniformity, runs and lag-1 correlation); None if none fits."""
    name = encoding_of(token)
    if name is None:
        return None
    values = np.array([_RANK[name][c] for c in token.rstrip("=")])
    n, size = len(values), len(ENCODINGS[name])
    if n < 20:
        return None
    counts = np.bincount(values, minlength=size)
    stat = float((counts.astype(float) ** 2).sum() * size / n - n)
    p_uniform = _tail((stat - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    above = values >= size / 2
    ups, downs = int(above.sum()), int(n - above.sum())
    if ups and downs:
        mean = 2 * ups * downs / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((above[1:] != above[:-1]).sum())
        p_runs = 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 0.0
    centred = values - values.mean()
    square = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / square if square else 1.0
    return name, n, stat, p_uniform, p_runs, 2 * _tail(abs(r) * math.sqrt(n))


def tested_tokens(text: str) -> list[tuple]:
    """(start, end, *battery) of each run of 20 or more letters that an alphabet holds, or else of its pieces."""
    out = set()
    for m in TOKEN.finditer(text):
        whole = encoding_of(m.group()) is not None
        spans = [m.span()] if whole else [p.span() for piece in PIECES for p in piece.finditer(text, m.start(), m.end())]
        out.update((a, b, *got) for a, b in spans if (got := battery(text[a:b])))
    return sorted(out)


def ordinary_chance(stat: float, n: int, shares: np.ndarray) -> float:
    """The chance that n letters drawn at the shares of ordinary text look so uniform: P(statistic <= stat).

    The statistic's exact mean and variance under these shares are used, with a normal curve: the longer a token, the
    farther ordinary text lies from uniform, so short tokens rarely pass.
    """
    size = len(shares)
    s2, s3 = float((shares**2).sum()), float((shares**3).sum())
    mean = size / n * (n + n * (n - 1) * s2) - n
    var = (size / n) ** 2 * 2 * n * (n - 1) * max(s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2**2, 1e-12)
    return max(_tail((mean - stat) / math.sqrt(var)), 1e-300)


SCAN = (
    "row long, doc_id long, base array<struct<kind:string,start:int,end:int>>, "
    "tokens array<struct<start:int,end:int,encoding:string,n:int,stat:double,p_uniform:double,p_runs:double,p_serial:double>>, letters array<long>"
)
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_TOKEN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("n", pa.int32()), *[(x, pa.float64()) for x in ("stat", "p_uniform", "p_runs", "p_serial")]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one a batch (row null) with the counts of ASCII bytes in its texts."""
    for batch in batches:
        base, tokens, letters = [], [], np.zeros(128, np.int64)
        for text in batch["text"]:
            text = text.as_py() or ""
            letters += np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)[:128]
            base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in base_spans(text)])
            tokens.append([dict(zip(_TOKEN.names, x, strict=True)) for x in tested_tokens(text)])
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch["row"], pa.nulls(1, pa.int64())]),
                pa.concat_arrays([batch["doc_id"], pa.nulls(1, pa.int64())]),
                pa.array([*base, None], pa.list_(_SPAN)),
                pa.array([*tokens, None], pa.list_(_TOKEN)),
                pa.array([*[None] * n, letters.tolist()], pa.list_(pa.int64())),
            ],
            ["row", "doc_id", "base", "tokens", "letters"],
        )


def ordinary_shares(scanned: DataFrame) -> dict[str, np.ndarray]:
    """Each encoding's shares of letters in the whole corpus; one is added to each count. 128 sums reach the driver."""
    rows = scanned.select(F.posexplode("letters").alias("c", "n")).groupBy("c").agg(F.sum("n")).collect()
    counts = np.ones(128)
    for c, n in rows:
        counts[c] += n
    shares = {name: counts[[ord(c) for c in letters]] for name, letters in ENCODINGS.items()}
    return {name: x / x.sum() for name, x in shares.items()}


def _limits(tested: DataFrame, rate: float) -> DataFrame:
    """For each encoding and length class the largest bin of p0 that Benjamini-Hochberg accepts, from counts of all."""
    counts = tested.groupBy("encoding", "length_class", "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("encoding", "length_class")
    counts = counts.withColumn("all", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(whole.orderBy(F.desc("bin"))))
    kept = counts.where(F.pow(F.lit(10.0), -F.col("bin") / BINS) * F.col("all") <= rate * F.col("upto"))
    return kept.groupBy("encoding", "length_class").agg(F.min("bin").alias("least_bin"))


def scan_secrets(docs: DataFrame, rate: float = RATE, alpha: float = ALPHA) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points, end exclusive), a row for each row of docs.

    spans holds the base spans and those that the battery adds (kind random), by start, then kind as in KINDS. A token
    of 20 or more letters is added if (1) it passes for uniform in its inferred encoding: letter counts, runs and lag-1
    correlation; and (2) text with the corpus's own letter shares would hardly look so, at a share ``rate`` of false
    discoveries among the tokens of its encoding and length class (powers of two). Null texts are empty. Rows without a
    doc_id, repeated rows and empty tables are handled alike; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    text_batches(docs.sparkSession)
    scanned = cut(docs.mapInArrow(tidy(_scan), SCAN))
    shares = ordinary_shares(scanned.where("letters IS NOT NULL"))

    @F.pandas_udf("int")
    def bin_of(encoding: pd.Series, n: pd.Series, stat: pd.Series) -> pd.Series:
        return pd.Series([int(-math.log10(ordinary_chance(s, k, shares[e])) * BINS) for e, k, s in zip(encoding, n, stat, strict=True)], dtype="int32")

    rows = scanned.where("letters IS NULL")
    tested = rows.select("row", F.explode("tokens").alias("t")).distinct().select("row", "t.*")
    tested = tested.where((F.col("p_uniform") >= alpha) & (F.col("p_runs") >= alpha) & (F.col("p_serial") >= alpha))
    tested = tested.withColumn("length_class", F.floor(F.log2("n")).cast("int")).withColumn("bin", bin_of("encoding", "n", "stat"))
    added = tested.join(F.broadcast(_limits(tested, rate)), ["encoding", "length_class"]).where("bin >= least_bin")
    added = added.groupBy("row").agg(F.collect_list(F.struct(F.lit("random").alias("kind"), "start", "end")).alias("added"))
    out = rows.join(added, "row", "left").withColumn("all", F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))))
    ranked = F.expr("transform(array_sort(transform(all, x -> struct(x.start AS start, array_position(array('assign', 'access', 'hex', 'random'), x.kind) AS k, x.kind AS kind, x.end AS end))), x -> struct(x.kind AS kind, x.start AS start, x.end AS end))")
    return out.select("doc_id", "base", ranked.alias("spans"))


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint) AS n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *count, F.sha2(F.encode(_joined("base"), "UTF-8"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
