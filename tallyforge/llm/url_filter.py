"""URL filter: rules, and gradient-boosted trees on lexical features for what no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.store import cut

# Fixed rules: (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Labelled rows on which trees are fitted: about so many at most, those of least hash, whatever the order of rows.
FIT_ROWS, SEED = 20_000, 17
#: Suffixes up to which their statistics (three short columns) are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 100_000
TREES, DEPTH, RATE, LEAST_LEAF, BINS = 40, 4, 0.2, 8, 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased): after the first :// up to /, ?, # or the end. Path: from there up to ?, # or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and starts the path; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    letters = F.split(text, "")
    distinct = F.array_distinct(letters)
    n = F.greatest(F.char_length(text), F.lit(1))
    share = F.transform(distinct, lambda c: (n - F.char_length(F.replace(text, c))) / n)
    return F.when(F.char_length(text) > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


#: Names of the lexical features, in the order in which trees see them.
FEATURES = ("length", "host_length", "path_length", "depth", "dots", "hyphens", "digit_ratio", "digits_in_host", "parameters", "fragment", "secure", "extension", "last_length", "entropy", "host_entropy", "suffix_share", "suffix_entropy")


def features(pages: DataFrame, suffixes: DataFrame) -> DataFrame:
    """pages (url, host, path) with one double for each name of FEATURES; suffixes as suffix_statistics() gives them."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda text, pattern: F.char_length(F.regexp_replace(text, f"[^{pattern}]", ""))
    last = F.regexp_extract(path, "([^/]*)/?$", 1)
    columns = {
        "length": F.char_length(url),
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "depth": count(path, "/"),
        "dots": count(host, "."),
        "hyphens": count(url, "-"),
        "digit_ratio": count(url, "0-9") / F.greatest(F.char_length(url), F.lit(1)),
        "digits_in_host": count(host, "0-9"),
        "parameters": F.when(F.instr(url, "?") > 0, 1 + count(url, "&")).otherwise(0),
        "fragment": F.instr(url, "#") > 0,
        "secure": F.startswith(url, F.lit("https:")),
        "extension": F.regexp_like(last, F.lit(r"\.[A-Za-z0-9]+$")),
        "last_length": F.char_length(last),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "suffix_share": F.coalesce("suffix_share", F.lit(0.0)),
        "suffix_entropy": F.coalesce("suffix_entropy", F.lit(0.0)),
    }
    out = pages.withColumn("suffix", _suffix(host)).join(suffixes, "suffix", "left")
    return out.withColumns({name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in columns.items()})


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def suffix_statistics(pages: DataFrame) -> DataFrame:
    """For each last label of a host: its share of all rows, and the entropy in bits of first path parts below it."""
    parts = pages.select(_suffix(F.col("host")).alias("suffix"), F.regexp_extract("path", "^/([^/]*)", 1).alias("first"))
    pairs = parts.groupBy("suffix", "first").agg(F.count("*").alias("n"))
    out = pairs.groupBy("suffix").agg(F.sum("n").alias("rows"), (-F.sum(F.col("n") * F.log2("n"))).alias("s"))
    out = out.select("suffix", "rows", (F.log2("rows") + F.col("s") / F.col("rows")).alias("suffix_entropy"))
    total = max(pages.count(), 1)
    return out.select("suffix", (F.col("rows") / total).alias("suffix_share"), F.round("suffix_entropy", 9).alias("suffix_entropy"))


@dataclass(frozen=True)
class Boosted:
    """Regression trees on the logistic loss: per tree arrays (feature, threshold, value); node i has children 2i+1, 2i+2."""

    start: float
    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of block."""
        out = np.full(len(x), self.start)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[node] >= 0
                right = x[np.arange(len(x)), np.maximum(feature[node], 0)] > threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Second-order boosting over histograms of up to BINS quantiles a feature; y is 1 for block."""
    share = min(max(y.mean(), 1e-6), 1 - 1e-6) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Boosted(start, ())
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    score, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        size = 2 ** (DEPTH + 1) - 1
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            g, h = grad[rows], hess[rows]
            value[k] = -RATE * g.sum() / (h.sum() + 1.0)
            if k >= 2**DEPTH - 1 or len(rows) < 2 * LEAST_LEAF:
                continue
            best = (1e-6, 0, 0)
            for f, c in enumerate(cuts):
                b = codes[rows, f]
                n = len(c) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (g, h, None))
                gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
                gain = np.where((nl >= LEAST_LEAF) & (nr >= LEAST_LEAF), gl**2 / (hl + 1) + gr**2 / (hr + 1), 0) - g.sum() ** 2 / (h.sum() + 1)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            if best[0] > 1e-6:
                _, f, at = best
                feature[k], threshold[k] = f, cuts[f][at]
                node[rows] = 2 * k + 1 + (x[rows, f] > cuts[f][at])
        tree = (feature, threshold, np.where(feature < 0, value, 0.0))
        score = score + Boosted(0.0, (tree,)).scores(x)
        out.append(tree)
    return Boosted(start, tuple(out))


def held_out(x: np.ndarray, y: np.ndarray, every: int = 5) -> tuple[float, float]:
    """Accuracy on each ``every``-th row of a model fitted on the others, and that of always giving the commoner verdict."""
    out = np.arange(len(y)) % every == 0
    model = fit(x[~out], y[~out])
    return float(((model.scores(x[out]) > 0) == (y[out] > 0)).mean()), float(max(y[out].mean(), 1 - y[out].mean()))


def judged(pages: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages (page_id, url).

    verdict is the rule's where one fits. Else it is the trees': block where their log-odds are above 0. They are fitted
    on about ``fit_rows`` at most of the rows that rules label, weighing both verdicts as they come. Without labelled rows all
    others are allowed. Null urls and those without :// have empty host and path. Other columns are ignored.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("rule", rule).withColumn("ruled", verdict)
    suffixes = cut(suffix_statistics(pages))
    rows = features(pages, F.broadcast(suffixes) if suffixes.count() <= BROADCAST_ROWS else suffixes)
    labelled = rows.where("ruled IS NOT NULL").select(F.xxhash64(F.lit(SEED), "url", "page_id").alias("h"), (F.col("ruled") == "block").cast("int").alias("y"), *FEATURES)
    part = min(1.0, fit_rows / max(pages.where("ruled IS NOT NULL").count(), 1))
    sample = labelled.where(F.shiftrightunsigned("h", 11) <= int(part * (1 << 53))).toPandas().sort_values(["h", *FEATURES])
    model = fit(sample[list(FEATURES)].to_numpy(float), sample["y"].to_numpy(float))

    @F.pandas_udf(T.DoubleType())
    def score_of(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    rows = rows.withColumn("score", score_of(*FEATURES))
    verdict = F.coalesce("ruled", F.when((F.col("score") > 0) & F.lit(bool(len(sample))), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
