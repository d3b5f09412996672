"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The index holds postings (document, position, term) of the training tokens. A query item is cut into windows; each window is
sought by its two rarest terms. A first pass counts the terms of all items; the postings of those that some window is
sought by are then stored, and their lists, shifted by the terms' offsets, intersected. What is left is compared word by
word, in the few documents that have any. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.rows import by_keys, row_key, small
from tallyforge.llm.store import cut, new_folder, remove

WINDOW, RATIO = 13, 20
#: Rows of query terms and windows up to which they are broadcast (up to about 100 bytes each, a plan's words included); more
#: are joined by sorting, where Spark splits hot terms.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that end a word: all ASCII but digits and letters.
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with their letters' case kept; null has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _BREAKS), "")


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is much the faster where a text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def text_key(doc_id: Column, text: Column) -> Column:
    """A short key of postings. Documents that share one by chance only have more to compare."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def postings(docs: DataFrame) -> DataFrame:
    """The positional index of docs (doc_id, text): doc (text_key), pos (from 0), term."""
    return docs.select(text_key(docs["doc_id"], docs["text"]).alias("doc"), F.posexplode(words_of(lowered(docs["text"]))).alias("pos", "term"))


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, words (lowered) of each item that has any; repeated rows once."""
    return items.select(F.col("item_id"), words_of(lowered(items["text"])).alias("words")).where(F.size("words") > 0).distinct()


def plans(items: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """Windows of each item by the offsets of their two rarest terms (ties: the further left).

    item_id, words (from the first window's start to the last one's end), lo, hi (starts of these windows), first,
    second (offsets in the item), length (words of a window). A window that lies between others of the same two offsets
    has them too, so lo to hi are all windows of the plan.
    """
    size = F.size("words")
    length = F.least(F.lit(window), size)
    known = items.select("item_id", "words", F.posexplode("words").alias("offset", "term"))
    known = known.join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = known.groupBy("item_id", "words").agg(F.array_sort(F.collect_list(F.struct("offset", "n"))).alias("counts"))
    starts = ranked.select("item_id", "words", "counts", length.alias("length"), F.explode(F.sequence(F.lit(0), size - length)).alias("start"))
    rare = F.array_sort(F.transform(F.slice("counts", F.col("start") + 1, F.col("length")), lambda x: F.struct(x["n"], x["offset"])))
    starts = starts.withColumn("rare", rare).withColumn("first", F.col("rare")[0]["offset"])
    starts = starts.withColumn("second", F.coalesce(F.get("rare", F.lit(1))["offset"], F.col("first")))
    out = starts.groupBy("item_id", "words", "length", "first", "second").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    return out.withColumn("words", F.expr("slice(words, lo + 1, hi - lo + length)"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of the rows of docs with an occurrence: row (row_key), n_words and hits as in occurrences(). Repeated rows once."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    items = cut(query_terms(items))
    terms = cut(items.select(F.explode("words").alias("term")).distinct().withColumn("t", F.xxhash64("term")))
    hashed = postings(docs).select("doc", "pos", F.xxhash64("term").alias("t"))  # terms that share one by chance are told apart below
    frequency = hashed.select("t").join(_small(terms.select("t").distinct()), "t").groupBy("t").agg(F.count("*").alias("n")).join(terms, "t").select("term", "n")
    plan = cut(plans(items, cut(frequency), window).withColumn("plan", F.xxhash64("item_id", "words", "first", "second", "lo")))
    both = F.array(F.struct(F.col("first").alias("offset"), F.lit(1).alias("bit")), F.struct(F.col("second").alias("offset"), F.lit(2).alias("bit")))
    sought = plan.select("plan", "words", "lo", F.explode(both).alias("x"))
    sought = sought.select("plan", F.xxhash64(F.expr("words[x.offset - lo]")).alias("t"), "x.offset", "x.bit")
    at = new_folder(spark, "postings")
    hashed.join(_small(sought.select("t").distinct()), "t").select("doc", "pos", "t").write.parquet(at)
    lists = spark.read.parquet(at).join(_small(sought), "t")
    met = lists.groupBy("doc", "plan", (F.col("pos") - F.col("offset")).alias("shift")).agg(F.bit_or("bit").alias("bits")).where("bits = 3")
    met = cut(met.groupBy("doc", "plan").agg(F.collect_list("shift").alias("shifts")))
    remove(spark, at)
    found = met.join(_small(plan.select("plan", "item_id", "words", "lo", "hi", "length")), "plan")
    found = cut(found.groupBy("doc").agg(F.collect_list(F.struct("item_id", "words", "lo", "hi", "length", "shifts")).alias("found")))
    few = docs.withColumn("doc", text_key(F.col("doc_id"), F.col("text"))).join(small(found.select("doc")), "doc", "left_semi")
    out = few.join(found, "doc")
    out = out.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), words_of(lowered(F.col("text"))).alias("low"), "found")
    out = out.select("row", F.size("low").cast("long").alias("n_words"), F.expr(_VERIFIED).alias("hits")).where(F.size("hits") > 0)
    return cut(out.dropDuplicates(["row"]))


def _small(df: DataFrame) -> DataFrame:
    return small(df, BROADCAST_ROWS)


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows of docs (doc_id, text), with n_words and hits: array of (item_id, start, length) sorted and distinct.

    A hit is an exact occurrence of a window of ``window`` consecutive item words (of all words of a shorter item).
    Null and empty texts have no words and items without words no windows. Repeated rows each get their hits; so do
    rows without a doc_id. Other columns are ignored.
    """
    found = hits(docs, items, window).select("row", "hits")
    rows = docs.select("doc_id", row_key(docs["doc_id"], docs["text"]).alias("row"), F.size(words_of(docs["text"])).cast("long").alias("n_words"))
    out = rows.join(found, "row", "left")
    return out.select("doc_id", "row", "n_words", F.coalesce("hits", F.expr(_NONE)).alias("hits"))


_NONE = "cast(array() AS array<struct<item_id:bigint,start:int,length:int>>)"
#: Of the windows in ``found``, those whose words are the document's at that place.
_VERIFIED = """array_sort(array_distinct(flatten(transform(found, c -> flatten(transform(c.shifts, shift -> transform(
    filter(sequence(c.lo, c.hi), a -> a + shift >= 0 AND a + shift + c.length <= size(low)
           AND slice(low, a + shift + 1, c.length) = slice(c.words, a - c.lo + 1, c.length)),
    a -> struct(cast(c.item_id AS bigint) AS item_id, a + shift AS start, c.length AS length))))))))"""


def proximity(docs: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """doc_id, item_id, start, end of the tightest stretch (leftmost of equals) with all distinct words of an item.

    Only stretches of at most ``slop`` words count, words in any order. Items without words match nothing, and so do
    null texts. Rows without a doc_id match under null; repeated rows once each.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = query_terms(items).select("item_id", F.array_sort(F.array_distinct("words")).alias("terms")).distinct()
    sought = items.select("item_id", F.size("terms").alias("k"), F.posexplode("terms").alias("t", "term"))
    lists = postings(docs).distinct().join(_small(sought), "term")
    met = lists.groupBy("doc", "item_id", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("at"))
    met = met.where(F.size(F.array_distinct("at.t")) == F.col("k"))
    best = F.expr(
        """aggregate(at, struct(array_repeat(-1, k) AS last, 2147483647 AS width, -1 AS start, -1 AS end),
             (acc, x) -> struct(
               transform(acc.last, (p, i) -> if(i = x.t, x.pos, p)) AS last,
               if(x.pos - array_min(transform(acc.last, (p, i) -> if(i = x.t, x.pos, p))) + 1 < acc.width
                  AND array_min(transform(acc.last, (p, i) -> if(i = x.t, x.pos, p))) >= 0,
                  x.pos - array_min(transform(acc.last, (p, i) -> if(i = x.t, x.pos, p))) + 1, acc.width) AS width,
               if(x.pos - array_min(transform(acc.last, (p, i) -> if(i = x.t, x.pos, p))) + 1 < acc.width
                  AND array_min(transform(acc.last, (p, i) -> if(i = x.t, x.pos, p))) >= 0,
                  array_min(transform(acc.last, (p, i) -> if(i = x.t, x.pos, p))), acc.start) AS start,
               if(x.pos - array_min(transform(acc.last, (p, i) -> if(i = x.t, x.pos, p))) + 1 < acc.width
                  AND array_min(transform(acc.last, (p, i) -> if(i = x.t, x.pos, p))) >= 0, x.pos + 1, acc.end) AS end))"""
    )
    met = met.withColumn("best", best).where(F.col("best.width") <= slop)
    keys = docs.select("doc_id", text_key(F.col("doc_id"), F.col("text")).alias("doc"))
    return keys.join(met, "doc").select("doc_id", "item_id", F.col("best.start").alias("start"), F.col("best.end").alias("end"))


def _marks(rows: DataFrame, ratio: int) -> DataFrame:
    hit = "size(array_distinct(flatten(transform(hits, h -> sequence(h.start, h.start + h.length - 1)))))"
    out = rows.withColumn("n_hit", F.expr(hit).cast("long"))
    out = out.withColumn("items", F.array_compact(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string"))))))
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 AND {ratio} * n_hit >= n_words"))


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, ratio: int = RATIO) -> DataFrame:
    """occurrences() with n_hit (words inside hits), items (their ids as strings, sorted) and contaminated.

    contaminated: n_hit > 0 and ratio * n_hit >= n_words. Hits of items without an id count as words, not as items.
    """
    return _marks(occurrences(docs, items, window), ratio)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, ratio: int = RATIO) -> DataFrame:
    """The rows of docs, in all their columns whatever their names, that are not contaminated; as in judged()."""
    return by_keys(docs, cut(_marks(hits(docs, items, window), ratio).where("contaminated").select("row")), "left_anti")


def op1(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = judged(docs, items)
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


#: The same rows by comparing all windows as text.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(ws) - k + 1)) AS s FROM i)),
l AS (SELECT DISTINCT k FROM q),
p AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS s FROM d, l WHERE len(ws) >= k)),
h AS (SELECT p.doc_id, p.s, p.k, q.item_id FROM p JOIN q USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(c, ',' ORDER BY c) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS c FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
