"""Substring dedup by fixed-block anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.repeats import BlockAnchors, ExactRepeats, FixedBlocks

WINDOW = 20


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, spans (removed ranges of words).

    Blocks of window // 2 words at fixed distances are the index, all rolling windows of that length probe it, and hits
    grow to maximal exact repeats. Null and empty texts have no words; repeated rows and ids follow ``ExactRepeats``.
    """
    return ExactRepeats(window, BlockAnchors(FixedBlocks((window + 1) // 2)), chunk_bytes).run(docs)


def op2(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"), "spans")


#: The same rows by comparing all windows as text.
OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS k FROM p),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS i FROM g WHERE k > 1),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
j AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT doc_id, len(ws) AS n_words, len(gone) AS n_removed, [{'s': x - 1, 'd': NOT list_contains(gone, x - 1)} FOR x IN list_sort([y + 1 FOR y IN gone])] AS q,
      array_to_string([ws[x] FOR x IN generate_series(1, len(ws)) IF NOT list_contains(gone, x)], ' ') AS kept, list_sort(gone) AS gs FROM j)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256,
  [{'start': a - 1, 'end': list_min([b FOR b IN gs IF b >= a AND NOT list_contains(gs, b + 1)])} FOR a IN gs IF NOT list_contains(gs, a - 1)] AS spans FROM m
"""
