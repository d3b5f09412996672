import random

import pytest

from tallyforge.llm import near_copies, simhash_dedup

pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, _row string, _number string, root string"


def rows_of():
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(8)]
    rows = []
    for i in range(80):
        words = list(base[i % 8])
        for at in rng.sample(range(20), rng.randrange(5)):
            words[10 * at + 5] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    return rows + [(100, None, None), (101, " \n", None), (102, "one two", None), (103, "ONE  two", None), (104, "one three", None), (None, rows[3][1], None), (3, rows[3][1], None), (None, "alone", None)]


def kept_by_brute(rows):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    least = {}
    for at, (i, *_) in zip(label, rows, strict=True):
        least[at] = min(least.get(at, 1 << 62), 1 << 62 if i is None else i)
    return sorted(least.values())


@pytest.mark.parametrize("tile", [near_copies.TILE, 700])
def test_near_copies(spark, tile):
    rows = rows_of()
    kept = near_copies.one_of_each(spark.createDataFrame([(*r[:2], "1", "2", "3") for r in rows], DOCS), tile=tile)
    assert kept.columns == ["doc_id", "text", "_row", "_number", "root"]
    assert {tuple(r)[2:] for r in kept.collect()} == {("1", "2", "3")}
    assert sorted(1 << 62 if r.doc_id is None else r.doc_id for r in kept.collect()) == kept_by_brute(rows)


def test_stage_drops_copies_beyond_op10s_distance(spark):
    rows = rows_of()
    prints = [simhash_dedup.fingerprint(t) for _, t, *_ in rows[:80:8]]
    assert max((a ^ b).bit_count() for a in prints for b in prints) > 4
    kept = pipeline._near_dedup(spark, spark.createDataFrame([(*r[:2], "1", "2", "3") for r in rows], DOCS), "")
    assert kept.count() == len(kept_by_brute(rows))


def test_nothing(spark):
    assert near_copies.near_copies(spark.createDataFrame([], DOCS)).collect() == []


def test_shape_holds_the_similarity():
    rng = random.Random(5)
    import numpy as np
    import pyarrow as pa

    shape = near_copies.Shape.of(200_000, 0.8)
    assert shape.blocks * shape.bits <= 64 * shape.lanes and 1 << shape.bits > 200
    met = far = 0
    for _ in range(300):
        both = [f"w{rng.random()}" for _ in range(160)]
        texts = [" ".join(both + [f"x{rng.random()}" for _ in range(18)]) for _ in (0, 1)]
        found = near_copies.Shingles(pa.array(texts))
        prints = found.fingerprints(shape.lanes)
        values = near_copies.block_values(prints, shape)
        met += bool((values[0] == values[1]).any())
        far += int(np.bitwise_count(prints[0] ^ prints[1]).sum()) > shape.distance
    assert met >= 294 and far <= 3
