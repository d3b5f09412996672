import random

import numpy as np
import pytest
import xxhash

from tallyforge.llm import components, simhash_dedup, vector_search

DOCS = "doc_id long, text string, fp string"


def find(links, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(500, 500 + i) for i in range(60)] + [(600 + i, 601 + i) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links + [(9, 9), (None, 5)], "a long, b long")).collect()}
    true = [(a, b) for a, b in links if a != b]
    assert got == find(true, {x for link in true for x in link})
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    values = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def texts():
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(300)) for _ in range(12)]
    rows = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "Zé"
        rows.append((i, " ".join(words), "x"))
    return rows + [(200, None, None), (201, "", None), (202, "\n", None), (203, "one", None), (204, "ONE", None), (205, "a b c d", None), (1, rows[1][1], None), (None, rows[5][1], None), (None, "alone here", None)]


@pytest.mark.parametrize("tile", [2048, 4])
def test_simhash(spark, tile):
    rows = texts()
    prints = {brute_print(t) for _, t, _ in rows}
    roots = find([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4], prints)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            key = roots[brute_print(t)]
            least[key] = min(i, least.get(key, i))
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash_dedup.near_duplicates(docs, tile=tile).collect()), key=repr)
    assert got == sorted(((i, brute_print(t), least.get(roots[brute_print(t)])) for i, t, _ in rows), key=repr)


def test_blocks_grow_with_the_count():
    assert simhash_dedup.blocks_for(1000, 4, 2048) == 6
    many = simhash_dedup.blocks_for(10**10, 4, 2048)
    assert 6 < many and 10**10 >> (64 * (many - 4) // many) <= 1024


def test_simhash_of_nothing(spark):
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def nearest_by_brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            scored = sorted((-float((v * w).sum()), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (1100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in vector_search.nearest(df, k=5, every=20, block=150, query_block=7, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: v for q, v in nearest_by_brute(rows, 20, 5).items() if v}
    assert got == want
    assert vector_search.nearest(df.limit(0)).collect() == []


@pytest.mark.parametrize(("n", "most"), [(500, 0.65), (2000, 0.48), (6000, 0.37)])
def test_recall_of_the_forest(n, most):
    rng = np.random.default_rng(6)
    rows = rng.standard_normal((n, 64)) * rng.choice([1e-30, 1.0, 1e30], (n, 1))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    ids, share = np.arange(n), vector_search.wanted_of(n, 20)
    asked = ids[::20]
    got = vector_search._nearest(rows[asked], asked, rows, ids, 20, share)
    counts = [len(found) for _, found in vector_search.Forest(rows).candidates(rows[asked], int(share * n))]
    assert min(counts) >= int(share * n) and sum(counts) <= most * n * len(asked)  # the forest answers, not a scan
    hits = 0
    for q in asked:
        scores = rows @ rows[q]
        scores[q] = -9
        hits += len(set(np.argsort(-scores)[:20]) & set(got[got["query_id"] == q]["vec_id"]))
    assert hits >= 0.9 * 20 * len(asked)


def test_forest_in_spark(spark):
    rng = np.random.default_rng(7)
    rows = rng.standard_normal((900, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = vector_search.nearest(df, k=10, block=300).collect()
    true = nearest_by_brute([(i, v.tolist()) for i, v in enumerate(rows)], 20, 10)
    assert sum(r.vec_id in true[r.query_id] for r in got) >= 0.9 * 10 * len(true)
    assert all(r.score == pytest.approx(float(rows[r.query_id] @ rows[r.vec_id])) for r in got)


def test_large_vectors_with_small_products():
    rows = np.array([[1e8, 0.0], [1e8, 1e-3], [-1e8, 2e-3], [1e8, 3e-3], [1e200, 1e-3]] * 20)
    rows[:, 1] += np.arange(100) * 1e-6
    got = vector_search._nearest(np.array([[0.0, 1.0]]), np.array([-1]), rows, np.arange(100), 5, 1.0)
    assert list(got["vec_id"]) == np.argsort(-rows[:, 1], kind="stable")[:5].tolist()
