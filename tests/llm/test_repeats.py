import hashlib
import random

import pytest
import xxhash

from tallyforge.llm import substring_dedup, suffix_dedup
from tallyforge.llm.repeats import Chunk, FixedBlocks
from tallyforge.llm.wordcodes import Words, pack_sorted, rolling, slices, unpack_sorted

SCHEMA = "doc_id long, text string, n_words string"


def hashed(text):
    value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def brute(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashed(r[1]), r[1] or "")):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if key in seen:
                gone[i : i + length] = [True] * length
            seen.add(key)
        out.append((doc_id, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def corpus(seed, length):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(6 * length)]
    rows = []
    for i in range(60):
        text = [rng.choice(["é", "A", "a"]) + str(rng.randrange(60)) for _ in range(rng.randrange(3 * length))]
        for _ in range(rng.randrange(3)):
            at, n = rng.randrange(len(base)), rng.randrange(2 * length)
            text[len(text) // 2 : len(text) // 2] = base[at : at + n]
        rows.append((i * 7 % 60, rng.choice([" ", "\n", "\x0b "]).join(text), "clash"))
    return rows + [(100, None, None), (101, "", None), (102, " \n", None), (None, rows[3][1], None), (103, rows[3][1], None), (103, rows[3][1], None), (104, "x " * 500, None)]


@pytest.mark.parametrize(("module", "length"), [(substring_dedup, 20), (suffix_dedup, 50)])
@pytest.mark.parametrize("chunk", [1 << 20, 3000])
def test_against_all_windows(spark, module, length, chunk):
    rows = corpus(1, length)
    got = module.remove_repeats(spark.createDataFrame(rows, SCHEMA), chunk_bytes=chunk).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute([r[:2] for r in rows], length)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_empty_table(spark):
    for module in (substring_dedup, suffix_dedup):
        assert module.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_too_small_a_window_is_refused(spark):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA), window=20)


def test_queries(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for query, length in ((substring_dedup.op2, 20), (suffix_dedup.op7, 50)):
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in query(spark, "/root/testdata/sf0.001").collect())
        assert got == sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows, length))


def test_words_and_packing():
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["a b", None, " c\td ", "", "é\x85x"])
    words = Words(texts)
    assert [bytes(words.data[s:e]).decode() for s, e in zip(words.starts, words.ends, strict=True)] == ["a", "b", "c", "d", "é\x85x"]
    assert list(np.diff(words.first)) == [2, 0, 2, 0, 1]
    values = np.unique(rolling(words.codes(), 1))
    assert (unpack_sorted(pack_sorted(values)) == values).all()
    batch = pa.RecordBatch.from_arrays([pa.array(["aaa", "b", None, "c" * 9])], ["text"])
    assert [p.num_rows for p in slices(batch, most=4)] == [3, 1]


def test_anchors_cover_every_window():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    words = Words(pa.array([" ".join(str(rng.randrange(5)) for _ in range(400))]))
    codes = words.codes()
    _, index, blocks = FixedBlocks(10).probes(words, codes)
    suffixes = suffix_dedup.minimisers(Chunk(None, None, words, codes), 6, 35, 16)
    for at, span, window in ((np.sort(blocks[index]), 10, 20), (suffixes, 16, 50)):
        assert all(((at >= s) & (at + span <= s + window)).any() for s in words.window_starts(window))


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


@pytest.mark.parametrize(("module", "length"), [(substring_dedup, 20), (suffix_dedup, 50)])
def test_words_made_to_collide_under_polynomials(spark, module, length):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(length - 1))
    rows = [(1, f"{same} {word}", "x"), (2, f"{same} {other}", "x"), (3, f"{same} {word}", "x"), (4, "é" * 700 + f" {same} {'y' * 3000}", "x"), (5, f"{same} {'y' * 3000}", "x")]
    got = {r.doc_id: r.n_removed for r in module.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 0, 3: length, 4: 0, 5: length}


def test_many_rows_without_an_id_or_of_one_id_are_cut_into_chunks(spark):
    rows = [r[:2] for r in corpus(3, 20)]
    rows = [(None if i % 3 else 7, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = substring_dedup.remove_repeats(docs, chunk_bytes=1000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute(rows, 20)


def test_neighbours_over_edges_of_runs():
    import pyarrow as pa

    def run(values):
        batch = lambda part: pa.RecordBatch.from_pydict({"head": pa.array(part, pa.binary()), "chunk": pa.array([0] * len(part), pa.int32()), "at": pa.array([int(x[1:]) for x in part], pa.int32())})
        return [r["at"] for part in suffix_dedup._neighbours(iter([batch(p) for p in values])) for r in part.to_pylist()]

    cut = lambda x: [v.ljust(2, b"0") for v in x]
    assert run([]) == []
    assert run([cut([b"a1"])]) == [1]
    assert run([cut([b"11"]), cut([b"11", b"12"])]) == [1, 1, 2]
    assert run([cut([b"11", b"12", b"14"]), [], cut([b"14", b"15", b"13", b"13"])]) == [1, 4, 4, 3, 3]
