import pytest

from tallyforge.llm import decontamination, mixing, quality, token_file

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def one_of_each_by_brute(rows):
    sets = [[i, set(zip(*[w[k:] for k in range(min(5, len(w)))], strict=False))] for i, w in rows]
    label = list(range(len(sets)))
    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                label = [min(label[x], label[y]) if v in (label[x], label[y]) else v for v in label]
    least = {}
    for at, (i, _) in zip(label, sets, strict=True):
        least[at] = min(i, least.get(at, i))
    return sorted(least.values())


def with_odd_rows(spark):
    """Null, blank, repeated and very long texts, rows without an id, and columns that stages use inside."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    rows = [(1, "the first of all texts here", "en", "src1"), (2, None, None, None), (3, " \n", "en", "src2"), (4, "x", "de", "src1"), (5, long, "en", "src3"), (6, long + " end", "en", "src4"), (None, "no id at all", "en", "src1"), (1, "the first of all texts here", "en", "src1")]
    return spark.createDataFrame([(*r, 0, "a", "b") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string, row string")


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    docs = with_odd_rows(spark)
    docs = docs if rows == "odd" else docs.limit(0)
    columns = docs.columns
    for number, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert docs.columns == columns
        if number == 1:  # copies went: the blank ones, the repeated row and the long text with one word more
            kept = sorted(str(r.doc_id) for r in docs.collect())
            assert kept == (["1", "2", "4", "5", "None"] if rows == "odd" else [])
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and (docs.count() > 0) == (rows == "odd")


def test_each_stage_on_its_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [name for name, _ in pipeline.STAGES]
    assert len(names) == 5
    for number, (_, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if number < 4:
            assert docs.columns == columns
        if number == 0:
            kept = quality.judged(before, spark.read.parquet(f"{SF}/labels.parquet")).where("keep")
            assert ids == sorted(r.doc_id for r in kept.collect())
        elif number == 1:
            assert ids == one_of_each_by_brute([(r.doc_id, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "").split()) for r in before.collect()])
        elif number == 2:
            bad = decontamination.judged(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
            assert ids == sorted({r.doc_id for r in before.collect()} - {r.doc_id for r in bad.collect()})
        elif number == 3:
            taken = mixing.mixed(mixing.leaf_columns(before), mixing.WEIGHTS).collect()
            assert sorted(set(ids)) == sorted(r.doc_id for r in taken if r.taken) and len(ids) == sum(len(r.taken) for r in taken)
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(token_file.default_tokenizer())
            lengths = sorted(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
            assert sorted(r.n_tokens for r in docs.collect()) == lengths
