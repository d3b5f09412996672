import pytest
from pyspark.sql import functions as F

from tallyforge import config
from tallyforge.functions import normalise
from tallyforge.operators import basis, evidence, fuzzy, ledger, lookup, matching, rules, search, sequence
from tallyforge.sources import cells, sinks

REPORTS = "report_id string, report_no string, ndt_method string, joints array<struct<joint_no:string,welder_id:string>>"
ITEMS = "item_id int, report_no string, joint_no string, ndt_method string, welder_id string"


def matched(spark, item, reports):
    items = spark.createDataFrame([(1, *item)], ITEMS)
    rows = matching.match_reports(items, spark.createDataFrame(reports, REPORTS)).collect()
    return (rows[0].rule, rows[0].report_id) if rows else None


def test_match_cascade(spark):
    assert matched(spark, (None, "FW99", "PT", None), [("a", None, "PT", []), ("b", "77-001PT", "PT", [])]) is None
    assert matched(spark, ("No. 77-001PT", "FW12", "PT", None), [("b", "77-001PT", "PT", [])]) == (1, "b")
    two = [("a", "x", "PT", [("FW07", None)]), ("b", "y", "PT", [("FW11", None), ("fw-12", None)])]
    assert matched(spark, (None, "FW12", "PT", None), two) == (2, "b")
    assert matched(spark, (None, "FW12", "RT", None), two) is None
    same = [("a", "x", "PT", [("FW12", "A")]), ("b", "y", "PT", [("FW12", "B")])]
    assert matched(spark, (None, "FW12", "PT", "b"), same) == (3, "b")
    assert matched(spark, (None, "FW12", "PT", None), same) is None
    apart = [("a", "x", "PT", [("FW12", "A"), ("FW13", "B")]), ("b", "y", "PT", [("FW12", "C")])]
    assert matched(spark, (None, "FW12", "PT", "B"), apart) is None  # joint and welder stand on different rows


def test_risk_counts_repeats_and_is_bounded(spark):
    row = spark.sql("select array('welder_mismatch','welder_mismatch') a, array_repeat('billed_ndt_not_in_requirements', 3) b, array('?') c")
    assert tuple(row.select(*[rules.risk(F.col(x)) for x in "abc"]).first()) == (10, 100, 0)


def test_verdicts(spark):
    rows = [(["billed_ndt_basis_unclear"], "SUSPECT", "NONCOMPLIANT", "SUSPECT", True), (["required_ndt_missing"], "OK", None, "OK", False), ([], "OK", "NONCOMPLIANT", "NONCOMPLIANT", True), ([], "OK", "odd", "SUSPECT", True), (["result_mismatch"], "NONCOMPLIANT", "OK", "NONCOMPLIANT", True)]
    df = spark.createDataFrame(rows, "f array<string>, own string, model string, final string, disagree boolean")
    final, disagree = rules.reconciled(F.col("own"), F.col("model"), F.col("f"))
    assert df.where((final != F.col("final")) | (disagree != F.col("disagree"))).count() == 0


RULE = ("PT", "weld of plate", None, "q", None, "0.9")


def classified(spark, docs, claim=("PT", "M1", "NP.D.X.1.0UMA&&9PAB&&.1", "plate off")):
    rows = spark.createDataFrame(docs, basis.DOCUMENT)
    claims = spark.createDataFrame([claim], "ndt_method string, discipline string, drawing_no string, report_context string")
    return tuple(basis.classified(claims, rows).select("state", "reason", "docs").first())


def document(n, rules_=(RULE,), kks="0UMA&&9PAB&&", review=False, schema=2, sure="0.8", general=(), sampling=()):
    return (n, f"D{n}", kks, [], review, schema, sure, list(rules_), list(general), list(sampling))


def test_basis_gate(spark):
    silent = [("RT", "t", None, "q", None, "0.9")]
    assert classified(spark, [document(1)]) == ("covered", "covered_by_conditional", ["D1"])
    for bad in (("ALL", *RULE[1:]), (*RULE[:3], "", *RULE[4:]), (*RULE[:4], False, "0.9"), (*RULE[:5], "0.3"), (*RULE[:5], "x")):
        assert classified(spark, [document(1, [bad])])[0] == ("no_basis_found" if bad[0] == "ALL" else "unclear")
    assert classified(spark, [document(1, review=None)])[0] == "unclear"  # no flag counts as flagged
    assert classified(spark, [document(1)], ("PT", "M1", "NP.D.X.1.0UMA&&9PAB&&.1", "repair"))[0] == "unclear"
    assert classified(spark, [document(1, silent)]) == ("no_basis_found", "no_basis_found", ["D1"])
    assert classified(spark, [document(1, silent, general=[("ALL", "sampling")])])[0] == "unclear"
    assert classified(spark, [document(1, silent, sampling=[("PT", "0"), ("PT", "20")])])[0] == "unclear"
    for why, doc in (("scwep_out_of_scope", document(2, silent, kks="0UMB&&9PAB&&")), ("scwep_scope_unknown", document(2, silent, kks=None)), ("scwep_legacy_schema", document(2, silent, schema=1)),
                     ("scwep_doc_needs_review", document(2, silent, review=True)), ("scwep_low_confidence", document(2, silent, sure=None)), ("scwep_extraction_empty", document(2, []))):
        assert classified(spark, [doc, document(3, silent, kks="0UMB&&9PAB&&")]) == ("not_submitted", why, [])
    assert classified(spark, []) == ("not_submitted", "scwep_not_submitted", [])
    assert classified(spark, [document(1)], (" ", None, None, None))[:2] == ("not_submitted", "billed_method_empty")


def test_overbill_switches(spark):
    row = spark.sql("select 'not_submitted' s, 'scwep_legacy_schema' r, array('PT') q, cast(array() as array<string>) e, true f")
    claim = lambda q, f, **on: row.select(rules.overbill_claim(F.col("s"), F.col("r"), F.col(q), f, on)["rule"]).first()[0]
    no = F.lit(False)
    assert claim("q", no) == "billed_ndt_basis_not_submitted"
    assert claim("q", no, require_conditional_schema=False) == claim("q", no, require_submitted_basis=False) == "billed_ndt_not_in_requirements"
    assert claim("e", no, require_submitted_basis=False) == claim("q", F.col("f"), require_submitted_basis=False) == "billed_ndt_basis_not_submitted"
    assert claim("e", no, require_submitted_basis=False, never_claim_on_empty_drawing_requirement=False) == "billed_ndt_not_in_requirements"


def test_joint_fields_by_row(spark):
    reports = spark.createDataFrame([("a", None, "PT", None, [("FW12", "W1")]), ("b", None, "PT", "FW13", [("FW12", "W1")])], "report_id string, report_no string, ndt_method string, joint_no string, joints array<struct<joint_no:string,welder_id:string>>")
    items = spark.createDataFrame([(1, None, "FW12", "PT", None), (2, None, "FW13", "PT", None)], ITEMS)
    assert {r.item_id: r.report_id for r in matching.match_reports(items, reports).collect()} == {1: "a", 2: "b"}


def test_fuzzy_candidates_against_all_pairs(spark):
    import random

    rng = random.Random(6)
    items = [(i, f"FW{rng.randrange(30)}", rng.choice(["PT", "VT"]), f"DW{rng.randrange(40):03}") for i in range(60)]
    reports = [(i, rng.choice(["PT", "VMC"]), [(f"fw{rng.randrange(30)}", f"dw{rng.randrange(40):03} X{rng.randrange(2)}"), ("Z", f"DW{rng.randrange(40)}")]) for i in range(40)]
    one = spark.createDataFrame(items, "item_id int, joint_no string, ndt_method string, welder_id string").withColumn("ndt_method", normalise.method(F.col("ndt_method")))
    two = spark.createDataFrame(reports, "report_id int, ndt_method string, joints array<struct<joint_no:string,welder_id:string>>").withColumn("ndt_method", normalise.method(F.col("ndt_method")))
    got = {(r.item_id, r.report_id): r.score for r in fuzzy.candidates(one, two, most=1000).collect()}
    want = {}
    for i, joint, how, welder in items:
        for j, kind, rows in reports:
            best = [max(evidence.token_set_ratio(a.upper(), b.upper()) for b in bs) for a, bs in ((joint, [r[0] for r in rows]), (welder, [r[1] for r in rows]))]
            if how == {"VMC": "VT"}.get(kind, kind) and best[0] >= 85 and best[1] >= 90:
                want[i, j] = (best[0] + 100 + best[1]) / 3
    assert want and {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_near_keys_of_all_that_score():
    import random

    rng, found = random.Random(3), 0
    for _ in range(3000):
        least, letters = rng.choice([67, 80, 85, 90, 95, 97.5, 50]), rng.choice(["AB", "ABCDEFGH01234567", "ABCD 1"])
        a = rng.choices(letters, k=rng.choice([rng.randrange(1, 15), rng.randrange(15, 60), rng.randrange(60, 90)]))
        b = list(a)
        for _ in range(rng.randrange(int(len(a) * (100 - least) / 50) + 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
        a, b = (fuzzy.words("".join(x)) for x in (a, b))
        if evidence.token_set_ratio(a, b) >= least:
            found += 1
            assert set(fuzzy.near_keys(a, least, True)) & set(fuzzy.near_keys(b, least, False)), (least, a, b)
    assert found > 1500


@pytest.mark.parametrize("welder", [90, 80, 60])
def test_fuzzy_candidates_of_long_welders(spark, welder):
    import random

    rng = random.Random(welder)
    full = ["".join(rng.choices("ABCDEFGHJK0123456789", k=n)) for n in (14, 17, 20, 26, 33, 48)] + ["WELDER 12", "\t"]
    other = lambda s: "".join(c.lower() * (rng.random() > 0.06) + "x" * (rng.random() < 0.06) for c in s)
    items = [(i, f"FW{rng.randrange(3)}", rng.choice(["PT", "VT", "PT VT"]), rng.choice(full)) for i in range(60)]
    items += [(100, "FW1", "VT", "AAAABBBBCCCCDDDDEEEE"), (101, "FW1", "Visual test", "DW1")]
    reports = [(i, rng.choice(["PT", "VT"]), [(f"FW{rng.randrange(3)}", other(rng.choice(full)))]) for i in range(60)]
    reports += [(100, "VT", [("FW1", "AAABBBBCCCDDDDEEEE")]), (101, "Visual", [("FW1", "DW1")])]
    one = spark.createDataFrame(items, "item_id int, joint_no string, ndt_method string, welder_id string")
    two = spark.createDataFrame(reports, "report_id int, ndt_method string, joints array<struct<joint_no:string,welder_id:string>>")
    least = fuzzy.THRESHOLDS | {"welder_id": welder}
    got = {(r.item_id, r.report_id): round(r.score, 6) for r in fuzzy.candidates(one, two, least, most=1000).collect()}
    want = {}
    for i, *asked in items:
        for j, kind, [(joint, name)] in reports:
            scores = [evidence.token_set_ratio(a.upper(), b.upper()) for a, b in zip(asked, (joint, kind, name), strict=True)]
            if all(s >= t for s, t in zip(scores, least.values(), strict=True)):
                want[i, j] = round(sum(scores) / 3, 6)
    assert (100, 100) in want and (101, 101) in want and got == want


def test_settings():
    found = config.settings(None, {"TALLYFORGE_MATCHING__JUDGE_GAP": "5", "TALLYFORGE_DEFAULT_PROVIDER": "big", "OTHER": "1"})
    assert found["matching"]["judge_gap"] == 5 and found["matching"]["hold_gap"] == 5
    with pytest.raises(KeyError):
        config.settings(None, {"TALLYFORGE_MATCHING__NOTHING": "5"})
    with pytest.raises(KeyError):
        config.provider("x", found)
    assert config.provider("x", config.merged(found, {"providers": {"big": {"url": "u"}}}))["retry"]["attempts"] == 5


def test_error_rows_and_sets(spark, tmp_path):
    rows = sinks.with_errors(spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "no string, v int"), {"v given": F.col("v").isNotNull()})
    good, failed = sinks.by_set(rows, "no")
    assert [r.no for r in good.collect()] == ["b"] and [r.error for r in failed.collect()] == ["v given"] * 2
    assert [r[0] for r in rows.select(sinks.guarded(F.array(F.lit("x")), F.col("error"))).collect()].count(["pipeline_row_failed"]) == 1
    old, new = (spark.createDataFrame(x, "round_no int, v int") for x in ([(1, 1), (2, 2)], [(2, 3), (2, 4)]))
    assert sorted(tuple(r) for r in sinks.appended(old, new, "round_no").collect()) == [(1, 1), (2, 3), (2, 4)]
    assert [r.row_index for r in sinks.with_row_index(new.withColumn("o", -F.col("v")), "o").orderBy("o").collect()] == [0, 1]
    with pytest.raises(ValueError, match="is a code"):
        sinks.upsert_standards(*(spark.createDataFrame([("p", t)], "file_path string, type string") for t in ("code", "scwep")))
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", [1.0, float("nan")])], "doc string, vec array<double>")
    vectors.write.parquet(str(tmp_path / "v"))
    assert [r.doc for r in sinks.read_vectors(spark, str(tmp_path / "v"), 2).collect()] == ["a"]
    sinks.write_vectors(vectors, str(tmp_path / "w"), 2)
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2
    sinks.guide({"one": old, "two": new}, str(tmp_path / "g"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "g" / "two")).count() == 2
    assert cells.read_review(spark, str(tmp_path / "g" / "one"), ["v"]).count() == 2
    with pytest.raises(ValueError, match="missing columns: x"):
        cells.read_review(spark, str(tmp_path / "g" / "one"), ["x"])


def test_request_keys_keep_places(spark):
    row = spark.sql("select 'x' a, cast(null as string) b, 'y' c, '' d")
    keys = row.select(*[normalise.request_key(*[F.col(c) for c in cs]) for cs in ("abc", "ac", "adc", "abbc")]).first()
    assert len(set(keys)) == 4


def test_lenient_json_leaves_strings_alone(spark):
    texts = ['{"k": "a,}b // c", /* no */ "n": [1, 2,],}', 'Sure: {"k": "x"} // end\n done', "```json\n{\"k\": \"y\",}\n```", "none"]
    got = [r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalise.lenient_json(F.col("t"), "k string")["k"].alias("k")).collect()]
    assert got == ["a,}b // c", "x", "y", None]


def test_violations(spark):
    df = spark.createDataFrame([(None,), ("x",), ("NaN",), ("5",)], "v string")
    found = rules.violations([("v", F.col("v"), "range", rules.within(F.col("v"), 0, 9), "high")])
    assert [r[0] for r in df.select(F.size(found)).collect()] == [0, 1, 1, 0]


def test_budget(spark):
    claims = spark.createDataFrame([(1, 0, "100", 1), (1, 1, "100", 1), (1, 2, "1 00", 1), (1, 3, "7", 1), (1, 4, "8", 1), (2, 0, "5", None), (3, 0, "5", 9)], "row int, ordinal int, value string, page int")
    pages = spark.createDataFrame([(1, "100 and 100, not 1000 or x7")], "page int, text string")
    got = {(r.row, r.ordinal): r.outcome for r in evidence.budget(claims, pages).collect()}
    assert got == {(1, 0): "kept", (1, 1): "kept", (1, 2): "over", (1, 3): "kept", (1, 4): "absent", (2, 0): "unverifiable", (3, 0): "unsupported"}


def test_similarity():
    assert evidence.token_set_ratio("FW12", "FW12 A") == 100
    assert evidence.token_set_ratio("", "a") == 0
    assert evidence.partial_ratio("weld", "the weld is") == 1
    assert 0.5 < evidence.partial_ratio("wald", "the weld is") < 1


def test_islands_and_absorption(spark):
    pages = spark.createDataFrame([("d", i, x) for i, x in enumerate([None, "A", "A", None, "B", "A"])], "doc string, page int, number string")
    runs = {(r.number, r.first_page): (r.last_page, r.disjoint, r.confidence) for r in sequence.islands(pages, "doc", "page", "number").collect()}
    assert runs == {("A", 1): (2, True, 0.55), ("A", 5): (5, True, 0.55), ("B", 4): (4, False, 0.95)}
    got = [(r.segment, r.absorbed) for r in sequence.absorbed(pages, "doc", "page", "number").orderBy("page").collect()]
    assert got == [(None, False), ("A", False), ("A", False), ("A", True), ("B", False), ("A", False)]


def test_chunks(spark):
    df = spark.createDataFrame([("",), (None,), ("x" * 1200,), ("x" * 1201,), ("x" * 2200,)], "t string")
    got = [[(c.start, len(c.text)) for c in r.c] for r in df.select(sequence.chunks(F.col("t")).alias("c")).collect()]
    assert got == [[], [], [(0, 1200)], [(0, 1200), (1000, 201)], [(0, 1200), (1000, 1200)]]


def test_packed(spark):
    pages = spark.createDataFrame([("d", 0, "ab"), ("d", 1, "c" * 70), ("d", 2, "e"), ("f", 0, None)], "doc string, page int, text string")
    got = [(r.doc, r.window, r.content) for r in sequence.packed(pages, "doc", "page", "text", 50).orderBy("doc", "window").collect()]
    part = lambda k, text: f"---PAGE 2--- (part {k})\n{text}\n\n"
    assert got == [("d", 1, "---PAGE 1---\nab\n\n"), ("d", 2, part(1, "c" * 26)), ("d", 3, part(2, "c" * 26)), ("d", 4, part(3, "c" * 18)), ("d", 5, "---PAGE 3---\ne\n\n"), ("f", 1, "---PAGE 1---\n\n\n")]


def test_absorption_needs_the_page_before(spark):
    pages = spark.createDataFrame([("d", i, x) for i, x in [(0, "A"), (1, None), (3, None), (4, "B"), (5, None)]], "doc string, page int, number string")
    got = {(r.number, r.first_page): (r.last_page, r.absorbed_pages, r.confidence) for r in sequence.segments(pages, "doc", "page", "number").collect()}
    assert got == {("A", 0): (1, [1], 0.7), (None, 3): (3, [], 0.2), ("B", 4): (5, [5], 0.7)}


def test_folded_by_judge(spark):
    rows = [("d", 0, None, None), ("d", 1, "a", None), ("d", 2, None, (False, 0.8)), ("d", 3, "a", (True, 0.9)), ("d", 4, "b", None)]
    turns = spark.createDataFrame(rows, "doc string, page int, no string, judge struct<is_new:boolean,confidence:double>")
    got = [(r.segment, r.first_page, r.last_page, r.no, round(r.confidence, 4)) for r in sequence.folded(turns, "doc", "page", ["no"], "judge").orderBy("segment").collect()]
    assert got == [(1, 0, 0, None, 1.0), (2, 1, 2, "a", 0.7), (3, 3, 3, "a", 0.9), (4, 4, 4, "b", 0.95)]


def test_digits_and_layers(spark):
    rows = spark.createDataFrame([(1, "1,250 0,125 DN100 UGB95GML +3 4.", ["1250 100", "0.125 3 3 4"]), (2, "none", ["1"])], "id int, candidate string, references array<string>")
    got = {r.id: (r.matched, r.total, r.invented, r.missing, r.unverified) for r in evidence.compared_texts(rows).collect()}
    assert got == {1: (5, 5, [], ["3"], False), 2: (0, 0, [], [], True)}
    pages = spark.createDataFrame([("d", i, "KKS code 10PAB02BR005") for i in range(25)] + [("e", 0, "a\n____\nb\nc")], "doc string, page int, text string")
    assert {r.doc: (r.clean, r.quality) for r in evidence.layer_quality(pages, "doc", "page").collect()} == {"d": (12, 1.0), "e": (0, 0.0)}
    assert evidence.sampled_pages(pages, "doc", "page").where("doc = 'd'").count() == 12


def test_cited_revision(spark):
    sets = spark.createDataFrame([("D", 1, "C01"), ("D", 2, "C02,C03")], "no string, set_id int, revision string")
    asked = spark.createDataFrame([("D", 2, "C01"), ("D", 2, "C09"), ("D", 2, None)], "no string, set_id int, cited string")
    got = sorted((r.cited or "", r.set_id, r.flag) for r in lookup.cited_revision(asked, sets, "no").collect())
    assert got == [("", 2, None), ("C01", 1, None), ("C09", 2, "not loaded: C09")]


def test_tokens(spark):
    df = spark.createDataFrame([("Weld 12.3-4 и ГОСТ 용접검사 é",), (None,)], "t string")
    got = [sorted(r[0]) for r in df.select(search.tokens(F.col("t"))).collect()]
    assert got == [sorted(["weld", "12.3-4", "12", "гост", "용접검사", "용접", "접검", "검사"]), []]


def test_quotas_sum_up(spark):
    strata = spark.createDataFrame([("a", 50), ("b", 30), ("c", 5)], "stratum string, size long")
    assert sum(r.quota for r in ledger.quotas(strata, 20).collect()) == 20


def test_upsert_is_null_safe(spark):
    old = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    new = spark.createDataFrame([(None, 3), ("b", 4)], "k string, v int")
    assert sorted((r.k or "", r.v) for r in ledger.upsert(old, new, ["k"]).collect()) == [("", 3), ("a", 2), ("b", 4)]
    assert sorted((r.k or "", r.v) for r in sinks.get_or_create(old, new, ["k"]).collect()) == [("", 1), ("a", 2), ("b", 4)]


def test_workbook_cells(spark):
    head = [("s", 2, 0, "Report No"), ("s", 2, 1, "Joint No"), ("s", 2, 2, "Method")]
    rows = [*head, ("s", 1, 0, "Title"), ("s", 3, 0, "77"), ("s", 3, 1, "FW1"), ("s", 3, 2, "PT"), ("s", 4, 0, "78"), ("s", 4, 2, "PT")]
    good, skipped = cells.claims(spark.createDataFrame(rows, "sheet string, row int, col int, value string"))
    assert [(r.report_no, r.joint_no) for r in good.collect()] == [("77", "FW1")]
    assert [r.report_no for r in skipped.collect()] == ["78"]


def test_pruned_editions(spark):
    files = spark.createDataFrame([("a/X.pdf",), ("a/X_scan.pdf",), ("a/Y.R.pdf",), ("a/Y.E.pdf",), ("a/Z.R.pdf",)], "path string")
    assert sorted(r.path for r in cells.pruned_editions(files).collect()) == ["a/X.pdf", "a/Y.E.pdf", "a/Z.R.pdf"]
