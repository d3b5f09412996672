import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import normalise as n
from tallyforge.functions import notation


def one(spark, make, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], kinds).select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "count", "first", "last"), [
    ("B7", 1, "B7", "B7"),
    ("B7, C8\nD9", 3, "B7", "D9"),
    ("B7,B7 , B8", 2, "B7", "B8"),
    ("B7;B8", 1, "B7;B8", "B7;B8"),  # not a mark of lists
    ("Q2.9÷12", 4, "Q2.9", "Q2.12"),
    ("Q007÷0011", 5, "Q007", "Q011"),
    ("Q7÷Q9", 3, "Q7", "Q9"),
    ("2/7÷2/9", 3, "2/7", "2/9"),
    ("2/7÷3/9", 1, "2/7÷3/9", "2/7÷3/9"),
    ("Q9÷3", 1, "Q9÷3", "Q9÷3"),
    ("Q1÷8000", 8000, "Q1", "Q8000"),
    ("( 2 ÷ 4 )T-7,8", 6, "2T-7", "4T-8"),
    ("K.(08÷11)", 4, "K.08", "K.11"),
    ("K.5.(1÷3)-in,out", 6, "K.5.1-in", "K.5.3-out"),
    ("K.(5÷6)-(in,out)", 4, "K.5-in", "K.6-out"),
    ("(1÷2)(3÷4)", 4, "13", "24"),
    ("(9÷2)K", 1, "(9÷2)K", "(9÷2)K"),
    ("M.3F-(in-1,2,out-4)", 3, "M.3F-in-1", "M.3F-out-4"),
    ("3T.10,11-in,out", 4, "3T.10-in", "3T.11-out"),
    ("T-4.10,11-in,out", 4, "T-4.10-in", "T-4.11-out"),
    ("T7÷8,10-in,out", 8, "T7-in", "T10-out"),
    ("some words", 1, "some words", "some words"),
    ("", 0, None, None),
    (None, 0, None, None),
])
def test_notation(text, count, first, last):
    items = notation.expand(text)
    assert (len(items), items[0] if items else None, items[-1] if items else None) == (count, first, last)


def test_range_inside_jvm_agrees_with_the_grammar(spark):
    cells = ["FW12÷15", "SW0105÷0107", "SW0105÷SW0107", "FW1", "FW5÷2", "", None, "A9÷B12"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", notation.expanded_range(F.col("c")).alias("a"), notation.expanded(F.col("c")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


@pytest.mark.parametrize(("make", "value", "wanted"), [
    (n.match_key, " No. 77-001PT ", "77001PT"),
    (n.match_key, "fw-12", "FW12"),
    (n.method, " visual", "VT"),
    (n.method, "zz", "ZZ"),
    (n.result, "accept", "ACC"),
    (n.drawing_body, "A.B.DC.1.KE.2", "A.B"),
    (n.code_key, "iso 12.1-45_EN", "ISO12145"),
    (n.revision, "rev. c2", "C02"),
    (n.revision, "СО2", "C02"),
    (n.revision, "DC=C03", "C03"),
    (n.revision, "", None),
    (n.revision_rank, "C12", 12),
    (n.revision_rank, "b", 2),
    (n.revision_rank, None, 0),
    (n.thickness, "57x3,5", 3.5),
    (n.thickness, "57xa", None),
    (n.day, "05.08.2024", datetime.date(2024, 8, 5)),
    (n.day, "2024-2-5", datetime.date(2024, 2, 5)),
    (n.day, "13.13.2024", None),
    (n.iso_text, "5.8.24", "2024-08-05"),
    (n.truthy, "Yes", True),
    (n.truthy, "필요", True),
    (n.truthy, None, False),
])
def test_normalisers(spark, make, value, wanted):
    assert one(spark, make, value) == wanted


def test_scope(spark):
    number = "NP.D.P002.1.0UMA&&LAH&&&.015.KE.0001.E"
    assert tuple(one(spark, n.scope, number)) == ("UMA", "LAH")
    assert one(spark, n.scope, "a.b") is None
    assert one(spark, lambda a, b: n.same_scope(n.scope(a), n.scope(b)), number, "a.b") == "unknown"
    assert one(spark, lambda a, b: n.same_scope(n.scope(a), n.scope(b)), number, number) == "yes"


def test_lenient_json(spark):
    for text in ('{"k": 1}', 'x ```json\n{"k": 1}\n``` y', 'see {"k": 1,} end'):
        assert one(spark, lambda c: n.lenient_json(c, "k long")["k"], text) == 1
    assert one(spark, lambda c: n.lenient_json(c, "k long")["k"], "none") is None


def test_reconciled(spark):
    row = spark.sql("select cast(null as double) q, array('a') x").select(notation.reconciled(F.col("q"), F.col("x")).alias("r")).first()
    assert row.r is None
