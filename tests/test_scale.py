"""Rows and bytes of operators grow with their input, not with its square."""

from collections import Counter

import pytest
from plans import most_rows, nodes
from pyspark.sql import functions as F

from tallyforge.operators import evidence, fuzzy, lookup, matching


def test_fuzzy_candidates_meet_by_distinct_values(spark):
    items = spark.range(3000).selectExpr("id AS item_id", "concat('FW', id % 2) AS joint_no", "'VT' AS ndt_method", "'DW001' AS welder_id")
    reports = spark.range(2000).selectExpr("id AS report_id", "'VT' AS ndt_method", "array(named_struct('joint_no', concat('FW', id % 3), 'welder_id', 'DW001')) AS joints")
    out = fuzzy.candidates(items, reports, most=3)
    assert most_rows(out) <= 4 * 3000
    got = {(r.item_id, r["rank"]): (r.report_id, r.score, r.gap) for r in out.collect()}
    assert len(got) == 9000
    assert all(v == (3 * k + i % 2 - 3, 100.0, 0.0) for (i, k), v in got.items())


@pytest.mark.parametrize("score", ["edits", "words"])
def test_names_of_a_block_meet_by_distinct_values(spark, score):
    names = ["hot ring", "hot rings", "blue ring", None, ""]
    rows = spark.createDataFrame([(i, names[i % 7 % 5], i // 1000) for i in range(3000)] + [(3000, "alone", 3), (3001, "hot ring", None)], "item long, name string, block int")
    by = evidence.token_set if score == "words" else lambda a, b: 100 - F.floor(100 * F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))).cast("int")
    out = matching.alike_within(rows, "item", "name", ["block"], by)
    assert most_rows(out) <= 5 * 3002
    pairs = rows.join(rows.select(F.col("item").alias("candidate"), F.col("name").alias("other"), "block"), "block").where("item <> candidate AND item % 1000 < 20")
    want = matching.top_candidates(pairs.select("item", "candidate", by(F.col("name"), F.col("other")).alias("score")), "item", "candidate")
    columns = ["item", "candidate", "score", "rank", "gap"]
    assert Counter(map(tuple, out.where("item % 1000 < 20").select(*columns).collect())) == Counter(map(tuple, want.select(*columns).collect()))


def test_texts_with_ids_of_their_own_are_compared_in_place(spark):
    rows = [(i, f"{i % 7} {i % 7} 12 12 12 -3,5 DN80", [f"{i % 7} 12 12", None, "12 9 9 -3.5"]) for i in range(40)]
    rows += [(100, None, None), (101, "x", ["5"]), (102, "5 5", [])]
    both = [(1, "2 40", ["40", "3"]), (200, "1 1", ["1"]), (200, "1 2", ["1", "2 2"]), (None, "4", ["4"]), (None, "4", ["4"])]
    schema = "id int, candidate string, references array<string>"
    plain = lambda df: Counter((r.id, r.matched, r.total, *map(tuple, (r.invented, r.missing)), round(r.ratio, 9), r.unverified) for r in df.collect())
    alone = spark.createDataFrame(rows, schema)
    assert not [name for name, _ in nodes(evidence.compared_texts(alone)) if "Exchange" in name]
    assert plain(evidence.compared_texts(alone)) == plain(evidence._compared_together(alone))
    every = spark.createDataFrame(rows + both, schema)
    assert plain(evidence.compared_texts(every)) == plain(evidence._compared_together(every))


def test_prefixes_meet_without_a_broadcast(spark):
    import datetime

    day = lambda n: n and datetime.date(2024, 1, n)
    texts = [(t, day(n)) for t in ("D", "D.1", "D.1.A", "D.12", "", None) for n in (None, 1, 3, 5, 9)] * 2
    sets = [("D.1", 4, "b"), ("D.1", 4, "a"), ("D.1", 8, "c"), ("D.1", None, "n"), ("D.1.A.B", 2, "x"), ("D.12", 6, None), ("D.12", 6, "y"), ("D.0", 9, "z"), ("D.11", 1, "w"), ("", 1, "no")]
    asked = spark.createDataFrame(texts, "text string, at date")
    known = spark.createDataFrame([(a, day(n), v) for a, n, v in sets], "number string, created date, value string")
    out = lookup.by_prefix(asked, "text", "at", known, "number", "created", "value")
    assert not [name for name, _ in nodes(out) if "Broadcast" in name]
    want = Counter()
    for text, at in texts:
        found = []
        for number, n, value in sets:
            created = day(n)
            if text and number and (at is None or created and created <= at) and (text.startswith(number) or number.startswith(text)):
                tier = 1 if number == text else 2 if text.startswith(number) else 3
                age = (created is not None, -created.toordinal() if created else 0)
                found.append(((tier, -len(number) if tier == 2 else 0, number, age, value is not None, value or ""), (number, value, tier)))
        want[text, at, *min(found, default=(0, (None, None, None)))[1]] += 1
    assert Counter((r.text, r.at, r.number, r.value, r.tier) for r in out.collect()) == want
