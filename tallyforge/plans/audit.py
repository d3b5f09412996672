"""Queries on matching, rules, verdicts and rollups, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import basis, matching, rules
from tallyforge.plans.roles import _item_id, LINES_SQL, REQUIRED_SQL, billing, reports, requirements, table

#: State of the basis of a claim: a stand-in for the documents' outcome, by supplier.
STATE = "CASE l_suppkey % 4 WHEN 0 THEN 'no_basis_found' WHEN 1 THEN 'not_submitted' WHEN 2 THEN 'unclear' ELSE 'covered' END"

_NORM = "upper(replace(replace(replace(regexp_replace(trim({0}), '(?i)^no\\.\\s*', ''), ' ', ''), '-', ''), '_', ''))"
_HITS_SQL = f"""{LINES_SQL},
b AS (SELECT item_id, {_NORM.format("report_no")} AS r, {_NORM.format("joint_no")} AS j, ndt_method AS m, welder_id AS w FROM lines WHERE side = 'O'),
c AS (SELECT DISTINCT full_no AS id, {_NORM.format("full_no")} AS r, {_NORM.format("joint_no")} AS j, ndt_method AS m, welder_id AS w FROM lines WHERE side = 'F'),
hits AS (
  SELECT item_id, 1 AS rule, count(DISTINCT id) AS n_reports, min(id) AS report_id FROM b JOIN c ON b.r = c.r GROUP BY item_id
  UNION ALL SELECT item_id, 2, count(DISTINCT id), min(id) FROM b JOIN c ON b.j = c.j AND b.m = c.m GROUP BY item_id
  UNION ALL SELECT item_id, 3, count(DISTINCT id), min(id) FROM b JOIN c ON b.j = c.j AND b.m = c.m AND b.w = c.w GROUP BY item_id),
matched AS (SELECT item_id, rule, report_id, 100 AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rule) AS k FROM hits WHERE n_reports = 1) WHERE k = 1)"""

_WEIGHT = " ".join(f"WHEN '{name}' THEN {w}" for name, (w, _) in rules.FINDINGS.items())
_HARD = ", ".join(f"'{n}'" for n, (_, c) in rules.FINDINGS.items() if c == "hard")
_SUSPECT = ", ".join(f"'{n}'" for n, (_, c) in rules.FINDINGS.items() if c == "suspect")
_FINDINGS_SQL = f"""{_HITS_SQL}, {REQUIRED_SQL},
gated AS (SELECT l.*, q.required, q.set_flagged, m.report_id, m.rule, m.score,
    CASE WHEN (q.set_flagged OR len(q.required) = 0) AND l_suppkey % 4 = 0 THEN 'not_submitted' ELSE {STATE} END AS state
  FROM lines l LEFT JOIN matched m USING (item_id) LEFT JOIN requirements q USING (l_partkey) WHERE side = 'O'),
found AS (SELECT *, list_filter([
    CASE WHEN report_id IS NULL THEN 'no_matching_report' END,
    CASE WHEN required IS NULL THEN 'drawing_requirement_missing' END,
    CASE WHEN NOT list_contains(required, ndt_method) THEN CASE state WHEN 'no_basis_found' THEN 'billed_ndt_not_in_requirements'
      WHEN 'not_submitted' THEN 'billed_ndt_basis_not_submitted' WHEN 'unclear' THEN 'billed_ndt_basis_unclear' ELSE 'billed_ndt_covered_by_scwep' END END,
    CASE WHEN len(list_filter(required, lambda x: x <> ndt_method)) > 0 THEN 'required_ndt_missing' END], lambda x: x IS NOT NULL) AS findings FROM gated),
judged AS (SELECT *, least(100, coalesce(list_sum([CASE x {_WEIGHT} ELSE 0 END FOR x IN findings]), 0))::INT AS risk,
    CASE WHEN list_has_any(findings, [{_HARD}]) THEN 'NONCOMPLIANT' WHEN list_has_any(findings, [{_SUSPECT}]) OR report_id IS NULL THEN 'SUSPECT' ELSE 'OK' END AS verdict FROM found)"""


def match_cascade(spark, sf_dir: str) -> DataFrame:
    return matching.match_reports(billing(spark, sf_dir), reports(spark, sf_dir))


def match_ambiguity(spark, sf_dir: str) -> DataFrame:
    return matching.ambiguity(billing(spark, sf_dir), reports(spark, sf_dir))


def judged(spark, sf_dir: str) -> DataFrame:
    """Claims with match, findings, risk and verdict."""
    items = billing(spark, sf_dir)
    matched = matching.match_reports(items, reports(spark, sf_dir))
    rows = items.join(matched, "item_id", "left").join(requirements(spark, sf_dir), "l_partkey", "left")
    rows = rows.withColumn("basis_state", F.expr(STATE)).withColumn("drawing_no", F.lit(None).cast("string"))
    rows = rules.compliance(rows.withColumnRenamed("welder_id", "welder"))
    rows = rows.withColumn("risk", rules.risk(F.col("findings")))
    return rows.withColumn("verdict", rules.verdict(F.col("findings"), F.col("report_id").isNotNull(), F.col("score")))


def compliance_findings(spark, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("item_id", F.array_join("findings", ",").alias("findings"))


def risk_score(spark, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("item_id", "risk")


def review_rollup(spark, sf_dir: str) -> DataFrame:
    """The flagship: per round and verdict the claims, their risk and the money at stake."""
    high = F.sum(F.when(F.col("risk") >= 60, 1).otherwise(0)).alias("n_high_risk")
    return judged(spark, sf_dir).groupBy("round_no", "verdict").agg(F.count("*").alias("n_items"), F.sum("risk").alias("risk_total"), F.max("risk").alias("risk_max"), high, F.sum("amount").alias("amount"))


def verdict_reconcile(spark, sf_dir: str) -> DataFrame:
    """Final verdicts where a model's opinion (by line number) is at hand."""
    rows = judged(spark, sf_dir).withColumn("model", F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'NONCOMPLIANT' WHEN 2 THEN 'odd' END"))
    final, disagree = rules.reconciled(F.col("verdict"), F.col("model"), F.col("findings"))
    return rows.groupBy("verdict", F.coalesce("model", F.lit("-")).alias("model"), final.alias("final"), disagree.alias("disagree")).agg(F.count("*").alias("n"))


def review_reasons(spark, sf_dir: str) -> DataFrame:
    """needs_review and its reasons with their origin."""
    rows = judged(spark, sf_dir)
    reasons = F.array_compact(F.array(
        F.when(F.col("report_id").isNull(), "[match] no single report"),
        F.when(F.col("rule") > 1, F.concat(F.lit("[match] by rule "), F.col("rule").cast("string"))),
        F.when(F.col("set_flagged"), "[drawing] set needs review"),
        F.when(F.col("risk") >= 80, "[compliance] high risk"),
    ))
    return rows.select("item_id", (F.size(reasons) > 0).alias("needs_review"), F.array_join(reasons, "; ").alias("reasons"))


def basis_rollup(spark, sf_dir: str) -> DataFrame:
    """Rows by round and state of the basis, all four states always there; alarms of a silent gate."""
    rows = judged(spark, sf_dir).where("required IS NOT NULL AND NOT array_contains(required, ndt_method)")
    counts = rows.groupBy("round_no").pivot("basis_state", ["covered", "unclear", "no_basis_found", "not_submitted"]).agg(F.count(F.lit(1))).na.fill(0)
    total = F.col("covered") + F.col("unclear") + F.col("no_basis_found") + F.col("not_submitted")
    return counts.select("round_no", "covered", "unclear", "no_basis_found", "not_submitted", ((total > 0) & (F.col("no_basis_found") == 0)).alias("never_confirms"))


def overbill_underbill(spark, sf_dir: str) -> DataFrame:
    """Per part: billed methods against required ones, status, rows and amounts over."""
    items = billing(spark, sf_dir)
    billed = items.groupBy("l_partkey").agg(F.collect_set("ndt_method").alias("billed"))
    pairs = billed.join(requirements(spark, sf_dir), "l_partkey")
    over, under = F.array_except("billed", "required"), F.array_except("required", "billed")
    status = F.when(F.col("required").isNull(), "unknown").when((F.size(over) > 0) & (F.size(under) > 0), "both").when(F.size(over) > 0, "over").when(F.size(under) > 0, "under").otherwise("OK")
    joined = lambda x: F.array_join(F.array_sort(F.coalesce(x, F.array().cast("array<string>"))), ",")
    out = pairs.select("l_partkey", joined(F.col("billed")).alias("billed"), joined(over).alias("over"), joined(under).alias("under"), status.alias("status"))
    money = items.join(requirements(spark, sf_dir), "l_partkey").where("NOT array_contains(required, ndt_method)")
    money = money.groupBy("l_partkey").agg(F.count("*").alias("over_rows"), F.sum("amount").alias("over_amount"))
    return out.join(money, "l_partkey", "left").na.fill({"over_rows": 0}).withColumn("over_amount", F.coalesce("over_amount", F.lit(0).cast("decimal(38,2)")))


def confirmed_amounts(spark, sf_dir: str) -> DataFrame:
    """Overbilled money by round, split into confirmed and unproven."""
    rows = judged(spark, sf_dir).where("NOT array_contains(required, ndt_method)")
    sure = F.array_contains("findings", "billed_ndt_not_in_requirements")
    zero = F.lit(0).cast("decimal(18,2)")
    return rows.groupBy("round_no").agg(F.sum(F.when(sure, F.col("amount")).otherwise(zero)).alias("confirmed"), F.sum(F.when(sure, zero).otherwise(F.col("amount"))).alias("unproven"), F.count("*").alias("n"))


def item_match_finding(spark, sf_dir: str) -> DataFrame:
    """Review list: claims with their match and findings, in the order of the dashboard."""
    rows = judged(spark, sf_dir).where("risk >= 30")
    return rows.select("item_id", "round_no", F.coalesce("report_id", F.lit("")).alias("report_id"), F.size("findings").alias("n_findings"), "risk", "verdict").orderBy(F.desc("risk"), "item_id")


def rule_violations(spark, sf_dir: str) -> DataFrame:
    """Structural checks of customers and orders: one row a violation."""
    customer, order = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    one = rules.violations([
        ("c_acctbal", F.col("c_acctbal"), "range", rules.within(F.col("c_acctbal"), 0, 1e9), "medium"),
        ("c_name", F.col("c_name"), "regex", F.col("c_name").rlike("^Customer#[0-9]+[02468]$"), "low"),
        ("c_mktsegment", F.col("c_mktsegment"), "enum", F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "MACHINERY"), "high"),
    ])
    two = rules.violations([
        ("o_totalprice", F.col("o_totalprice"), "range", rules.within(F.col("o_totalprice"), 0, 250000), "medium"),
        ("o_orderstatus", F.col("o_orderstatus"), "enum", F.col("o_orderstatus").isin("O", "F"), "high"),
    ])
    rows = customer.select(F.lit("customer").alias("entity"), F.col("c_custkey").alias("id"), F.explode(one).alias("v"))
    rows = rows.union(order.select(F.lit("orders"), "o_orderkey", F.explode(two)))
    return rows.select("entity", "id", F.col("v.field").alias("field"), F.col("v.rule").alias("rule"), F.col("v.severity").alias("severity"))


def violation_summary(spark, sf_dir: str) -> DataFrame:
    rows = rule_violations(spark, sf_dir).groupBy("entity", "id").agg(*[F.sum((F.col("severity") == s).cast("long")).alias(s) for s in ("high", "medium", "low")])
    return rows.withColumn("needs_review", (F.col("high") > 0) | (F.col("medium") >= 3))


def basis_truth_table(spark, sf_dir: str) -> DataFrame:
    """The state for all combinations of two documents' outcomes."""
    bit = lambda n: f"id % {2 * n} >= {n}"
    rows = spark.range(64).selectExpr("id AS key", f"stack(2, 1, {bit(1)}, {bit(2)}, {bit(4)}, 'first', 2, {bit(8)}, {bit(16)}, {bit(32)}, 'second') AS (ordinal, strong, weak, eligible, reason)")
    return rules.basis_state(rows)


def procedures(spark, sf_dir: str) -> DataFrame:
    """Nations as procedure documents: their rules, scopes and flaws by their numbers."""
    rule = "named_struct('ndt_method', {m}, 'trigger', {t}, 'trigger_keywords', {k}, 'quote', {q}, 'quote_verified', {v}, 'confidence', {c})"
    one = rule.format(m="element_at(array('PT', ' vt', 'UT'), cast(n_nationkey % 3 + 1 AS int))", t="if(n_nationkey % 7 = 6, ' ', 'return of goods')", k="if(n_nationkey % 2 = 0, array('RETURN', ' '), cast(array() AS array<string>))",
                      q="if(n_nationkey % 5 = 4, '', 'as seen')", v="if(n_nationkey % 6 = 0, false, if(n_nationkey % 6 = 1, cast(null AS boolean), true))", c="if(n_nationkey % 4 = 3, 'high', cast(0.5 + n_nationkey * 0.02 AS string))")
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey AS bigint) AS ordinal", "concat('NP.D.X.1.0UM', substr(n_name, 1, 1), '&&PA', substr(n_name, 2, 1), '&&&.1') AS document_no", "cast(null AS string) AS kks",
        "if(n_nationkey % 3 = 0, cast(array() AS array<string>), array('AIR', concat(' ', lower('mail')), 'SHIP')) AS disciplines", "if(n_nationkey % 8 = 5, true, if(n_nationkey % 8 = 6, null, false)) AS needs_review",
        "cast(if(n_nationkey % 9 = 8, 1, 2) AS int) AS schema_version", "if(n_nationkey % 10 = 9, 'n/a', '0.8') AS confidence",
        f"if(n_nationkey % 4 = 2, cast(array() AS array<struct<ndt_method:string,trigger:string,trigger_keywords:array<string>,quote:string,quote_verified:boolean,confidence:string>>), array({one})) AS conditional",
        "if(n_nationkey % 11 = 10, array(named_struct('ndt_method', 'ALL', 'topic', 'sampling')), if(n_nationkey % 5 = 1, array(named_struct('ndt_method', 'RT', 'topic', 'sampling')), cast(array() AS array<struct<ndt_method:string,topic:string>>))) AS general",
        "if(n_nationkey % 12 = 11, array(named_struct('ndt_method', 'UT', 'rate_pct', '20')), array(named_struct('ndt_method', 'UT', 'rate_pct', '0'))) AS sampling",
    )


def _asked(spark, sf_dir: str) -> DataFrame:
    """Lines as claims: a method, a discipline, a drawing whose codes some documents share, and what the report says."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CASE l_returnflag WHEN 'A' THEN 'PT' WHEN 'N' THEN 'VT' ELSE if(l_linenumber = 7, ' ', 'ut ') END AS ndt_method", "element_at(array('AIR', 'mail', null, 'TRUCK'), cast(l_suppkey % 4 + 1 AS int)) AS discipline",
        "if(l_linenumber > 4, concat('NP.D.X.1.0UM', element_at(array('A', 'C', 'I'), cast(l_linenumber % 3 + 1 AS int)), '&&PAL&&&.1'), null) AS drawing_no", "if(l_linestatus = 'O', element_at(array('TAKE BACK RETURN', 'the goods came', 'none'), cast(l_partkey % 3 + 1 AS int)), '') AS report_context")


def basis_gate(spark, sf_dir: str) -> DataFrame:
    """The state of each kind of claim's basis by all procedure documents."""
    out = basis.classified(_asked(spark, sf_dir), procedures(spark, sf_dir))
    text = lambda c: F.coalesce(c, F.lit("~"))
    return out.select("ndt_method", text("discipline").alias("discipline"), text("drawing_no").alias("drawing_no"), "report_context", "state", "reason", F.coalesce("trigger", F.lit("")).alias("trigger"), F.array_join("docs", "|").alias("docs"))


def basis_alarms(spark, sf_dir: str) -> DataFrame:
    """Rounds with their states, reasons, the document that covers most, and the alarms of a silent gate."""
    rows = judged(spark, sf_dir)
    gate = F.get(F.filter("findings", lambda x: F.startswith(x, F.lit("billed_"))), F.lit(0))
    state = F.when(gate.isNotNull(), F.expr(STATE))
    found = rows.select("round_no", "item_id", F.coalesce(gate, F.get("findings", F.lit(0))).alias("rule"), state.alias("basis_state"), F.when(state == "not_submitted", F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string"))).alias("basis_reason"),
                        F.when(state == "covered", F.array(F.concat(F.lit("D"), (F.col("l_suppkey") % 2 + F.col("round_no") % 2).cast("string")))).alias("basis_docs"))
    missing = rows.where(F.array_contains("findings", "drawing_requirement_missing")).select("round_no", "item_id", F.lit("drawing_requirement_missing").alias("rule"), *[F.lit(None).cast(t).alias(c) for c, t in (("basis_state", "string"), ("basis_reason", "string"), ("basis_docs", "array<string>"))])
    out = basis.rollup(found.where("rule IS NOT NULL AND rule <> 'drawing_requirement_missing'").unionByName(missing), "round_no")
    return out.withColumn("suppression_reasons", F.coalesce("suppression_reasons", F.lit(""))).withColumn("top_doc", F.coalesce("top_doc", F.lit(""))).withColumn("top_rows", F.coalesce("top_rows", F.lit(0)))


def full_compliance(spark, sf_dir: str) -> DataFrame:
    """Lines with a report, joints, requirements and flags in which every finding occurs; names, risk, verdict and reasons."""
    joint = "array(named_struct('joint_no', concat(' fw', l_linenumber), 'result', if(l_tax > 0.06, 'REJ', 'acc'), 'welder_id', concat('W', l_suppkey % 9)), named_struct('joint_no', 'FW99', 'result', 'REJ', 'welder_id', 'W1'))"
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        f"{_item_id()} AS item_id", "if(l_partkey % 29 = 0, 'NP.D.ke.1', 'NP.D.1') AS drawing_no", "if(l_partkey % 31 = 0, 'X.KE', null) AS report_drawing_no", "if(l_linenumber = 6, null, concat('FW', l_linenumber)) AS joint_no",
        "element_at(array('VMC', 'Dye Penetrant', 'ut', ' '), cast(l_linenumber % 4 + 1 AS int)) AS ndt_method", "if(l_discount > 0.07, 'ACC', null) AS result", "concat('w', l_suppkey % 10) AS welder_id",
        "if(l_partkey % 6 = 0, null, l_orderkey) AS report_id", f"if(l_partkey % 6 = 0, null, if(l_linenumber = 6 AND l_partkey % 2 = 1, slice({joint}, 1, 1), {joint})) AS joints",
        "CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN cast(array() AS array<string>) WHEN 2 THEN array('Visual Test', 'PT') WHEN 3 THEN array('UT', ' ') ELSE array('rt', 'vt') END AS required",
        "l_partkey % 4 = 0 AS set_flagged", "element_at(array('covered', 'unclear', 'no_basis_found', 'not_submitted'), cast(l_orderkey % 4 + 1 AS int)) AS basis_state", "concat('why', l_orderkey % 4) AS basis_reason",
        "l_partkey % 37 = 0 AS reference_flagged", "l_partkey % 41 = 0 AS violations", "l_partkey % 43 = 0 AS corrected", "l_partkey % 47 = 0 AS failed")
    rows = rules.compliance(rows)
    verdict = rules.verdict(F.col("findings"), F.col("report_id").isNotNull(), F.lit(100))
    return rows.select("item_id", F.array_join("findings", ",").alias("findings"), rules.risk(F.col("findings")).alias("risk"), verdict.alias("verdict"), F.coalesce("claim_reason", F.lit("")).alias("claim_reason"),
                       F.array_join(F.coalesce("still_required", F.array().cast("array<string>")), ",").alias("still_required"), F.coalesce("extra_method", F.lit("")).alias("extra_method"), F.coalesce("refs_of", F.lit("")).alias("refs_of"))


QUERIES = {
    "q01_review_rollup": review_rollup,
    "q02_match_cascade": match_cascade,
    "q03_match_ambiguity_report": match_ambiguity,
    "q14_rule_engine_violations": rule_violations,
    "q15_violation_summary": violation_summary,
    "q18_basis_gate_state": basis_gate,
    "q18b_basis_alarms": basis_alarms,
    "q21b_compliance_all_findings": full_compliance,
    "q19_basis_truth_table": basis_truth_table,
    "q21_compliance_findings": compliance_findings,
    "q22_risk_score": risk_score,
    "q23_verdict_reconcile": verdict_reconcile,
    "q24_review_reasons": review_reasons,
    "q25_silence_alarms": basis_rollup,
    "q26_overbill_underbill": overbill_underbill,
    "q27_confirmed_vs_unproven_amounts": confirmed_amounts,
    "q60_item_match_finding_report": item_match_finding,
}

_VIOLATIONS_SQL = """v AS (SELECT 'customer' AS entity, c_custkey AS id, 'c_acctbal' AS field, 'range' AS rule, 'medium' AS severity FROM customer WHERE NOT c_acctbal BETWEEN 0 AND 1e9
  UNION ALL SELECT 'customer', c_custkey, 'c_name', 'regex', 'low' FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]+[02468]$')
  UNION ALL SELECT 'customer', c_custkey, 'c_mktsegment', 'enum', 'high' FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
  UNION ALL SELECT 'orders', o_orderkey, 'o_totalprice', 'range', 'medium' FROM orders WHERE NOT o_totalprice BETWEEN 0 AND 250000
  UNION ALL SELECT 'orders', o_orderkey, 'o_orderstatus', 'enum', 'high' FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))"""
_OUTSIDE = "required IS NOT NULL AND NOT list_contains(required, ndt_method)"

SQL = {
    "q01_review_rollup": f"WITH {_FINDINGS_SQL} SELECT round_no, verdict, count(*) AS n_items, CAST(sum(risk) AS BIGINT) AS risk_total, max(risk) AS risk_max, CAST(sum(CASE WHEN risk >= 60 THEN 1 ELSE 0 END) AS BIGINT) AS n_high_risk, sum(amount) AS amount FROM judged GROUP BY ALL",
    "q02_match_cascade": f"WITH {_HITS_SQL} SELECT item_id, rule, report_id, score FROM matched",
    "q03_match_ambiguity_report": f"WITH {_HITS_SQL} SELECT r.rule, CASE WHEN n_reports IS NULL THEN 'none' WHEN n_reports = 1 THEN 'one' ELSE 'many' END AS outcome, count(*) AS n_items FROM b CROSS JOIN (VALUES (1), (2), (3)) r(rule) LEFT JOIN hits h ON h.item_id = b.item_id AND h.rule = r.rule GROUP BY ALL",
    "q14_rule_engine_violations": f"WITH {_VIOLATIONS_SQL} SELECT * FROM v",
    "q15_violation_summary": f"WITH {_VIOLATIONS_SQL} SELECT entity, id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'high') > 0 OR count(*) FILTER (severity = 'medium') >= 3 AS needs_review FROM v GROUP BY entity, id",
    "q18_basis_gate_state": """WITH d AS (SELECT n_nationkey AS k, 'NP.D.X.1.0UM' || substr(n_name, 1, 1) || '&&PA' || substr(n_name, 2, 1) || '&&&.1' AS no, 'UM' || substr(n_name, 1, 1) || '/PA' || substr(n_name, 2, 1) AS code,
      CASE WHEN k % 3 = 0 THEN [] ELSE ['AIR', 'MAIL', 'SHIP'] END AS ds, k % 8 IN (5, 6) AS flagged, k % 9 = 8 AS old, k % 10 = 9 AS unsure, k % 4 <> 2 AS cond, ['PT', 'VT', 'UT'][k % 3 + 1] AS cm,
      k % 7 <> 6 AND k % 5 <> 4 AND k % 6 <> 0 AND k % 4 <> 3 AND 0.5 + k * 0.02 >= 0.6999999 AS whole, k % 11 = 10 AS allg, k % 11 <> 10 AND k % 5 = 1 AS rtg, k % 12 = 11 AS sampled, CASE WHEN k % 2 = 0 THEN ['return'] ELSE ['return', 'goods'] END AS words FROM nation),
    q AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'PT' WHEN 'N' THEN 'VT' ELSE CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'ut ' END END AS ndt_method, ['AIR', 'mail', NULL, 'TRUCK'][l_suppkey % 4 + 1] AS discipline,
      CASE WHEN l_linenumber > 4 THEN ['A', 'C', 'I'][l_linenumber % 3 + 1] END AS letter, CASE WHEN l_linestatus = 'O' THEN ['TAKE BACK RETURN', 'the goods came', 'none'][l_partkey % 3 + 1] ELSE '' END AS report_context FROM lineitem),
    p AS (SELECT *, upper(trim(ndt_method)) AS m, CASE WHEN letter IS NOT NULL THEN CASE WHEN code = 'UM' || letter || '/PAL' THEN 'yes' ELSE 'no' END WHEN discipline IS NULL OR len(ds) = 0 THEN 'unknown' WHEN list_contains(ds, upper(discipline)) THEN 'yes' ELSE 'no' END AS scope FROM q, d),
    f AS (SELECT *, scope <> 'no' AND cond AND cm = m AND whole AND NOT flagged AND (report_context = '' OR len([w FOR w IN words IF contains(lower(report_context), w)]) > 0) AS s, cond AND cm = m AS hit FROM p),
    g AS (SELECT *, scope <> 'no' AND (hit AND NOT s OR allg OR m = 'UT' AND sampled) AS w, CASE WHEN scope = 'unknown' THEN 'scwep_scope_unknown' WHEN scope = 'no' THEN 'scwep_out_of_scope' WHEN old THEN 'scwep_legacy_schema' WHEN flagged THEN 'scwep_doc_needs_review' WHEN unsure THEN 'scwep_low_confidence' WHEN NOT cond AND NOT allg AND NOT rtg THEN 'scwep_extraction_empty' END AS why FROM f),
    x AS (SELECT ndt_method, discipline, letter, report_context, any_value(m) AS m, bool_or(s) AS s, bool_or(w) AS w, bool_or(why IS NULL) AS e, first(coalesce(why, '') ORDER BY k) AS first_why, coalesce(list_sort(list_distinct(list(no) FILTER (s))), []) AS sn, coalesce(list_sort(list_distinct(list(no) FILTER (w))), []) AS wn, coalesce(list_sort(list_distinct(list(no) FILTER (why IS NULL))), []) AS en FROM g GROUP BY ALL)
    SELECT ndt_method, coalesce(discipline, '~') AS discipline, coalesce('NP.D.X.1.0UM' || letter || '&&PAL&&&.1', '~') AS drawing_no, report_context, CASE WHEN m = '' THEN 'not_submitted' WHEN s THEN 'covered' WHEN w THEN 'unclear' WHEN e THEN 'no_basis_found' ELSE 'not_submitted' END AS state,
      CASE WHEN m = '' THEN 'billed_method_empty' WHEN s THEN 'covered_by_conditional' WHEN w THEN 'mentioned_without_condition' WHEN e THEN 'no_basis_found' ELSE first_why END AS reason, CASE WHEN m <> '' AND s THEN 'return of goods' ELSE '' END AS trigger,
      array_to_string(CASE WHEN m = '' THEN [] WHEN s THEN sn WHEN w THEN wn WHEN e THEN en ELSE [] END, '|') AS docs FROM x""",
    "q18b_basis_alarms": f"""WITH {_FINDINGS_SQL}, r AS (SELECT round_no, item_id, l_suppkey, list_filter(findings, lambda x: starts_with(x, 'billed_'))[1] AS gate, findings FROM judged),
      g AS (SELECT *, CASE WHEN gate IS NOT NULL THEN {STATE} END AS s FROM r WHERE len(findings) > 0),
      k AS (SELECT round_no, count(*) FILTER (s = 'covered') AS covered, count(*) FILTER (s = 'unclear') AS unclear, count(*) FILTER (s = 'no_basis_found') AS no_basis_found, count(*) FILTER (s = 'not_submitted') AS not_submitted,
        count(DISTINCT item_id) AS rows_with_findings, count(DISTINCT item_id) FILTER (list_contains(findings, 'drawing_requirement_missing')) AS unevaluated_rows FROM g GROUP BY round_no),
      w AS (SELECT round_no, string_agg('r' || z || ' ' || n, ', ' ORDER BY 'r' || z || ' ' || n) AS reasons FROM (SELECT round_no, l_suppkey % 3 AS z, count(*) AS n FROM g WHERE s = 'not_submitted' GROUP BY ALL) GROUP BY round_no),
      t AS (SELECT round_no, 'D' || d AS top_doc, n AS top_rows FROM (SELECT round_no, l_suppkey % 2 + round_no % 2 AS d, count(*) AS n FROM g WHERE s = 'covered' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY round_no ORDER BY n DESC, d) = 1)
      SELECT k.*, coalesce(reasons, '') AS suppression_reasons, coalesce(top_doc, '') AS top_doc, coalesce(top_rows, 0) AS top_rows, covered + unclear + no_basis_found + not_submitted = 0 AND unevaluated_rows > 0 AS gate_idle,
        covered + unclear + no_basis_found + not_submitted > 0 AND no_basis_found = 0 AS never_confirms, coalesce(covered > 0 AND top_rows / covered >= 0.3 AND top_rows >= 3, false) AS one_covers FROM k LEFT JOIN w USING (round_no) LEFT JOIN t USING (round_no)""",
    "q21b_compliance_all_findings": f"""WITH a AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(round(l_extendedprice * 100) AS BIGINT)) AS item_id, l_partkey AS p, l_suppkey AS z, l_orderkey AS o, l_linenumber AS n, l_tax, l_discount,
        ['VT', 'PT', 'UT', ''][l_linenumber % 4 + 1] AS m, CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN ['VT', 'PT'] WHEN 3 THEN ['UT'] ELSE ['RT', 'VT'] END AS q FROM lineitem),
      b AS (SELECT *, m <> '' AND q IS NOT NULL AND NOT list_contains(q, m) AS outside, o % 4 AS st, CASE WHEN p % 6 = 0 THEN NULL WHEN n = 6 AND p % 2 = 0 THEN NULL WHEN l_tax > 0.06 THEN 'REJ' ELSE 'ACC' END AS rr, CASE WHEN p % 6 = 0 OR n = 6 AND p % 2 = 0 THEN NULL ELSE z % 9 END AS rw FROM a),
      c AS (SELECT *, CASE WHEN st <> 2 THEN NULL WHEN len(q) = 0 THEN 'drawing_requirement_empty' WHEN p % 4 = 0 THEN 'drawing_set_flagged' END AS block, list_sort([x FOR x IN q IF x <> m]) AS others FROM b),
      d AS (SELECT *, list_filter([CASE WHEN p % 29 = 0 OR p % 31 = 0 THEN 'drawing_no_is_ke_misentry' END, CASE WHEN p % 6 = 0 THEN 'no_matching_report' END, CASE WHEN q IS NULL THEN 'drawing_requirement_missing' END,
        CASE WHEN outside THEN CASE WHEN st = 2 AND block IS NULL THEN 'billed_ndt_not_in_requirements' WHEN st = 3 OR block IS NOT NULL THEN 'billed_ndt_basis_not_submitted' WHEN st = 1 THEN 'billed_ndt_basis_unclear' ELSE 'billed_ndt_covered_by_scwep' END END,
        CASE WHEN m <> '' AND len(others) > 0 THEN 'required_ndt_missing' END, CASE WHEN l_discount > 0.07 AND rr = 'REJ' THEN 'result_mismatch' END, CASE WHEN rw <> z % 10 THEN 'welder_mismatch' END,
        CASE WHEN p % 37 = 0 THEN 'low_confidence_code_ref' END, CASE WHEN p % 41 = 0 THEN 'rule_engine_violation' END, CASE WHEN p % 43 = 0 THEN 'ocr_auto_corrected' END, CASE WHEN p % 47 = 0 THEN 'pipeline_row_failed' END], lambda x: x IS NOT NULL) AS f FROM c)
      SELECT item_id, array_to_string(f, ',') AS findings, least(100, coalesce(list_sum([CASE x {_WEIGHT} ELSE 0 END FOR x IN f]), 0))::INT AS risk, CASE WHEN list_has_any(f, [{_HARD}]) THEN 'NONCOMPLIANT' WHEN list_has_any(f, [{_SUSPECT}]) THEN 'SUSPECT' ELSE 'OK' END AS verdict,
        CASE WHEN outside THEN coalesce(block, 'why' || st) ELSE '' END AS claim_reason, CASE WHEN m <> '' THEN coalesce(array_to_string(others, ','), '') ELSE '' END AS still_required, CASE WHEN outside THEN m ELSE '' END AS extra_method, CASE WHEN q IS NULL THEN 'authority' WHEN outside THEN 'claim' ELSE '' END AS refs_of FROM d""",
    "q19_basis_truth_table": """SELECT k AS key, CASE WHEN k % 2 >= 1 OR k % 16 >= 8 THEN 'covered' WHEN k % 4 >= 2 OR k % 32 >= 16 THEN 'unclear' WHEN k % 8 >= 4 OR k % 64 >= 32 THEN 'no_basis_found' ELSE 'not_submitted' END AS state,
      CASE WHEN k = 0 THEN 'first' END AS reason FROM range(64) t(k)""",
    "q21_compliance_findings": f"WITH {_FINDINGS_SQL} SELECT item_id, array_to_string(findings, ',') AS findings FROM judged",
    "q22_risk_score": f"WITH {_FINDINGS_SQL} SELECT item_id, risk FROM judged",
    "q23_verdict_reconcile": f"""WITH {_FINDINGS_SQL},
      m AS (SELECT verdict, findings, CASE l_linenumber % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'NONCOMPLIANT' WHEN 2 THEN 'odd' END AS model FROM judged),
      s AS (SELECT *, CASE verdict WHEN 'OK' THEN 0 WHEN 'SUSPECT' THEN 1 ELSE 2 END AS own, CASE model WHEN 'OK' THEN 0 WHEN 'odd' THEN 1 WHEN 'NONCOMPLIANT' THEN 2 END AS g,
        list_has_any(findings, ['billed_ndt_basis_not_submitted', 'billed_ndt_basis_unclear', 'billed_ndt_covered_by_scwep']) AS capped FROM m)
      SELECT verdict, coalesce(model, '-') AS model, ['OK', 'SUSPECT', 'NONCOMPLIANT'][1 + greatest(own, coalesce(CASE WHEN capped THEN least(g, 1) ELSE g END, 0))] AS final, coalesce(g <> own, false) AS disagree, count(*) AS n FROM s GROUP BY ALL""",
    "q24_review_reasons": f"""WITH {_FINDINGS_SQL}, r AS (SELECT item_id, list_filter([CASE WHEN report_id IS NULL THEN '[match] no single report' END, CASE WHEN rule > 1 THEN concat('[match] by rule ', rule) END,
      CASE WHEN set_flagged THEN '[drawing] set needs review' END, CASE WHEN risk >= 80 THEN '[compliance] high risk' END], lambda x: x IS NOT NULL) AS x FROM judged)
      SELECT item_id, len(x) > 0 AS needs_review, array_to_string(x, '; ') AS reasons FROM r""",
    "q25_silence_alarms": f"""WITH {_FINDINGS_SQL}, g AS (SELECT round_no, {STATE} AS s FROM judged WHERE {_OUTSIDE})
      SELECT round_no, count(*) FILTER (s = 'covered') AS covered, count(*) FILTER (s = 'unclear') AS unclear, count(*) FILTER (s = 'no_basis_found') AS no_basis_found, count(*) FILTER (s = 'not_submitted') AS not_submitted,
        count(*) > 0 AND count(*) FILTER (s = 'no_basis_found') = 0 AS never_confirms FROM g GROUP BY round_no""",
    "q26_overbill_underbill": f"""WITH {LINES_SQL}, {REQUIRED_SQL}, i AS (SELECT * FROM lines WHERE side = 'O'),
      p AS (SELECT l_partkey, list_sort(list(DISTINCT ndt_method)) AS billed FROM i GROUP BY l_partkey),
      x AS (SELECT *, list_sort(list_filter(billed, lambda m: NOT list_contains(required, m))) AS o, list_sort(list_filter(required, lambda m: NOT list_contains(billed, m))) AS u FROM p JOIN requirements USING (l_partkey)),
      m AS (SELECT l_partkey, count(*) AS over_rows, sum(amount) AS over_amount FROM i JOIN requirements USING (l_partkey) WHERE {_OUTSIDE} GROUP BY l_partkey)
      SELECT l_partkey, array_to_string(billed, ',') AS billed, CASE WHEN required IS NULL THEN '' ELSE array_to_string(o, ',') END AS over, CASE WHEN required IS NULL THEN '' ELSE array_to_string(u, ',') END AS under,
        CASE WHEN required IS NULL THEN 'unknown' WHEN len(o) > 0 AND len(u) > 0 THEN 'both' WHEN len(o) > 0 THEN 'over' WHEN len(u) > 0 THEN 'under' ELSE 'OK' END AS status,
        coalesce(over_rows, 0) AS over_rows, coalesce(over_amount, 0) AS over_amount FROM x LEFT JOIN m USING (l_partkey)""",
    "q27_confirmed_vs_unproven_amounts": f"WITH {_FINDINGS_SQL} SELECT round_no, sum(CASE WHEN list_contains(findings, 'billed_ndt_not_in_requirements') THEN amount ELSE 0 END) AS confirmed, sum(CASE WHEN list_contains(findings, 'billed_ndt_not_in_requirements') THEN 0 ELSE amount END) AS unproven, count(*) AS n FROM judged WHERE {_OUTSIDE} GROUP BY round_no",
    "q60_item_match_finding_report": f"WITH {_FINDINGS_SQL} SELECT item_id, round_no, coalesce(report_id, '') AS report_id, CAST(len(findings) AS INT) AS n_findings, risk, verdict FROM judged WHERE risk >= 30",
}
