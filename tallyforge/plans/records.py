"""Queries on checks of fields, scalar normalisers, workbooks, civil reports, sheets of results and drawings, with SQL for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import headers, normalise, notation
from tallyforge.operators import basis, civil, dashboard, fuzzy, geometry, ledger, requests, rules
from tallyforge.plans.audit import _FINDINGS_SQL, STATE, judged
from tallyforge.plans.roles import LINES_SQL, REQUIRED_SQL, table
from tallyforge.sources import cells, sinks


def pick(values: list[str | None], number: str) -> Column:
    """One of the values, by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(number) % len(values) + 1).cast("int"))


def _listed(found: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(found, lambda v: F.concat_ws(":", v["field"], v["rule"], v["severity"]))), " ")


METHODS, RESULTS, NUMBERS = ["VT", "vmc ", "XX", None, "rt"], ["ACC", "p", "no", None], ["77-005PT", " 7-1 vmc", "77-5", "5PT", None]
DRAWINGS, JOINTS, WELDERS = ["NP.D.N000.1.0UMA&&PAB&&&.021.DC.0001.E_C02", "NP.D.1", None], ["FW12", "fw19a", "12", "F1-2", None], ["DW001 DW003", "7", "", "A1 x y", None]
DAYS, AMOUNTS = ["2024-01-31", "31.1.2024", "31/13/2024", "2024/1/2", "soon", None], ["12.5", "-1", "NaN", "1e13", "x", None]


def claim_violations(spark, sf_dir: str) -> DataFrame:
    """Orders as claims with fields of every kind, and what the checks find."""
    fields = {"ndt_method": pick(METHODS, "o_orderkey"), "result": pick(RESULTS, "o_orderkey"), "report_no": pick(NUMBERS, "o_custkey"), "drawing_no": pick(DRAWINGS, "o_orderkey"), "joint_no": pick(JOINTS, "o_custkey + o_orderkey"),
              "inspection_date": pick(DAYS, "o_orderkey"), "welder_id": pick(WELDERS, "o_orderkey"), "unit_price": pick(AMOUNTS, "o_custkey"), "amount": pick(AMOUNTS, "o_orderkey")}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in fields.items()])
    found = rows.select("o_orderkey", rules.billing_violations(lambda n: F.col(n)).alias("v"))
    return found.select("o_orderkey", _listed(F.col("v")).alias("found"), rules.summary(F.col("v"))["needs_review"].alias("needs_review"))


def report_violations(spark, sf_dir: str) -> DataFrame:
    """Customers as reports with two joints each, named by their place where a check fails."""
    joint = lambda n: F.struct(pick(RESULTS, f"c_custkey + {n}").alias("result"), pick(JOINTS, f"c_custkey + {n}").alias("joint_no"), pick(WELDERS, f"c_custkey + {n}").alias("welder_id"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(NUMBERS, "c_custkey").alias("report_no"), pick(METHODS, "c_custkey").alias("ndt_method"), pick(DAYS, "c_custkey").alias("inspection_date"), pick(DRAWINGS, "c_custkey").alias("drawing_no"), F.when(F.col("c_custkey") % 4 > 0, F.array(joint(0), joint(1))).alias("joints"))
    return rows.select("c_custkey", _listed(rules.report_violations(lambda n: F.col(n))).alias("found"))


CODES, CLASSES, SEISMIC, PRESSURES, PERCENTS = ["40PAB02BR005", "PAB", "10AB", None], ["2", "4n", "5", None], ["II", "iv", None], ["18", "51", "x", None], ["100", "-", "", "101", "all", None]


def drawing_violations(spark, sf_dir: str) -> DataFrame:
    """Parts as drawings with a line and a row of the inspection matrix."""
    line = F.struct(pick(CODES, "p_partkey").alias("kks_code"), pick(CLASSES, "p_partkey").alias("safety_class"), pick(SEISMIC, "p_partkey").alias("seismic"), pick(PRESSURES, "p_partkey").alias("design_pressure_mpag"), pick(PRESSURES, "p_partkey + 1").alias("design_temperature_c"))
    row = F.struct(pick(CODES, "p_size").alias("kks_code"), *[pick(PERCENTS, f"p_partkey + {i}").alias(f) for i, f in enumerate(rules.MATRIX_FIELDS)])
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(DRAWINGS, "p_partkey").alias("drawing_no"), F.array(line).alias("kks_lines"), F.array(row).alias("inspection_matrix"))
    asked = F.array_join(F.filter(F.array(*[F.when(rules.is_required(F.col("inspection_matrix")[0][f]), F.lit(f)) for f in rules.MATRIX_FIELDS]), lambda x: x.isNotNull()), ",")
    return rows.select("p_partkey", _listed(rules.drawing_violations(lambda n: F.col(n))).alias("found"), asked.alias("required"))


def _sql_pick(values: list[str | None], number: str) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][CAST(({number}) % {len(values)} AS INT) + 1]"


def _bad(field: str, values: list[str | None], number: str, bad: dict[str, tuple[str, str]]) -> str:
    """The violation of a field by its picked value: value to (rule, severity)."""
    cases = " ".join(f"WHEN {v!r} THEN '{field}:{r}:{s}'" for v, (r, s) in bad.items())
    return f"CASE {_sql_pick(values, number)} {cases} END"


_ENUM, _PATTERN, _LOW, _RANGE, _TYPE, _DATE, _TOKEN = ("enum_violation", "high"), ("regex_violation", "medium"), ("regex_violation", "low"), ("range_violation", "medium"), ("type_violation", "high"), ("date_format_violation", "high"), ("welder_token_pattern", "low")
_METHOD_BAD, _RESULT_BAD, _NUMBER_BAD, _DRAWING_BAD = {"XX": _ENUM}, {"no": _ENUM}, {"77-5": _PATTERN, "5PT": _PATTERN}, {"NP.D.1": _PATTERN}
_JOINT_BAD, _WELDER_BAD, _DAY_BAD, _AMOUNT_BAD = {"12": _LOW, "F1-2": _LOW}, {"7": _TOKEN, "A1 x y": _TOKEN}, {"31/13/2024": _DATE, "soon": _DATE}, {"-1": _RANGE, "NaN": _RANGE, "x": _TYPE}


def _violations_sql(parts: list[str]) -> str:
    return f"list_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"


def scalars(spark, sf_dir: str) -> DataFrame:
    """Normalisers of codes, numbers, dates and scopes over texts made of a part's fields."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    segment = F.concat(F.lpad((F.col("p_size") % 10).cast("string"), 1, "0"), F.lit("UMA&&"), F.when(F.col("p_size") % 3 == 0, "9PAB&&").otherwise("P&&&&&"))
    number = F.concat(F.lit("NP.D.N000."), (F.col("p_size") % 4).cast("string"), F.lit("."), segment, F.lit(".021.DC.0001"))
    other = F.lit("NP.D.N000.1.0UMA&&9PAB&&.1")
    revisions = F.map_from_arrays(F.array(F.lit("SD"), F.lit("DC")), F.array(F.when(F.col("p_size") % 2 == 0, "C01").otherwise(" "), F.concat(F.lit("C0"), (F.col("p_size") % 9).cast("string"))))
    code = pick(["GOST 14098-2014", "see NP-001-15", "PNAE G-7-010-89", "ASME B31.1", "EN 1090-2", "KS B 0845", "TU 14-3-190", "ISO 5817", "RCC-M C 2000", "house rule"], "p_size")
    cell = pick(["A  B", " 1 × 2", "SN 527-80 / SNiP 3.05.05-84", "0.5 – 1~2", "IL|O"], "p_size")
    day = pick(["2024-02-30", "5.1.2024", "2024/1/5", "5/1/2024", "1.5", "05-01-2024"], "p_size")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("~"))
    return rows.select(
        "p_partkey", text(normalise.scope(number)["building"]).alias("building"), text(normalise.scope(number)["system"]).alias("system"), normalise.same_scope(normalise.scope(number), normalise.scope(other)).alias("same"), text(normalise.unit_of(number)).alias("unit"),
        normalise.set_revision(revisions).alias("set_revision"), text(normalise.code_family(code)).alias("family"), normalise.table_value(cell).alias("value"), F.array_join(normalise.codes_named(cell), ",").alias("codes"), normalise.line_code(cell).alias("line"),
        text(normalise.day(day)).alias("day"), normalise.is_date(day).alias("is_date"), normalise.without_unit(F.concat((F.col("p_size") + 10).cast("string"), pick(["pab", "7", "X1"], "p_partkey"))).alias("without_unit"),
        text(normalise.building_of_drawing(number)).alias("drawn_building"), normalise.building(F.concat((F.col("p_size") % 9).cast("string"), F.lit(".1u md"))).alias("plain_building"), normalise.product(F.concat(F.lit("rc -"), F.col("p_size").cast("string"))).alias("product"),
        normalise.report_number(F.concat(F.lit("77 -\n"), F.col("p_size").cast("string"), F.lit("vt"))).alias("report_no"), normalise.method(pick(["visual  TEST", "Dye Penetrant", "방사선", "zz ", "초음파 탐상"], "p_size")).alias("method"), normalise.result(pick(["합격", "ng", "Pending", "재검사", " ok"], "p_size")).alias("result"),
        text(normalise.thickness_of(F.array(F.lit("1x2"), F.concat(F.lit("57×"), F.col("p_size").cast("string"), F.lit(",5"))))).alias("thickness"), F.array_join(notation.weld_maps(F.concat(F.lit("'a,b\n'"), F.lit("a, "), F.col("p_size").cast("string"))), "|").alias("maps"),
        text(F.when(basis.context_matches(pick(["weld of a joint", "in the", "repair"], "p_size"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(" "), F.lit("Steel"))), F.col("p_type")), "yes").otherwise("no")).alias("context"),
    )


def report_contexts(spark, sf_dir: str) -> DataFrame:
    """What an order's lines state as reasons, each once, whatever the case."""
    joints = F.array(pick(["Repair", "repair ", None, "Fit-up"], "o_orderkey"), pick(["fit-up", "", "REPAIR"], "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(basis.report_context(joints, pick([None, "Other", "repair"], "o_custkey")), F.lit("")).alias("context"))


def log_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of a log as written, read back: progress with a note or none, and usage with or without week and month."""
    events = table(spark, sf_dir, "events")
    line = headers.format_progress(F.col("event_type"), F.col("user_id"), F.lit(500), F.when(F.col("event_id") % 2 == 0, "a — b").otherwise(""))
    use = headers.format_usage(F.col("event_id"), F.col("user_id"), F.lit(7), F.when(F.col("event_id") % 3 == 0, F.col("user_id")), F.when(F.col("event_id") % 5 == 0, F.lit(9)))
    rows = events.select("event_id", headers.progress_line(line).alias("p"), headers.usage_line(use).alias("u"), headers.usage_line(F.lit("other")).isNull().alias("none"))
    return rows.select("event_id", "p.stage", "p.done", "p.total", "p.note", "u.calls", "u.today", "u.tokens", F.coalesce("u.week", F.lit(-1)).alias("week"), F.coalesce("u.month", F.lit(-1)).alias("month"), "none")


def civil_reports(spark, sf_dir: str) -> DataFrame:
    """Lines of an order as pages of civil reports: headers, pages that go on, mirrored pages, quantities in both orders."""
    n, q, k = "l_linenumber", F.col("l_quantity").cast("int").cast("string"), F.col("l_orderkey").cast("string")
    head = F.when(F.expr(f"{n} % 3 = 1"), F.concat(F.lit("No. 77-"), k, F.when(F.expr(f"{n} > 3"), "5").otherwise(""), F.lit(" vt dated 1.2.2024. 2OUMA\n"))).when(F.expr(f"{n} = 5"), F.concat(F.lit("No. VT-"), k, F.lit(" dated 3.4.2024\n"))).otherwise("")
    head = F.upper(head)
    head = F.replace(F.replace(head, F.lit("NO."), F.lit("No.")), F.lit("DATED"), F.lit("dated"))
    body = F.concat(F.when(F.expr(f"{n} % 2 = 0"), F.concat(F.lit("Drawing: NP.D.N000.1."), k, F.lit(",\n"))).otherwise(""), F.lit("RC-"), F.col(n).cast("string"), F.lit(" "), q, F.lit("pcs and "), q, F.lit(" EA (MD-1)\n"), F.when(F.expr(f"{n} = 7"), "R-not accepted").otherwise("welding inspection drawing"))
    page = F.concat(head, body)
    page = F.when(F.expr(f"{n} % 4 = 0"), F.array_join(F.transform(F.split(page, "\n"), F.reverse), "\n")).otherwise(page)
    place = F.row_number().over(ledger.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("page"), page.alias("text"))
    out = civil.reports(pages, "l_orderkey", "page", "text")
    items = F.array_join(F.transform("items", lambda i: F.concat_ws("x", i["product"], i["quantity"].cast("string"))), "|")
    return out.select("l_orderkey", "report_no", "org", F.coalesce("day", F.lit("")).alias("day"), F.coalesce("facility", F.lit("")).alias("facility"), F.coalesce("drawing", F.lit("")).alias("drawing"), items.alias("items"), "start_page", F.array_join("needs_review", "|").alias("needs_review"))


def _workbook(spark, sf_dir: str) -> DataFrame:
    """Nations' customers as a workbook of cells: a sheet a segment, some under names of no discipline, a head row after a title."""
    rows = table(spark, sf_dir, "customer").selectExpr("concat(if(c_nationkey % 5 = 0, 'notes ', 'List cp-p1 '), c_nationkey) AS sheet", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    place = F.row_number().over(ledger.Window.partitionBy("sheet").orderBy("c_custkey")) + 2
    body = rows.withColumn("row", place).select("sheet", "row", F.posexplode(F.array(F.concat(F.lit("FW"), F.col("c_custkey").cast("string")), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.col("c_acctbal").cast("int").cast("string"))).alias("col", "value")).where("value IS NOT NULL")
    sheets = rows.select("sheet").distinct()
    heads = sheets.select("sheet", F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in ((1, 0, "Title"), (2, 0, "Joint  No"), (2, 1, "NDT Method"), (2, 2, "Q'ty"))])).alias("x")).select("sheet", "x.*")
    return body.unionByName(heads)


def workbook_claims(spark, sf_dir: str) -> DataFrame:
    """Claims of the workbook's best sheet of a discipline, and the rows it skips."""
    good, skipped = cells.claims(_workbook(spark, sf_dir), cells.DISCIPLINES)
    pieces = [df.select("sheet", "discipline", "row", F.coalesce("joint_no", F.lit("")).alias("joint_no"), F.coalesce("ndt_method", F.lit("")).alias("ndt_method"), F.lit(kind).alias("kind")) for df, kind in ((good, "claim"), (skipped, "skipped"))]
    return pieces[0].unionByName(pieces[1])


def enriched(spark, sf_dir: str) -> DataFrame:
    """Claims without a drawing filled from what their report's other sheets say first, and whether these differ."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS report_no", "concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place", "if(l_linenumber % 3 = 0, ' ', concat('D.', l_partkey % 40)) AS drawing_no", "if(l_linenumber > 4, concat('M', l_suppkey % 3), null) AS welding_map")
    known = cells.first_values(rows, "report_no", "place", "drawing_no", "welding_map")
    items = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS report_no", "if(o_custkey % 2 = 0, ' ', 'D.own') AS drawing_no", "cast(null AS string) AS welding_map")
    out = cells.filled(items, known, "report_no", "drawing_no", "welding_map").join(known.select("report_no", "drawing_no_conflict"), "report_no", "left")
    return out.select("report_no", F.coalesce("drawing_no", F.lit("")).alias("drawing_no"), F.coalesce("welding_map", F.lit("")).alias("welding_map"), F.coalesce("drawing_no_conflict", F.lit(False)).alias("conflict"))


def page_sources(spark, sf_dir: str) -> DataFrame:
    """Turns of a conversation as pages: which text counts, whether the layer is there, and whether it is read again."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_index"), F.substring("text", 1, 45).alias("layer_text"), F.lit("ocr").alias("ocr_text"))
    out = cells.page_texts(rows)
    again = cells.reread(F.when(F.col("doc") % 2 == 0, 0.5).otherwise(0.9), F.col("doc") % 5, F.lit(6))
    return out.select("doc", "page_index", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "source", again.alias("again"))


def editions(spark, sf_dir: str) -> DataFrame:
    """Files of parts in several editions, those left after pruning."""
    names = F.expr("array(concat('a/S', p_partkey, '.pdf'), concat('b/S', p_partkey, '_scan.pdf'), concat('S', p_partkey, '_v2_scan_x.pdf'), concat('T', p_size, '.R.pdf'), concat('T', p_size % 25, '.E.pdf'), concat('S', p_partkey, '0_scan.pdf'))")
    files = table(spark, sf_dir, "part").select(F.explode(names).alias("path")).distinct()
    return cells.pruned_editions(files)


def review_sheet(spark, sf_dir: str) -> DataFrame:
    """The sixteen review columns beside the claims of a round, in full."""
    rows = judged(spark, sf_dir).where("round_no = 1995")
    gate = F.get(F.filter("findings", lambda x: F.startswith(x, F.lit("billed_"))), F.lit(0))
    refs = F.array(F.struct(F.lit(2).alias("authority_level"), F.lit("P1").alias("doc"), F.lit("3.1").alias("section"), F.lit(4).alias("page")), F.struct(F.lit(3).alias("authority_level"), F.lit("C1").alias("doc"), F.lit(None).cast("string").alias("section"), F.lit(7).alias("page")))
    done = rows.select("item_id", F.col("report_id").alias("report_no"), F.when(F.col("report_id").isNotNull(), "deterministic").alias("how"), F.col("score").cast("double").alias("score"), "required", "still_required", "extra_method", "verdict", F.when(gate.isNotNull(), F.col("basis_state")).alias("basis_state"), "risk",
                       rules.tagged(적합성=F.when(F.col("risk") >= 60, F.array(F.lit("high"))), 매칭=F.when(F.col("report_id").isNull(), F.array(F.lit("none")))).alias("reasons"), F.lit("s").alias("summary"), refs.alias("refs"), rules.action(F.col("findings"), F.lit("look")).alias("action"))
    out = sinks.review_sheet(rows.select("item_id", "round_no"), done, "item_id")
    return out.select("item_id", "round_no", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i:02d}") for i, c in enumerate(sinks.REVIEW_COLUMNS)], sinks.colour(F.col("`재확인_필요`").isNotNull(), F.coalesce(F.col("`위험도`"), F.lit(0))).alias("colour"))


def dashboard_list(spark, sf_dir: str) -> DataFrame:
    """The review list under all filters, with what its rows are to be corrected for."""
    rows = judged(spark, sf_dir).withColumn("needs_review", F.col("report_id").isNull()).withColumnRenamed("welder", "welder_id")
    some = dashboard.filtered(rows, 40, True, ["SUSPECT", "NONCOMPLIANT"], ["PT", "UT"], "w1")
    labels = dashboard.to_correct(some, ["no_matching_report", "billed_ndt_basis_unclear"], {"no_matching_report": "B report", "billed_ndt_basis_unclear": "A basis"})
    return labels.select("item_id", "risk", "verdict", F.array_join("labels", ", ").alias("labels"))


def guide_sheets(spark, sf_dir: str) -> DataFrame:
    """Counters of overbilling, the classes of customers, the parts billed most, and how much of the ledger was read."""
    from tallyforge.plans.roles import billing, requirements

    required = requirements(spark, sf_dir).select("l_partkey", F.col("required").alias("methods"))
    billed = billing(spark, sf_dir).select("l_partkey", F.col("ndt_method").alias("method"), "amount", (F.col("l_suppkey") % 3 == 0).alias("confirmed"))
    counters = ledger.overbill_counters(ledger.billed_against_required(billed, required, "l_partkey"))
    names = [c for c in counters.columns]
    one = counters.select(F.explode(F.array(*[F.struct(F.lit(f"overbill {c}").alias("name"), F.col(c).cast("decimal(24,2)").alias("value")) for c in names])).alias("x")).select("x.*")
    two = dashboard.distribution(table(spark, sf_dir, "customer").withColumn("class", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))), "class").select(F.concat(F.lit("class "), "value").alias("name"), F.col("n").cast("decimal(24,2)").alias("value"))
    top = dashboard.samples(dashboard.most_common(billing(spark, sf_dir), "l_partkey"), [F.desc("n"), "value"], 20).select(F.concat(F.lit("part "), F.col("value").cast("string")).alias("name"), F.col("n").cast("decimal(24,2)").alias("value"))
    orders = table(spark, sf_dir, "orders")
    read = ledger.coverage(orders.where("o_orderstatus <> 'P'"), orders.where("o_totalprice > 1000"), "o_orderkey")
    three = read.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("decimal(24,2)").alias("value")) for c in read.columns])).alias("x")).select("x.*")
    return one.union(two).union(top).union(three)


def shown_drawings(spark, sf_dir: str) -> DataFrame:
    """Sets in force of some drawings with the sizes of what they hold, and their review reasons."""
    sets = table(spark, sf_dir, "part").selectExpr("concat('D.', p_brand, '.', p_partkey) AS drawing_no", "concat('C0', p_size % 4) AS set_revision", "if(p_size % 3 = 0, date'2024-01-01', null) AS superseded_at", "sequence(1, p_size % 5 + 1) AS requirements", "if(p_size % 2 = 0, null, array('a', 'b')) AS kks_lines",
                                                   "if(p_size % 7 = 0, array('x', 'y', 'z', 'u', 'v', 'w'), null) AS conflicts", "if(p_size % 4 = 0, array('FW1'), cast(array() AS array<string>)) AS missing_joints", "transform(sequence(1, p_size % 8 + 1), x -> concat('r', x)) AS file_reasons").withColumn("review_reasons", F.col("file_reasons"))
    shown = dashboard.shown_drawings(sets, "#1")
    reasons = dashboard.set_reasons(sets).select("drawing_no", F.array_join("reasons", "; ").alias("reasons"))
    return shown.join(reasons, "drawing_no")


def routing_sheets(spark, sf_dir: str) -> DataFrame:
    """Texts of sheets made of an order's lines: tie-ins, pipes, bends, parts, fittings, slopes and valves read from them."""
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(" GOST 8732-78 Pipe CS 108x6 x "), (F.col("l_quantity").cast("int") * 20).cast("string"), F.lit(" mm\nX+1"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit(" Y -2000 Z+30\n"), F.lit("9 GOST 17375-2001 Bend 90-108x6 20 steel 3 1.2\n4 GOST 17376 Tee 57x5 a 2 3.3\n"),
                    F.col("l_linenumber").cast("string"), F.lit(" 90GMM91AA00"), F.col("l_linenumber").cast("string"), F.lit(" Valve - 1\nslope "), F.col("l_linenumber").cast("string"), F.lit(" mm/m\n"))
    sheets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("text"))
    size = lambda c: F.size(c)
    total = F.aggregate(geometry.spools(F.col("text")), F.lit(0.0), lambda a, s: a + s["length"])
    return sheets.select("l_orderkey", size(geometry.tie_ins(F.col("text"))).alias("tie_ins"), total.alias("length"), size(geometry.bends(F.col("text"))).alias("bends"), size(geometry.fittings(F.col("text"))).alias("fittings"),
                         F.array_join(F.transform(geometry.components(F.col("text")), lambda c: c["code"]), ",").alias("codes"), F.array_join(F.transform(geometry.slopes(F.col("text")), lambda s: s.cast("int").cast("string")), ",").alias("slopes"))


def components_placed(spark, sf_dir: str) -> DataFrame:
    """Components of an order's sheet at the end of the last spool before them."""
    spools = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS sheet", "l_linenumber AS pos", "cast(l_quantity AS int) AS length")
    parts = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sheet", "cast(o_custkey % 9 AS int) AS pos", "concat('V', o_custkey) AS code")
    return geometry.placed(parts, spools).select("sheet", "code", "pos", "at")


def request_outcomes(spark, sf_dir: str) -> DataFrame:
    """Events as requests: what an error asks for, how long to wait, whether the answer is kept, and who answered."""
    http, body = pick(["200", "429", "401", "400", "500", "404"], "event_id"), pick(["", "40001", "40103", "40003", "42900", None, "40000"], "user_id")
    content, stop = pick(['{"a": 1}', "no json", "[1]"], "event_id"), pick([None, "stop", "LENGTH"], "user_id")
    kind = requests.error_class(http.cast("int"), body)
    rows = table(spark, sf_dir, "events").select(kind.alias("kind"), requests.backoff(F.col("event_id") % 8 + 1).alias("wait"), requests.keepable(content, stop).alias("kept"), F.coalesce(requests.provider_of(F.col("event_type"), {"click": "small", "view": "large"}, "default"), F.lit("")).alias("provider"))
    return rows.groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), "wait", "kept", "provider").agg(F.count("*").alias("n"))


def cached_requests(spark, sf_dir: str) -> DataFrame:
    """Requests answered from the cache and one of each key that isn't, nulls and blanks being different."""
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.when(F.col("user_id") % 3 > 0, F.when(F.col("user_id") % 3 == 1, "").otherwise("m")).alias("model"), (F.col("user_id") % 20).cast("string").alias("prompt"))
    known = asked.where("mode = 'click'").select(normalise.request_key(F.col("mode"), F.col("model"), F.col("prompt")).alias("key")).distinct().withColumn("content", F.lit("{}"))
    hits, misses = requests.answered(asked, known, "mode", "model", "prompt")
    return hits.groupBy("mode").agg(F.count("*").alias("n")).withColumn("kind", F.lit("hit")).unionByName(misses.groupBy("mode").agg(F.count("*").alias("n")).withColumn("kind", F.lit("miss")))


def table_kinds(spark, sf_dir: str) -> DataFrame:
    """Tables of several kinds as markup and as cells, told apart and compared."""
    word = pick(["Scope of inspection NDT", "Safety class seismic", "Materials", "ndt seismic", "Radiographic, ultrasonic, seismic, KKS code"], "p_size")
    rows = F.concat(F.lit("<table><tr><th>"), word, F.lit("</th><th>B</th></tr>"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit("<TR><td> "), i.cast("string"), F.lit(" </td></TR>"))), ""), F.lit("</table>"))
    one = headers.html_matrix(rows)
    cell = lambda r, c, t: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), t.alias("text"))
    two = headers.matrix(F.array(cell(0, 0, word), cell(1, 1, F.lit("x")), cell(1, 0, F.lit("1"))))
    part = table(spark, sf_dir, "part").select("p_partkey", one.alias("one"), two.alias("two"))
    d = dashboard.table_differences(F.col("one"), F.col("two"))
    return part.select("p_partkey", F.coalesce(headers.table_kind(F.col("one")), F.lit("-")).alias("kind"), F.size("one").alias("n_rows"), d["cells"].alias("cells"), d["differing"].alias("differing"), d["same_shape"].alias("same_shape"))


def joint_candidates(spark, sf_dir: str) -> DataFrame:
    """Suppliers' reports as fuzzy candidates for customers' claims."""
    items = table(spark, sf_dir, "customer").selectExpr("c_custkey AS item_id", "concat('FW', c_custkey % 90) AS joint_no", "if(c_custkey % 2 = 0, 'Visual', 'RT') AS ndt_method", "concat('DW', lpad(c_custkey % 50, 3, '0')) AS welder_id")
    reports = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS report_id", "if(s_suppkey % 2 = 0, 'VMC', 'rt') AS ndt_method", "array(named_struct('joint_no', concat('fw', s_suppkey % 90), 'welder_id', 'X'), named_struct('joint_no', 'Z', 'welder_id', concat('dw', lpad(s_suppkey % 50, 3, '0')))) AS joints")
    return fuzzy.candidates(items.withColumn("ndt_method", normalise.method(F.col("ndt_method"))), reports.withColumn("ndt_method", normalise.method(F.col("ndt_method"))), most=3)


def upper_medians(spark, sf_dir: str) -> DataFrame:
    """The upper median price of each segment's and each size's rows."""
    return ledger.upper_median(table(spark, sf_dir, "part"), "p_retailprice", ["p_size"])


def claim_totals(spark, sf_dir: str) -> DataFrame:
    """Units, drawn quantities and totals of supplier nations and parts, with the total over all rows."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("building", F.when(F.col("s_nationkey") > 2, F.concat(F.lit("B"), "s_nationkey")).otherwise(" "))
    q = F.col("l_quantity").cast("decimal(18,2)")
    unit = F.when(F.col("l_linenumber") > 4, 0).otherwise(F.col("l_linenumber") % 2 + 1)
    index = ledger.unit_index(rows, ["building", "l_partkey"], unit, q, q * 2).crossJoin(F.broadcast(ledger.grand_total(rows, q * 2)))
    return index.select("building", "l_partkey", "rows", F.col("drawn").cast("decimal(18,2)").alias("drawn"), F.col("total").cast("decimal(18,2)").alias("total"), F.coalesce("unit", F.lit("-")).alias("unit"), F.col("grand_total").cast("decimal(18,2)").alias("grand_total"))


QUERIES = {
    "q14b_claim_violations": claim_violations,
    "q14c_report_violations": report_violations,
    "q14d_drawing_violations": drawing_violations,
    "q70_scalars": scalars,
    "q70b_report_contexts": report_contexts,
    "q70c_log_lines": log_lines,
    "q71_civil_reports": civil_reports,
    "q72_workbook_claims": workbook_claims,
    "q72b_enriched": enriched,
    "q72c_page_sources": page_sources,
    "q72d_editions": editions,
    "q73_review_sheet": review_sheet,
    "q73b_dashboard_list": dashboard_list,
    "q73c_guide_sheets": guide_sheets,
    "q73d_shown_drawings": shown_drawings,
    "q74_routing_sheets": routing_sheets,
    "q74b_components_placed": components_placed,
    "q75_request_outcomes": request_outcomes,
    "q75b_cached_requests": cached_requests,
    "q76_table_kinds": table_kinds,
    "q04c_joint_candidates": joint_candidates,
    "q55c_upper_medians": upper_medians,
    "q31b_claim_totals": claim_totals,
}

_CLAIM = _violations_sql([_bad("ndt_method", METHODS, "o_orderkey", _METHOD_BAD), _bad("result", RESULTS, "o_orderkey", _RESULT_BAD), _bad("report_no", NUMBERS, "o_custkey", _NUMBER_BAD), _bad("drawing_no", DRAWINGS, "o_orderkey", _DRAWING_BAD), _bad("joint_no", JOINTS, "o_custkey + o_orderkey", _JOINT_BAD),
                          _bad("inspection_date", DAYS, "o_orderkey", _DAY_BAD), _bad("welder_id", WELDERS, "o_orderkey", _WELDER_BAD), _bad("unit_price", AMOUNTS, "o_custkey", _AMOUNT_BAD | {"1e13": _RANGE}), _bad("amount", AMOUNTS, "o_orderkey", _AMOUNT_BAD | {"1e13": _RANGE})])
_JOINT = [_bad(f"joints[{n}].{f}", v, f"c_custkey + {n}", b) for n in (0, 1) for f, v, b in (("result", RESULTS, _RESULT_BAD), ("joint_no", JOINTS, _JOINT_BAD), ("welder_id", WELDERS, _WELDER_BAD))]
_REPORT = _violations_sql([_bad("report_no", NUMBERS, "c_custkey", _NUMBER_BAD), _bad("ndt_method", METHODS, "c_custkey", _METHOD_BAD), _bad("inspection_date", DAYS, "c_custkey", _DAY_BAD), _bad("drawing_no", DRAWINGS, "c_custkey", _DRAWING_BAD), *[f"CASE WHEN c_custkey % 4 > 0 THEN {j} END" for j in _JOINT]])
_PERCENT_BAD = {"101": _RANGE, "all": _TYPE}
_DRAWN = _violations_sql([_bad("drawing_no", DRAWINGS, "p_partkey", _DRAWING_BAD), _bad("kks_lines[0].kks_code", CODES, "p_partkey", {"PAB": _LOW}), _bad("kks_lines[0].safety_class", CLASSES, "p_partkey", {"5": _ENUM}), _bad("kks_lines[0].seismic", SEISMIC, "p_partkey", {"iv": _ENUM}),
                          _bad("kks_lines[0].design_pressure_mpag", PRESSURES, "p_partkey", {"51": _RANGE, "x": _TYPE}), _bad("kks_lines[0].design_temperature_c", PRESSURES, "p_partkey + 1", {"x": _TYPE}), _bad("inspection_matrix[0].kks_code", CODES, "p_size", {"PAB": _LOW}),
                          *[_bad(f"inspection_matrix[0].{f}", PERCENTS, f"p_partkey + {i}", _PERCENT_BAD) for i, f in enumerate(rules.MATRIX_FIELDS)]])
_ASKED = ", ".join(f"CASE WHEN {_sql_pick(PERCENTS, f'p_partkey + {i}')} IN ('100', '101', 'all') THEN '{f}' END" for i, f in enumerate(rules.MATRIX_FIELDS))

SQL = {
    "q14b_claim_violations": f"WITH v AS (SELECT o_orderkey, {_CLAIM} AS x FROM orders) SELECT o_orderkey, array_to_string(x, ' ') AS found, len([y FOR y IN x IF ends_with(y, ':high')]) > 0 OR len([y FOR y IN x IF ends_with(y, ':medium')]) >= 3 AS needs_review FROM v",
    "q14c_report_violations": f"SELECT c_custkey, array_to_string({_REPORT}, ' ') AS found FROM customer",
    "q14d_drawing_violations": f"SELECT p_partkey, array_to_string({_DRAWN}, ' ') AS found, concat_ws(',', {_ASKED}) AS required FROM part",
    "q70_scalars": """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'UMA' ELSE '~' END AS building, CASE WHEN p_size % 3 = 0 THEN 'PAB' ELSE '~' END AS system, CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE 'unknown' END AS same, CAST(p_size % 4 AS VARCHAR) AS unit,
      'DC=C0' || p_size % 9 || ',SD=' || CASE WHEN p_size % 2 = 0 THEN 'C01' ELSE '-' END AS set_revision, ['GOST', 'NP', 'PNAE', 'ASME', 'EN', 'KS', 'TU', 'ISO', 'RCC-M', '~'][p_size % 10 + 1] AS family, ['ab', '1x2', 'sn527-80/snip3.05.05-84', '0.5-1-2', 'il|o'][p_size % 5 + 1] AS value,
      CASE WHEN p_size % 5 = 2 THEN 'sn527-80,snip3.05.05-84' ELSE '' END AS codes, ['AB', '1×2', 'SN527-80/SN1P3.05.05-84', '0.5–1~2', '1110'][p_size % 5 + 1] AS line, ['~', '2024-01-05', '2024-01-05', '2024-01-05', '~', '2024-01-05'][p_size % 6 + 1] AS day, [false, true, true, true, false, false][p_size % 6 + 1] AS is_date,
      CASE WHEN p_size + 10 >= 100 THEN '' ELSE '' END || CASE p_partkey % 3 WHEN 0 THEN 'PAB' WHEN 1 THEN CAST(p_size + 10 AS VARCHAR) || '7' ELSE 'X1' END AS without_unit, p_size % 4 || CAST(p_size % 10 AS VARCHAR) || 'UMA' AS drawn_building, p_size % 9 || '1UMD' AS plain_building, 'RC' || p_size AS product, '77-' || p_size || 'VT' AS report_no,
      ['VT', 'PT', 'RT', 'ZZ', 'UT'][p_size % 5 + 1] AS method, ['ACC', 'REJ', 'PENDING', 'PENDING', 'ACC'][p_size % 5 + 1] AS result, p_size || '.5' AS thickness, 'a|b|' || p_size AS maps,
      CASE WHEN CASE WHEN p_partkey % 2 = 0 THEN contains(lower(p_type), 'steel') ELSE CASE p_size % 3 WHEN 0 THEN contains(lower(p_type), 'weld') OR contains(lower(p_type), 'joint') WHEN 1 THEN false ELSE contains(lower(p_type), 'repair') END END THEN 'yes' ELSE 'no' END AS context FROM part""",
    "q70b_report_contexts": """WITH r AS (SELECT o_orderkey, list_filter([trim(coalesce(x, '')) FOR x IN [['Repair', 'repair ', NULL, 'Fit-up'][o_orderkey % 4 + 1], ['fit-up', '', 'REPAIR'][o_orderkey % 3 + 1], [NULL, 'Other', 'repair'][o_custkey % 3 + 1]]], lambda x: x <> '') AS l FROM orders)
      SELECT o_orderkey, coalesce(array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF list_position([lower(z) FOR z IN l], lower(l[i])) = i], ' / '), '') AS context FROM r""",
    "q70c_log_lines": """SELECT event_id, event_type AS stage, CAST(user_id AS INT) AS done, 500 AS total, CASE WHEN event_id % 2 = 0 THEN 'a — b' ELSE '' END AS note, event_id AS calls, user_id AS today, CAST(7 AS BIGINT) AS tokens, CASE WHEN event_id % 3 = 0 THEN user_id ELSE -1 END AS week, CAST(CASE WHEN event_id % 5 = 0 THEN 9 ELSE -1 END AS BIGINT) AS month, true AS none FROM events""",
    "q71_civil_reports": """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS page FROM lineitem),
      h AS (SELECT *, CASE WHEN n % 3 = 1 THEN '77-' || o || CASE WHEN n > 3 THEN '5' ELSE '' END || 'VT' WHEN n = 5 THEN 'VT-' || o END AS no, n % 3 = 1 AS own FROM l),
      f AS (SELECT *, last_value(no IGNORE NULLS) OVER (PARTITION BY o ORDER BY page ROWS UNBOUNDED PRECEDING) AS of FROM h), g AS (SELECT * FROM f WHERE of IS NOT NULL),
      u AS (SELECT o, of, page, unnest(['MD1', 'RC' || n]) AS p, q FROM g WHERE no IS NOT NULL), m AS (SELECT o, of, p, q, min(page) AS fp FROM u GROUP BY ALL), i AS (SELECT o, of, string_agg(p || 'x' || q, '|' ORDER BY fp, p, q) AS items FROM m GROUP BY o, of)
      SELECT g.o AS l_orderkey, g.of AS report_no, CASE WHEN bool_or(own) THEN 'CRST' ELSE 'OTHER' END AS org, CASE WHEN bool_or(own) THEN '1.2.2024' ELSE '3.4.2024' END AS day, CASE WHEN bool_or(own) THEN '20UMA' ELSE '' END AS facility, CASE WHEN bool_or(n % 2 = 0) THEN 'NP.D.N000.1.' || g.o ELSE '' END AS drawing,
        any_value(items) AS items, CAST(min(page) FILTER (no IS NOT NULL) + 1 AS INT) AS start_page, concat_ws('|', CASE WHEN arg_min(n, page) FILTER (no IS NOT NULL) = 7 THEN 'rejected' END, CASE WHEN bool_or(own) AND NOT bool_or(n % 2 = 0) THEN 'no drawing' END) AS needs_review
      FROM g JOIN i ON g.o = i.o AND g.of = i.of GROUP BY g.o, g.of""",
    "q72_workbook_claims": """WITH r AS (SELECT 'List cp-p1 ' || c_nationkey AS sheet, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 2 AS INT) AS row, 'FW' || c_custkey AS joint_no, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS m FROM customer WHERE c_nationkey % 5 <> 0), b AS (SELECT sheet FROM r GROUP BY sheet ORDER BY count(m) DESC, sheet LIMIT 1)
      SELECT sheet, 'CP-P1' AS discipline, row, joint_no, coalesce(m, '') AS ndt_method, CASE WHEN m IS NULL THEN 'skipped' ELSE 'claim' END AS kind FROM r WHERE sheet IN (SELECT sheet FROM b)""",
    "q72b_enriched": """WITH l AS (SELECT l_orderkey AS o, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, CASE WHEN l_linenumber % 3 <> 0 THEN 'D.' || l_partkey % 40 END AS d, CASE WHEN l_linenumber > 4 THEN 'M' || l_suppkey % 3 END AS w FROM lineitem),
      k AS (SELECT o, arg_min(d, place) FILTER (d IS NOT NULL) AS d, arg_min(w, place) FILTER (w IS NOT NULL) AS w, count(DISTINCT d) > 1 AS c FROM l GROUP BY o)
      SELECT o_orderkey AS report_no, coalesce(CASE WHEN o_custkey % 2 = 0 THEN d ELSE 'D.own' END, '') AS drawing_no, coalesce(w, '') AS welding_map, coalesce(c, false) AS conflict FROM orders LEFT JOIN k ON o = o_orderkey""",
    "q72c_page_sources": """WITH r AS (SELECT conv_id AS doc, turn, substr(text, 1, 45) AS t FROM conversations), h AS (SELECT doc, bool_or(length(trim(t)) >= 40) AS layer FROM r WHERE turn < 3 GROUP BY doc)
      SELECT r.doc, turn AS page_index, md5(coalesce(CASE WHEN layer THEN t ELSE 'ocr' END, '')) AS digest, CASE WHEN layer THEN 'layer' ELSE 'ocr' END AS source, r.doc % 2 = 0 AND r.doc % 5 * 2 >= 6 AS again FROM r LEFT JOIN h USING (doc)""",
    "q72d_editions": """WITH f AS (SELECT DISTINCT unnest(['a/S' || p_partkey || '.pdf', 'b/S' || p_partkey || '_scan.pdf', 'S' || p_partkey || '_v2_scan_x.pdf', 'T' || p_size || '.R.pdf', 'T' || p_size % 25 || '.E.pdf', 'S' || p_partkey || '0_scan.pdf']) AS path FROM part), s AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') AS stem FROM f)
      SELECT path FROM s WHERE NOT (contains(stem, '_scan') AND EXISTS (SELECT 1 FROM s t WHERE NOT contains(t.stem, '_scan') AND t.stem = string_split(s.stem, '_')[1])) AND NOT (ends_with(stem, '.R') AND EXISTS (SELECT 1 FROM s t WHERE t.stem = substr(s.stem, 1, length(s.stem) - 1) || 'E'))""",
    "q73_review_sheet": f"""WITH {_FINDINGS_SQL}, r AS (SELECT *, list_filter(findings, lambda x: starts_with(x, 'billed_'))[1] AS gate, {STATE} AS st FROM judged WHERE round_no = 1995),
      t AS (SELECT *, concat_ws(chr(10), CASE WHEN risk >= 60 THEN '- [적합성] high' END, CASE WHEN report_id IS NULL THEN '- [매칭] none' END) AS why FROM r)
      SELECT item_id, round_no, coalesce(report_id, '') AS c00, CASE WHEN report_id IS NULL THEN '' ELSE 'deterministic' END AS c01, CASE WHEN score IS NULL THEN '' ELSE '100.0' END AS c02, coalesce(array_to_string(list_sort(required), ', '), '') AS c03, coalesce(array_to_string(list_sort([x FOR x IN required IF x <> ndt_method]), ', '), '') AS c04,
        CASE WHEN gate IS NULL THEN '' ELSE ndt_method END AS c05, verdict AS c06, CASE WHEN gate IS NULL THEN '' ELSE CASE st WHEN 'covered' THEN 'SCWEP 근거 있음 — 조건 확인 필요' WHEN 'unclear' THEN '근거 불명확 — 조항 확인' WHEN 'not_submitted' THEN '근거 미제출 — 제출 요청' ELSE '근거 밖 — 과다청구' END END AS c07,
        CAST(risk AS VARCHAR) AS c08, CASE WHEN why = '' THEN '' ELSE '필요' END AS c09, why AS c10, 's' AS c11, CASE WHEN gate IS NOT NULL AND st = 'no_basis_found' THEN 'C1' ELSE 'C1 / P1' END AS c12, CASE WHEN gate IS NOT NULL AND st = 'no_basis_found' THEN 'p.7' ELSE '3.1/p.4 / p.7' END AS c13,
        CASE gate """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.ACTIONS.items()) + """ ELSE 'look' END AS c14, '' AS c15, CASE WHEN why <> '' THEN 'blue' WHEN risk >= 80 THEN 'red' WHEN risk >= 60 THEN 'orange' ELSE 'none' END AS colour FROM t""",
    "q73c_guide_sheets": f"""WITH {LINES_SQL}, {REQUIRED_SQL}, b AS (SELECT l_partkey, ndt_method AS m, amount, l_suppkey % 3 = 0 AS ok, required, coalesce(NOT list_contains(required, ndt_method), false) AS outside FROM lines LEFT JOIN requirements USING (l_partkey) WHERE side = 'O'),
      k AS (SELECT l_partkey, any_value(required) AS r, list(DISTINCT m) AS ms, count(*) FILTER (outside) AS n, coalesce(sum(amount) FILTER (outside AND ok), 0) AS c, coalesce(sum(amount) FILTER (outside AND NOT ok), 0) AS u FROM b GROUP BY l_partkey),
      s AS (SELECT *, len([x FOR x IN ms IF NOT list_contains(r, x)]) AS o, len([x FOR x IN r IF NOT list_contains(ms, x)]) AS d FROM k), z AS (SELECT *, CASE WHEN r IS NULL THEN 'unknown' WHEN o > 0 AND d > 0 THEN 'both' WHEN o > 0 THEN 'over' WHEN d > 0 THEN 'under' ELSE 'ok' END AS st FROM s),
      v AS (SELECT 'overbill n_keys' AS name, count(*)::DECIMAL(24,2) AS value FROM z UNION ALL SELECT 'overbill n_' || t, (SELECT count(*) FROM z WHERE st = t) FROM (VALUES ('ok'), ('over'), ('under'), ('both'), ('unknown')) x(t)
        UNION ALL SELECT 'overbill over_rows', sum(n) FROM z UNION ALL SELECT 'overbill under_pairs', sum(d) FROM z WHERE r IS NOT NULL UNION ALL SELECT 'overbill confirmed', sum(c) FROM z UNION ALL SELECT 'overbill unproven', sum(u) FROM z
        UNION ALL SELECT 'class ' || CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '(unspecified)' END, count(*) FROM customer GROUP BY 1 UNION ALL (SELECT 'part ' || l_partkey, count(*) FROM b GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 20)
        UNION ALL SELECT 'n_reports', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'n_ledger', count(*) FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'n_both', count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000)
      SELECT name, CAST(value AS DECIMAL(24,2)) AS value FROM v""",
    "q73d_shown_drawings": """SELECT 'D.' || p_brand || '.' || p_partkey AS drawing_no, 'C0' || p_size % 4 AS set_revision, CAST(p_size % 5 + 1 AS INT) AS n_requirements, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 2 END AS n_lines, CAST(p_size % 8 + 1 AS INT) AS n_reasons,
      concat_ws('; ', CASE WHEN p_size % 7 = 0 THEN '6 conflicts: x, y, z, u, v' END, CASE WHEN p_size % 4 = 0 THEN '1 joints without a requirement: FW1' END, array_to_string(['r' || i FOR i IN range(1, least(5, p_size % 8 + 1) + 1)], '; ')) AS reasons FROM part WHERE p_size % 3 <> 0 AND contains('D.' || p_brand || '.' || p_partkey, '#1')""",
    "q73b_dashboard_list": f"""WITH {_FINDINGS_SQL} SELECT item_id, risk, verdict, concat_ws(', ', CASE WHEN list_contains(findings, 'billed_ndt_basis_unclear') THEN 'A basis' END, CASE WHEN list_contains(findings, 'no_matching_report') THEN 'B report' END) AS labels
      FROM judged WHERE risk >= 40 AND report_id IS NULL AND verdict IN ('SUSPECT', 'NONCOMPLIANT') AND ndt_method IN ('PT', 'UT') AND contains(lower(welder_id), 'w1')""",
    "q74b_components_placed": "SELECT o_orderkey AS sheet, 'V' || o_custkey AS code, CAST(o_custkey % 9 AS INT) AS pos, coalesce((SELECT sum(CAST(l_quantity AS INT)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber <= o_custkey % 9), 0)::DOUBLE AS at FROM orders",
    "q74_routing_sheets": """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS INT) * 20 AS len FROM lineitem)
      SELECT o AS l_orderkey, CAST(count(DISTINCT n) AS INT) AS tie_ins, coalesce((SELECT sum(DISTINCT len) FROM l k WHERE k.o = l.o AND len >= 50), 0)::DOUBLE AS length, CAST(count(*) AS INT) AS bends, CAST(count(*) AS INT) AS fittings, string_agg(DISTINCT '90GMM91AA00' || n, ',' ORDER BY '90GMM91AA00' || n) AS codes, string_agg(DISTINCT CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) AS slopes FROM l GROUP BY o""",
    "q75_request_outcomes": """WITH e AS (SELECT [200, 429, 401, 400, 500, 404][event_id % 6 + 1] AS h, ['', '40001', '40103', '40003', '42900', '', '40000'][user_id % 7 + 1] AS b, event_id % 3 = 1 AS nojson, user_id % 3 = 2 AS cut, event_id % 8 AS a, event_type AS t FROM events)
      SELECT CASE WHEN h < 400 AND b = '' THEN 'none' WHEN h IN (429, 500) OR b = '42900' THEN 'retry' WHEN b = '40103' OR h = 401 THEN 'authentication' WHEN b = '40001' THEN 'parameters' WHEN b = '40003' THEN 'too_long' ELSE 'client' END AS kind, least(60, 2 * pow(2, a))::DOUBLE AS wait, NOT cut AND NOT nojson AS kept,
        CASE t WHEN 'click' THEN 'small' WHEN 'view' THEN 'large' ELSE 'default' END AS provider, count(*) AS n FROM e GROUP BY ALL""",
    "q75b_cached_requests": """SELECT event_type AS mode, count(*) AS n, 'hit' AS kind FROM events WHERE event_type = 'click' GROUP BY ALL UNION ALL SELECT mode, count(*), 'miss' FROM (SELECT DISTINCT event_type AS mode, user_id % 3 AS m, user_id % 20 AS p FROM events WHERE event_type <> 'click') GROUP BY mode""",
    "q76_table_kinds": """WITH t AS (SELECT p_partkey, p_size AS n, p_size % 5 AS w FROM part)
      SELECT p_partkey, CASE WHEN w IN (0, 4) THEN 'inspection' WHEN w = 1 THEN 'safety' WHEN n + 1 <= 25 THEN 'other' ELSE '-' END AS kind, n + 1 AS n_rows, CAST(2 + 2 + (n - 1) AS INT) AS cells, CAST(1 + 1 + (n - 1) AS INT) AS differing, n = 1 AND false AS same_shape FROM t""",
    "q55c_upper_medians": "SELECT p_size, list_sort(list(p_retailprice))[count(*) // 2 + 1] AS median FROM part GROUP BY p_size",
    "q31b_claim_totals": """WITH r AS (SELECT 'B' || s_nationkey AS building, s_nationkey AS k, l_partkey, CAST(l_quantity AS DECIMAL(18,2)) AS q, CASE WHEN l_linenumber > 4 THEN NULL ELSE CAST(l_linenumber % 2 + 1 AS VARCHAR) END AS u FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
      SELECT building, l_partkey, count(*) AS rows, CAST(sum(q) AS DECIMAL(18,2)) AS drawn, CAST(sum(q * 2) AS DECIMAL(18,2)) AS total, CASE WHEN count(DISTINCT u) > 1 THEN 'CONFLICT' ELSE coalesce(min(u), '-') END AS unit, (SELECT CAST(sum(q * 2) AS DECIMAL(18,2)) FROM r) AS grand_total FROM r WHERE k > 2 GROUP BY building, l_partkey""",
}
