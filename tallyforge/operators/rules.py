"""The decision layer: findings in a fixed order, risk, verdicts and reasons for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.normalise import is_date, method

# Weight and class of each finding, in the order of evaluation.
FINDINGS = {
    "drawing_no_is_ke_misentry": (45, "suspect"),
    "no_matching_report": (30, "suspect"),
    "drawing_requirement_missing": (35, "suspect"),
    "billed_ndt_not_in_requirements": (60, "hard"),
    "billed_ndt_basis_not_submitted": (45, "suspect"),
    "billed_ndt_basis_unclear": (50, "suspect"),
    "billed_ndt_covered_by_scwep": (35, "suspect"),
    "required_ndt_missing": (5, "info"),
    "result_mismatch": (0, "hard"),
    "welder_mismatch": (5, "suspect"),
    "low_confidence_code_ref": (20, "suspect"),
    "rule_engine_violation": (25, "suspect"),
    "ocr_auto_corrected": (5, "info"),
    "pipeline_row_failed": (30, "suspect"),
}
#: The strictest verdict of a model that each state of the basis allows.
CEILINGS = {"billed_ndt_basis_not_submitted": "SUSPECT", "billed_ndt_basis_unclear": "SUSPECT", "billed_ndt_covered_by_scwep": "SUSPECT"}
SEVERITY = ("OK", "SUSPECT", "NONCOMPLIANT")


def findings(row: dict[str, Column]) -> Column:
    """Array of rule names that hold, in order. ``row`` maps each name to its condition; null counts as false."""
    listed = [F.when(F.coalesce(row[name], F.lit(False)), F.lit(name)) for name in FINDINGS if name in row]
    return F.array_compact(F.array(*listed))


def basis_finding(state: Column) -> Column:
    """The name of the finding for a billed method outside the requirements, by the state of its basis."""
    names = {"no_basis_found": "billed_ndt_not_in_requirements", "not_submitted": "billed_ndt_basis_not_submitted", "unclear": "billed_ndt_basis_unclear", "covered": "billed_ndt_covered_by_scwep"}
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(state == key, name).otherwise(out)
    return out


#: Checks that can be switched off.
SWITCHES = {
    "check_billed_ndt_in_requirements": True,
    "check_required_ndt_present": True,
    "require_submitted_basis": True,
    "require_conditional_schema": True,
    "never_claim_on_empty_drawing_requirement": True,
    "never_claim_on_flagged_drawing_set": True,
}


def _plain(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def joint_field(joints: Column, joint_no: Column, field: str) -> Column:
    """A field of the report's joint of this number; of its only joint if the claim names none; else null."""
    named = F.get(F.filter(joints, lambda j: _plain(j["joint_no"]) == _plain(joint_no)), F.lit(0))[field]
    only = F.when(F.size(joints) == 1, F.get(joints, F.lit(0))[field])
    return F.when(_plain(joint_no) != "", named).otherwise(only)


def is_misentry(drawing_no: Column) -> Column:
    """Whether a drawing number names a procedure: one of its dotted parts is KE, in any case."""
    return F.array_contains(F.split(_plain(drawing_no), r"\."), "KE")


def overbill_claim(state: Column, reason: Column, required: Column, flagged: Column, switches: dict[str, bool] | None = None) -> Column:
    """struct(rule, reason) for a billed method that the drawing doesn't ask for, by the state of its basis.

    Only no_basis_found, on a drawing whose requirements were read, aren't empty and aren't flagged, is a hard finding.
    """
    on = SWITCHES | (switches or {})
    state, reason = F.coalesce(state, F.lit("not_submitted")), reason
    if not on["require_submitted_basis"]:
        state, reason = F.lit("no_basis_found"), F.lit("gate_disabled")
    elif not on["require_conditional_schema"]:
        state = F.when((state == "not_submitted") & (reason == "scwep_legacy_schema"), "no_basis_found").otherwise(state)
    block = F.lit(None).cast("string")
    if on["never_claim_on_flagged_drawing_set"]:
        block = F.when(F.coalesce(flagged, F.lit(False)), "drawing_set_flagged")
    if on["never_claim_on_empty_drawing_requirement"]:
        block = F.when(F.size(required) == 0, "drawing_requirement_empty").otherwise(block)
    blocked = (state == "no_basis_found") & block.isNotNull()
    return F.struct(basis_finding(F.when(blocked, "not_submitted").otherwise(state)).alias("rule"), F.when(blocked, block).otherwise(reason).alias("reason"))


def compliance(rows: DataFrame, switches: dict[str, bool] | None = None) -> DataFrame:
    """rows with ``findings`` (names in order), ``claim_reason``, ``still_required``, ``extra_method`` and ``refs_of``.

    rows: drawing_no, joint_no, ndt_method, result, welder_id, report_id, report_drawing_no, joints (of the report: array of
    structs with joint_no, result, welder_id), required (methods; null: the joint has no requirement or it couldn't be read; an
    empty array requires nothing), set_flagged, basis_state, basis_reason, and flags reference_flagged, violations,
    corrected, failed. Columns that aren't there count as null. Methods of both sides are brought to their canonical names.
    refs_of: claim where the basis' own references go with the row, authority where the requirement is missing.
    """
    on = SWITCHES | (switches or {})
    here = {c.lower() for c in rows.columns}
    get = lambda name, kind="string": F.col(name) if name in here else F.lit(None).cast(kind)
    needed = F.array_distinct(F.filter(F.transform(get("required", "array<string>"), lambda m: method(m)), lambda m: F.coalesce(m != "", F.lit(False))))
    rows = rows.withColumn("_billed", method(get("ndt_method"))).withColumn("_needed", needed)
    billed, needed = F.col("_billed"), F.col("_needed")
    has = F.coalesce(billed, F.lit("")) != ""
    outside = has & needed.isNotNull() & ~F.array_contains(needed, F.coalesce(billed, F.lit("")))
    rows = rows.withColumn("_claim", overbill_claim(get("basis_state"), get("basis_reason"), needed, get("set_flagged", "boolean"), on))
    claim = F.col("_claim")
    others = F.array_sort(F.array_except(needed, F.array(F.coalesce(billed, F.lit("")))))
    joints = get("joints", "array<struct<joint_no:string,result:string,welder_id:string>>")
    fields = {f.name for f in rows.schema["joints"].dataType.elementType.fields} if "joints" in here else set()
    missing = F.col("report_id").isNull()
    known = {
        "drawing_no_is_ke_misentry": is_misentry(get("drawing_no")) | is_misentry(get("report_drawing_no")),
        "no_matching_report": missing,
        "drawing_requirement_missing": needed.isNull(),
        "low_confidence_code_ref": get("reference_flagged", "boolean"),
        "rule_engine_violation": get("violations", "boolean"),
        "ocr_auto_corrected": get("corrected", "boolean"),
        "pipeline_row_failed": get("failed", "boolean"),
    }
    if on["check_billed_ndt_in_requirements"]:
        known |= {name: outside & (claim["rule"] == name) for name in ("billed_ndt_not_in_requirements", *CEILINGS)}
    if on["check_required_ndt_present"]:
        known["required_ndt_missing"] = has & (F.coalesce(F.size(others), F.lit(0)) > 0)
    for name, field in (("result_mismatch", "result"), ("welder_mismatch", "welder_id")):
        if field in fields and field in here:
            found = joint_field(joints, get("joint_no"), field)
            known[name] = ~missing & (_plain(F.col(field)) != "") & (_plain(found) != "") & (_plain(F.col(field)) != _plain(found))
    out = rows.withColumn("findings", findings(known))
    gated = F.coalesce(outside, F.lit(False)) & F.lit(on["check_billed_ndt_in_requirements"])
    return out.withColumns({
        "claim_reason": F.when(gated, claim["reason"]),
        "still_required": F.when(has, others),
        "extra_method": F.when(gated, billed),
        "refs_of": F.when(needed.isNull(), "authority").when(gated, "claim"),
    }).drop("_billed", "_needed", "_claim")


def scope_drawing(drawing_no: Column, report_drawing_no: Column) -> Column:
    """The number by which the scope of procedure documents is told: the claim's, else the report's; none if either is KE."""
    return F.when(~(is_misentry(drawing_no) | is_misentry(report_drawing_no)), first_given(drawing_no, report_drawing_no))


def first_given(*columns: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in columns])


def report_values(report: dict[str, Column], extracted: Column) -> list[Column]:
    """A report's fields: the table's own value where it isn't blank, else that of the extracted JSON."""
    return [first_given(value.cast("string"), F.get_json_object(extracted, f"$.{name}")).alias(name) for name, value in report.items()]


def match_reasons(report_id: Column, how: Column, score: Column, discrepancies: Column) -> Column:
    """Why a match needs a look: array of texts. discrepancies: array of struct(field, billing_value, report_value, severity)."""
    high = F.transform(F.filter(F.coalesce(discrepancies, F.array().cast("array<struct<field:string,billing_value:string,report_value:string,severity:string>>")), lambda d: d["severity"] == "high"),
                       lambda d: F.concat(F.lit("differs: "), d["field"], F.lit(" ("), F.coalesce(d["billing_value"], F.lit("-")), F.lit(" / "), F.coalesce(d["report_value"], F.lit("-")), F.lit(")")))
    low = F.when((how == "fuzzy") & (score < 90), F.concat(F.lit("low score "), F.format_number(score, "0.0")))
    said = F.when(how == "llm", "judged by a model")
    return F.when(report_id.isNull(), F.array(F.lit("no report matched"))).otherwise(F.concat(F.array_compact(F.array(low, said)), high))


def tagged(**reasons: Column) -> Column:
    """All reasons (arrays, null for none) in one array, each with its origin in brackets."""
    none = F.array().cast("array<string>")
    with_origin = lambda origin: lambda r: F.concat(F.lit(f"[{origin}] "), r)
    return F.concat(*[F.transform(F.coalesce(c, none), with_origin(origin)) for origin, c in reasons.items()])


def risk(names: Column, weights: dict[str, int] | None = None) -> Column:
    """Sum of weights, a repeated finding counting each time, from 0 to 100. Unknown names weigh nothing."""
    known = {k: w for k, (w, _) in FINDINGS.items()} | (weights or {})
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    total = F.aggregate(names, F.lit(0), lambda a, x: a + F.coalesce(F.try_element_at(table, x), F.lit(0)))
    return F.greatest(F.least(total, F.lit(100)), F.lit(0))


def _any(names: Column, kind: str) -> Column:
    return F.arrays_overlap(names, F.array(*[F.lit(k) for k, (_, c) in FINDINGS.items() if c == kind]))


def verdict(names: Column, matched: Column, score: Column) -> Column:
    """NONCOMPLIANT for any hard finding; SUSPECT for a suspect one, no match or a score below 90; else OK."""
    doubt = _any(names, "suspect") | ~matched | F.coalesce(score < 90, F.lit(False))
    return F.when(_any(names, "hard"), "NONCOMPLIANT").when(doubt, "SUSPECT").otherwise("OK")


def severity(label: Column) -> Column:
    """0 to 2; an unknown label is SUSPECT, null stays null."""
    return F.when(label == "OK", 0).when(label == "NONCOMPLIANT", 2).when(label.isNotNull(), 1)


def reconciled(own: Column, model: Column, names: Column) -> tuple[Column, Column]:
    """(final, disagree): the stricter of the rules' verdict and the model's, the latter capped by the basis findings.

    disagree compares with the model's verdict before it is capped. Without a model verdict the rules' stands.
    """
    capped = _any_of(names, list(CEILINGS))
    given = severity(model)
    allowed = F.when(capped, F.least(given, F.lit(1))).otherwise(given)
    final = F.greatest(severity(own), F.coalesce(allowed, F.lit(0)))
    label = F.when(final == 0, "OK").when(final == 1, "SUSPECT").otherwise("NONCOMPLIANT")
    return label, F.coalesce(given != severity(own), F.lit(False))


def _any_of(names: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, wanted)))


def violations(checks: list[tuple[str, Column, str, Column, str]]) -> Column:
    """Array of (field, raw_value, rule, severity) of the checks (field, value, rule, fine, severity) that fail.

    A null value passes every check; a check that gives null fails.
    """
    listed = [F.when(value.isNotNull() & ~F.coalesce(fine, F.lit(False)), F.struct(F.lit(field).alias("field"), value.cast("string").alias("raw_value"), F.lit(rule).alias("rule"), F.lit(level).alias("severity"))) for field, value, rule, fine, level in checks]
    return F.array_compact(F.array(*listed))


def within(c: Column, low: float, high: float) -> Column:
    """Numbers in a range; text that is no number, and NaN, are not."""
    return c.try_cast("double").between(low, high)


# Enumerations, patterns and ranges of the checks of fields.
NDT_METHODS = ("VT", "PT", "MT", "RT", "UT", "VMC")
RESULTS = ("ACC", "REJ", "PENDING", "A", "R", "P")
SAFETY_CLASSES = ("1", "2", "3", "4", "1N", "2N", "3N", "4N")
SEISMIC_CATEGORIES = ("I", "II", "III")
DRAWING_NO = r"^NP\.[A-Z]\.[A-Z0-9]+\.\d+\.[A-Z0-9&]+\.\d+\.(DC|SD|BG|KE)\.\d+\.[A-Z](?:_C\d+)?$"
REPORT_NO = r"(?i)^\d{1,3}-\d{1,4}\s?(VT|PT|MT|RT|UT|VMC)$"
KKS_CODE = r"^\d{2}[A-Z]{2,4}\d{0,3}[A-Z0-9]{0,6}$"
JOINT_NO = r"(?i)^[A-Z]{1,4}\d{1,5}[A-Z]?$"
WELDER_TOKEN = r"(?i)^[A-Z]{1,4}\d{1,4}$"
PRESSURE, TEMPERATURE, PERCENT = (0.0, 50.0), (-50.0, 800.0), (0.0, 100.0)
MATRIX_FIELDS = ("vt_pct", "pt_or_mt_pct", "rt_pct", "ut_pct", "auxiliary_vt_pct", "auxiliary_pt_or_mt_pct")


def _failed(field: Column, value: Column, rule: str, expected: str, level: str, bad: Column) -> Column:
    return F.when(value.isNotNull() & F.coalesce(bad, F.lit(True)), F.struct(field.alias("field"), value.cast("string").alias("raw_value"), F.lit(rule).alias("rule"), F.lit(expected).alias("expected"), F.lit(level).alias("severity")))


def _name(field: str | Column) -> Column:
    return F.lit(field) if isinstance(field, str) else field


def enum_check(field, value: Column, allowed: tuple[str, ...]) -> Column:
    return _failed(_name(field), value, "enum_violation", "one of " + ", ".join(sorted(allowed)), "high", ~F.upper(F.trim(value.cast("string"))).isin(*allowed))


def pattern_check(field, value: Column, pattern: str, expected: str, level: str = "medium") -> Column:
    return _failed(_name(field), value, "regex_violation", expected, level, ~F.trim(value.cast("string")).rlike(pattern))


def range_check(field, value: Column, low: float, high: float) -> Column:
    """No number: type_violation, high; NaN or a number outside: range_violation, medium."""
    number = value.cast("string").try_cast("double")
    outside = _failed(_name(field), value, "range_violation", f"{low:g} to {high:g}", "medium", F.isnan(number) | ~number.between(low, high))
    return F.when(value.isNotNull() & number.isNull(), _failed(_name(field), value, "type_violation", "a number", "high", F.lit(True))).otherwise(outside)


def date_check(field, value: Column) -> Column:
    return _failed(_name(field), value, "date_format_violation", "a day", "high", ~is_date(value.cast("string")))


def welder_check(field, value: Column) -> Column:
    """One violation for a value with any token that is no welder's id; blank is none."""
    bad = F.exists(F.split(F.trim(value), r"\s+"), lambda t: ~t.rlike(WELDER_TOKEN))
    return _failed(_name(field), F.when(F.trim(value) != "", value), "welder_token_pattern", "letters and digits", "low", bad)


def billing_violations(row) -> Column:
    """Violations of a claim's fields, in their order. ``row``: a function from a field's name to its column."""
    return F.array_compact(F.array(
        enum_check("ndt_method", row("ndt_method"), NDT_METHODS), enum_check("result", row("result"), RESULTS),
        pattern_check("report_no", row("report_no"), REPORT_NO, "a report number"), pattern_check("drawing_no", row("drawing_no"), DRAWING_NO, "a drawing number"),
        pattern_check("joint_no", row("joint_no"), JOINT_NO, "a joint number", "low"), date_check("inspection_date", row("inspection_date")),
        welder_check("welder_id", row("welder_id")), range_check("unit_price", row("unit_price"), 0.0, 1e9), range_check("amount", row("amount"), 0.0, 1e12),
    ))


def _each(rows: Column, name: str, checks) -> Column:
    """Violations of the elements of an array; a field is named by its place: joints[0].result."""
    at = lambda i, f: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{f}"))
    return F.coalesce(F.flatten(F.transform(rows, lambda x, i: F.array_compact(F.array(*checks(x, lambda f: at(i, f)))))), F.array().cast(VIOLATIONS))


VIOLATIONS = "array<struct<field:string,raw_value:string,rule:string,expected:string,severity:string>>"


def report_violations(row) -> Column:
    """Violations of a report's fields, then of its joints' (array of structs with result, joint_no, welder_id)."""
    own = F.array_compact(F.array(
        pattern_check("report_no", row("report_no"), REPORT_NO, "a report number"), enum_check("ndt_method", row("ndt_method"), NDT_METHODS),
        date_check("inspection_date", row("inspection_date")), pattern_check("drawing_no", row("drawing_no"), DRAWING_NO, "a drawing number"),
    ))
    joints = _each(row("joints"), "joints", lambda j, at: (enum_check(at("result"), j["result"], RESULTS), pattern_check(at("joint_no"), j["joint_no"], JOINT_NO, "a joint number", "low"), welder_check(at("welder_id"), j["welder_id"])))
    return F.concat(own, joints)


def drawing_violations(row) -> Column:
    """Violations of a drawing's number, of its lines (kks_lines) and of its inspection matrix; a dash or blank is no percentage."""
    own = F.array_compact(F.array(pattern_check("drawing_no", row("drawing_no"), DRAWING_NO, "a drawing number")))
    lines = _each(row("kks_lines"), "kks_lines", lambda x, at: (
        pattern_check(at("kks_code"), x["kks_code"], KKS_CODE, "a code", "low"), enum_check(at("safety_class"), x["safety_class"], SAFETY_CLASSES),
        enum_check(at("seismic"), x["seismic"], SEISMIC_CATEGORIES), range_check(at("design_pressure_mpag"), x["design_pressure_mpag"], *PRESSURE),
        range_check(at("design_temperature_c"), x["design_temperature_c"], *TEMPERATURE)))
    given = lambda c: F.when(~c.isin("", "-"), c)
    matrix = _each(row("inspection_matrix"), "inspection_matrix", lambda x, at: (
        pattern_check(at("kks_code"), x["kks_code"], KKS_CODE, "a code", "low"), *[range_check(at(f), given(x[f].cast("string")), *PERCENT) for f in MATRIX_FIELDS]))
    return F.concat(own, lines, matrix)


def is_required(value: Column) -> Column:
    """Whether an entry of an inspection matrix asks for the inspection: given, and no dash or zero."""
    text = F.trim(value.cast("string"))
    return F.coalesce(~text.isin("", "-", "0", "0%") & (F.coalesce(text.try_cast("double"), F.lit(1.0)) != 0), F.lit(False))


def corrected(found: Column, corrections: Column) -> Column:
    """The violations that accepted corrections (array of field names) don't settle. Only fields of the row itself are corrected."""
    return F.filter(found, lambda v: ~(F.array_contains(corrections, v["field"]) & ~v["field"].rlike(r"[.\[]")))


def summary(found: Column) -> Column:
    """struct(high, medium, low, needs_review): counts by severity; review for any high or three medium ones."""
    n = lambda level: F.size(F.filter(found, lambda x: x["severity"] == level))
    return F.struct(n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"), ((n("high") > 0) | (n("medium") >= 3)).alias("needs_review"))


def basis_state(docs: DataFrame) -> DataFrame:
    """One state for each key from rows (key, ordinal, strong, weak, eligible, reason) of a claim's documents.

    covered before unclear before no_basis_found before not_submitted, the last with the first document's reason.
    """
    out = docs.groupBy("key").agg(
        F.coalesce(F.bool_or("strong"), F.lit(False)).alias("strong"),
        F.coalesce(F.bool_or("weak"), F.lit(False)).alias("weak"),
        F.coalesce(F.bool_or("eligible"), F.lit(False)).alias("eligible"),
        F.min_by("reason", "ordinal").alias("first_reason"),
    )
    state = F.when(F.col("strong"), "covered").when(F.col("weak"), "unclear").when(F.col("eligible"), "no_basis_found").otherwise("not_submitted")
    return out.select("key", state.alias("state"), F.when(state == "not_submitted", F.col("first_reason")).alias("reason"))


# What each state of the basis asks the reviewer to do.
ACTIONS = {
    "billed_ndt_not_in_requirements": "Reject the charge: no document asks for this inspection.",
    "billed_ndt_basis_not_submitted": "Ask for the procedure document.",
    "billed_ndt_basis_unclear": "Check the procedure document by hand.",
    "billed_ndt_covered_by_scwep": "Confirm that the condition of the procedure applied.",
}


def action(names: Column, model_text: Column) -> Column:
    """The action of the first finding on the basis; else the model's text."""
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    first = F.get(F.filter(names, lambda x: x.isin(*ACTIONS)), F.lit(0))
    return F.coalesce(F.try_element_at(table, F.coalesce(first, F.lit(""))), model_text)


def labels(required: Column, billed: Column) -> Column:
    """struct(required, missing, extra) as text for the review sheet; a dash for none, (not read) for null."""
    text = lambda x: F.coalesce(F.nullif(F.array_join(F.array_sort(x), ", "), F.lit("")), F.lit("-"))
    unread = F.lit("(not read)")
    return F.struct(
        F.when(required.isNull(), unread).otherwise(text(required)).alias("required"),
        F.when(required.isNull(), unread).otherwise(text(F.array_except(required, billed))).alias("missing"),
        F.when(required.isNull(), unread).otherwise(text(F.array_except(billed, required))).alias("extra"),
    )


def basis_label(state: Column) -> Column:
    """How the review sheet names a state of the basis; null for none."""
    # The sheet's words.
    words = {"covered": "SCWEP 근거 있음 — 조건 확인 필요", "unclear": "근거 불명확 — 조항 확인", "not_submitted": "근거 미제출 — 제출 요청", "no_basis_found": "근거 밖 — 과다청구"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.coalesce(state, F.lit("")))


def citations(refs: Column, accused: Column) -> Column:
    """struct(docs, places) of references (array of struct(authority_level, doc, section, page)) as text; null where none.

    Next to an accusation no procedure document (level 2) is shown, as it would read like a permission.
    """
    shown = F.filter(refs, lambda r: ~(accused & F.coalesce(r["authority_level"] == 2, F.lit(False))))
    docs = F.array_sort(F.array_distinct(F.filter(F.transform(shown, lambda r: r["doc"]), lambda d: F.coalesce(d != "", F.lit(False)))))
    place = lambda r: F.concat_ws("/", F.nullif(r["section"], F.lit("")), F.concat(F.lit("p."), r["page"].cast("string")))
    places = F.array_sort(F.array_distinct(F.filter(F.transform(shown, place), lambda x: x != "")))
    text = lambda x: F.nullif(F.array_join(x, " / "), F.lit(""))
    return F.struct(text(docs).alias("docs"), text(places).alias("places"))
