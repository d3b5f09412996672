"""Grades of the criteria that a claim cites in free text, and what they say of the methods billed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of standards, clauses, and the patterns by which a text cites them.
SP, GOST = "SP 70.13330.2012", "GOST 23118"
SP_PATTERN, GOST_PATTERN = r"(?i)(?:SP\s*)?70\.13330[.\-]?(\d{4})?", r"(?i)GOST\s*23118(?:-(\d{4}))?"
SP_SCOPE_CLAUSE, GOST_CLAUSE = r"(?i)clause\s*10\.4|table\s*10\.6", r"\b6\.18\b"
CONCEALED, CRITICAL = r"(?i)concealed\s+works?", r"(?i)critical\s+st(?:r)?uctures?|examination\s+certificates?"
EMBEDDED, GENERAL = r"(?i)embedded\s+parts?", r"(?i)shall\s+be\s+implemented\s+and\s+accepted|in\s+compliance\s+with"
NOTE, WHOLE = r"\(([A-Z]/[\d.]+)\)", r"(?i)100\s*%|each\s+weld|entire\s+length|all\s+(?:the\s+)?(?:welded\s+)?joints"
VISUAL = r"(?i)visual|VT\b"
#: Methods that the cited criteria don't ask for.
OTHER_METHODS = ("PT", "LT", "KT", "UT", "RT")


def graded(text: Column) -> Column:
    """struct(grade, standard, clause, method, scope_pct, note_ref, needs_review) of a text; the first grade that fits holds.

    A1 the clause on the scope of inspection; A2 the standard on steel structures; A3 to A5 clauses on documents; A6 general
    compliance; B1 a note of the drawing; B2 method and scope without a source; B3 a method alone; UNKNOWN; EMPTY.
    """
    said = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    has = lambda pattern: said.rlike(pattern)
    none = F.lit(None).cast("string")
    method = F.when(has(VISUAL), "VT")
    scope = F.when(has(WHOLE), 100.0)
    year = F.nullif(F.regexp_extract(said, GOST_PATTERN, 1), F.lit(""))

    def is_(grade: str, standard=none, clause=none, how=none, pct=F.lit(None).cast("double"), note=none, review=F.lit(False)) -> Column:
        parts = {"grade": F.lit(grade), "standard": standard, "clause": clause, "method": how, "scope_pct": pct, "note_ref": note, "needs_review": review}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    true, vt, all_ = F.lit(True), F.lit("VT"), F.lit(100.0)
    return (
        F.when((said == "") | F.lower(said).isin("none", "nan", "-"), is_("EMPTY", review=true))
        .when(has(SP_PATTERN) & has(SP_SCOPE_CLAUSE), is_("A1", F.lit(SP), F.lit("10.4/T10.6"), vt, all_))
        .when(has(GOST_PATTERN), is_("A2", F.concat_ws("-", F.lit(GOST), year), F.when(has(GOST_CLAUSE), "6.18(2012판)"), vt, all_, review=F.coalesce(year == "2012", F.lit(False))))
        .when(has(SP_PATTERN) & has(CONCEALED), is_("A3", F.lit(SP), F.lit("concealed works acceptance")))
        .when(has(CRITICAL), is_("A4", F.lit(SP), F.lit("critical structures acceptance")))
        .when(has(SP_PATTERN) & has(EMBEDDED), is_("A5", F.lit(SP), F.lit("embedded parts")))
        .when(has(SP_PATTERN) & has(GENERAL), is_("A6", F.lit(SP), review=true))
        .when(has(NOTE), is_("B1", how=method, pct=scope, note=F.regexp_extract(said, NOTE, 1), review=true))
        .when(has(VISUAL) & has(WHOLE), is_("B2", how=vt, pct=all_, review=true))
        .when(has(VISUAL), is_("B3", how=vt, review=true))
        .otherwise(is_("UNKNOWN", review=true))
    )


def criteria_findings(grade: Column, billed: Column) -> Column:
    """Array of struct(rule, severity, methods) for a grade and the billed quantities (map of method to number; 0 is none)."""
    some = F.map_filter(billed, lambda k, v: F.coalesce(v != 0, F.lit(False)))
    methods = F.array_sort(F.array_distinct(F.transform(F.map_keys(some), lambda m: F.upper(m))))
    finding = lambda rule, level, names: F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("severity"), names.alias("methods"))
    none = F.array().cast("array<string>")
    empty = F.array().cast("array<struct<rule:string,severity:string,methods:array<string>>>")
    beyond = F.transform(F.filter(methods, lambda m: m.isin(*OTHER_METHODS)), lambda m: finding("billed_method_not_in_cited_criteria", "review", F.array(m)))
    first = F.when(grade.isin("A1", "A2"), beyond).when(grade.isin("B2", "B3", "EMPTY", "UNKNOWN") & (F.size(methods) > 0), F.array(finding("billing_without_cited_criteria", "review", methods))).when(grade == "B1", F.array(finding("criteria_is_unresolved_note_ref", "review", none))).otherwise(empty)
    unbilled = F.when((grade == "A1") & ~F.array_contains(methods, "UT"), F.array(finding("required_method_unbilled_info", "info", F.array(F.lit("UT")))))
    unbilled = unbilled.when((grade == "A2") & ~F.arrays_overlap(methods, F.array(F.lit("UT"), F.lit("RT"))), F.array(finding("required_method_unbilled_info", "info", F.array(F.lit("UT"), F.lit("RT")))))
    return F.concat(first, F.coalesce(unbilled, empty))
