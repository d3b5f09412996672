"""The basis of a claim: what the submitted procedure documents say about a method that the drawing doesn't ask for.

Documents come as rows: ordinal, document_no, kks (of the scope's own field), disciplines, needs_review, schema_version,
confidence, and the arrays conditional (ndt_method, trigger, trigger_keywords, quote, quote_verified, confidence), general
(ndt_method, topic) and sampling (ndt_method, rate_pct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.normalise import same_scope, scope, scope_segment

# Least confidence of a rule and of a document, least schema, topics of general rules that count as a
# mention, and words of a trigger that say nothing.
RULE_CONFIDENCE, DOC_CONFIDENCE, SCHEMA = 0.7, 0.7, 2
TOPICS = ("procedure", "sampling", "re-examination", "acceptance")
STOP_WORDS = ("후", "전", "및", "the", "of", "and", "shall", "be", "to", "in", "a", "is", "for", "제거", "자리")
STATES = ("covered", "unclear", "no_basis_found", "not_submitted")

DOCUMENT = (
    "ordinal long, document_no string, kks string, disciplines array<string>, needs_review boolean, schema_version int, confidence string, "
    "conditional array<struct<ndt_method:string,trigger:string,trigger_keywords:array<string>,quote:string,quote_verified:boolean,confidence:string>>, "
    "general array<struct<ndt_method:string,topic:string>>, sampling array<struct<ndt_method:string,rate_pct:string>>"
)


def _said(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def _upper(c: Column) -> Column:
    return F.upper(_said(c))


def sure(c: Column, least: float) -> Column:
    """Whether a confidence is a number of ``least`` or more; missing ones and other text are not."""
    number = c.cast("string").try_cast("double")
    return F.coalesce((number >= least) & ~F.isnan(number), F.lit(False))


def scope_state(document_no: Column, kks: Column, disciplines: Column, discipline: Column, drawing_no: Column) -> Column:
    """yes, no or unknown: by the codes of building and system first, by the list of disciplines where these don't tell."""
    by_code = same_scope(F.coalesce(scope(document_no), scope_segment(kks)), scope(drawing_no))
    have = F.filter(F.transform(disciplines, _upper), lambda x: x != "")
    listed = F.when((_said(discipline) == "") | (F.coalesce(F.size(have), F.lit(0)) <= 0), "unknown").when(F.array_contains(have, _upper(discipline)), "yes").otherwise("no")
    return F.when(by_code != "unknown", by_code).otherwise(listed)


def context_matches(trigger: Column, keywords: Column, context: Column) -> Column:
    """Whether a reason stated in a report has one of a rule's keywords, or, without any, a word of its trigger.

    Words of one letter and stop words don't count. A blank reason matches nothing.
    """
    given = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(_said(k))), lambda k: k != "")
    words = F.filter(F.split(F.lower(_said(trigger)), r"[\s,·/]+"), lambda w: (F.char_length(w) >= 2) & ~w.isin(*STOP_WORDS))
    text = F.lower(_said(context))
    return (text != "") & F.exists(F.when(F.size(given) > 0, given).otherwise(words), lambda k: F.contains(text, k))


def report_context(joints: Column, own: Column) -> Column:
    """The distinct reasons of a report's joints, then its own, joined by " / "; null if it states none. Case doesn't tell them apart."""
    every = F.concat(F.transform(F.coalesce(joints, F.array().cast("array<string>")), _said), F.array(_said(own)))
    every = F.filter(every, lambda x: x != "")
    low = F.transform(every, lambda x: F.lower(x))
    first = F.filter(F.transform(every, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.nullif(F.array_join(first, " / "), F.lit(""))


def _strong(rule: Column, method: Column, flagged: Column, context: Column) -> Column:
    """Whether a conditional rule proves a basis: of this very method (not ALL), with trigger and quote, the quote not refuted."""
    full = (_said(rule["trigger"]) != "") & (_said(rule["quote"]) != "") & F.coalesce(rule["quote_verified"], F.lit(True))
    fits = (_said(context) == "") | context_matches(rule["trigger"], rule["trigger_keywords"], context)
    return (_upper(rule["ndt_method"]) == method) & full & sure(rule["confidence"], RULE_CONFIDENCE) & ~flagged & fits


def classified(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each distinct (ndt_method, discipline, drawing_no, report_context) of the claims: state, reason, trigger, docs.

    covered before unclear before no_basis_found before not_submitted. ``docs``: those that cover, mention, or are silent.
    ``reason`` of a claim that nothing can be said of is that of the first document. Claims repeat few such keys and the
    documents of an audit are few, so both are made distinct and meet by a broadcast; each pair gives a row of flags.
    """
    key = ["ndt_method", "discipline", "drawing_no", "report_context"]
    asked = claims.select(*key).distinct()
    docs = docs.withColumn("_there", F.lit(True))
    pairs = asked.join(F.broadcast(docs), F.lit(True), "left")
    method, context = _upper(F.col("ndt_method")), F.col("report_context")
    state = scope_state(F.col("document_no"), F.col("kks"), F.col("disciplines"), F.col("discipline"), F.col("drawing_no"))
    flagged = F.coalesce("needs_review", F.lit(True))
    rows = pairs.withColumn("_scope", state).withColumn("_flagged", flagged).withColumn("_name", F.when(_said(F.col("document_no")) != "", _said(F.col("document_no"))).otherwise("(no number)"))
    hits = F.filter("conditional", lambda r: _upper(r["ndt_method"]) == method)
    strong = F.filter("conditional", lambda r: _strong(r, method, F.col("_flagged"), context))
    general = F.exists("general", lambda r: ((_upper(r["ndt_method"]) == "ALL") | (_upper(r["ndt_method"]) == method)) & _said(r["topic"]).isin(*TOPICS))
    sampled = F.exists("sampling", lambda r: (_upper(r["ndt_method"]) == method) & (F.coalesce(r["rate_pct"].try_cast("double"), F.lit(0.0)) != 0))
    inside = F.col("_there") & (F.col("_scope") != "no")
    true = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumn("_strong", F.when(inside, strong)).withColumn("_n", F.coalesce(F.size("_strong"), F.lit(0)))
    rows = rows.withColumn("_is_strong", F.col("_n") > 0)
    rows = rows.withColumn("_is_weak", true(inside & (true(F.size(hits) > F.col("_n")) | true(general) | true(sampled))))
    extracted = (F.coalesce(F.size("conditional"), F.lit(0)) > 0) | (F.coalesce(F.size("general"), F.lit(0)) > 0)
    reason = (
        F.when(F.col("_there").isNull(), "scwep_not_submitted")
        .when(F.col("_scope") == "unknown", "scwep_scope_unknown")
        .when(F.col("_scope") == "no", "scwep_out_of_scope")
        .when(F.coalesce("schema_version", F.lit(1)) < SCHEMA, "scwep_legacy_schema")
        .when(F.col("_flagged"), "scwep_doc_needs_review")
        .when(~sure(F.col("confidence"), DOC_CONFIDENCE), "scwep_low_confidence")
        .when(~extracted, "scwep_extraction_empty")
    )
    rows = rows.withColumn("_reason", reason)
    names = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("_name"))))
    out = rows.groupBy(*key).agg(
        F.bool_or("_is_strong").alias("_s"),
        F.bool_or("_is_weak").alias("_w"),
        F.bool_or(F.col("_reason").isNull()).alias("_e"),
        F.min_by("_reason", F.coalesce("ordinal", F.lit(0))).alias("_first"),
        F.min_by(F.get(F.col("_strong.trigger"), F.lit(0)), F.when(F.col("_is_strong"), F.col("ordinal"))).alias("_trigger"),
        names(F.col("_is_strong")).alias("_covering"),
        names(F.col("_is_weak")).alias("_mentioning"),
        names(F.col("_reason").isNull()).alias("_silent"),
    )
    empty = _upper(F.col("ndt_method")) == ""
    label = F.when(empty, "not_submitted").when(F.col("_s"), "covered").when(F.col("_w"), "unclear").when(F.col("_e"), "no_basis_found").otherwise("not_submitted")
    why = F.when(empty, "billed_method_empty").when(F.col("_s"), "covered_by_conditional").when(F.col("_w"), "mentioned_without_condition").when(F.col("_e"), "no_basis_found").otherwise(F.col("_first"))
    none = F.array().cast("array<string>")
    docs_of = F.when(label == "covered", F.col("_covering")).when(label == "unclear", F.col("_mentioning")).when(label == "no_basis_found", F.col("_silent")).otherwise(none)
    return out.select(*key, label.alias("state"), why.alias("reason"), F.when(label == "covered", _said(F.col("_trigger"))).alias("trigger"), docs_of.alias("docs"))


def sampling_references(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claims (ndt_method, ...) with each document's sampling rule of the same method: document_no, rate_pct."""
    rules = docs.select("document_no", F.explode("sampling").alias("_r"))
    rules = rules.select("document_no", _upper(F.col("_r.ndt_method")).alias("_m"), F.col("_r.rate_pct").alias("rate_pct"))
    return claims.withColumn("_m", _upper(F.col("ndt_method"))).join(rules, "_m").drop("_m")


def rollup(found: DataFrame, by: str, limit: float = 0.3, least: int = 3) -> DataFrame:
    """Per round: rows by state (all four, zeros too), reasons of not_submitted, the document that covers most, and alarms.

    found: a row a finding of a claim: ``by``, item_id, rule, basis_state, basis_reason, basis_docs (nulls where the rule is another).
    gate_idle: claims without a requirement, and no state at all. never_confirms: states, but none of them confirmed.
    one_covers: a document covers ``limit`` of the covered rows and ``least`` rows or more. Ties go to the document that comes
    first in the alphabet.
    """
    of = lambda name: F.count(F.when(F.col("basis_state") == name, 1)).alias(name)
    rows = found.groupBy(by).agg(
        *[of(s) for s in STATES],
        F.countDistinct("item_id").alias("rows_with_findings"),
        F.countDistinct(F.when(F.col("rule") == "drawing_requirement_missing", F.col("item_id"))).alias("unevaluated_rows"),
    )
    reasons = found.where("basis_state = 'not_submitted'").groupBy(by, F.coalesce("basis_reason", F.lit("?")).alias("reason")).agg(F.count("*").alias("n"))
    reasons = reasons.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "reason", "n"))), ", ").alias("suppression_reasons"))
    covering = found.where("basis_state = 'covered'").select(by, F.explode("basis_docs").alias("doc")).groupBy(by, "doc").agg(F.count("*").alias("n"))
    top = covering.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("doc").alias("doc"))).alias("t")).select(by, F.col("t.doc").alias("top_doc"), (-F.col("t.m")).alias("top_rows"))
    out = rows.join(reasons, by, "left").join(top, by, "left")
    total = sum((F.col(s) for s in STATES), F.lit(0))
    return out.withColumns({
        "gate_idle": (total == 0) & (F.col("unevaluated_rows") > 0),
        "never_confirms": (total > 0) & (F.col("no_basis_found") == 0),
        "one_covers": F.coalesce((F.col("covered") > 0) & (F.col("top_rows") / F.col("covered") >= limit) & (F.col("top_rows") >= least), F.lit(False)),
    })
