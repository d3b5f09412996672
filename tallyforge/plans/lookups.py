"""Queries on lookups, sequences and text, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import headers, normalise, notation
from tallyforge.operators import ledger, lookup, search, sequence
from tallyforge.plans.roles import LINES_SQL, billing, table


def enrich_first(spark, sf_dir: str) -> DataFrame:
    """The first part of each order by line, and whether others follow."""
    rows = table(spark, sf_dir, "lineitem")
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return rows.groupBy("l_orderkey").agg(F.min_by("l_partkey", place).alias("first_part"), (F.countDistinct("l_partkey") > 1).alias("conflict"))


def sheet_choice(spark, sf_dir: str) -> DataFrame:
    """For each language the source with the most rows that have text; the first in order wins a tie."""
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum((F.length("text") >= 40).cast("long")).alias("n_rows"))
    return lookup.latest(rows, ["lang"], F.desc("n_rows"), F.asc("source"))


def ledger_explode(spark, sf_dir: str) -> DataFrame:
    """Cells with several numbers, one row each; the last row of a number wins."""
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderkey", F.lit("; "), F.col("o_orderkey") + 1)).otherwise(F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("booked"), F.split(cell, r"[\n,;]").alias("numbers"))
    rows = rows.select("o_orderkey", "booked", F.explode("numbers").alias("number"), (F.size("numbers") > 1).alias("shared"))
    return rows.groupBy(F.trim("number").alias("number")).agg(F.max_by("booked", "o_orderkey").alias("booked"), F.max_by("shared", "o_orderkey").alias("shared"))


def prefix_match(spark, sf_dir: str) -> DataFrame:
    """Each url's longest known prefix: hosts, and host with language for hosts ending in .org."""
    url = F.regexp_replace(F.regexp_extract("url", r"^\w+://([^?#]*)", 1), "/$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("address"))
    host = F.substring_index("address", "/", 1)
    known = pages.select(host.alias("prefix")).union(pages.where(F.endswith(host, F.lit(".org"))).select(F.substring_index("address", "/", 2))).distinct()
    return lookup.longest_prefix(pages, "address", known, "prefix", "/").select("page_id", "address", "prefix")


def asof_effective(spark, sf_dir: str) -> DataFrame:
    """For each purchase the user's newest signup up to then."""
    events = table(spark, sf_dir, "events")
    asked = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    sets = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("set_id"), F.col("ts").alias("created_at"))
    return lookup.effective(asked, sets, "user_id", "ts", "created_at", "set_id", "set_id").select("user_id", "event_id", "set_id")


def supersede_chain(spark, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "event_id", "ts")
    return lookup.superseded(sets, "user_id", "ts", "event_id").select("user_id", "event_id", (F.unix_micros(F.col("superseded_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("open_micros"))


def revision_override(spark, sf_dir: str) -> DataFrame:
    """The cited set of a customer's orders, where its revision is loaded."""
    orders = table(spark, sf_dir, "orders")
    sets = orders.select("o_custkey", F.col("o_orderkey").alias("set_id"), F.concat(F.lit("C"), F.lpad((F.col("o_orderkey") % 5).cast("string"), 2, "0"), F.lit(",C"), F.lpad((F.col("o_orderkey") % 7 + 5).cast("string"), 2, "0")).alias("revision"))
    asked = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("set_id"), F.count("*").alias("n"))
    asked = asked.withColumn("cited", F.when(F.col("n") % 4 != 0, F.concat(F.lit("rev. с"), (F.col("n") % 12).cast("string"))))
    return lookup.cited_revision(asked, sets, "o_custkey").select("o_custkey", "set_id", F.coalesce("flag", F.lit("")).alias("flag"))


def latest_per_type(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return lookup.latest(rows, ["o_custkey", "o_orderpriority"], F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderpriority", "o_orderkey")


def notation_expand(spark, sf_dir: str) -> DataFrame:
    """Ranges of joints made of line numbers and quantities, expanded."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice")
    high = F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5
    cell = F.concat(F.lit("FW"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("÷"), F.lpad(high.cast("string"), 2, "0"))
    return rows.select("l_orderkey", cell.alias("cell"), F.explode(notation.expanded_range(cell)).alias("joint")).groupBy("cell", "joint").agg(F.count("*").alias("n"))


def notation_grammar(spark, sf_dir: str) -> DataFrame:
    """Cells in each form of the grammar, made of a line's numbers, with what they stand for."""
    forms = F.expr("""array(
        concat('(', l_linenumber, '÷', l_linenumber + 2, ')SC', l_suppkey % 7, '-1,2'), concat('R.', l_linenumber, ',', l_linenumber + 10, '-up,dn'), concat('S.', l_linenumber, 'E-(up-1,2,dn-', l_linenumber, ')'),
        concat('G', l_suppkey % 7, '.(0', l_linenumber, '÷', 10 + l_linenumber, ')'), concat('R.4.(1÷', l_linenumber, ')-dn,up'), concat('FW', l_linenumber, '\nFW', l_linenumber, ',FX'), concat('A', l_linenumber, '÷B', l_linenumber + 1), concat('(', l_linenumber + 1, '÷1)K'))""")
    rows = table(spark, sf_dir, "lineitem").select(F.explode(forms).alias("cell")).distinct()
    return rows.select("cell", F.array_join(notation.expanded(F.col("cell")), "|").alias("joints"))


def notation_reconcile(spark, sf_dir: str) -> DataFrame:
    """Whether the expanded cell has as many joints as the quantity says, by outcome."""
    rows = table(spark, sf_dir, "lineitem")
    quantity = F.when(F.col("l_quantity") < 40, F.col("l_quantity"))
    cell = F.concat(F.lit("FW1÷"), F.col("l_quantity").cast("int") + F.col("l_linenumber") % 2)
    ok = notation.reconciled(quantity, notation.expanded_range(cell))
    return rows.groupBy(F.coalesce(ok.cast("string"), F.lit("unknown")).alias("outcome")).agg(F.count("*").alias("n"))


def _numbered(spark, sf_dir: str, *more: str) -> DataFrame:
    """Events of a user as pages, with the event type as number; every eleventh one unreadable."""
    events = table(spark, sf_dir, "events")
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select("user_id", page.alias("page"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("number"), *more)


def segment_islands(spark, sf_dir: str) -> DataFrame:
    return sequence.islands(_numbered(spark, sf_dir), "user_id", "page", "number")


def absorb(spark, sf_dir: str) -> DataFrame:
    out = sequence.absorbed(_numbered(spark, sf_dir), "user_id", "page", "number")
    return out.select("user_id", "page", F.coalesce("segment", F.lit("-")).alias("segment"), "absorbed")


def segment_pages(spark, sf_dir: str) -> DataFrame:
    """Pages of a user's events with some missing and others unreadable, as segments with what they absorb."""
    rows = _numbered(spark, sf_dir, "event_id").where("event_id % 13 <> 0").withColumn("source", F.when(F.col("event_id") % 3 == 0, "regex+billing").otherwise("regex"))
    out = sequence.segments(rows, "user_id", "page", "number", "source")
    return out.select("user_id", F.coalesce("number", F.lit("-")).alias("number"), "first_page", "last_page", F.array_join(F.col("absorbed_pages").cast("array<string>"), ",").alias("absorbed_pages"), "disjoint", "confidence")


def running_fold(spark, sf_dir: str) -> DataFrame:
    """Turns of a conversation as pages with one field, cut where it changes."""
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "CASE WHEN length(text) % 3 = 0 THEN substr(text, 1, 1) END AS mark")
    return sequence.folded(turns, "conv_id", "turn", ["mark"]).select("conv_id", "segment", "first_page", "last_page", F.coalesce("mark", F.lit("")).alias("mark"), F.round("confidence", 9).alias("confidence"))


def windows_packed(spark, sf_dir: str) -> DataFrame:
    """Documents by source as pages, packed into windows of 4,000 characters."""
    order = Window.partitionBy("source", "lang").orderBy("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("doc"), (F.row_number().over(order) - 1).alias("page"), "text")
    out = sequence.packed(rows, "doc", "page", "text", 4000)
    return out.groupBy("doc").agg(F.count("*").alias("n"), F.max(F.char_length("content")).alias("longest"), F.sum(F.size(F.split("content", "---PAGE ", -1)) - 1).alias("headings"))


def keyword_pages(spark, sf_dir: str) -> DataFrame:
    """Turns that speak of a keyword and their neighbours; conversations without it give their first three."""
    rows = table(spark, sf_dir, "conversations")
    return sequence.keyword_pages(rows, "conv_id", "turn", "text", "(?i)weld|test|the", 3).select("conv_id", "turn")


def gappy_pages(spark, sf_dir: str) -> DataFrame:
    """Lines of an order as words placed on a page of three lines, and whether it looks like a table."""
    words = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber % 2 AS line", "l_linenumber * 100 AS left_", "l_linenumber * 100 + cast(l_quantity AS int) AS right_", "cast(l_quantity AS int) + 5 AS height")
    out = sequence.table_pages(sequence.gappy_lines(words, ["l_orderkey"], "line", "left_", "right_", "height"), 1, 0.4)
    return out.select("l_orderkey", "multiword_lines", "gappy_lines", "score", "table")


def prefix_tiers(spark, sf_dir: str) -> DataFrame:
    """Drawing numbers of lines against sets, some shorter, some longer, at the day of the line."""
    sets = table(spark, sf_dir, "orders").selectExpr("CASE o_orderkey % 3 WHEN 0 THEN concat('D.', o_custkey) WHEN 1 THEN concat('D.', o_custkey, '.DC') ELSE concat('D.', o_custkey, '.DC.1.E') END AS number", "to_date(o_orderdate) AS created", "o_orderkey AS set_id")
    asked = table(spark, sf_dir, "orders").selectExpr("concat('D.', o_custkey, '.DC.1') AS cited", "to_date(o_orderdate) AS day").distinct()
    out = lookup.by_prefix(asked, "cited", "day", sets, "number", "created", "set_id")
    return out.select("cited", F.col("day").cast("string").alias("day"), F.coalesce("number", F.lit("-")).alias("number"), F.coalesce("set_id", F.lit(-1)).alias("set_id"), F.coalesce("tier", F.lit(0)).alias("tier"))


def grouped_revisions(spark, sf_dir: str) -> DataFrame:
    """Orders as files of a customer's drawing by type, the highest revision of each, and the collisions in order."""
    files = table(spark, sf_dir, "orders").selectExpr("o_custkey", "substr(o_orderpriority, 1, 1) AS type", "o_orderkey", "element_at(array(null, 'C01', 'C03', 'B', '2', 'rev'), cast(o_orderkey % 6 + 1 AS int)) AS rev")
    out = lookup.grouped_files(files, ["o_custkey", "type"], "rev", "o_orderkey")
    return out.select("o_custkey", "type", "o_orderkey", F.coalesce("rev", F.lit("-")).alias("rev"), F.size("collisions").alias("n_collisions"))


def chunks_overlap(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(sequence.chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.start").alias("start"), F.md5("c.text").alias("digest"))


def sessions(spark, sf_dir: str) -> DataFrame:
    rows = sequence.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 12 * 3600)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def trailing_hour(spark, sf_dir: str) -> DataFrame:
    rows = sequence.trailing(table(spark, sf_dir, "events"), ["event_type"], "ts", 3600)
    return rows.select("event_id", "prior")


def progress_eta(spark, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts"))
    done = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.withColumn("done", done).groupBy("user_id", "ts").agg(F.max("done").alias("done"))
    return sequence.progress(rows, ["user_id"], "ts", "done", 100).select("user_id", "done", F.round("eta", 6).alias("eta"))


def position_asof(spark, sf_dir: str) -> DataFrame:
    """Running end position of each line of an order, and how much of the order lies before it."""
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("decimal(18,2)"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return rows.select("l_orderkey", F.row_number().over(order).alias("place"), F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))


def tokens_multilingual(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" ГОСТ 12.1-45 용접검사 3E")).alias("text"))
    return search.term_counts(docs, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def bm25_topk(spark, sf_dir: str) -> DataFrame:
    scores = search.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query"), "doc_id", "query")
    return search.ranked(scores, "query", "doc_id", 5)


def cosine_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "v")
    return search.ranked(search.cosine(rows, asked, "vec_id", "query"), "query", "vec_id", 5, 4)


def rrf_hybrid(spark, sf_dir: str) -> DataFrame:
    """Both rankings of a query, thirty deep each, fused to the best five."""
    lexical = search.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query"), "doc_id", "query")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "v")
    near = search.cosine(rows, asked, "vec_id", "query").select(F.expr("query div 50").alias("query"), F.col("vec_id").alias("doc_id"), "score")
    return search.hybrid(lexical, near, "query", "doc_id")


def code_gap(spark, sf_dir: str) -> DataFrame:
    """Codes cited by suppliers' drawings against the standards that customers' nations stand for."""
    cited = table(spark, sf_dir, "supplier").select(F.concat(F.lit("GOST 1"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), F.lit("-2014_en")).alias("code"), F.concat(F.lit("D."), "s_suppkey").alias("drawing"))
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("gost.1"), F.lpad((F.col("c_nationkey") + 5).cast("string"), 3, "0"), F.lit("_2014")).alias("code"))
    out = ledger.code_gap(cited, known)
    return out.select("code", F.coalesce("family", F.lit("")).alias("family"), "n_cited", "n_drawings", F.coalesce(F.array_join("drawings", ","), F.lit("")).alias("drawings"), "n_known", "outcome")


def drawing_coverage(spark, sf_dir: str) -> DataFrame:
    """Billed drawings, and whether an indexed number begins with theirs."""
    rows = billing(spark, sf_dir).groupBy(F.concat(F.lit("D."), F.col("l_partkey").cast("string"), F.lit(".")).alias("body")).agg(F.count("*").alias("n"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("D."), (F.col("s_suppkey") * 7).cast("string"), F.lit(".DC.1")).alias("number"))
    return ledger.begun(rows, "body", known, "number").select("body", "n", "indexed")


def mirrored(spark, sf_dir: str) -> DataFrame:
    """Every second text mirrored line by line, then repaired where two reversed marks show."""
    docs = table(spark, sf_dir, "documents")
    turned = F.when(F.col("doc_id") % 2 == 0, F.array_join(F.transform(F.split("text", "\n"), F.reverse), "\n")).otherwise(F.col("text"))
    fixed = normalise.unmirrored(turned, [" with ", " from "])
    return docs.select("doc_id", (fixed == F.col("text")).alias("restored"))


def json_lenient(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("reply "), F.replace("props", F.lit("}"), F.lit(",}")), F.lit(" end"))).otherwise(F.col("props"))
    return rows.select("event_id", normalise.lenient_json(text, "k long")["k"].alias("k"))


def report_headers(spark, sf_dir: str) -> DataFrame:
    """Headers written for each line with slips of a scanner, on a page with a false start before them, read back."""
    day = F.date_format("l_shipdate", "d.M.yyyy")
    how = F.element_at(F.array(F.lit("V\u041c\u0421"), F.lit(" Р Т"), F.lit("UT(C"), F.lit("_x"), F.lit("ct "), F.lit("S VMC")), (F.col("l_suppkey") % 6 + 1).cast("int"))
    number = F.concat(F.lit("7l-"), F.col("l_linenumber").cast("string"), F.element_at(F.array(F.lit("O"), F.lit("S / I"), F.lit("0")), (F.col("l_partkey") % 3 + 1).cast("int")))
    text = F.concat(F.lit("Page 3 of 12 dated soon\nTown N\u00ba. "), number, how, F.element_at(F.array(F.lit(" dated "), F.lit(" datcd — "), F.lit(" dat ")), (F.col("l_suppkey") % 3 + 1).cast("int")), day, F.lit(" 10UMA"))
    read = table(spark, sf_dir, "lineitem").select(headers.report_header(text).alias("h"))
    return read.groupBy(F.coalesce("h.report_no", F.lit("-")).alias("report_no"), F.coalesce("h.as_written", F.lit("-")).alias("as_written"), F.coalesce("h.method", F.lit("-")).alias("method"), F.coalesce("h.day", F.lit("-")).alias("day")).agg(F.count("*").alias("n"))


def header_sources(spark, sf_dir: str) -> DataFrame:
    """Three readings of a line's header, two of which may be damaged, decided by the billed numbers or by vote."""
    one = lambda n: F.concat(F.lit("No. 77-"), n.cast("string"), F.lit("PT dated 1.2.2024"))
    n, z = F.col("l_orderkey") % 50, F.col("l_suppkey") % 4
    sources = F.array(one(F.when(z == 0, n + 1000).otherwise(n)), F.when(z == 1, F.lit("unread")).otherwise(one(F.when(z == 2, n + 2000).otherwise(n))), one(F.when(z == 3, n + 3000).otherwise(n + 1000)))
    known = F.array(F.concat(F.lit("77"), (F.col("l_partkey") % 50 + 1000).cast("string"), F.lit("PT")))
    read = table(spark, sf_dir, "lineitem").select(headers.voted_header(sources, known).alias("h"))
    return read.groupBy("h.report_no", "h.source").agg(F.count("*").alias("n"))


def drawing_files(spark, sf_dir: str) -> DataFrame:
    """File names written for each part, classified and held against a title block."""
    kind = F.element_at(F.array(F.lit("DC"), F.lit("SD"), F.lit("XX"), F.lit("KE")), (F.col("p_size") % 4 + 1).cast("int"))
    tail = F.element_at(F.array(F.lit("_C0"), F.lit("=C0")), (F.col("p_size") % 2 + 1).cast("int"))
    name = F.concat(F.lit("[AB] 4. NP.D.P000.1.0UMA&&PAB&&&."), F.lpad((F.col("p_size") % 9).cast("string"), 3, "0"), F.lit("."), kind, F.lit("."), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit(".E"), tail, (F.col("p_size") % 7).cast("string"), F.when(F.col("p_size") % 2 == 0, "_scan, v. 2").otherwise(" copy"), F.lit(".pdf"))
    title = F.concat(F.lit("Title\nNP.D.P000.1.0uma&&PAB &&&."), F.lpad((F.col("p_size") % 9).cast("string"), 3, "0"), F.lit("."), kind, F.lit("."), F.lpad((F.col("p_partkey") % 9999).cast("string"), 4, "0"))
    rows = table(spark, sf_dir, "part").select("p_partkey", headers.classified_file(name, title).alias("f"), headers.classified_file(F.concat(F.lit("X"), F.col("p_size").cast("string"), F.lit("-"), kind, F.lit("_rev.b.pdf")), F.lit(None).cast("string")).alias("g"))
    return rows.where("f IS NOT NULL").select("p_partkey", "f.drawing_no", "f.type", "f.seq", "f.revision", "f.scan", "f.needs_review", F.size("f.reasons").alias("n_reasons"), F.coalesce("g.drawing_no", F.lit("-")).alias("other_no"), F.coalesce("g.revision", F.lit("-")).alias("other_revision"))


QUERIES = {
    "q67_report_header": report_headers,
    "q67b_header_sources": header_sources,
    "q13b_grouped_revisions": grouped_revisions,
    "q09b_prefix_tiers": prefix_tiers,
    "q35b_notation_grammar": notation_grammar,
    "q38b_segments": segment_pages,
    "q41b_windows_packed": windows_packed,
    "q69_keyword_pages": keyword_pages,
    "q69b_gappy_pages": gappy_pages,
    "q68_drawing_files": drawing_files,
    "q06_enrich_first_value": enrich_first,
    "q07_sheet_choice_most_rows": sheet_choice,
    "q08_ledger_explode_last_wins": ledger_explode,
    "q09_prefix_longest_match": prefix_match,
    "q10_asof_effective": asof_effective,
    "q11_revision_override": revision_override,
    "q12_supersede_chain": supersede_chain,
    "q13_latest_per_type": latest_per_type,
    "q28_code_gap": code_gap,
    "q29_drawing_coverage": drawing_coverage,
    "q35_notation_expand": notation_expand,
    "q36_notation_reconcile": notation_reconcile,
    "q37_segment_islands": segment_islands,
    "q38_absorb_forward_fill": absorb,
    "q39_running_meta_fold": running_fold,
    "q42_tokens_multilingual": tokens_multilingual,
    "q43_chunks_overlap": chunks_overlap,
    "q44_bm25_topk": bm25_topk,
    "q45_cosine_topk": cosine_topk,
    "q46_rrf_hybrid": rrf_hybrid,
    "q57_trailing_hour_calls": trailing_hour,
    "q58_sessions": sessions,
    "q59_progress_eta": progress_eta,
    "q62_mirrored_repair": mirrored,
    "q63_json_lenient": json_lenient,
    "q64_cum_position_asof": position_asof,
}

_PAGES = "p AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS page, CASE WHEN event_id % 11 <> 0 THEN event_type END AS number FROM events)"
_TOKENS = """list_filter(list_concat(regexp_extract_all(low, '[a-z]+'), regexp_extract_all(low, '[0-9]+(?:[.-][0-9]+)*'),
  [regexp_extract(c, '^[0-9]+') FOR c IN regexp_extract_all(low, '[0-9]+(?:[.-][0-9]+)*') IF regexp_matches(c, '[.-]')],
  regexp_extract_all(low, '[а-яё]+'), regexp_extract_all(low, '[가-힣]+'),
  flatten([CASE WHEN length(w) > 2 THEN [substr(w, i, 2) FOR i IN range(1, length(w))] ELSE [] END FOR w IN regexp_extract_all(low, '[가-힣]+')])), lambda t: length(t) > 1)"""
_BM25 = f"""d AS (SELECT doc_id, {_TOKENS} AS ts FROM (SELECT doc_id, lower(text) AS low FROM documents)),
  a AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
  q AS (SELECT query, term, count(*) AS qf FROM (SELECT item_id AS query, unnest({_TOKENS}) AS term FROM (SELECT item_id, lower(text) AS low FROM benchmark)) GROUP BY ALL),
  t AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
  s AS (SELECT query, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 + 0.1 * (qf - 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM t JOIN f USING (term) JOIN q USING (term), a GROUP BY ALL),
  lex AS (SELECT query, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 30)"""
_COS = """u AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])) AS norm FROM embeddings),
  c AS (SELECT a.vec_id AS query, b.vec_id, round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 4) AS score FROM u a, u b WHERE a.vec_id % 50 = 0 AND a.norm > 0 AND b.norm > 0),
  near AS (SELECT query, vec_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS rank FROM c QUALIFY rank <= 30)"""

SQL = {
    "q67_report_header": """WITH t AS (SELECT '71' AS a, l_linenumber || CASE WHEN l_suppkey % 6 = 5 AND l_partkey % 3 <> 1 THEN '05' ELSE ['0', '5', '0'][l_partkey % 3 + 1] END AS b, CASE WHEN l_partkey % 3 = 1 THEN '/1' ELSE '' END AS c, ['VMC', 'PT', 'UT', NULL, 'CT', CASE WHEN l_partkey % 3 = 1 THEN 'SVMC' ELSE 'VMC' END][l_suppkey % 6 + 1] AS tok, ['VT', 'PT', 'UT', NULL, 'PT', 'VT'][l_suppkey % 6 + 1] AS m, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem)
      SELECT coalesce(a || b || c || tok, '-') AS report_no, coalesce(a || '-' || b || c || ' ' || tok, '-') AS as_written, coalesce(m, '-') AS method, CASE WHEN tok IS NULL THEN '-' ELSE d END AS day, count(*) AS n FROM t GROUP BY ALL""",
    "q67b_header_sources": """WITH t AS (SELECT l_orderkey % 50 AS n, l_suppkey % 4 AS z, 1000 + l_partkey % 50 AS k FROM lineitem), s AS (SELECT *, list_filter([CASE WHEN z = 0 THEN n + 1000 ELSE n END, CASE WHEN z = 1 THEN NULL WHEN z = 2 THEN n + 2000 ELSE n END, CASE WHEN z = 3 THEN n + 3000 ELSE n + 1000 END], lambda x: x IS NOT NULL) AS x FROM t),
      v AS (SELECT *, CASE WHEN list_contains(x, k) THEN k WHEN z = 0 THEN n + 1000 ELSE n END AS w FROM s)
      SELECT '77' || w || 'PT' AS report_no, CASE WHEN list_contains(x, k) THEN 'regex+billing' ELSE 'regex' END AS source, count(*) AS n FROM v GROUP BY ALL""",
    "q13b_grouped_revisions": """WITH f AS (SELECT o_custkey, substr(o_orderpriority, 1, 1) AS type, o_orderkey, [NULL, 'C01', 'C03', 'B', '2', 'rev'][o_orderkey % 6 + 1] AS rev, [0, 1, 3, 2, 2, 22][o_orderkey % 6 + 1] AS r FROM orders)
      SELECT o_custkey, type, arg_max(o_orderkey, (r, -o_orderkey)) AS o_orderkey, coalesce(['-', 'C01', 'C03', 'B', '2', 'rev'][arg_max(o_orderkey, (r, -o_orderkey)) % 6 + 1], '-') AS rev, CAST(count(*) - 1 AS INT) AS n_collisions FROM f GROUP BY o_custkey, type""",
    "q09b_prefix_tiers": """WITH s AS (SELECT o_custkey AS c, CASE o_orderkey % 3 WHEN 0 THEN 'D.' || o_custkey WHEN 1 THEN 'D.' || o_custkey || '.DC' ELSE 'D.' || o_custkey || '.DC.1.E' END AS number, CAST(o_orderdate AS DATE) AS created, o_orderkey AS id FROM orders),
      q AS (SELECT DISTINCT o_custkey AS c, 'D.' || o_custkey || '.DC.1' AS cited, CAST(o_orderdate AS DATE) AS day FROM orders),
      x AS (SELECT q.cited, day, number, created, id, CASE WHEN number = cited THEN 1 WHEN starts_with(cited, number) THEN 2 ELSE 3 END AS tier FROM q JOIN s ON created <= day AND (starts_with(cited, number) OR starts_with(number, cited))),
      b AS (SELECT cited, day, number, id, tier FROM x QUALIFY row_number() OVER (PARTITION BY cited, day ORDER BY tier, CASE WHEN tier = 2 THEN -length(number) ELSE 0 END, number, created DESC, id) = 1)
      SELECT cited, CAST(day AS VARCHAR) AS day, coalesce(number, '-') AS number, coalesce(id, -1) AS set_id, coalesce(tier, 0) AS tier FROM q LEFT JOIN b USING (cited, day)""",
    "q35b_notation_grammar": """WITH l AS (SELECT DISTINCT l_linenumber AS n, l_suppkey % 7 AS z FROM lineitem), r AS (
      SELECT '(' || n || '÷' || n + 2 || ')SC' || z || '-1,2' AS cell, flatten([[i || 'SC' || z || '-1', i || 'SC' || z || '-2'] FOR i IN range(n, n + 3)]) AS j FROM l
      UNION SELECT 'R.' || n || ',' || n + 10 || '-up,dn', ['R.' || n || '-up', 'R.' || n || '-dn', 'R.' || n + 10 || '-up', 'R.' || n + 10 || '-dn'] FROM l
      UNION SELECT 'S.' || n || 'E-(up-1,2,dn-' || n || ')', ['S.' || n || 'E-up-1', 'S.' || n || 'E-up-2', 'S.' || n || 'E-dn-' || n] FROM l
      UNION SELECT 'G' || z || '.(0' || n || '÷' || 10 + n || ')', ['G' || z || '.' || lpad(CAST(i AS VARCHAR), 2, '0') FOR i IN range(n, n + 11)] FROM l
      UNION SELECT 'R.4.(1÷' || n || ')-dn,up', flatten([['R.4.' || i || '-dn', 'R.4.' || i || '-up'] FOR i IN range(1, n + 1)]) FROM l
      UNION SELECT 'FW' || n || chr(10) || 'FW' || n || ',FX', ['FW' || n, 'FX'] FROM l
      UNION SELECT 'A' || n || '÷B' || n + 1, ['A' || n || '÷B' || n + 1] FROM l
      UNION SELECT '(' || n + 1 || '÷1)K', ['(' || n + 1 || '÷1)K'] FROM l)
      SELECT cell, array_to_string(j, '|') AS joints FROM r""",
    "q38b_segments": f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS page FROM events), p AS (SELECT user_id, CAST(page AS INT) AS page, event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS number, event_id % 3 = 0 AS billed FROM e WHERE event_id % 13 <> 0),
      r AS (SELECT user_id, page, number, billed, page - row_number() OVER (PARTITION BY user_id, number ORDER BY page) AS run FROM p WHERE number IS NOT NULL),
      m AS (SELECT *, min(run) OVER (PARTITION BY user_id, number) <> max(run) OVER (PARTITION BY user_id, number) AS many FROM r),
      g AS (SELECT p.*, run, many, p.page - row_number() OVER (PARTITION BY p.user_id ORDER BY p.page) AS gap FROM p LEFT JOIN m ON p.user_id = m.user_id AND p.page = m.page),
      f AS (SELECT *, last_value(number IGNORE NULLS) OVER w AS s, last_value(run IGNORE NULLS) OVER w AS sr, last_value(many IGNORE NULLS) OVER w AS sm FROM g WINDOW w AS (PARTITION BY user_id, gap ORDER BY page ROWS UNBOUNDED PRECEDING)),
      x AS (SELECT user_id, s, sr, CASE WHEN s IS NULL THEN page END AS alone, min(page) AS first_page, max(page) AS last_page, coalesce(string_agg(page, ',' ORDER BY page) FILTER (number IS NULL AND s IS NOT NULL), '') AS absorbed_pages, coalesce(bool_or(sm), false) AS disjoint, arg_min(billed, page) AS billed FROM f GROUP BY ALL),
      c AS (SELECT *, CASE WHEN disjoint THEN 0.55 WHEN billed THEN 0.75 ELSE 0.95 END AS k FROM x)
      SELECT user_id, coalesce(s, '-') AS number, first_page, last_page, absorbed_pages, disjoint, CAST(CASE WHEN s IS NULL THEN 0.2 WHEN absorbed_pages <> '' THEN least(k, 0.7) ELSE k END AS DOUBLE) AS confidence FROM c""",
    "q39_running_meta_fold": """WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, mark NULLS FIRST) AS i, mark FROM (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN nullif(substr(text, 1, 1), '') END AS mark FROM conversations)),
      r AS (SELECT conv_id, i, turn, CAST(1 AS BIGINT) AS seg, mark AS m, 1.0::DOUBLE AS sure FROM t WHERE i = 1
        UNION ALL SELECT t.conv_id, t.i, t.turn, CASE WHEN r.m IS NULL OR coalesce(t.mark <> r.m, false) THEN seg + 1 ELSE seg END, CASE WHEN r.m IS NULL OR coalesce(t.mark <> r.m, false) THEN t.mark ELSE r.m END, (CASE WHEN r.m IS NULL THEN 0.6 WHEN t.mark <> r.m THEN 0.95 ELSE 0.5 END)::DOUBLE FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
      SELECT conv_id, CAST(seg AS INT) AS segment, min(turn) AS first_page, max(turn) AS last_page, coalesce(max(m), '') AS mark, round(avg(sure), 9) AS confidence FROM r GROUP BY conv_id, seg""",
    "q41b_windows_packed": """WITH RECURSIVE d AS (SELECT source || '/' || lang AS doc, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS page, text FROM documents),
      w AS (SELECT doc, page, length('---PAGE ' || page || '---' || chr(10) || text) + 2 AS n, length(text) AS len, 4000 - length('---PAGE ' || page || '--- (part 1)' || chr(10)) - 2 AS room FROM d),
      parts AS (SELECT doc, page, 1 AS part, CASE WHEN n <= 4000 THEN n ELSE 4000 END AS size, CASE WHEN n <= 4000 THEN 0 ELSE len - room END AS rest FROM w
        UNION ALL SELECT doc, page, part + 1, least(rest, 4000 - length('---PAGE ' || page || '--- (part ' || part + 1 || ')' || chr(10)) - 2) + length('---PAGE ' || page || '--- (part ' || part + 1 || ')' || chr(10)) + 2, rest - (4000 - length('---PAGE ' || page || '--- (part ' || part + 1 || ')' || chr(10)) - 2) FROM parts WHERE rest > 0),
      o AS (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY page, part) AS i FROM parts),
      f AS (SELECT doc, i, size AS used, 1 AS win FROM o WHERE i = 1 UNION ALL SELECT o.doc, o.i, CASE WHEN f.used + o.size > 4000 THEN o.size ELSE f.used + o.size END, CASE WHEN f.used + o.size > 4000 THEN f.win + 1 ELSE f.win END FROM f JOIN o ON o.doc = f.doc AND o.i = f.i + 1)
      SELECT doc, CAST(max(win) AS BIGINT) AS n, CAST(max(used) AS INT) AS longest, count(*) AS headings FROM f GROUP BY doc""",
    "q69_keyword_pages": """WITH h AS (SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '(?i)weld|test|the') AS hit FROM conversations), a AS (SELECT conv_id, bool_or(hit) AS hits FROM h GROUP BY conv_id)
      SELECT h.conv_id, h.turn FROM h JOIN a USING (conv_id) WHERE CASE WHEN hits THEN EXISTS (SELECT 1 FROM h k WHERE k.conv_id = h.conv_id AND k.hit AND abs(k.turn - h.turn) <= 1) ELSE h.turn < 3 END""",
    "q69b_gappy_pages": """WITH w AS (SELECT l_orderkey AS o, l_linenumber % 2 AS line, l_linenumber * 100 AS l, l_linenumber * 100 + CAST(l_quantity AS INT) AS r, CAST(l_quantity AS INT) + 5 AS h FROM lineitem), m AS (SELECT *, median(h) OVER (PARTITION BY o) AS med, l - lag(r) OVER (PARTITION BY o, line ORDER BY l, r) AS gap FROM w),
      x AS (SELECT o, line, count(*) AS n, count(*) FILTER (gap > 3 * med) AS g FROM m GROUP BY ALL), y AS (SELECT o, count(*) FILTER (n >= 3) AS a, count(*) FILTER (n >= 3 AND g >= 2) AS b FROM x GROUP BY o)
      SELECT o AS l_orderkey, a AS multiword_lines, b AS gappy_lines, CASE WHEN a > 0 THEN b / a ELSE 0.0 END AS score, a >= 1 AND CASE WHEN a > 0 THEN b / a ELSE 0 END >= 0.4 AS "table" FROM y""",
    "q68_drawing_files": """SELECT p_partkey, 'NP.D.P000.1.0UMA&&PAB&&&.00' || p_size % 9 AS drawing_no, ['DC', 'SD', 'XX', 'KE'][p_size % 4 + 1] AS type, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS seq, 'C0' || p_size % 7 AS revision, p_size % 2 = 0 AS scan,
      p_size % 4 = 3 OR p_partkey % 10000 <> p_partkey % 9999 AS needs_review, CAST(p_size % 4 = 3 AS INT) + CAST(p_partkey % 10000 <> p_partkey % 9999 AS INT) AS n_reasons, CASE WHEN p_size % 4 = 3 THEN '-' ELSE 'X' || p_size END AS other_no, CASE WHEN p_size % 4 = 3 THEN '-' ELSE 'b' END AS other_revision FROM part WHERE p_size % 4 <> 2""",
    "q06_enrich_first_value": "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS first_part, count(DISTINCT l_partkey) > 1 AS conflict FROM lineitem GROUP BY l_orderkey",
    "q07_sheet_choice_most_rows": "SELECT lang, source, n_rows FROM (SELECT lang, source, count(*) FILTER (length(text) >= 40) AS n_rows FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_rows DESC, source) = 1",
    "q08_ledger_explode_last_wins": """WITH c AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS booked, CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey, o_orderkey + 1] ELSE [o_orderkey] END AS ns FROM orders),
      r AS (SELECT o_orderkey, booked, unnest(ns) AS n, len(ns) > 1 AS shared FROM c)
      SELECT CAST(n AS VARCHAR) AS number, booked, shared FROM r QUALIFY row_number() OVER (PARTITION BY n ORDER BY o_orderkey DESC) = 1""",
    "q09_prefix_longest_match": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^\w+://([^?#]*)', 1), '/$', '') AS address FROM pages), h AS (SELECT *, split_part(address, '/', 1) AS host FROM p),
      k AS (SELECT host AS prefix FROM h UNION SELECT array_to_string(string_split(address, '/')[1:2], '/') FROM h WHERE ends_with(host, '.org'))
      SELECT page_id, address, (SELECT arg_max(prefix, length(prefix)) FROM k WHERE address = prefix OR starts_with(address, prefix || '/')) AS prefix FROM h""",
    "q10_asof_effective": """WITH s AS (SELECT user_id, event_id AS set_id, ts FROM events WHERE event_type = 'signup'), q AS (SELECT * FROM events WHERE event_type = 'purchase')
      SELECT q.user_id, q.event_id, s.set_id FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ts >= s.ts""",
    "q11_revision_override": """WITH t AS (SELECT o_custkey, o_orderkey AS id, unnest([lpad(CAST(o_orderkey % 5 AS VARCHAR), 2, '0'), lpad(CAST(o_orderkey % 7 + 5 AS VARCHAR), 2, '0')]) AS tok FROM orders),
      m AS (SELECT o_custkey, tok, min(id) AS cited_id FROM t GROUP BY ALL), a AS (SELECT o_custkey, max(o_orderkey) AS set_id, count(*) AS n FROM orders GROUP BY o_custkey),
      b AS (SELECT *, CASE WHEN n % 4 <> 0 THEN lpad(CAST(n % 12 AS VARCHAR), 2, '0') END AS tok FROM a)
      SELECT o_custkey, coalesce(cited_id, set_id) AS set_id, CASE WHEN tok IS NOT NULL AND cited_id IS NULL THEN concat('not loaded: C', tok) ELSE '' END AS flag FROM b LEFT JOIN m USING (o_custkey, tok)""",
    "q12_supersede_chain": "SELECT user_id, event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS open_micros FROM events WHERE event_type = 'signup'",
    "q13_latest_per_type": "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "q28_code_gap": """WITH c AS (SELECT 'GOST1' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') || '2014' AS code, count(*) AS n_cited, list_sort(list('D.' || s_suppkey)) AS d FROM supplier GROUP BY 1), k AS (SELECT 'GOST1' || lpad(CAST(c_nationkey + 5 AS VARCHAR), 3, '0') || '2014' AS code, count(*) AS n_known FROM customer GROUP BY 1)
      SELECT code, CASE WHEN n_cited IS NULL THEN '' ELSE 'GOST' END AS family, coalesce(n_cited, 0) AS n_cited, CAST(coalesce(len(d), 0) AS INT) AS n_drawings, coalesce(array_to_string(d[1:5], ','), '') AS drawings, coalesce(n_known, 0) AS n_known, CASE WHEN n_cited IS NULL THEN 'ingested_only' WHEN n_known IS NULL THEN 'cited_only' ELSE 'matched' END AS outcome FROM c FULL JOIN k USING (code)""",
    "q29_drawing_coverage": f"WITH {LINES_SQL} SELECT 'D.' || l_partkey || '.' AS body, count(*) AS n, bool_or(l_partkey IN (SELECT s_suppkey * 7 FROM supplier)) AS indexed FROM lines WHERE side = 'O' GROUP BY l_partkey",
    "q35_notation_expand": """WITH r AS (SELECT l_linenumber AS a, l_linenumber + CAST(l_quantity AS INT) % 5 AS b FROM lineitem), c AS (SELECT concat('FW', lpad(CAST(a AS VARCHAR), 2, '0'), '÷', lpad(CAST(b AS VARCHAR), 2, '0')) AS cell, a, b FROM r)
      SELECT cell, joint, count(*) AS n FROM (SELECT cell, CASE WHEN b > a THEN unnest([concat('FW', lpad(CAST(i AS VARCHAR), 2, '0')) FOR i IN generate_series(a, greatest(a, b))]) ELSE cell END AS joint, a, b FROM c WHERE b > a UNION ALL SELECT cell, cell, a, b FROM c WHERE b <= a) GROUP BY ALL""",
    "q36_notation_reconcile": """WITH r AS (SELECT CASE WHEN l_quantity < 40 THEN l_quantity END AS q, CASE WHEN CAST(l_quantity AS INT) + l_linenumber % 2 > 1 THEN CAST(l_quantity AS INT) + l_linenumber % 2 ELSE 1 END AS n FROM lineitem)
      SELECT coalesce(CAST(abs(q - n) < 0.01 AS VARCHAR), 'unknown') AS outcome, count(*) AS n FROM r GROUP BY 1""",
    "q37_segment_islands": f"""WITH {_PAGES}, r AS (SELECT *, page - row_number() OVER (PARTITION BY user_id, number ORDER BY page) AS run FROM p WHERE number IS NOT NULL),
      g AS (SELECT user_id, number, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages FROM r GROUP BY user_id, number, run)
      SELECT *, count(*) OVER (PARTITION BY user_id, number) > 1 AS disjoint, CASE WHEN count(*) OVER (PARTITION BY user_id, number) > 1 THEN 0.55 ELSE 0.95 END AS confidence FROM g""",
    "q38_absorb_forward_fill": f"""WITH {_PAGES}, f AS (SELECT user_id, page, number, last_value(number IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS s FROM p)
      SELECT user_id, page, coalesce(s, '-') AS segment, number IS NULL AND s IS NOT NULL AS absorbed FROM f""",
    "q42_tokens_multilingual": f"""WITH d AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM (SELECT doc_id, lower(text || ' ГОСТ 12.1-45 용접검사 3E') AS low FROM documents)), t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL)
      SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY term""",
    "q43_chunks_overlap": "WITH c AS (SELECT doc_id, text, unnest([s FOR s IN range(0, length(text), 1000) IF s = 0 OR s + 200 < length(text)]) AS start FROM documents) SELECT doc_id, CAST(start AS INT) AS start, md5(substr(text, start + 1, 1200)) AS digest FROM c",
    "q44_bm25_topk": f"WITH {_BM25} SELECT query, doc_id, score, rank FROM lex WHERE rank <= 5",
    "q45_cosine_topk": f"WITH {_COS} SELECT query, vec_id, score, rank FROM near WHERE rank <= 5",
    "q46_rrf_hybrid": f"""WITH {_BM25}, {_COS}, x AS (SELECT query, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT query, doc_id, rank FROM lex UNION ALL SELECT query // 50, vec_id, rank FROM near) GROUP BY ALL)
      SELECT query, doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INT) AS rank, CASE WHEN query IN (SELECT query // 50 FROM near) THEN 'hybrid' ELSE 'lexical' END AS source FROM x QUALIFY rank <= 5""",
    "q57_trailing_hour_calls": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS prior FROM events",
    "q58_sessions": """WITH s AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 43200000000, true) AS b FROM events), t AS (SELECT *, CAST(sum(CAST(b AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM s)
      SELECT user_id, session, count(*) AS n, min(event_id) AS first_id FROM t GROUP BY ALL""",
    "q59_progress_eta": """WITH e AS (SELECT user_id, date_trunc('second', ts) AS ts, event_id FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM e),
      d AS (SELECT user_id, ts, CAST(max(done) AS INT) AS done FROM n GROUP BY ALL), f AS (SELECT *, epoch(ts) - epoch(first(ts) OVER w) AS spent, done - first(done) OVER w AS made FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts))
      SELECT user_id, done, CASE WHEN made > 0 THEN round((100 - done) * spent / made, 6) END AS eta FROM f""",
    "q62_mirrored_repair": r"""WITH d AS (SELECT doc_id, text, array_to_string([reverse(l) FOR l IN string_split(text, chr(10))], chr(10)) AS r FROM documents), t AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN r ELSE text END AS x, CASE WHEN doc_id % 2 = 0 THEN text ELSE r END AS y FROM d)
      SELECT doc_id, CASE WHEN contains(x, ' htiw ') AND contains(x, ' morf ') THEN y ELSE x END = text AS restored FROM t""",
    "q63_json_lenient": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "q64_cum_position_asof": """SELECT l_orderkey, CAST(row_number() OVER w AS INT) AS place, sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS "end" FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)""",
}
