"""Workbooks as raw cells (sheet, row, col, value), page texts, folders of files, and JSON or CSV answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.normalise import squeezed

# Header words of each field of a claim.
HEADERS = {
    "report_no": ["reportno", "reportnumber", "report"],
    "joint_no": ["jointno", "weldno", "joint"],
    "ndt_method": ["ndtmethod", "method", "ndt"],
    "drawing_no": ["drawingno", "drawing"],
    "inspection_date": ["date", "inspectiondate"],
    "quantity": ["quantity", "qty", "q'ty"],
    "welder_id": ["welder", "welderid"],
}
#: Disciplines in order, and texts of which a sheet's name holds one, in any case.
DISCIPLINES = {"CP-P1": ["CP-P1", "piping"], "CP-M1": ["CP-M1", "mechanical"], "CP-E1": ["CP-E1", "I&E"], "CP-A1": ["CP-A1", "C&A"]}


def discipline_of(name: Column, disciplines: dict[str, list[str]] | None = None) -> Column:
    """The first discipline one of whose texts a sheet's name holds, in any case; null if none."""
    holds = lambda word: F.contains(F.lower(name), F.lit(word.lower()))
    known = (disciplines or DISCIPLINES).items()
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, map(holds, words)), F.lit(d)) for d, words in known])


def headers(cells: DataFrame, least: int = 3, names: dict[str, list[str]] | None = None) -> DataFrame:
    """sheet, head_row, field, col: the first row of each sheet that names most of the fields, ``least`` or more."""
    names = names or HEADERS
    pairs = [(word, field) for field, words in names.items() for word in words]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    found = cells.withColumn("field", F.try_element_at(table, squeezed(F.coalesce("value", F.lit(""))))).where("field IS NOT NULL")
    rows = found.groupBy("sheet", "row").agg(F.countDistinct("field").alias("n")).where(F.col("n") >= least)
    best = rows.groupBy("sheet").agg(F.min_by("row", F.struct(-F.col("n"), "row")).alias("head_row"))
    at = found.join(best, "sheet").where("row = head_row")
    return at.groupBy("sheet", "head_row", "field").agg(F.min("col").alias("col"))


def claims(cells: DataFrame, disciplines: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims, skipped) of the sheet with the most valid rows; the first sheet by name wins a tie.

    With ``disciplines`` only sheets whose names tell a discipline are looked at, and both parts say which. A row is valid
    with a joint and a method; others of the sheet that hold anything are skipped, not lost. Rows keep their number.
    """
    if disciplines is not None:
        cells = cells.withColumn("discipline", discipline_of(F.col("sheet"), disciplines)).where("discipline IS NOT NULL")
    keys = ["sheet", "row"] + (["discipline"] if disciplines is not None else [])
    body = cells.where("value IS NOT NULL").join(headers(cells), ["sheet", "col"]).where("row > head_row")
    rows = body.groupBy(*keys).pivot("field", list(HEADERS)).agg(F.first("value"))
    valid = F.coalesce(F.trim("joint_no") != "", F.lit(False)) & F.coalesce(F.trim("ndt_method") != "", F.lit(False))
    rows = rows.withColumn("_valid", valid)
    counts = rows.groupBy("sheet").agg(F.sum(F.col("_valid").cast("long")).alias("n"))
    chosen = counts.agg(F.min_by("sheet", F.struct(-F.col("n"), "sheet")).alias("sheet"))
    rows = rows.join(F.broadcast(chosen), "sheet")
    return rows.where("_valid").drop("_valid"), rows.where("NOT _valid").drop("_valid")


def first_values(rows: DataFrame, key: str, ordinal: str, *values: str) -> DataFrame:
    """key, and for each of ``values`` the first that isn't blank in the order of ``ordinal``, with <value>_conflict if others differ."""
    out = []
    for v in values:
        given = F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.col(v))
        out += [F.min_by(given, F.when(given.isNotNull(), F.col(ordinal))).alias(v), (F.countDistinct(given) > 1).alias(f"{v}_conflict")]
    return rows.groupBy(key).agg(*out)


def filled(items: DataFrame, known: DataFrame, key: str, *values: str) -> DataFrame:
    """items with blank ``values`` filled from the row of the same key (a row a key); what is there stays."""
    right = known.select(key, *[F.col(v).alias(f"_{v}") for v in values])
    out = items.join(right, key, "left")
    return out.withColumns({v: F.coalesce(F.when(F.trim(v) != "", F.col(v)), F.col(f"_{v}")) for v in values}).drop(*[f"_{v}" for v in values])


def exploded_cells(rows: DataFrame, cell: str, ordinal: str, breaks: str = r"[\n,;]") -> DataFrame:
    """One row for each number in a cell that holds several, with shared_cell; the last row of a repeated number counts."""
    parts = F.filter(F.transform(F.split(cell, breaks), lambda x: F.trim(x)), lambda x: x != "")
    every = rows.withColumn("_parts", parts).withColumn("number", F.explode("_parts")).withColumn("shared_cell", F.size("_parts") > 1).drop("_parts")
    rest = [c for c in every.columns if c != "number"]
    best = every.groupBy("number").agg(F.max_by(F.struct(*rest), ordinal).alias("_r"))
    return best.select("number", "_r.*")


def quantity_columns(cells: DataFrame, labels_row: int, quantities_row: int) -> DataFrame:
    """sheet, method, col: the first quantity column within the span of each method's label."""
    label = F.regexp_extract(F.lower("value"), r"^\s*(pt|ut|vt|rt|mt)\b", 1)
    starts = cells.where(F.col("row") == labels_row).select("sheet", F.col("col").alias("start"), F.upper(label).alias("method")).where("method <> ''")
    starts = starts.withColumn("stop", F.coalesce(F.lead("start").over(Window.partitionBy("sheet").orderBy("start")), F.lit(1 << 30)))
    marks = cells.where((F.col("row") == quantities_row) & squeezed(F.col("value")).isin("q'ty", "qty", "quantity"))
    both = marks.select("sheet", "col").join(starts, "sheet").where("col >= start AND col < stop")
    return both.groupBy("sheet", "method").agg(F.min("col").alias("col"))


def pages_with_text(pages: DataFrame) -> DataFrame:
    """doc, has_layer: whether one of its first three pages holds 40 characters of text."""
    enough = F.length(F.trim(F.coalesce("text", F.lit("")))) >= 40
    return pages.where("page_index < 3").groupBy("doc").agg(F.bool_or(enough).alias("has_layer"))


def reread(quality: Column, scanned: Column, sampled: Column) -> Column:
    """Whether a document needs character recognition again: a poor layer, and scans on half of the sampled pages."""
    return (quality < 0.6) & (scanned * 2 >= sampled)


def best_variant(variants: DataFrame) -> DataFrame:
    """doc, page_index, text of the variant (ordinal, confidence) that is surest; the first wins a tie."""
    order = F.struct(F.col("confidence"), -F.col("ordinal"))
    return variants.groupBy("doc", "page_index").agg(F.max_by("text", order).alias("text"))


def page_texts(pages: DataFrame) -> DataFrame:
    """pages (doc, page_index, layer_text, ocr_text) with text, source and confidence: the layer where the document has one."""
    out = pages.join(pages_with_text(pages.withColumnRenamed("layer_text", "text")), "doc", "left")
    layer = F.coalesce("has_layer", F.lit(False))
    return out.withColumn("text", F.when(layer, F.col("layer_text")).otherwise(F.col("ocr_text"))).withColumn("source", F.when(layer, "layer").otherwise("ocr")).drop("has_layer")


def pruned_editions(files: DataFrame) -> DataFrame:
    """files (path) without scans of a text edition that is there, and without .R where .E is there.

    A name with _scan in it is such a scan if it begins with the name of a file without _scan, and an underscore. The
    beginnings of each scan's name that end before an underscore are joined on equality.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = files.withColumn("_stem", stem)
    scan = F.contains("_stem", F.lit("_scan"))
    names = rows.select(F.col("_stem").alias("_other")).distinct()
    parts = F.split("_stem", "_", -1)
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    scans = rows.where(scan).select("_stem", F.explode(heads).alias("_other")).where("_other <> _stem")
    scans = scans.join(names.where("NOT contains(_other, '_scan')"), "_other", "left_semi").select("_stem")
    russian = rows.where(F.endswith("_stem", F.lit(".R"))).select("_stem", F.regexp_replace("_stem", r"R$", "E").alias("_other")).join(names, "_other", "left_semi").select("_stem")
    return rows.join(scans.union(russian).distinct(), "_stem", "left_anti").drop("_stem")


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length and sha256 of files below a folder, in order of path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of answers, an object or an array."""
    return spark.read.option("multiLine", "true").json(path)


def read_review(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A reviewed sheet as CSV; raises an error that names the columns it lacks."""
    rows = spark.read.option("header", "true").csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows
