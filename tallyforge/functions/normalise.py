"""Normalisers of codes, names, dates and numbers as column functions. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of methods and results, and what else they are called.
METHOD_NAMES = {
    "VT": ("VT", "VMC", "Visual", "Visual Test", "Visual and Measuring", "육안", "육안검사"),
    "RT": ("RT", "방사선", "방사선투과", "Radiographic", "Radiography"),
    "UT": ("UT", "초음파", "초음파탐상", "Ultrasonic", "Ultrasonic Test"),
    "PT": ("PT", "침투", "침투탐상", "Liquid Penetrant", "Dye Penetrant"),
    "MT": ("MT", "자분", "자분탐상", "Magnetic Particle"),
}
RESULT_NAMES = {
    "ACC": ("A", "ACC", "Accept", "Accepted", "합격", "OK", "PASS"),
    "REJ": ("R", "REJ", "Reject", "Rejected", "불합격", "NG", "FAIL"),
    "PENDING": ("P", "PEND", "Pending", "보류", "재검사"),
}
def let(value: Column, use) -> Column:
    """use(value), where the value is computed once for all places in which ``use`` has it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def match_key(c: Column) -> Column:
    """Trimmed, without a leading "no.", upper case, without blanks, hyphens and underscores."""
    return F.upper(F.translate(F.regexp_replace(F.trim(c), r"(?i)^no\.\s*", ""), " -_", ""))


def squeezed(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def named(c: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """The name that a text stands for, white space and case aside; any other text trimmed, in upper case."""
    pairs = [F.lit(x) for name, others in names.items() for other in others for x in ("".join(other.split()).lower(), name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), squeezed(c)), F.upper(F.trim(c)))


def method(c: Column, names: dict[str, tuple[str, ...]] | None = None) -> Column:
    """A method's canonical name; unknown ones in trimmed upper case."""
    return named(c, names or METHOD_NAMES)


def result(c: Column, names: dict[str, tuple[str, ...]] | None = None) -> Column:
    return named(c, names or RESULT_NAMES)


def report_number(c: Column) -> Column:
    """Upper case without white space; hyphens stay."""
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def product(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s_-]+", ""))


def building(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[.\s]+", ""))


def drawing_body(c: Column) -> Column:
    """Up to the first of .DC. .SD. .BG. .KE., in that priority."""
    out = c
    for mark in (".KE.", ".BG.", ".SD.", ".DC."):
        out = F.when(F.contains(c, F.lit(mark)), F.substring_index(c, mark, 1)).otherwise(out)
    return out


def code_key(c: Column) -> Column:
    """A standard's code without language suffix, blanks, dots, hyphens and underscores, in upper case."""
    bare = F.regexp_replace(c, r"(?i)_(?:en|ru|kor|kr|eng|jp|cn)$", "")
    return F.upper(F.regexp_replace(bare, r"[\s._-]+", ""))


def scope_segment(c: Column) -> Column:
    """struct(building, system) of a 12-character segment; null if it has another length or either code is missing."""
    part = lambda at: F.regexp_extract(F.regexp_replace(F.substring(c, at, 6), "&+$", ""), r"^[0-9]?([A-Z]{3})", 1)
    one, two = part(1), part(7)
    return F.when((F.char_length(c) == 12) & (one != "") & (two != ""), F.struct(one.alias("building"), two.alias("system")))


def scope(c: Column) -> Column:
    """struct(building, system) from the fifth dotted part of a document number."""
    return scope_segment(F.get(F.split(c, r"\."), F.lit(4)))


def same_scope(a: Column, b: Column) -> Column:
    """yes, no, or unknown where either is null."""
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "yes").otherwise("no")


def revision(c: Column) -> Column:
    """A revision token as C and two digits, also from Cyrillic letters and with a zero read as O or Q; else null."""
    text = F.upper(F.translate(c, "СОсо", "COco"))
    digits = F.regexp_extract(text, r"C\s*[O0Q]?\s*([0-9]{1,2})", 1)
    return F.when(digits != "", F.concat(F.lit("C"), F.lpad(digits, 2, "0")))


def revision_rank(c: Column) -> Column:
    """0 for blank; else trailing digits; else the place in the alphabet of a trailing letter; else 0."""
    text = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    digits = F.regexp_extract(text, "([0-9]+)$", 1)
    letter = F.regexp_extract(text, "([A-Z])$", 1)
    return F.when(digits != "", F.try_to_number(digits, F.lit("999999999")).cast("int")).when(letter != "", F.ascii(letter) - 64).otherwise(0)


def thickness(c: Column) -> Column:
    """The last number of a dimension such as 57x3.5."""
    return F.element_at(F.split(F.replace(c, F.lit(","), F.lit(".")), "[×xX*]"), -1).try_cast("double")


def flattened(c: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def truthy(c: Column) -> Column:
    """Fixed words for true; blank and all others are false, null included. The writer's own mark counts too."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "y", "yes", "1", "예", "필요"), F.lit(False))


def unmirrored(c: Column, marks: list[str]) -> Column:
    """Each line reversed if the text holds two or more of the reversed marks."""
    hits = sum((F.contains(c, F.lit(m[::-1])).cast("int") for m in marks), F.lit(0))
    return F.when(hits >= 2, F.array_join(F.transform(F.split(c, "\n"), F.reverse), "\n")).otherwise(c)


def day(c: Column) -> Column:
    """A date in one of six forms, day before month; null if none fits or the day doesn't exist."""
    forms = ("yyyy-M-d", "d.M.yyyy", "d/M/yyyy", "yyyy/M/d", "yyyy.M.d", "d-M-yyyy")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(c), F.lit(f))) for f in forms])


def iso_text(c: Column) -> Column:
    """Day, month, year to yyyy-mm-dd without a look at the calendar; years of two digits are after 2000."""
    part = lambda i: F.regexp_extract(c, r"([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4}|[0-9]{2})", i)
    year = F.when(F.char_length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    return F.when(part(3) != "", F.concat_ws("-", year, F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))


def percent_off(expected: Column, found: Column) -> Column:
    """|expected - found| in percent of found; where found is 0: 0 if expected is 0, else 100."""
    return F.when(found == 0, F.when(expected == 0, 0.0).otherwise(100.0)).otherwise(F.abs(expected - found) / F.abs(found) * 100)


def request_key(*parts: Column) -> Column:
    """Key of an idempotent request. Parts keep their places: a missing one is not the same as a blank one or none."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


#: A string of JSON, or a comment outside of one, or a comma before a closing bracket.
_STRING_OR = r'("(?:[^"\\]|\\.)*")|'


def mended_json(c: Column) -> Column:
    """Text of JSON without comments and without commas before a closing bracket; what lies in strings stays as it is."""
    plain = F.regexp_replace(c, _STRING_OR + r"//[^\n]*|(?s:/\*.*?\*/)", "$1")
    return F.regexp_replace(plain, _STRING_OR + r",(?=\s*[}\]])", "$1")


def lenient_json(c: Column, schema: str) -> Column:
    """A JSON object in bare text, in a fenced block, or between the outermost braces; each as it is, then mended."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    tries = [x for text in (c, fenced, braces) for x in (text, mended_json(text))]
    return F.coalesce(*[F.when(F.get_json_object(x, "$").isNotNull(), F.from_json(x, schema, {"mode": "PERMISSIVE"})) for x in tries])


def canonical_json(c: Column) -> Column:
    """A flat JSON object's text with its members in the order of their names, for request_key()."""
    members = F.map_entries(F.from_json(c, "map<string,string>"))
    return F.to_json(F.map_from_entries(F.array_sort(members)))


def without_unit(c: Column) -> Column:
    """A code in upper case without the two digits of its unit, where a letter follows them."""
    code = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(code.rlike("^[0-9]{2}[A-Z]"), F.substring(code, 3, 1_000_000)).otherwise(code)


def building_of_drawing(c: Column) -> Column:
    """The building in a drawing's number: the unit's digit and the building's letters; null if there is none."""
    part = lambda i: F.regexp_extract(c, r"NP\.[DС]\.[A-Z0-9]{4}\.([0-9])\.([0-9][A-Z]{3})", i)
    return F.nullif(F.concat(part(1), part(2)), F.lit(""))


def unit_of(c: Column) -> Column:
    """The unit, the fourth dotted part of a document number, if it is a number."""
    part = F.get(F.split(c, r"\."), F.lit(3))
    return F.when(part.rlike("^[0-9]+$"), part)


def set_revision(revisions: Column) -> Column:
    """The label of a set from its map of type to revision: DC, SD, BG and DK in this order, those there are, a dash for a blank."""
    label = lambda t: F.concat(F.lit(f"{t}="), F.coalesce(F.nullif(F.trim(F.try_element_at(revisions, F.lit(t))), F.lit("")), F.lit("-")))
    return F.concat_ws(",", *[F.when(F.map_contains_key(revisions, t), label(t)) for t in ("DC", "SD", "BG", "DK")])


def table_value(c: Column) -> Column:
    """A cell's value for comparison: lower case, no blanks, one kind of dash (also for ~) and of multiplication sign."""
    return F.translate(F.lower(F.trim(c)), "—–~−×* ", "----xx")


def codes_named(c: Column) -> Column:
    """The distinct names of codes in a text (letters, number, perhaps a year), lower case without blanks, sorted."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z]{2,6}\s*[0-9.]{2,}(?:[-–][0-9]+)?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, squeezed)))


def thickness_of(dims: Column) -> Column:
    """thickness() of the last of a list of dimensions."""
    return thickness(F.element_at(F.when(F.size(dims) > 0, dims), -1))


# Families of codes in the order in which they are tried, and the pattern of each.
CODE_FAMILIES = {
    "NP": r"\bNP-?\d{3}(?:-\d{2,4})\b",
    "PNAE": r"(?i)\bPNAE[\s-]*[A-Z]?[\s-]*\d+(?:[\s-]*\d+)*",
    "GOST": r"\bGOST\s+(?:ISO\s+)?\d{2,5}[\-\.\d]*",
    "TU": r"(?i)\bTU\s+\d{1,3}[-\.\s\d/]{3,}",
    "ASME": r"(?i)\bASME\s+(?:Sec(?:tion)?\.?[\s\d]*(?:Div\.?\s*\d+)?|B\d+(?:\.\d+)?|Code\s+Case)\s*[^\n,]{0,30}",
    "RCC-M": r"(?i)\bRCC-M[\s-]*[A-Z]?[\s\d\-\.]{0,20}",
    "ISO": r"\bISO\s+\d{2,5}[\-\d]*",
    "EN": r"\bEN\s+\d{2,5}[\-\d]*",
    "KS": r"\bKS\s+[A-Z]\s*\d{2,5}",
}


def code_family(c: Column) -> Column:
    """The first family whose pattern a text holds; null if none."""
    return F.coalesce(*[F.when(c.rlike(pattern), F.lit(name)) for name, pattern in CODE_FAMILIES.items()])


def is_date(c: Column) -> Column:
    """Whether a text is a day that exists in one of the four forms that the checks of fields accept."""
    forms = ("yyyy-M-d", "d.M.yyyy", "yyyy/M/d", "d/M/yyyy")
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in forms]).isNotNull()


def line_code(c: Column) -> Column:
    """A line's code for comparison: upper case, no white space, I, L and | as 1, O as 0."""
    return F.translate(F.upper(F.regexp_replace(c, r"\s+", "")), "IL|O", "1110")
