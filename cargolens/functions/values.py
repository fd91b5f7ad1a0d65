"""Column functions on field values: text, numbers, units, conversions, messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at both ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Recognised units.
DIMENSION_UNITS = ["MM", "CM", "M", "METRE", "METER", "IN", "INCH", "INCHES"]
WEIGHT_UNITS = ["G", "GRAM", "GRAMS", "KG", "LB", "LBS", "POUND", "POUNDS"]

# A number as text, after commas are gone. Java also accepts a trailing d or f
# and hexadecimal, so the text is checked before it is cast.
NUMBER_PATTERN = r"^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"

# Fields edited as numbers.
NUMERIC_FIELDS = [
    "gross_weight", "net_weight", "volume", "length", "width", "height", "quantity", "sequence",
]

PATH_PATTERN = r"^(order|shipment|packages)(\[[0-9]+\])?([.][a-zA-Z][a-zA-Z0-9_]*(\[[0-9]+\])?)*$"


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_missing(value: Column) -> Column:
    """Null or empty. A blank such as ' ' is present."""
    return value.isNull() | (value == "")


def first_present(*texts: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


# ---- field structs -------------------------------------------------------


def lift(value, unit=None, status=None, locator=None, raw=None, kind=None, required=False) -> Column:
    """Build a field from a mapped value: source, equal working value, evidence, flags."""
    null = F.lit(None).cast("string")
    value = value.cast("string")
    unit = null if unit is None else unit
    status = F.lit("SUPPORTED") if status is None else status
    locator = null if locator is None else locator
    raw = null if raw is None else raw
    kind = F.when(value.isNull(), "null").otherwise("string") if kind is None else kind
    evidence = F.struct(
        F.lit(None).cast("bigint").alias("document_id"),
        locator.alias("locator"),
        raw.alias("raw_text"),
        status.alias("status"),
    )
    has_evidence = ~is_missing(locator) | ~is_missing(raw)
    source = F.struct(
        value.alias("value"),
        kind.alias("value_kind"),
        unit.alias("unit"),
        raw.alias("raw"),
        F.when(has_evidence, F.array(evidence)).otherwise(F.array().cast(f"array<{EVIDENCE}>")).alias("evidence"),
    )
    working = F.struct(
        value.alias("value"),
        kind.alias("value_kind"),
        unit.alias("unit"),
        F.lit("source").alias("origin"),
        null.alias("modified_by"),
        null.alias("reason"),
    )
    return F.struct(
        source.alias("source"),
        working.alias("working"),
        F.lit(False).alias("modified"),
        F.lit(required).alias("required"),
    )


EVIDENCE = "struct<document_id:bigint,locator:string,raw_text:string,status:string>"
SOURCE = f"struct<value:string,value_kind:string,unit:string,raw:string,evidence:array<{EVIDENCE}>>"
WORKING = (
    "struct<value:string,value_kind:string,unit:string,origin:string,"
    "modified_by:string,reason:string>"
)
FIELD = f"struct<source:{SOURCE},working:{WORKING},modified:boolean,required:boolean>"


def current_value(field: Column) -> Column:
    """Working value when a working record exists, even a null one; else the source value."""
    return F.when(field["working"].isNotNull(), field["working"]["value"]).otherwise(field["source"]["value"])


def current_kind(field: Column) -> Column:
    return F.when(field["working"].isNotNull(), field["working"]["value_kind"]).otherwise(
        field["source"]["value_kind"]
    )


def checked_unit(field: Column, fallback: Column | None = None) -> Column:
    """Unit for validation and queries: working, else source, else the fallback; normalised, '' if none."""
    candidates = [field["working"]["unit"], field["source"]["unit"]]
    if fallback is not None:
        candidates.append(fallback)
    return normal_unit(first_present(*candidates))


def output_unit(field: Column, fallback: Column | None = None) -> Column:
    """Unit for output rows: the working unit alone when a working record exists, else the source unit."""
    own = F.when(field["working"].isNotNull(), field["working"]["unit"]).otherwise(field["source"]["unit"])
    return normal_unit(own if fallback is None else first_present(own, fallback))


def normal_unit(unit: Column) -> Column:
    return F.coalesce(F.replace(F.upper(strip(unit)), F.lit("."), F.lit("")), F.lit(""))


def number(value: Column, kind: Column | None = None) -> Column:
    """Text to double: every comma is dropped, ends are stripped, anything else is null."""
    text = strip(F.replace(value, F.lit(","), F.lit("")))
    parsed = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return parsed if kind is None else F.when(kind == "bool", F.lit(None)).otherwise(parsed)


def field_number(field: Column) -> Column:
    return number(current_value(field), current_kind(field))


def case_text(field: Column) -> Column:
    """Case number as stripped text, blank gives null."""
    return blank_to_null(strip(current_value(field)))


def case_label(field: Column) -> Column:
    """Case number for query results: only null and '' have no label."""
    value = current_value(field)
    return F.when(is_missing(value), F.lit("(missing case number)")).otherwise(strip(value))


def ordered(left: Column, op: str, right: Column) -> Column:
    """Comparison in which NaN is never above, below or equal (Spark sorts NaN last)."""
    # comparison names as requests carry them
    compare = {
        "gt": left > right,
        "gte": left >= right,
        "lt": left < right,
        "lte": left <= right,
        "eq": left == right,
    }[op]
    return ~F.isnan(left) & ~F.isnan(right) & compare


# ---- conversions ---------------------------------------------------------

# Conversion factors. A factor is (operation, constant, origin).
LENGTH_TO_CM = [
    (["MM"], "div", 10.0, "converted_mm_to_cm"),
    (["M", "METRE", "METER"], "mul", 100.0, "converted_m_to_cm"),
    (["IN", "INCH", "INCHES"], "mul", 2.54, "converted_in_to_cm"),
]
WEIGHT_TO_KG = [
    (["G", "GRAM", "GRAMS"], "div", 1000.0, "converted_g_to_kg"),
    (["LB", "LBS", "POUND", "POUNDS"], "mul", 0.45359237, "converted_lb_to_kg"),
]


def _converted(value: Column, unit: Column, base: str, table, family: str) -> tuple[Column, Column]:
    out = F.when(unit.isin(base, ""), value)
    origin = F.when(unit == base, "source").when(unit == "", f"assumed_{base.lower()}")
    for units, op, factor, name in table:
        out = out.when(unit.isin(units), value / factor if op == "div" else value * factor)
        origin = origin.when(unit.isin(units), name)
    origin = origin.otherwise(F.concat(F.lit(f"unsupported_{family}_unit:"), unit))
    return out, F.when(value.isNotNull(), origin)


def length_cm(field: Column, fallback: Column | None = None) -> tuple[Column, Column]:
    """(centimetres, origin of the number)."""
    return _converted(field_number(field), output_unit(field, fallback), "CM", LENGTH_TO_CM, "dimension")


def weight_kg(field: Column) -> tuple[Column, Column]:
    """(kilograms, origin of the number)."""
    return _converted(field_number(field), output_unit(field), "KG", WEIGHT_TO_KG, "weight")


def volume_m3(length: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Cubic metres from centimetres; null when one side is unknown."""
    known = length.isNotNull() & width.isNotNull() & height.isNotNull()
    return (
        length * width * height / 1_000_000,
        F.when(known, "calculated_preview_template_formula").otherwise("template_formula"),
    )


# ---- messages ------------------------------------------------------------


def short_number(value: Column) -> Column:
    """Six significant digits without trailing zeros: 830, 0.5, 1e+06.

    The number is first rounded to six digits, a tie to the even digit, since
    the formatter alone rounds ties up.
    """
    # one flat choice: nested ones make a method too large to be compiled
    rounded = None
    for power in range(-4, 16):
        inside = (F.abs(value) >= 10.0**power) & (F.abs(value) < 10.0 ** (power + 1))
        even = F.bround(value, 5 - power)
        rounded = F.when(inside, even) if rounded is None else rounded.when(inside, even)
    rounded = rounded.otherwise(value)
    text = F.format_string("%g", rounded)
    text = F.regexp_replace(text, r"([.][0-9]*?)0+(e|$)", "$1$2")
    text = F.regexp_replace(text, r"[.](e|$)", "$1")
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .when((value == F.floor(value)) & (F.abs(value) < 1e6) & (value != 0), value.cast("bigint").cast("string"))
        .otherwise(text)
    )


def quoted(text: Column) -> Column:
    """Text in quotes, as the messages show it."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(shown))
    only_single = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(only_single, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


# ---- edits ---------------------------------------------------------------


def leaf_name(path: Column) -> Column:
    """Last name of a path, without an index."""
    return F.regexp_extract(path, r"([^.\[]+)(\[[0-9]*\])?$", 1)


def path_allowed(path: Column) -> Column:
    """A path the working data may be changed at, judged by its text alone."""
    forbidden = path.rlike(r"__|[(){};]")
    return F.coalesce(path.rlike(PATH_PATTERN) & ~forbidden, F.lit(False))


def coerced(path: Column, existing_kind: Column, value: Column) -> tuple[Column, Column, Column]:
    """(value text, kind, error) of an edit, following the field name and the kind it replaces."""
    text = blank_to_null(strip(value))
    bare = F.replace(text, F.lit(","), F.lit(""))
    numeric = leaf_name(path).isin(NUMERIC_FIELDS)
    lowered = F.lower(text)
    # words read as yes and no
    yes = lowered.isin("1", "true", "yes", "on")
    no = lowered.isin("0", "false", "no", "off")
    whole = strip(bare).rlike(r"^[+-]?[0-9]+$")
    real = number(text)
    out = (
        F.when(text.isNull() | ~numeric, text)
        .when(existing_kind == "bool", F.when(yes, "true").when(no, "false"))
        .when(existing_kind == "int", F.when(whole, strip(bare)))
        .otherwise(F.when(real.isNotNull(), strip(bare)))
    )
    kind = (
        F.when(text.isNull(), "null")
        .when(~numeric, "string")
        .when(existing_kind == "bool", "bool")
        .when(existing_kind == "int", "int")
        .otherwise("float")
    )
    error = (
        F.when(text.isNull() | ~numeric | out.isNotNull(), F.lit(None))
        .when(existing_kind == "bool", "Enter a true/false value.")
        .when(existing_kind == "int", "Enter a whole number.")
        .otherwise("Enter a numeric value.")
    )
    return out, kind, error


def same_value(left: Column, left_kind: Column, right: Column, right_kind: Column) -> Column:
    """Typed equality: numbers by value whatever their kind, everything else by kind and text."""
    numeric = ["int", "float", "bool"]

    def as_number(value: Column, kind: Column) -> Column:
        flag = F.when(value == "true", 1.0).when(value == "false", 0.0)
        return F.when(kind == "bool", flag).otherwise(number(value))

    both = left_kind.isin(numeric) & right_kind.isin(numeric)
    by_number = as_number(left, left_kind).eqNullSafe(as_number(right, right_kind))
    by_text = left_kind.eqNullSafe(right_kind) & left.eqNullSafe(right)
    return F.coalesce(F.when(both, by_number).otherwise(by_text), F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
