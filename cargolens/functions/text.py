"""Column functions on document text: titles, versions, sections, terms, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens.functions.values import blank_to_null, strip

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row, also where ``use`` loops over it."""
    return F.transform(F.array(value), use)[0]


def lines(text: Column) -> Column:
    """Text as an array of lines, without an empty line after a final break."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(
        parts
    )


def folded(text: Column) -> Column:
    """Case-folded text. Lower case plus the one fold that matters in practice, sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normal(text: Column) -> Column:
    """Case-folded text with every run of white space as one space."""
    return F.btrim(F.regexp_replace(folded(text), r"(?U)[\s\x1c-\x1f]+", " "))


def title(text: Column, fallback: Column) -> Column:
    """Text of the first line that starts with '# ', else the fallback."""
    found = F.regexp_extract(text, rf"(?:^|{LINE_BREAK})# ([^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]*)", 1)
    has = text.rlike(rf"(?:^|{LINE_BREAK})# ")
    return F.when(has, strip(found)).otherwise(fallback)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"[.][^.]*$", "")


def version_text(text: Column) -> Column:
    """Text after the first 'version:' line label, blank gives null."""
    found = F.regexp_extract(
        text, r"(?i)(?:^|[\n\r])[ \t]*version:([^\n\r]*)", 1
    )
    return blank_to_null(strip(found))


def version_number(text: Column) -> Column:
    """The version as a whole number; null when there is none or it is not whole."""
    raw = version_text(text)
    return F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("int"))


def search_terms(query: Column) -> Column:
    """Distinct search terms of a query."""
    return F.array_distinct(F.regexp_extract_all(folded(query), F.lit(r"[a-z0-9_\-]{3,}"), F.lit(0)))


def slug(text: Column, fallback: str = "vendor") -> Column:
    dashed = F.regexp_replace(folded(text), r"[^a-z0-9]+", "-")
    cut = F.left(F.btrim(dashed, F.lit("-")), F.lit(80))
    return F.coalesce(blank_to_null(cut), F.lit(fallback))


def page_of_locator(locator: Column) -> Column:
    """Page number of a locator 'Page 12, part 3'; null for other locators."""
    head = F.split_part(locator, F.lit(","), F.lit(1))
    found = F.regexp_extract(strip(head), r"(?i)^page +([0-9]+)$", 1).try_cast("int")
    return F.when(found > 0, found)


def section_indicators(text: Column, heading: str) -> Column:
    """Bulleted entries below one '## ' heading, in order, 1 to 160 characters each.

    The fold keeps (state, entries): state 0 before the section, 1 inside, 2 after it.
    """
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        bare = strip(line)
        is_heading = bare.startswith("## ")
        is_target = folded(strip(F.substring(bare, F.lit(4), F.length(bare)))) == folded(F.lit(heading))
        state = (
            F.when(~is_heading | (acc["state"] == 2), acc["state"])
            .when(is_target, 1)
            .when(acc["state"] == 1, 2)
            .otherwise(0)
        )
        entry = strip(F.btrim(strip(F.substring(bare, F.lit(3), F.length(bare))), F.lit("`")))
        takes = (
            (state == 1)
            & ~is_heading
            & (bare.startswith("- ") | bare.startswith("* "))
            & (F.length(entry) > 0)
            & (F.length(entry) <= 160)
        )
        found = F.when(takes, F.array_append(acc["found"], entry)).otherwise(acc["found"])
        return F.struct(state.alias("state"), found.alias("found"))

    return F.aggregate(lines(text), start, step, lambda acc: acc["found"])
