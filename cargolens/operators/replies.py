"""Mapper replies as text: fence removal, unwrapping, shorthand repair, strict documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens.functions.text import lines, once
from cargolens.functions.values import strip
from cargolens.operators.merge import MAPPED

KNOWN_KEYS = ["value", "unit", "raw", "locator", "status"]
SHORT_KEYS = ["text", "content", "mapped_value", "result"]
STATUSES = ["MISSING", "AMBIGUOUS", "SUPPORTED", "CONFIRMED"]


def unfenced(reply: Column) -> Column:
    """The reply without a surrounding fence of tildes or backticks, when it has three lines or more."""

    def body(both: Column) -> Column:
        text, parts = both["text"], both["parts"]
        fenced = (text.startswith("~~~") & text.endswith("~~~")) | (text.startswith("```") & text.endswith("```"))
        inner = strip(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "\n"))
        return F.when(fenced & (F.size(parts) >= 3), inner).otherwise(text)

    split = once(strip(reply), lambda t: F.struct(t.alias("text"), lines(t).alias("parts")))
    return once(split, body)


def json_of_reply(reply: Column) -> Column:
    """JSON text of a reply; a JSON string that itself holds JSON is unwrapped, at most twice. Null if unreadable."""

    def unwrapped(text: Column) -> Column:
        inner = strip(F.try_variant_get(F.try_parse_json(text), "$", "string"))
        return once(
            inner, lambda i: F.when(text.startswith('"') & F.coalesce(i.rlike(r"^[\[{]"), F.lit(False)), i).otherwise(text)
        )

    text = once(once(unfenced(reply), unwrapped), unwrapped)
    return once(text, lambda t: F.when(F.try_parse_json(t).isNotNull(), t))


def _scalar_kind(json: Column) -> Column:
    return (
        F.when(json.isNull() | (json == "null"), "null")
        .when(json.startswith('"'), "string")
        .when(json.isin("true", "false"), "bool")
        .when(json.rlike(r"^-?[0-9]+$"), "int")
        .when(json.rlike(r"^-?[0-9]"), "float")
        .otherwise("json")
    )


def _scalar_text(json: Column) -> Column:
    """Text of a JSON scalar as it was written: 12.0 stays 12.0."""
    return (
        F.when(json.isNull() | (json == "null"), F.lit(None))
        .when(json.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v"))
        .otherwise(json)
    )


def _struct(value, kind, unit, raw, locator, status) -> Column:
    return F.struct(
        value.alias("value"), kind.alias("value_kind"), unit.alias("unit"), raw.alias("raw"),
        locator.alias("locator"), status.alias("status"),
    ).cast(MAPPED)


def _opened(text: Column) -> Column:
    """What is read once from the JSON text: its entries as text, its keys, the types of its values."""
    is_object = text.startswith("{")
    return F.struct(
        text.alias("text"),
        is_object.alias("is_object"),
        F.when(is_object, F.from_json(text, "map<string,string>")).alias("entries"),
        F.coalesce(F.when(is_object, F.json_object_keys(text)), F.array().cast("array<string>")).alias("keys"),
        F.coalesce(F.when(is_object, F.schema_of_variant(F.try_parse_json(text))), F.lit("")).alias("types"),
    )


def _repaired(opened: Column) -> Column:
    text, entries, keys = opened["text"], opened["entries"], opened["keys"]
    null = F.lit(None).cast("string")

    def has(key: str) -> Column:
        return F.array_contains(keys, key)

    def kind_at(key: str) -> Column:
        kind = F.regexp_extract(opened["types"], rf"[<,] ?{key}: ([A-Z]+)", 1)
        raw = entries[key]
        return (
            F.when(kind.isin("", "VOID"), "null")
            .when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "bool")
            .when(raw.rlike(r"^-?[0-9]+$"), "int")
            .when(raw.rlike(r"^-?[0-9]"), "float")
            .otherwise("json")
        )

    def optional(key: str) -> Column:
        return F.when(has(key), entries[key])

    known = F.arrays_overlap(keys, F.array(*map(F.lit, KNOWN_KEYS)))
    empty = ~has("value") | entries["value"].isNull() | (entries["value"] == "")
    given = F.when(has("status"), F.upper(strip(entries["status"]))).otherwise(
        F.when(empty, "MISSING").otherwise("SUPPORTED")
    )
    rest = [optional("unit"), optional("raw"), optional("locator")]
    bare = _struct(
        _scalar_text(text), _scalar_kind(text), null, null, null, F.when(text == "null", "MISSING").otherwise("SUPPORTED")
    )
    full = _struct(optional("value"), F.when(has("value"), kind_at("value")).otherwise("null"), *rest, given)
    out = F.when(~opened["is_object"], bare).when(known, F.when(given.isin(STATUSES), full))
    for key in SHORT_KEYS:
        short = _struct(entries[key], kind_at(key), *rest, F.lit("SUPPORTED"))
        out = out.when(has(key) & (F.size(keys) <= 4), short)
    return out


def mapped_value(json: Column) -> Column:
    """A mapped value from its JSON text, shorthand forms repaired; null when the form is not accepted.

    null is MISSING, a bare scalar is SUPPORTED, an object with known keys
    keeps only those, and a small object with one of the short keys gives its value.
    """
    return once(once(F.coalesce(strip(json), F.lit("null")), _opened), _repaired)


def unknown_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object a strict document may not have."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))


def document_problem(json: Column, allowed: list[str]) -> Column:
    """Why a stored document is rejected as a whole: unreadable, no object, unknown key."""
    parsed = F.try_parse_json(json)
    extra = unknown_keys(json, allowed)
    return (
        F.when(parsed.isNull(), "unreadable JSON")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
        .when(F.size(extra) > 0, F.concat(F.lit("unknown key: "), F.array_join(F.array_sort(extra), ", ")))
    )
