"""Values, units, numbers, messages: the places where a plain function would differ."""

import math

from pyspark.sql import functions as F

from cargolens.functions import hashing as H
from cargolens.functions import text as T
from cargolens.functions import values as V


def column(spark, rows, build, schema="v string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(build).collect()]


def test_working_null_hides_source(spark):
    field = V.lift(F.lit("5"), F.lit("KG"))
    cleared = field.withField("working.value", F.lit(None).cast("string"))
    absent = field.withField("working", F.lit(None).cast(V.WORKING))
    row = spark.range(1).select(V.current_value(cleared), V.current_value(absent)).first()
    assert tuple(row) == (None, "5")


def test_unit_fallback_differs_between_checks_and_output(spark):
    field = V.lift(F.lit("5"), F.lit(" lb. ")).withField("working.unit", F.lit(""))
    row = spark.range(1).select(V.checked_unit(field), V.output_unit(field), V.weight_kg(field)[1]).first()
    assert tuple(row) == ("LB", "", "assumed_kg")


def test_numbers(spark):
    texts = ["1,5", " 12.0 ", "1d", "0x1", "", " ", "n/a", "nan", "-3", "1e3", ".5", "5.", " 7 ", None, "+4"]
    got = column(spark, texts, V.number(F.col("v")))
    want = [15.0, 12.0, None, None, None, None, None, math.nan, -3.0, 1000.0, 0.5, 5.0, 7.0, None, 4.0]
    assert [str(g) for g in got] == [str(w) for w in want]
    assert column(spark, ["1"], V.number(F.col("v"), F.lit("bool"))) == [None]


def test_short_number_is_six_digits_without_zeros(spark):
    numbers = [830.0, 0.5, 1e6, 999999.0, 1234567.0, 0.0001, 0.00001234, 0.0, -2.50, 100.0, 1e20, 123456.5, 1 / 3, 1e-7, 12345.25, 1.015625, 1234565.0, -77.0]
    got = column(spark, numbers, V.short_number(F.col("v")), "v double")
    assert got == [f"{n:g}" for n in numbers]


def test_quoted_text(spark):
    texts = ["KG", "it's", 'a"b', "it's \"x\"", "back\\slash", "a\nb\tc"]
    assert column(spark, texts, V.quoted(F.col("v"))) == [repr(t) for t in texts]


def test_nan_never_compares(spark):
    for op in ("gt", "gte", "lt", "lte", "eq"):
        assert column(spark, [math.nan], V.ordered(F.col("v"), op, F.lit(1.0)), "v double") == [False]
    assert column(spark, [2.0], V.ordered(F.col("v"), "gt", F.lit(1.0)), "v double") == [True]


def test_conversions(spark):
    def cm(unit):
        return V.length_cm(V.lift(F.lit("1480"), F.lit(unit)))

    row = spark.range(1).select(*cm("MM"), *cm("M"), *cm("inch"), *cm("yd"), *cm("")).first()
    assert tuple(row) == (
        148.0, "converted_mm_to_cm", 148000.0, "converted_m_to_cm", 1480 * 2.54, "converted_in_to_cm",
        None, "unsupported_dimension_unit:YD", 1480.0, "assumed_cm",
    )
    kg = spark.range(1).select(*V.weight_kg(V.lift(F.lit("100"), F.lit("lbs")))).first()
    assert tuple(kg) == (100 * 0.45359237, "converted_lb_to_kg")


def test_edit_coercion(spark):
    def edit(kind, path, text):
        return [x for x in spark.range(1).select(*V.coerced(F.lit(path), F.lit(kind), F.lit(text))).first()]

    assert edit("int", "a.quantity", "1,200") == ["1200", "int", None]
    assert edit("int", "a.quantity", "1.5") == [None, "int", "Enter a whole number."]
    assert edit("float", "a.volume", " 1.5 ") == ["1.5", "float", None]
    assert edit("bool", "a.volume", "Yes") == ["true", "bool", None]
    assert edit("string", "a.status", " x ") == ["x", "string", None]
    assert edit("float", "a.volume", "  ") == [None, "null", None]


def test_paths(spark):
    texts = ["packages[0].items[1].quantity", "order.sales_order", "issues[0].code", "packages[0].__class__", "a", "order.x()", "packages[x].a"]
    assert column(spark, texts, V.path_allowed(F.col("v"))) == [True, True, False, False, False, False, False]
    assert column(spark, texts[:2], V.leaf_name(F.col("v"))) == ["quantity", "sales_order"]


def test_typed_equality(spark):
    def same(a, ak, b, bk):
        return spark.range(1).select(V.same_value(F.lit(a), F.lit(ak), F.lit(b), F.lit(bk))).first()[0]

    assert same("12", "int", "12.0", "float")
    assert not same("12", "string", "12", "int")
    assert same(None, "null", None, "null")


def test_titles_versions_slugs_pages(spark):
    texts = ["x\n# Top  \n# Next", "no heading"]
    assert column(spark, texts, T.title(F.col("v"), F.lit("stem"))) == ["Top", "stem"]
    texts = ["a\n  VERSION: 3 \nversion: 4", "Version: two", "none"]
    assert column(spark, texts, T.version_text(F.col("v"))) == ["3", "two", None]
    assert column(spark, texts, T.version_number(F.col("v"))) == [3, None, None]
    assert column(spark, ["Straße & Söhne", "!!"], T.slug(F.col("v"))) == ["strasse-s-hne", "vendor"]
    texts = ["Page 12, part 3", "page 0", "PAGE 4", "Document", "Page x"]
    assert column(spark, texts, T.page_of_locator(F.col("v"))) == [12, None, 4, None, None]


def test_indicators_of_one_section(spark):
    text = "# T\n## Typical Recognition Indicators\n- `Packing List`\n* Sales Order\ntext\n- " + "x" * 161 + "\n## Other\n- no\n"
    assert column(spark, [text], T.section_indicators(F.col("v"), "Typical recognition indicators")) == [
        ["Packing List", "Sales Order"]
    ]


def test_issue_fingerprint_equals_compact_sorted_json(spark):
    import hashlib
    import json

    issue = {"code": "C", "severity": "WARNING", "message": 'é "q" \\ \t', "case_number": None, "field_path": "p[0]"}
    columns = [F.lit(issue[k]) for k in ("code", "severity", "message", "case_number", "field_path")]
    got = spark.range(1).select(H.issue_fingerprint(*[c.cast("string") for c in columns])).first()[0]
    text = json.dumps(issue, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got == hashlib.sha256(text.encode()).hexdigest()
