"""Merging of package records: segments of one document by status, continuation pages by first value.

Both merges are left folds over ordered records. Each is written as one
aggregate per (job, case) with map-side combine, so no task holds a group as a
list. The two differ on purpose: the first ranks by mapping status and compares
values with their type, the second keeps the first value and compares text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.values import (
    blank_to_null,
    current_value,
    is_missing,
    lift,
    quoted,
    strip,
)
from cargolens.operators.fields import SIDES
from cargolens.operators.ordinals import mark_first, of_several_pieces, piece_of

# Rank of a mapping status.
STATUS_RANK = {"MISSING": 0, "AMBIGUOUS": 1, "SUPPORTED": 2, "CONFIRMED": 3}
RANKS = sorted(STATUS_RANK.values(), reverse=True)

MAPPED = "struct<value:string,value_kind:string,unit:string,raw:string,locator:string,status:string>"

# Package fields beside case and sides, order and shipment fields, and the parts of an item's key.
CONTINUED_FIELDS = [
    "internal_reference", "volume", "gross_weight", "net_weight", "package_type",
    "package_description", "status", "packed_by", "pack_date",
]
ORDER_FIELDS = [
    "sales_order", "customer_order_number", "position", "project", "customer_project",
    "purchase_order", "purchase_order_position",
]
SHIPMENT_FIELDS = ["product_type", "description", "country_of_origin", "hs_code", "supplier_name"]
ITEM_KEY = ["sequence", "position", "item_number", "description", "serial_number", "quantity", "uom", "length"]


def mapped(value, kind=None, unit=None, raw=None, locator=None, status=None) -> Column:
    """One mapped value as the extraction step gives it."""
    null = F.lit(None).cast("string")
    value = value.cast("string")
    return F.struct(
        value.alias("value"),
        (F.when(value.isNull(), "null").otherwise("string") if kind is None else kind).alias("value_kind"),
        (null if unit is None else unit).alias("unit"),
        (null if raw is None else raw).alias("raw"),
        (null if locator is None else locator).alias("locator"),
        (F.lit("SUPPORTED") if status is None else status).alias("status"),
    )


def lift_mapped(field: Column, required: bool = False) -> Column:
    return lift(
        field["value"], field["unit"], field["status"], field["locator"], field["raw"], field["value_kind"], required
    )


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def _present(field: Column) -> Column:
    return ~is_missing(field["value"])


def typed_text(field: Column) -> Column:
    """Text that differs when the JSON form differs: 100, 100.0 and "100" are three values."""
    number = F.when(field["value_kind"].isin("int", "float"), F.lit("number")).otherwise(field["value_kind"])
    return F.concat_ws(":", number, field["value"])


def _case_key(case: Column | None = None) -> Column:
    case = F.col("case_number") if case is None else case
    return blank_to_null(strip(F.when(_present(case), case["value"])))


# ---- segments ------------------------------------------------------------


def document_scalars(segments: DataFrame, names: list[str]) -> DataFrame:
    """First non-empty value of each document-level text over the segments, and the document type.

    The type stays open while it is still the general one: the first other
    non-empty type takes its place.
    """
    picks = [F.min_by(n, F.when(~is_missing(F.col(n)), F.col("segment_no"))).alias(n) for n in names]
    kind = F.col("document_type")
    other = F.when(~is_missing(kind) & (kind != "packing_list"), F.col("segment_no"))
    return (
        segments.groupBy("job_id")
        .agg(
            *picks,
            F.min_by("document_type", "segment_no").alias("_first"),
            F.min_by("document_type", other).alias("_other"),
        )
        .withColumn(
            "document_type",
            F.when(F.col("_first") != "packing_list", F.col("_first")).otherwise(
                F.coalesce("_other", F.lit("packing_list"))
            ),
        )
        .drop("_first", "_other")
    )


def merged_notes(notes: DataFrame) -> DataFrame:
    """Notes of all segments in order: those of the first segment as they are, later ones once."""
    marked = mark_first(notes, ["job_id", "note"], ["job_id", "note_ord"], "note_ord", "_first")
    return marked.filter((F.col("segment_no") == 1) | F.col("_first")).drop("_first")


def _columns(fields) -> dict[str, Column]:
    """Fields by name. A list names columns of the rows; columns over narrower rows are worked out once the rows moved."""
    return dict(fields) if isinstance(fields, dict) else {n: F.col(n) for n in fields}


def _segment_picks(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Per (job, case), all as ordinals: its base, its home and the record that gives each field.

    The base is the last record of the case in the first segment; earlier
    repeats there stay packages of their own.
    """
    first, at = F.col("segment_no") == 1, F.col("pkg_ord").cast("bigint")
    aggs = [
        F.max(F.when(first, at)).alias("_base"),
        F.max(F.when(~first, at)).alias("_last"),
        F.min(F.when(~first, at)).alias("_first_later"),
        F.max(F.when(first, at * 2 + F.coalesce(~is_missing(F.col("dim_unit")), F.lit(False)).cast("int"))).alias("_unit_base"),
        F.min(F.when(~first & ~is_missing(F.col("dim_unit")), at)).alias("_unit_later"),
    ]
    for name, field in fields.items():
        rank, present = status_rank(field["status"]), _present(field)
        aggs.append(F.max(F.when(first, at * 8 + rank * 2 + present.cast("int"))).alias(f"_own_{name}"))
        aggs.append(F.min(F.when(~first & present, (3 - rank) * F.lit(1 << 48) + at)).alias(f"_best_{name}"))
    winners = []
    for name in fields:
        own, best = F.col(f"_own_{name}"), F.col(f"_best_{name}")
        beaten = 3 - F.shiftright(best, 48) > F.shiftright(own, 1).bitwiseAND(3)
        winners.append(
            F.when((own.bitwiseAND(1) == 1) & ~F.coalesce(beaten, F.lit(False)), F.col("_base"))
            .when(best.isNotNull(), best.bitwiseAND((1 << 48) - 1))
            .otherwise(F.coalesce("_last", "_base"))
            .alias(f"_at_{name}")
        )
    unit = F.when(F.col("_unit_base") % 2 == 1, F.col("_base")).otherwise(F.col("_unit_later"))
    return rows.groupBy("job_id", "_case").agg(*aggs).select(
        "job_id", "_case", "_base", F.coalesce("_base", "_first_later").alias("_home"), unit.alias("_unit_at"), *winners
    )


def merge_segments(packages: DataFrame, fields) -> DataFrame:
    """Packages of all segments merged by case: the earliest value of the highest status rank wins.

    Where no value is present the last record stands. Packages without a case
    number never merge. Winners are found as ordinals, so the rows themselves
    move once, and only the winning values are put together.
    """
    fields = _columns(fields)
    rows = packages.withColumn("_case", _case_key(fields.get("case_number", F.col("case_number"))))
    cased = rows.filter(F.col("_case").isNotNull())
    repeat = (F.col("segment_no") == 1) & (F.col("pkg_ord") != F.col("_base"))
    met = cased.join(_segment_picks(cased, fields), ["job_id", "_case"]).withColumn(
        "_alone", F.when(repeat, F.col("pkg_ord"))
    )

    def pick(at: str, value: Column) -> Column:
        here = F.coalesce(F.col("_alone"), F.col(at))
        return F.first(F.when(F.col("pkg_ord") == here, value), True)

    merged = met.groupBy("job_id", "_case", "_alone").agg(
        F.coalesce("_alone", F.max("_home")).alias("pkg_ord"),
        *[pick(f"_at_{n}", c).alias(n) for n, c in fields.items()],
        pick("_unit_at", F.col("dim_unit")).alias("dim_unit"),
    )
    columns = ["job_id", "pkg_ord", *fields, "dim_unit"]
    single = rows.filter(F.col("_case").isNull())
    return merged.select(*columns).unionByName(
        single.select("job_id", "pkg_ord", *[c.alias(n) for n, c in fields.items()], "dim_unit")
    )


def segment_targets(packages: DataFrame) -> DataFrame:
    """Which package every record ends up in: (job_id, pkg_ord, target_ord)."""
    rows = packages.select("job_id", "pkg_ord", "segment_no", _case_key().alias("_case"))
    first = F.col("segment_no") == 1
    homes = (
        rows.filter(F.col("_case").isNotNull())
        .groupBy("job_id", "_case")
        .agg(
            F.max(F.when(first, F.col("pkg_ord"))).alias("_base"),
            F.min(F.when(~first, F.col("pkg_ord"))).alias("_later"),
        )
        .select("job_id", "_case", F.coalesce("_base", "_later").alias("_home"))
    )
    later = rows.filter(F.col("_case").isNotNull() & ~first).join(homes, ["job_id", "_case"])
    stay = rows.filter(F.col("_case").isNull() | first)
    return later.select("job_id", "pkg_ord", F.col("_home").alias("target_ord")).unionByName(
        stay.select("job_id", "pkg_ord", F.col("pkg_ord").alias("target_ord"))
    )


def merge_items(items: DataFrame, targets: DataFrame, names: list[str], key) -> DataFrame:
    """Items of merged packages: all of the home record, later ones when their key is new.

    ``key(column)`` gives the text two item fields are compared by.
    """
    keys = [F.coalesce(key(F.col(n)), F.lit("")) for n in names]
    sizes = [F.length(k).cast("string") for k in keys]
    # the key is worked out before the items move, so fields nobody asks for stay behind
    whole = F.unhex(F.sha2(F.concat_ws("|", *sizes, *keys).cast("binary"), 256))
    rows = (
        items.withColumn("_key", whole)
        .join(targets, ["job_id", "pkg_ord"])
        .withColumn("_at", F.struct("pkg_ord", "item_ord"))
    )
    rows = mark_first(
        rows, ["job_id", "target_ord", "_key"], ["job_id", "target_ord", "_at"], "_at", "_first"
    )
    kept = rows.filter((F.col("pkg_ord") == F.col("target_ord")) | F.col("_first"))
    return kept.drop("_key", "_first", "_at")


def _long(rows: DataFrame, keys: list[str], fields) -> DataFrame:
    """A row for each field of each record: present ones, and all of the first segment."""
    parts = [
        F.struct(
            F.lit(n).alias("name"),
            field["value"].alias("value"),
            field["status"].alias("status"),
            typed_text(field).alias("text"),
            _present(field).alias("present"),
        )
        for n, field in _columns(fields).items()
    ]
    flat = rows.select(*keys, "segment_no", F.col("pkg_ord").alias("ord"), F.inline(F.array(*parts)))
    ranked = flat.withColumns({"rank": status_rank(F.col("status")), "first": F.col("segment_no") == 1})
    return ranked.filter(F.col("present") | F.col("first")).drop("segment_no")


def _ranked(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the base of the first segment and the first record of each rank, all as numbers.

    The base is the last record of the first segment; it comes before all others.
    """
    later = ~F.col("first") & F.col("present")
    code = F.col("ord") * 8 + F.col("rank") * 2 + F.col("present").cast("int")
    mark = F.when(F.col("present"), F.xxhash64("text"))
    groups = long.groupBy(*keys).agg(
        F.max(F.when(F.col("first"), code)).alias("_base"),
        (F.min(mark) != F.max(mark)).alias("_differs"),
        F.max("ord").alias("_last"),
        *[F.min(F.when(later & (F.col("rank") == r), F.col("ord"))).alias(f"_later_{r}") for r in RANKS],
    )
    base_present = F.coalesce(F.col("_base") % 2 == 1, F.lit(False))
    base_rank, base_ord = F.floor(F.col("_base") / 2) % 4, F.floor(F.col("_base") / 8)
    return groups.withColumns(
        {f"_at_{r}": F.when(base_present & (base_rank == r), base_ord).otherwise(F.col(f"_later_{r}")) for r in RANKS}
    )


def _conflicts(long: DataFrame, keys: list[str]) -> DataFrame:
    """Values that differ from the one held when they arrive, with the one kept.

    The value held before a record is the earliest of the highest rank so far,
    which follows from the first record of each rank. Only groups in which
    something differs meet their records again.
    """
    groups = _ranked(long, keys).filter("_differs").select(*keys, *[f"_at_{r}" for r in RANKS])
    rows = long.filter(F.col("present") & ~F.col("first")).join(groups, keys)
    held_at = F.coalesce(*[F.when(F.col(f"_at_{r}") < F.col("ord"), F.col(f"_at_{r}")) for r in RANKS])
    rows = rows.withColumn("_held_at", held_at).filter(F.col("_held_at").isNotNull())
    held = long.filter("present").select(
        *keys, F.col("ord").alias("_held_at"), *[F.col(c).alias(f"_{c}") for c in ("text", "value", "status", "rank")]
    )
    met = rows.join(held, [*keys, "_held_at"]).filter(F.col("_text") != F.col("text"))
    wins = F.col("rank") > F.col("_rank")
    return met.select(
        *keys,
        "ord",
        F.col("_value").alias("left_value"),
        F.col("value").alias("right_value"),
        F.when(wins, F.col("value")).otherwise(F.col("_value")).alias("kept_value"),
        F.when(wins, F.col("status")).otherwise(F.col("_status")).alias("kept_status"),
    )


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose group has more than one: a conflict takes two records."""
    several = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys)
    return rows.join(several, keys, "left_semi")


def segment_conflicts(packages: DataFrame, fields) -> DataFrame:
    """Conflicts of package fields between the segments of a case.

    Fields given as columns are worked out for records of repeated cases only.
    """
    fields = _columns(fields)
    rows = packages.withColumn("_case", _case_key(fields.get("case_number", F.col("case_number"))))
    rows = _shared(rows.filter(F.col("_case").isNotNull()), ["job_id", "_case"])
    found = _conflicts(_long(rows, ["job_id", "_case"], fields), ["job_id", "_case", "name"])
    side = F.when(F.col("name").isin(SIDES), ".dimensions.").otherwise(".")
    label = F.concat(F.lit("case "), F.col("_case"), side, F.col("name"))
    return found.select(
        "job_id", F.col("ord").alias("pkg_ord"), "name", label.alias("label"), "left_value", "right_value", "kept_value", "kept_status"
    )


def _document_names(rows: DataFrame) -> list[str]:
    return [n for n in (*[f"order_{f}" for f in ORDER_FIELDS], *[f"shipment_{f}" for f in SHIPMENT_FIELDS]) if n in rows.columns]


def _document_label() -> Column:
    return F.regexp_replace("name", "^(order|shipment)_", "$1.")


def merge_document_fields(segments: DataFrame) -> DataFrame:
    """Order and shipment fields over the segments of a job: (job_id, path, value, status).

    ``segments`` hold mapped values in columns order_* and shipment_*. The
    earliest value of the highest rank wins; without any the last record stands.
    """
    names = _document_names(segments)
    parts = [F.struct(F.lit(n).alias("name"), F.col(n).alias("f")) for n in names]
    flat = segments.select("job_id", F.col("pkg_ord").alias("ord"), F.inline(F.array(*parts)))
    code = (3 - status_rank(F.col("f.status"))) * F.lit(1 << 48) + F.col("ord")
    best = flat.groupBy("job_id", "name").agg(
        F.min(F.when(_present(F.col("f")), code)).alias("_best"), F.max("ord").alias("_last")
    )
    at = best.select("job_id", "name", F.coalesce(F.col("_best") % F.lit(1 << 48), "_last").alias("ord"))
    return flat.join(at, ["job_id", "name", "ord"]).select("job_id", _document_label().alias("path"), "f.value", "f.status")


def document_conflicts(segments: DataFrame, fields=None, segment: str = "segment_no") -> DataFrame:
    """Conflicts of order and shipment fields between the segments of a job.

    Segments follow each other in the order of ``pkg_ord``, a dense number;
    segment 1 gives the base. The value held before a segment is carried along
    in bounded pieces, so segments move once, all fields together; fields given
    as columns are worked out once they moved. ``segment`` names the column of
    the segment's number.
    """
    fields = _columns(_document_names(segments) if fields is None else fields)
    keys = ["job_id", "_piece"]
    cut = segments.dropna(subset=["job_id", "pkg_ord"]).withColumn("_piece", piece_of(F.col("pkg_ord")))
    first, ord_ = F.coalesce(F.col(segment) == 1, F.lit(False)), F.col("pkg_ord").cast("bigint")

    def states(rows: DataFrame) -> DataFrame:
        """What a segment brings to each field."""
        brought = {
            n: F.struct(
                f["value"].alias("value"), f["status"].alias("status"), typed_text(f).alias("text"),
                status_rank(f["status"]).alias("rank"), _present(f).alias("present"),
            )
            for n, f in fields.items()
        }
        return rows.select(*keys, ord_.alias("ord"), first.alias("first"), *[v.alias(f"_v_{n}") for n, v in brought.items()])

    def best(n: str) -> Column:
        """The least is held: highest rank, then earliest."""
        v = F.col(f"_v_{n}")
        return F.when(~F.col("first") & v["present"], (3 - v["rank"]) * F.lit(1 << 48) + F.col("ord"))

    ends = states(of_several_pieces(cut, ["job_id"])).groupBy(*keys).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col("first"), F.col("ord"))).alias(f"_b_{n}") for n in fields],
        *[F.min_by(f"_v_{n}", best(n)).alias(f"_l_{n}") for n in fields],
        *[F.min(best(n)).alias(f"_c_{n}") for n in fields],
    )
    earlier = Window.partitionBy("job_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(
        *keys,
        *[F.last(f"_b_{n}", True).over(earlier).alias(f"_b_{n}") for n in fields],
        *[F.min_by(f"_l_{n}", f"_c_{n}").over(earlier).alias(f"_l_{n}") for n in fields],
    )
    inside = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    met = states(cut.repartition(*keys)).join(F.broadcast(starts), keys, "left")
    held = []
    for n in fields:
        base = F.coalesce(F.last(F.when(F.col("first"), F.col(f"_v_{n}")), True).over(inside), F.col(f"_b_{n}"))
        own, before = F.min_by(f"_v_{n}", best(n)).over(inside), F.col(f"_l_{n}")
        # of equal ranks the earlier piece came first
        later = F.when(own.isNull() | (before["rank"] >= own["rank"]), F.coalesce(before, own)).otherwise(own)
        held += [base.alias(f"_b_{n}"), later.alias(f"_l_{n}")]
    met = met.select("job_id", "ord", "first", *[f"_v_{n}" for n in fields], *held)
    found = []
    for n in fields:
        v, base, later = F.col(f"_v_{n}"), F.col(f"_b_{n}"), F.col(f"_l_{n}")
        stays = F.coalesce(base["present"], F.lit(False)) & (later.isNull() | (base["rank"] >= later["rank"]))
        h = F.when(stays, base).otherwise(later)
        clash = ~F.col("first") & v["present"] & (h["text"] != v["text"])
        entry = F.struct(F.lit(n).alias("name"), h.alias("held"), v.alias("own"))
        found.append(F.when(clash, entry))
    rows = met.select("job_id", "ord", F.inline(F.filter(F.array(*found), lambda c: c.isNotNull())))
    wins = F.col("own.rank") > F.col("held.rank")
    return rows.select(
        "job_id", F.col("ord").alias("pkg_ord"), "name", _document_label().alias("label"),
        F.col("held.value").alias("left_value"), F.col("own.value").alias("right_value"),
        F.when(wins, F.col("own.value")).otherwise(F.col("held.value")).alias("kept_value"),
        F.when(wins, F.col("own.status")).otherwise(F.col("held.status")).alias("kept_status"),
    )


def segment_conflict_issues(conflicts: DataFrame) -> DataFrame:
    message = F.concat(
        F.col("label"),
        F.lit(" had conflicting segment values "),
        quoted(F.col("left_value")),
        F.lit(" and "),
        quoted(F.col("right_value")),
        F.lit("; kept "),
        quoted(F.col("kept_value")),
        F.lit(" ("),
        F.col("kept_status"),
        F.lit(")."),
    )
    null = F.lit(None).cast("string")
    return conflicts.select(
        "job_id",
        "pkg_ord",
        F.lit(0).cast("bigint").alias("item_ord"),
        F.lit(60).alias("rule_ord"),
        F.lit("CHUNK_MERGE_CONFLICT").alias("code"),
        F.lit("WARNING").alias("severity"),
        message.alias("message"),
        null.alias("case_number"),
        null.alias("field_path"),
    )


# ---- continuation pages --------------------------------------------------


def _continued_key(case: Column | None = None) -> Column:
    return blank_to_null(strip(current_value(F.col("case_number") if case is None else case)))


def _has_value(field: Column) -> Column:
    return ~is_missing(current_value(field))


def merge_continuations(packages: DataFrame, fields) -> DataFrame:
    """Records of one case as one package: the first non-missing value of each field, else the first record's.

    As with segments, the records that give the values are found as ordinals first.
    """
    fields = _columns(fields)
    case = fields.get("case_number", F.col("case_number"))
    rows = packages.withColumn("_case", _continued_key(case))
    cased = rows.filter(F.col("_case").isNotNull())
    merged_fields = {n: c for n, c in fields.items() if n != "case_number"}
    picks = cased.groupBy("job_id", "_case").agg(
        F.min("pkg_ord").alias("_base"),
        F.min(F.when(~is_missing(F.col("dim_unit")), F.col("pkg_ord"))).alias("_unit_at"),
        *[F.min(F.when(_has_value(c), F.col("pkg_ord"))).alias(f"_at_{n}") for n, c in merged_fields.items()],
    )

    def pick(at: Column, value: Column) -> Column:
        return F.first(F.when(F.col("pkg_ord") == at, value), True)

    merged = cased.join(picks, ["job_id", "_case"]).groupBy("job_id", "_case").agg(
        F.max("_base").alias("_home"),
        pick(F.col("_base"), case).alias("case_number"),
        *[pick(F.coalesce(f"_at_{n}", "_base"), c).alias(n) for n, c in merged_fields.items()],
        pick(F.col("_unit_at"), F.col("dim_unit")).alias("dim_unit"),
    )
    columns = ["job_id", "pkg_ord", *fields, "dim_unit"]
    single = rows.filter(F.col("_case").isNull())
    return merged.withColumnRenamed("_home", "pkg_ord").select(*columns).unionByName(
        single.select("job_id", "pkg_ord", *[c.alias(n) for n, c in fields.items()], "dim_unit")
    )


def continuation_targets(packages: DataFrame) -> DataFrame:
    """Which package every record continues: (job_id, pkg_ord, target_ord)."""
    rows = packages.select("job_id", "pkg_ord", _continued_key().alias("_case"))
    homes = (
        rows.filter(F.col("_case").isNotNull())
        .groupBy("job_id", "_case")
        .agg(F.min("pkg_ord").alias("target_ord"))
    )
    cased = rows.join(homes, ["job_id", "_case"]).select("job_id", "pkg_ord", "target_ord")
    alone = rows.filter(F.col("_case").isNull()).select("job_id", "pkg_ord", F.col("pkg_ord").alias("target_ord"))
    return cased.unionByName(alone)


def continuation_merges(packages: DataFrame) -> DataFrame:
    """How many records of a job were merged into an earlier one."""
    return (
        packages.select("job_id", _continued_key().alias("_case"))
        .groupBy("job_id", "_case")
        .agg(F.count("*").alias("_n"))
        .groupBy("job_id")
        .agg(F.sum(F.when(F.col("_case").isNotNull(), F.col("_n") - 1).otherwise(0)).alias("merges"))
    )


def continuation_conflicts(packages: DataFrame, fields: list[str]) -> DataFrame:
    """Later values that differ from the first one of their case, and later dimension units that differ."""
    names = [f for f in fields if f != "case_number"]
    rows = packages.select(
        "job_id",
        "pkg_ord",
        _continued_key().alias("_case"),
        *[F.when(_has_value(F.col(n)), strip(current_value(F.col(n)))).alias(n) for n in names],
        blank_to_null(F.col("dim_unit")).alias("dim_unit"),
    )
    rows = _shared(rows.filter(F.col("_case").isNotNull()), ["job_id", "_case"])
    checked = [*names, "dim_unit"]

    def compared(name: str) -> Column:
        return F.lower(name) if name == "dim_unit" else F.col(name)

    groups = rows.groupBy("job_id", "_case").agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("pkg_ord"))).alias(f"_{n}") for n in checked],
        *[(F.min(compared(n)) != F.max(compared(n))).alias(f"_{n}_differs") for n in checked],
    )
    # of the repeated cases, only those in which something differs meet their records again
    differs = F.lit(False)
    for n in checked:
        differs = differs | F.coalesce(F.col(f"_{n}_differs"), F.lit(False))
    joined = rows.join(groups.filter(differs), ["job_id", "_case"])
    found = []
    for n in checked:
        clash = F.col(n).isNotNull() & (
            (F.lower(n) != F.lower(f"_{n}")) if n == "dim_unit" else (F.col(n) != F.col(f"_{n}"))
        )
        path = "package.dimensions.unit" if n == "dim_unit" else (
            f"package.dimensions.{n}" if n in SIDES else f"package.{n}"
        )
        code = "CONTINUATION_UNIT_CONFLICT" if n == "dim_unit" else "CONTINUATION_FIELD_CONFLICT"
        found.append(
            F.when(
                clash,
                F.struct(
                    F.lit(code).alias("code"),
                    F.lit(path).alias("field_path"),
                    F.col(f"_{n}").alias("left_value"),
                    F.col(n).alias("right_value"),
                ),
            )
        )
    staged = joined.select(
        "job_id",
        "pkg_ord",
        F.col("_case").alias("case_number"),
        F.filter(F.array(*found), lambda c: c.isNotNull()).alias("_found"),
    )
    return staged.select("job_id", "pkg_ord", "case_number", F.inline("_found"))


def continuation_issues(conflicts: DataFrame) -> DataFrame:
    unit = F.col("code") == "CONTINUATION_UNIT_CONFLICT"
    subject = F.when(unit, "the dimension unit").otherwise(F.col("field_path"))
    message = F.concat(
        F.lit("Continuation pages for case "),
        F.col("case_number"),
        F.lit(" disagree on "),
        subject,
        F.lit(": "),
        quoted(F.col("left_value")),
        F.lit(" vs "),
        quoted(F.col("right_value")),
        F.when(unit, ".").otherwise(". The first mapped value was retained."),
    )
    return conflicts.select(
        "job_id",
        "pkg_ord",
        F.lit(0).cast("bigint").alias("item_ord"),
        F.lit(50).alias("rule_ord"),
        "code",
        F.lit("WARNING").alias("severity"),
        message.alias("message"),
        "case_number",
        "field_path",
    )
