"""Validation rules over packages, items and fields, and acknowledged warnings.

Each grain is checked in one pass: a row yields an array of issues, the empty
ones are dropped and the rest become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.hashing import issue_fingerprint
from cargolens.functions.values import (
    DIMENSION_UNITS,
    WEIGHT_UNITS,
    blank_to_null,
    case_text,
    checked_unit,
    current_value,
    field_number,
    is_missing,
    quoted,
    short_number,
    strip,
)
from cargolens.operators.fields import SIDES, Listed, item_path, package_path
from cargolens.operators.ordinals import mark_first

WARNING = "WARNING"
BLOCKING = "BLOCKING"
SEVERITIES = ["INFO", WARNING, BLOCKING]

ISSUE_COLUMNS = ["job_id", "pkg_ord", "item_ord", "rule_ord", "code", "severity", "message", "case_number", "field_path"]


def _issue(rule: int, code: str, severity: str, condition: Column, message: Column, path: Column) -> tuple:
    return code, F.when(
        condition,
        F.struct(
            F.lit(rule).alias("rule_ord"),
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            message.alias("message"),
            path.alias("field_path"),
        ),
    )


def _rows(df: DataFrame, found: list[tuple], codes, keys: list[Column]) -> DataFrame:
    kept = [column for code, column in found if codes is None or code in codes]
    if not kept:
        kept = [column for _, column in found[:1]]
        df = df.filter(F.lit(False))
    names = ["job_id", "pkg_ord", "item_ord", "case_number"]
    # issues not found are dropped as rows: what a function over an array holds is not compiled
    staged = df.select(*keys, F.array(*kept).alias("_found"))
    return staged.select(*names, F.inline("_found")).filter(F.col("code").isNotNull()).select(*ISSUE_COLUMNS)


def missing_package_issues(jobs: DataFrame, packages: DataFrame) -> DataFrame:
    """Jobs from which nothing was mapped."""
    none = F.lit(None)
    mapped = packages.select("job_id").distinct()
    return jobs.join(mapped, "job_id", "left_anti").select(
        "job_id",
        F.lit(0).cast("bigint").alias("pkg_ord"),
        F.lit(0).cast("bigint").alias("item_ord"),
        F.lit(0).alias("rule_ord"),
        F.lit("NO_PACKAGES").alias("code"),
        F.lit(BLOCKING).alias("severity"),
        F.lit("No packages/cases were mapped from the source document.").alias("message"),
        none.cast("string").alias("case_number"),
        none.cast("string").alias("field_path"),
    )


def _weight_rules(found: list, name: str, prefix: str, base: int) -> None:
    field = F.col(name)
    label = prefix.title()
    path = package_path(name)
    unit = F.col(f"_{name}_unit")
    missing = is_missing(current_value(field))
    invalid = ~missing & F.col(f"_{name}").isNull()
    counted = ~missing & F.col(f"_{name}").isNotNull()
    found += [
        _issue(base, f"{prefix}_WEIGHT_MISSING", WARNING, missing, F.lit(f"{label} weight is missing."), path),
        _issue(base + 1, f"{prefix}_WEIGHT_INVALID", BLOCKING, invalid, F.lit(f"{label} weight is not numeric."), path),
        _issue(
            base + 2,
            f"{prefix}_WEIGHT_UNIT_MISSING",
            WARNING,
            counted & (unit == ""),
            F.lit(f"{label} weight has no source/working unit."),
            path,
        ),
        _issue(
            base + 3,
            f"{prefix}_WEIGHT_UNIT_UNKNOWN",
            WARNING,
            counted & (unit != "") & ~unit.isin(WEIGHT_UNITS),
            F.concat(F.lit(f"{label} weight unit "), quoted(unit), F.lit(" is not recognised.")),
            path,
        ),
    ]


def package_issues(packages: DataFrame, codes: set[str] | None = None) -> DataFrame:
    """Case, weight and dimension rules. ``codes`` limits the rules that are run.

    Only the rule on repeated cases looks at other packages, and only keys and
    cases move for it; all others read a package where it stands.
    """
    df = packages.withColumn("_case", case_text(F.col("case_number")))
    names = ["gross_weight", "net_weight", *[s for s in SIDES if s in df.columns]]
    # numbers and units take part in several rules and are worked out once
    units = {f"_{n}_unit": checked_unit(F.col(n), F.col("dim_unit") if n in SIDES else None) for n in names}
    df = df.withColumns({f"_{n}": field_number(F.col(n)) for n in names} | units)

    case, gross, net = F.col("_case"), F.col("_gross_weight"), F.col("_net_weight")
    case_path = package_path("case_number")
    keys = [
        F.col("job_id"),
        F.col("pkg_ord"),
        F.lit(0).cast("bigint").alias("item_ord"),
        case.alias("case_number"),
    ]
    repeats = None
    if codes is None or "CASE_NUMBER_DUPLICATE" in codes:
        named = df.filter(case.isNotNull()).select("job_id", "pkg_ord", "_case")
        uses = mark_first(named, ["job_id", "_case"], ["job_id", "pkg_ord"], "pkg_ord", "_first_use")
        repeated = _issue(
            2,
            "CASE_NUMBER_DUPLICATE",
            BLOCKING,
            ~F.col("_first_use"),
            F.concat(
                F.lit("Case "),
                case,
                F.lit(" appears more than once after mapping. Continuation pages should normally be merged."),
            ),
            case_path,
        )
        repeats = _rows(uses, [repeated], None, keys)
        if codes == {"CASE_NUMBER_DUPLICATE"}:
            return repeats
    found = [
        _issue(
            1,
            "CASE_NUMBER_MISSING",
            BLOCKING,
            case.isNull(),
            F.concat(F.lit("Package "), F.col("pkg_ord").cast("string"), F.lit(" has no case/package identifier.")),
            case_path,
        ),
    ]
    _weight_rules(found, "gross_weight", "GROSS", 3)
    _weight_rules(found, "net_weight", "NET", 7)
    found.append(
        _issue(
            11,
            "GROSS_BELOW_NET",
            WARNING,
            ~F.isnan(gross) & ~F.isnan(net) & (gross < net),
            F.concat(
                F.lit("Gross weight ("),
                short_number(gross),
                F.lit(") is lower than net weight ("),
                short_number(net),
                F.lit(")."),
            ),
            package_path("gross_weight"),
        )
    )
    if "length" in df.columns:
        found += _dimension_rules()
    rows = _rows(df, found, codes, keys)
    return rows if repeats is None else rows.unionByName(repeats)


def _dimension_rules() -> list[tuple]:
    missing = {s: is_missing(current_value(F.col(s))) for s in SIDES}
    present = sum((F.when(missing[s], 0).otherwise(1) for s in SIDES), F.lit(0))
    dims = F.concat(F.lit("packages["), (F.col("pkg_ord") - 1).cast("string"), F.lit("].dimensions"))
    found = [
        _issue(
            12,
            "DIMENSIONS_INCOMPLETE",
            WARNING,
            present.isin(1, 2),
            F.lit("Only part of the L/W/H dimensions were mapped."),
            dims,
        )
    ]
    for i, side in enumerate(SIDES):
        amount = F.col(f"_{side}")
        unit = F.col(f"_{side}_unit")
        label, path, rule = side.title(), package_path(side), 13 + 3 * i
        wrong = ~missing[side] & (amount.isNull() | (amount < 0))
        fine = ~missing[side] & amount.isNotNull() & ~(amount < 0)
        found += [
            _issue(rule, "DIMENSION_INVALID", BLOCKING, wrong, F.lit(f"{label} must be a non-negative number."), path),
            _issue(
                rule + 1,
                "DIMENSION_UNIT_MISSING",
                WARNING,
                fine & (unit == ""),
                F.lit(f"{label} has no source/working dimension unit."),
                path,
            ),
            _issue(
                rule + 2,
                "DIMENSION_UNIT_UNKNOWN",
                WARNING,
                fine & (unit != "") & ~unit.isin(DIMENSION_UNITS),
                F.concat(F.lit(f"{label} unit "), quoted(unit), F.lit(" is not recognised.")),
                path,
            ),
        ]
    return found


def item_issues(items: DataFrame, cases: DataFrame, codes: set[str] | None = None) -> DataFrame:
    """Quantity rules; ``cases`` (job_id, pkg_ord, case_number) names the case of each package."""
    quantity = F.col("quantity")
    has = ~is_missing(current_value(quantity))
    label = F.concat(F.lit("Item "), F.col("item_ord").cast("string"))
    found = [
        _issue(
            30,
            "ITEM_QUANTITY_INVALID",
            WARNING,
            has & field_number(quantity).isNull(),
            F.concat(label, F.lit(" quantity is not numeric.")),
            item_path("quantity"),
        ),
        _issue(
            31,
            "ITEM_UOM_MISSING",
            WARNING,
            has & is_missing(current_value(F.col("uom"))),
            F.concat(label, F.lit(" has a quantity but no unit of measure.")),
            item_path("uom"),
        ),
    ]
    # issues are found where the item stands; only they meet the cases
    keys = [*[F.col(c) for c in ("job_id", "pkg_ord", "item_ord")], F.lit(None).cast("string").alias("case_number")]
    rows = _rows(items, found, codes, keys).drop("case_number")
    named = cases.select("job_id", "pkg_ord", "case_number")
    return rows.join(named, ["job_id", "pkg_ord"], "left").select(*ISSUE_COLUMNS)


def _ambiguous(f: Column) -> Column:
    undecided = f["working"].isNull() | (f["working"]["origin"] == "source")
    return undecided & F.exists(f["source"]["evidence"], lambda e: e["status"] == "AMBIGUOUS")


def _ambiguity_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "job_id",
        F.coalesce("pkg_ord", F.lit(0)).cast("bigint").alias("pkg_ord"),
        F.coalesce("item_ord", F.lit(0)).cast("bigint").alias("item_ord"),
        F.lit(40).alias("rule_ord"),
        F.lit("MAPPING_AMBIGUOUS").alias("code"),
        F.lit(WARNING).alias("severity"),
        F.lit("The source mapper marked this field as ambiguous. Confirm or edit the working value.").alias("message"),
        "case_number",
        F.col("path").alias("field_path"),
    )


def ambiguity_issues(fields: DataFrame) -> DataFrame:
    """Fields the source marked as ambiguous and nobody has decided yet."""
    return _ambiguity_rows(fields.filter(_ambiguous(F.col("field"))))


def ambiguity_record_issues(parts: list[Listed]) -> DataFrame:
    """``ambiguity_issues`` over the fields of narrow records: only the paths found become rows."""
    out = None
    for part in parts:
        paths = F.array(*[F.when(_ambiguous(f), F.struct(part.paths[n].alias("path"))) for n, f in part.fields.items()])
        staged = part.rows.select("job_id", *part.more, paths.alias("_found"))
        found = staged.select("job_id", "pkg_ord", "item_ord", "case_number", F.inline("_found")).filter(F.col("path").isNotNull())
        out = found if out is None else out.unionByName(found)
    return _ambiguity_rows(out)


def package_cases(packages: DataFrame) -> DataFrame:
    return packages.select("job_id", "pkg_ord", case_text(F.col("case_number")).alias("case_number"))


def validate(jobs: DataFrame, packages: DataFrame, items: DataFrame, fields: DataFrame | list[Listed]) -> DataFrame:
    """The whole issue list, rebuilt from the current data; every issue starts unresolved.

    ``fields`` are field rows or, as columns, those of narrow records.
    """
    return (
        missing_package_issues(jobs, packages)
        .unionByName(package_issues(packages))
        .unionByName(item_issues(items, package_cases(packages)))
        .unionByName(ambiguity_issues(fields) if isinstance(fields, DataFrame) else ambiguity_record_issues(fields))
        .withColumn("resolved", F.lit(False))
    )


# ---- acknowledgements ----------------------------------------------------


def with_fingerprint(issues: DataFrame) -> DataFrame:
    return issues.withColumn(
        "fingerprint",
        issue_fingerprint(*[F.col(c) for c in ("code", "severity", "message", "case_number", "field_path")]),
    )


def apply_acknowledgements(issues: DataFrame, acks: DataFrame) -> DataFrame:
    """Resolve the warnings that have an active acknowledgement; nothing else can resolve."""
    active = (
        acks.filter(F.col("status") == "active")
        .select("job_id", "fingerprint", F.lit(True).alias("_acked"))
        .distinct()
    )
    joined = with_fingerprint(issues).join(active, ["job_id", "fingerprint"], "left")
    resolved = F.col("_acked").isNotNull() & (F.col("severity") == WARNING)
    return joined.withColumn("resolved", resolved).drop("_acked")


def acknowledgement_state(actions: DataFrame) -> DataFrame:
    """Latest state per job and fingerprint from ordered acknowledge and revoke actions on warnings.

    The first acknowledgement creates the row, a later one makes it active
    again, a revoke of a known row marks it revoked.
    """
    rows = actions.filter(F.col("severity") == WARNING)
    last = F.struct("action_ord", "action", "actor", "reason")
    state = rows.groupBy("job_id", "fingerprint").agg(
        F.max(last).alias("_last"),
        F.max_by("actor", F.when(F.col("action") == "acknowledge", F.col("action_ord"))).alias("acknowledged_by"),
        F.max_by("reason", F.when(F.col("action") == "acknowledge", F.col("action_ord"))).alias("reason"),
        F.min(F.when(F.col("action") == "acknowledge", F.col("action_ord"))).alias("_created"),
    )
    active = F.col("_last.action") == "acknowledge"
    return state.filter(F.col("_created").isNotNull()).select(
        "job_id",
        "fingerprint",
        F.when(active, "active").otherwise("revoked").alias("status"),
        "acknowledged_by",
        blank_to_null(strip(F.col("reason"))).alias("reason"),
        F.when(~active, F.col("_last.actor")).alias("revoked_by"),
    )


def issue_counts(jobs: DataFrame, issues: DataFrame, include_resolved: bool = False) -> DataFrame:
    """Issues per severity for every job; the three severities are always there."""
    rows = issues if include_resolved else issues.filter(~F.col("resolved"))
    counts = rows.groupBy("job_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    )
    return jobs.select("job_id").join(counts, "job_id", "left").fillna(0, [s.lower() for s in SEVERITIES])


def resolved_warnings(issues: DataFrame) -> DataFrame:
    return issues.groupBy("job_id").agg(
        F.count_if(F.col("resolved") & (F.col("severity") == WARNING)).alias("resolved_warnings")
    )
