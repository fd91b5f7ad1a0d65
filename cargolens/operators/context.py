"""Project, job and case context, fixed output rows, and the project dataset over many jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.values import (
    current_value,
    is_missing,
    length_cm,
    quoted,
    strip,
    volume_m3,
    weight_kg,
)
from cargolens.operators.ordinals import running_total_before

HEADER_FIELDS = [
    "currency", "supplier_name", "pickup_address", "supplier_contact", "supplier_phone_email",
    "preliminary_final", "bu_details", "project_name", "delivery_location", "contact_person_number",
    "other_remarks", "supplier_reference",
]
CASE_FIELDS = [
    "content_description", "equipment_group", "border_crossing_value", "declare_as", "purchase_order",
    "purchase_order_position", "pickup_week_planned", "pickup_week_actual", "storage_requirement",
    "packaging_material", "stackability", "dangerous_goods", "item_designation", "remarks",
]
NUMERIC_CONTEXT = {"border_crossing_value"}

# Output column of each context field, header cell of each header field.
CONTEXT_COLUMNS = {
    "D": "content_description",
    "E": "equipment_group",
    "F": "border_crossing_value",
    "G": "declare_as",
    "H": "purchase_order",
    "I": "purchase_order_position",
    "P": "pickup_week_planned",
    "Q": "pickup_week_actual",
    "R": "storage_requirement",
    "T": "packaging_material",
    "U": "stackability",
    "V": "dangerous_goods",
    "W": "item_designation",
    "X": "remarks",
}
HEADER_CELLS = {
    "E9": "currency",
    "E12": "supplier_name",
    "E13": "pickup_address",
    "E15": "supplier_contact",
    "E16": "supplier_phone_email",
    "E17": "preliminary_final",
    "T6": "bu_details",
    "T8": "contact_person_number",
    "T9": "other_remarks",
    "M10": "supplier_reference",
    "T12": "project_name",
    "T13": "delivery_location",
}
NEEDED_HEADERS = ["E12", "T12", "T13"]
EXPECTED_CONTEXT = [
    "content_description", "equipment_group", "declare_as", "purchase_order", "purchase_order_position",
    "storage_requirement", "packaging_material", "stackability", "dangerous_goods",
]
# Allowed values per field, with the label messages use.
ALLOWED = {
    "declare_as": ("Declare As", ["System", "Loose Parts"]),
    "storage_requirement": ("Storage Requirement", ["Outdoor", "Outdoor covered", "Indoor", "Indoor heated"]),
    "packaging_material": (
        "Packaging Material",
        ["PALLET", "CARTON_BOX", "WOODEN_FRAME", "BUNDLE", "WOODEN_BOX", "DRUM", "UNPACKED"],
    ),
    "stackability": (
        "Stackability",
        ["Stackable 1 tier", "Stackable 2 tier", "Stackable 3 tier", "Not stackable"],
    ),
    "dangerous_goods": ("Dangerous Goods", ["Y", "N"]),
}
FIRST_ROW = 23
ROW_COLUMNS = list("CDEFGHIJKLNOPQRSTUVWX")
NUMERIC_COLUMNS = set("CFJKLNO")


def filled(value: Column, name: str) -> Column:
    """The value, with '' as null; numbers stay as they are."""
    return value if name in NUMERIC_CONTEXT else F.nullif(value, F.lit(""))


def override_with(base: str, override: str, names: list[str]) -> Column:
    """Struct of ``names``: the override where it is filled, else the base."""
    return F.struct(
        *[F.coalesce(filled(F.col(f"{override}.{n}"), n), F.col(f"{base}.{n}")).alias(n) for n in names]
    )


def allowed(name: str, value: Column) -> Column:
    """Whether a context value is in its fixed list; null and '' pass."""
    return is_missing(value) | value.isin(ALLOWED[name][1])


# ---- context resolution --------------------------------------------------


def effective_context(jobs: DataFrame, project_context: DataFrame, job_context: DataFrame) -> DataFrame:
    """Header and defaults of every job: project values, overridden by filled job values."""
    project = project_context.select(
        "project_id", F.col("header").alias("_ph"), F.col("defaults").alias("_pd")
    )
    own = job_context.select("job_id", F.col("header").alias("_jh"), F.col("defaults").alias("_jd"))
    joined = jobs.select("job_id", "project_id").join(project, "project_id", "left").join(own, "job_id", "left")
    return joined.select(
        "job_id",
        "project_id",
        override_with("_ph", "_jh", HEADER_FIELDS).alias("header"),
        override_with("_pd", "_jd", CASE_FIELDS).alias("defaults"),
    )


def effective_overrides(jobs: DataFrame, project_overrides: DataFrame, job_overrides: DataFrame) -> DataFrame:
    """Case overrides of every job: union of both levels, job values win per field."""
    inherited = jobs.select("job_id", "project_id").join(project_overrides, "project_id").select(
        "job_id", "case_number", F.col("override").alias("_p")
    )
    own = job_overrides.select("job_id", "case_number", F.col("override").alias("_j"))
    return inherited.join(own, ["job_id", "case_number"], "full_outer").select(
        "job_id", "case_number", override_with("_p", "_j", CASE_FIELDS).alias("override")
    )


def output_case(field: Column) -> Column:
    value = current_value(field)
    return F.when(~is_missing(value), strip(value))


def with_context(
    packages: DataFrame, jobs: DataFrame, contexts: DataFrame, overrides: DataFrame, scope: str, case_number: Column | None = None
) -> DataFrame:
    """Packages with the defaults and the case override of their scope (job or project) and the job's texts.

    ``jobs`` gives project and order fields; contexts and overrides are keyed by ``scope``.
    ``case_number`` gives the field over narrower rows, whose other fields are made after the joins.
    """
    texts = jobs.select(
        "job_id",
        "project_id",
        output_case(F.col("purchase_order")).alias("_po"),
        output_case(F.col("purchase_order_position")).alias("_po_position"),
    )
    case = F.col("case_number") if case_number is None else case_number
    base = packages.withColumn("case_text", output_case(case)).join(texts, "job_id")
    known = overrides.select(scope, F.col("case_number").alias("case_text"), "override")
    return base.join(known, [scope, "case_text"], "left").join(contexts.select(scope, "defaults"), scope, "left")


def output_rows(rows: DataFrame) -> DataFrame:
    """The fixed output row of every package: columns C to X, their origins, what is missing, row issues."""
    context = {
        n: F.coalesce(filled(F.col(f"override.{n}"), n), F.col(f"defaults.{n}")) for n in CASE_FIELDS
    }
    for name, own in (("purchase_order", "_po"), ("purchase_order_position", "_po_position")):
        context[name] = F.when(
            is_missing(context[name]) & ~is_missing(F.col(own)), F.col(own)
        ).otherwise(context[name])

    sides = {s: length_cm(F.col(s), F.col("dim_unit")) for s in ("length", "width", "height")}
    net, net_origin = weight_kg(F.col("net_weight"))
    gross, gross_origin = weight_kg(F.col("gross_weight"))
    volume, volume_origin = volume_m3(*[v for v, _ in sides.values()])

    columns = {"C": F.lit(1)}
    origins = {"C": F.lit("verified_default")}
    for letter, name in CONTEXT_COLUMNS.items():
        columns[letter] = context[name]
        from_case = F.col("override").isNotNull() & filled(F.col(f"override.{name}"), name).isNotNull()
        origins[letter] = F.when(from_case, "case_override").otherwise("ssd_context")
    for letter, (value, origin) in zip("JKL", sides.values()):
        columns[letter] = value
        origins[letter] = F.coalesce(origin, F.lit("missing"))
    columns |= {"M": volume, "N": net, "O": gross, "S": F.col("case_text")}
    origins |= {
        "M": volume_origin,
        "N": F.coalesce(net_origin, F.lit("missing")),
        "O": F.coalesce(gross_origin, F.lit("missing")),
        "S": F.lit("working_case_number"),
    }

    def empty(name: str) -> Column:
        return context[name].isNull() if name in NUMERIC_CONTEXT else is_missing(context[name])

    missing = [
        F.when(empty(n), F.lit(n)) for n in CONTEXT_COLUMNS.values() if n in EXPECTED_CONTEXT
    ]
    found = []
    for side, (value, origin) in sides.items():
        text = F.concat(F.lit(f"{side.title()}: "), F.replace(origin, F.lit("_"), F.lit(" ")), F.lit("."))
        found.append(F.when(value.isNull() & origin.startswith("unsupported_"), text))
    for value, origin in ((net, net_origin), (gross, gross_origin)):
        text = F.concat(F.replace(origin, F.lit("_"), F.lit(" ")), F.lit("."))
        found.append(F.when(value.isNull() & origin.startswith("unsupported_"), text))
    for name, (label, _) in ALLOWED.items():
        text = F.concat(F.lit(f"{label} value "), quoted(context[name]), F.lit(" is outside the verified SSD list."))
        found.append(F.when(~allowed(name, context[name]), text))

    def present(parts: list[Column]) -> Column:
        return F.filter(F.array(*parts), lambda x: x.isNotNull())

    order = sorted(columns)
    return rows.select(
        "project_id",
        "job_id",
        "pkg_ord",
        F.col("case_text").alias("case_number"),
        *[columns[c].alias(c) for c in order],
        F.create_map(*[x for c in order for x in (F.lit(c), origins[c])]).alias("origins"),
        present(missing).alias("missing_context"),
        present(found).alias("row_issues"),
    )


def job_excel_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("excel_row", F.col("pkg_ord") - 1 + FIRST_ROW)


def header_cells(contexts: DataFrame, jobs: DataFrame, scope: str) -> DataFrame:
    """The 12 header cells; the supplier falls back on the document's own."""
    supplier = jobs.select(scope, output_case(F.col("supplier_name")).alias("_supplier"))
    cells = [
        (F.coalesce(F.nullif("header.supplier_name", F.lit("")), "_supplier") if name == "supplier_name"
         else F.col(f"header.{name}")).alias(cell)
        for cell, name in HEADER_CELLS.items()
    ]
    return contexts.join(supplier, scope, "left").select(scope, *cells)


def missing_headers(cells: DataFrame, scope: str) -> DataFrame:
    """The warning for needed header cells that are empty."""
    lacking = F.filter(
        F.array(*[F.when(is_missing(F.col(c)), F.lit(c)) for c in NEEDED_HEADERS]), lambda x: x.isNotNull()
    )
    text = F.concat(F.lit("SSD project/header context is incomplete: "), F.array_join("_lacking", ", "), F.lit("."))
    return (
        cells.select(scope, lacking.alias("_lacking"))
        .filter(F.size("_lacking") > 0)
        .select(scope, text.alias("message"))
    )


def rows_missing_context(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(F.size("missing_context") > 0).alias("missing_rows"))


def preview_messages(issues: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Warnings and blocking messages of every job's preview: (job_id, level, message)."""
    listed = issues.filter((F.col("severity") == "BLOCKING") | ((F.col("severity") == "WARNING") & ~F.col("resolved")))
    texts = listed.select(
        "job_id",
        F.lower("severity").alias("level"),
        F.concat(F.col("code"), F.lit(": "), F.col("message")).alias("message"),
    )
    heads = missing_headers(cells, "job_id").select("job_id", F.lit("warning").alias("level"), "message")
    open_rows = rows_missing_context(rows, ["job_id"]).filter(F.col("missing_rows") > 0)
    lacking = open_rows.select(
        "job_id",
        F.lit("warning").alias("level"),
        F.concat(
            F.col("missing_rows").cast("string"),
            F.lit(" package row(s) still need SSD-specific project/default values."),
        ).alias("message"),
    )
    return texts.unionByName(heads).unionByName(lacking)


# ---- projects ------------------------------------------------------------


def with_project_index(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Add the row index over the whole project, from 0, in job ordinal and package order.

    Rows are counted per job, the counts are summed along the job ordinals, and
    each row adds its own dense package number: no window ever sees a project.
    """
    counts = rows.groupBy("job_id").agg(F.count("*").alias("_rows"))
    sized = links.join(counts, "job_id", "left").fillna(0, ["_rows"])
    offsets = running_total_before(sized, ["project_id"], "ordinal", "_rows", "_offset")
    joined = rows.join(offsets.select("job_id", "ordinal", "_offset"), "job_id")
    index = F.col("_offset") + F.col("pkg_ord") - 1
    return (
        joined.withColumn("row_index", index).withColumn("excel_row", index + FIRST_ROW).drop("_offset")
    )


def repeated_cases(rows: DataFrame) -> DataFrame:
    """Cases used again in a later row of their project, with the job that used them first.

    Rows are reduced to (project, case, job) before anything is compared; one
    message stands for all repeats of a case in a job.
    """
    uses = (
        rows.filter(~is_missing(F.col("case_number")))
        .groupBy("project_id", "case_number", "job_id")
        .agg(F.min("row_index").alias("_at"), F.count("*").alias("_uses"))
    )
    firsts = uses.groupBy("project_id", "case_number").agg(F.min_by("job_id", "_at").alias("first_job"))
    again = uses.join(firsts, ["project_id", "case_number"]).filter(
        (F.col("job_id") != F.col("first_job")) | (F.col("_uses") > 1)
    )
    text = F.concat(
        F.lit("Case "),
        F.col("case_number"),
        F.lit(" appears in more than one attached job (jobs "),
        F.col("first_job").cast("string"),
        F.lit(" and "),
        F.col("job_id").cast("string"),
        F.lit(")."),
    )
    return again.select("project_id", "job_id", "case_number", "first_job", F.col("_at").alias("at"), text.alias("message"))


def project_messages(messages: DataFrame, jobs: DataFrame, links: DataFrame, repeats: DataFrame) -> DataFrame:
    """Messages of all attached jobs with the job title in front, each text once, with where it comes first."""
    titled = messages.join(jobs.select("job_id", "title"), "job_id").join(links, "job_id")
    own = titled.select(
        "project_id",
        "level",
        F.concat(F.col("title"), F.lit(": "), F.col("message")).alias("message"),
        F.col("ordinal").alias("_ord"),
    )
    again = repeats.join(links.select("job_id", "ordinal"), "job_id").select(
        "project_id", F.lit("blocking").alias("level"), "message", F.col("ordinal").alias("_ord")
    )
    return (
        own.unionByName(again)
        .groupBy("project_id", "level", "message")
        .agg(F.min("_ord").alias("first_job_ordinal"))
    )


def empty_projects(projects: DataFrame, links: DataFrame) -> DataFrame:
    """Projects without a mapped job get one blocking message."""
    attached = links.select("project_id").distinct()
    return projects.select("project_id").join(attached, "project_id", "left_anti").select(
        "project_id",
        F.lit("blocking").alias("level"),
        F.lit("No mapped packing-list jobs are attached to this SSD project.").alias("message"),
    )


def project_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Packages, volume and weights, per key and over all."""
    return rows.rollup(*keys).agg(
        F.count("*").alias("packages"),
        F.round(F.sum("M"), 3).alias("volume_m3"),
        F.round(F.sum("N"), 3).alias("net_kg"),
        F.round(F.sum("O"), 3).alias("gross_kg"),
    )


def release_gates(
    projects: DataFrame, rows: DataFrame, messages: DataFrame, template_ready: bool, approvals: list[bool]
) -> DataFrame:
    """Whether a project may be built for checking and for production."""
    counted = rows.groupBy("project_id").agg(F.count("*").alias("rows"))
    noted = messages.groupBy("project_id").agg(
        F.count_if(F.col("level") == "blocking").alias("blocking"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
    )
    joined = (
        projects.select("project_id")
        .join(counted, "project_id", "left")
        .join(noted, "project_id", "left")
        .fillna(0, ["rows", "blocking", "warnings"])
    )
    ready = (F.col("rows") > 0) & (F.col("blocking") == 0) & (F.col("warnings") == 0) & F.lit(template_ready)
    return joined.select(
        "project_id",
        "rows",
        "blocking",
        "warnings",
        ready.alias("validation_ready"),
        (ready & F.lit(all(approvals))).alias("production_ready"),
    )


def rows_per_job(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Output rows of every attached job; a job without rows counts 0."""
    counts = rows.groupBy("job_id").agg(F.count("*").alias("rows"))
    return links.select("project_id", "job_id").join(counts, "job_id", "left").fillna(0, ["rows"])


def rows_needing_attention(rows: DataFrame) -> DataFrame:
    return rows.filter((F.size("missing_context") > 0) | (F.size("row_issues") > 0))


def row_cells(rows: DataFrame) -> DataFrame:
    """Output rows as cells (ref, value, numeric). M is left out: it is a formula in the output."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).cast("string").alias("value"),
                F.lit(c in NUMERIC_COLUMNS).alias("numeric"),
            )
            for c in ROW_COLUMNS
        ]
    )
    flat = rows.select("project_id", "excel_row", F.inline(cells))
    ref = F.concat(F.col("column"), F.col("excel_row").cast("string"))
    return flat.select("project_id", ref.alias("ref"), "value", "numeric")


def header_cell_rows(cells: DataFrame) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("ref"), F.col(c).alias("value")) for c in HEADER_CELLS])
    flat = cells.select("project_id", F.inline(entries))
    return flat.select("project_id", "ref", "value", F.lit(False).alias("numeric"))


def label_rows(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """What a package label shows: project header beside the row's own values."""
    head = cells.select(
        "project_id",
        F.col("T12").alias("project_name"),
        F.col("T13").alias("delivery_location"),
        F.col("E12").alias("supplier_name"),
    )
    return rows.join(head, "project_id").select(
        "project_id",
        "job_id",
        "pkg_ord",
        "project_name",
        "delivery_location",
        "supplier_name",
        F.col("H").alias("purchase_order"),
        F.col("I").alias("position"),
        F.col("R").alias("storage"),
        F.col("E").alias("equipment_group"),
        F.col("D").alias("description"),
        F.col("N").alias("net_kg"),
        F.col("O").alias("gross_kg"),
        F.col("J").alias("length_cm"),
        F.col("K").alias("width_cm"),
        F.col("L").alias("height_cm"),
        F.col("S").alias("case_number"),
    )


# ---- changes of context --------------------------------------------------


def latest(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of the old row (order 0) and all changes of a key, the last one stands."""
    both = base.withColumn(order, F.lit(0).cast("bigint")).unionByName(changes)
    rest = [c for c in both.columns if c not in (*keys, order)]
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def is_empty_override(name: str = "override") -> Column:
    filled_any = [filled(F.col(f"{name}.{n}"), n).isNotNull() for n in CASE_FIELDS]
    out = F.lit(False)
    for c in filled_any:
        out = out | c
    return ~out


def set_case_overrides(overrides: DataFrame, changes: DataFrame, cases: DataFrame) -> DataFrame:
    """Overrides after changes: the case must exist in the job, an all-empty change removes the override."""
    known = changes.join(cases.select("job_id", "case_number").distinct(), ["job_id", "case_number"], "left_semi")
    return latest(overrides, known, ["job_id", "case_number"], "change_ord").filter(~is_empty_override())


def promote_to_all(
    contexts: DataFrame, overrides: DataFrame, submitted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Submitted case values become the job's defaults and leave every override; emptied overrides go.

    ``submitted`` has one struct ``values`` per job; a filled field counts as submitted.
    """
    values = submitted.select("job_id", F.col("values").alias("_new"))
    defaults = contexts.join(values, "job_id", "left").select(
        "job_id", "header", override_with("defaults", "_new", CASE_FIELDS).alias("defaults")
    )
    cleared = F.struct(
        *[
            F.when(filled(F.col(f"_new.{n}"), n).isNull(), F.col(f"override.{n}")).alias(n)
            for n in CASE_FIELDS
        ]
    )
    kept = (
        overrides.join(values, "job_id", "left")
        .select("job_id", "case_number", cleared.alias("override"))
        .filter(~is_empty_override())
    )
    return defaults, kept


def inherit_project(job_contexts: DataFrame) -> DataFrame:
    """Job header and defaults cleared, so that the project's apply again."""
    blank = [
        F.struct(
            *[F.lit(None).cast("double" if n in NUMERIC_CONTEXT else "string").alias(n) for n in names]
        ).alias(part)
        for part, names in (("header", HEADER_FIELDS), ("defaults", CASE_FIELDS))
    ]
    return job_contexts.select("job_id", *blank)


def attach_jobs(links: DataFrame, requests: DataFrame, mapped_jobs: DataFrame) -> DataFrame:
    """Links after requests to attach: mapped jobs only, one project per job, ordinals go on from the last.

    Of several requests for a job the first counts.
    """
    free = (
        requests.join(mapped_jobs.select("job_id").distinct(), "job_id", "left_semi")
        .join(links.select("job_id"), "job_id", "left_anti")
        .groupBy("job_id")
        .agg(F.min_by(F.struct("project_id", "request_ord"), "request_ord").alias("_r"))
        .select("job_id", "_r.project_id", "_r.request_ord")
    )
    from cargolens.operators.ordinals import numbered, piece_of

    ranked = numbered(free, ["project_id"], {"_piece": piece_of(F.col("request_ord"))}, ["request_ord"], "_rank")
    ends = links.groupBy("project_id").agg(F.max("ordinal").alias("_last"))
    added = ranked.join(ends, "project_id", "left").select(
        "project_id", "job_id", (F.coalesce("_last", F.lit(-1)) + F.col("_rank")).alias("ordinal")
    )
    return links.select("project_id", "job_id", "ordinal").unionByName(added)


def detach_jobs(links: DataFrame, requests: DataFrame) -> DataFrame:
    """Links without those asked to go, by project and job; the others keep their ordinals."""
    return links.join(requests.select("project_id", "job_id").distinct(), ["project_id", "job_id"], "left_anti")


def unattached_jobs(mapped_jobs: DataFrame, links: DataFrame) -> DataFrame:
    return mapped_jobs.join(links.select("job_id").distinct(), "job_id", "left_anti")
