"""Working data as base fields plus ordered edit rows: set, revert, propose, reprocess.

The state after all edits follows from the last revert and the last settings
after it, so it is one aggregate per field and no row-by-row replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.values import (
    FIELD,
    NUMERIC_FIELDS,
    blank_to_null,
    coerced,
    current_kind,
    current_value,
    leaf_name,
    path_allowed,
    same_value,
    strip,
)
from cargolens.operators.chunking import carried_all
from cargolens.operators.fields import Listed, record_of
from cargolens.session import written

SET, REVERT, REVERT_PACKAGE, REVERT_JOB = "set", "revert", "revert_package", "revert_job"


def package_of(path: Column) -> Column:
    """The package part of a path, null for order and shipment fields."""
    return F.when(path.startswith("packages["), F.regexp_extract(path, r"^(packages\[[0-9]+\])", 1))


def _existing_kind(field: Column) -> Column:
    value = current_value(field)
    return F.when(value.isNotNull(), current_kind(field)).otherwise(field["source"]["value_kind"])


def checked_edits(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Field-level edits with their coerced value, its kind, and why they cannot be applied."""
    known = fields.select("job_id", "path", _existing_kind(F.col("field")).alias("_kind"), F.lit(True).alias("_known"))
    rows = edits.filter(F.col("op").isin(SET, REVERT)).join(known, ["job_id", "path"], "left")
    value, kind, problem = coerced(F.col("path"), F.col("_kind"), F.col("value"))
    error = (
        F.when(~path_allowed(F.col("path")), "path not allowed")
        .when(F.col("_known").isNull(), "no field at this path")
        .when(F.col("op") == SET, problem)
    )
    return rows.withColumns({"new_value": value, "new_kind": kind, "error": error}).drop("_kind", "_known")


def apply_edits(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Fields after all sound edits. The source side never changes.

    A revert of a package or a job means something to fields that were set or
    had been changed before; only those meet it. All other fields meet nothing
    but the edits of their own path, in one join.
    """
    sound = checked_edits(fields, edits).filter(F.col("error").isNull())
    is_set = F.col("op") == SET
    change = F.struct("edit_ord", "new_value", "new_kind", "actor", "reason")
    per_field = sound.groupBy("job_id", "path").agg(
        F.max(F.when(is_set, change)).alias("_set"),
        F.max(F.when(is_set & F.col("unit").isNotNull(), F.struct("edit_ord", "unit"))).alias("_unit"),
        F.max(F.when(F.col("op") == REVERT, F.col("edit_ord"))).alias("_field_revert"),
    )
    per_package = (
        edits.filter(F.col("op") == REVERT_PACKAGE)
        .groupBy("job_id", F.col("path").alias("_package"))
        .agg(F.max("edit_ord").alias("_package_revert"))
    )
    per_job = (
        edits.filter(F.col("op") == REVERT_JOB).groupBy("job_id").agg(F.max("edit_ord").alias("_job_revert"))
    )
    f = F.col("field")
    as_read = ~f["modified"] & f["working"].isNotNull()

    def with_reverts(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("_package", package_of(F.col("path")))
            .join(per_package, ["job_id", "_package"], "left")
            .join(per_job, "job_id", "left")
            .drop("_package")
        )

    own = fields.filter(as_read).join(with_reverts(per_field), ["job_id", "path"], "left")
    changed = with_reverts(fields.filter(~F.coalesce(as_read, F.lit(False))).join(per_field, ["job_id", "path"], "left"))
    return _settled(own.unionByName(changed), [c for c in fields.columns if c != "field"])


# The kinds by which a number field reads a new value differently; all others read as "float".
READ_AS = ("float", "int", "bool")


def _edits_by_record(edits: DataFrame) -> DataFrame:
    """Per record (job_id, _record): for each edited path what its last settings and revert are, by the kind they are read as."""
    rows = edits.filter(F.col("op").isin(SET, REVERT) & path_allowed(F.col("path")))
    is_set = F.col("op") == SET
    numeric = leaf_name(F.col("path")).isin(NUMERIC_FIELDS)
    picks = [F.max(F.when(F.col("op") == REVERT, F.col("edit_ord"))).alias("back")]
    for read_as in READ_AS:
        value, kind, problem = coerced(F.col("path"), F.lit(read_as), F.col("value"))
        sound = is_set & problem.isNull()
        if read_as != "float":
            sound = sound & numeric
        change = F.struct("edit_ord", value.alias("new_value"), kind.alias("new_kind"), "actor", "reason")
        picks.append(F.max(F.when(sound, change)).alias(f"set_{read_as}"))
        picks.append(F.max(F.when(sound & F.col("unit").isNotNull(), F.struct("edit_ord", "unit"))).alias(f"unit_{read_as}"))
    per_path = rows.groupBy("job_id", "path").agg(*picks)
    one = F.struct(*[c for c in per_path.columns if c != "job_id"])
    return per_path.groupBy("job_id", record_of(F.col("path")).alias("_record")).agg(F.collect_list(one).alias("_edits"))


def apply_record_edits(parts: list[Listed], edits: DataFrame) -> DataFrame:
    """``apply_edits`` over the fields of narrow records: they move once, and fields are made where their edits are.

    A record meets the folded edits of all its paths in one row.
    """
    per_record = _edits_by_record(edits)
    per_package = (
        edits.filter(F.col("op") == REVERT_PACKAGE)
        .groupBy("job_id", F.col("path").alias("_package"))
        .agg(F.max("edit_ord").alias("_package_revert"))
    )
    per_job = (
        edits.filter(F.col("op") == REVERT_JOB).groupBy("job_id").agg(F.max("edit_ord").alias("_job_revert"))
    )

    def with_reverts(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("_package", package_of(F.col("_record")))
            .join(per_package, ["job_id", "_package"], "left")
            .join(per_job, "job_id", "left")
            .drop("_package")
        )

    def own_edit(path: Column) -> Column:
        return F.get(F.filter("_edits", lambda e: e["path"] == path), F.lit(0)).alias("_edit")

    out = None
    for part in parts:
        rows = part.rows.withColumn("_record", part.record)
        untouched = F.lit(True)
        for f in part.fields.values():
            untouched = untouched & F.coalesce(~f["modified"] & f["working"].isNotNull(), F.lit(False))
        own = rows.filter(untouched).join(with_reverts(per_record), ["job_id", "_record"], "left")
        changed = with_reverts(rows.filter(~untouched).join(per_record, ["job_id", "_record"], "left"))
        joined = own.unionByName(changed)
        listed = part.field_rows(joined, F.col("_package_revert"), F.col("_job_revert"), beside=own_edit)
        out = listed if out is None else out.unionByName(listed)
    f = F.col("field")
    keep = [c for c in out.columns if c not in ("field", "_edit", "_package_revert", "_job_revert")]
    kind = F.when(leaf_name(F.col("path")).isin(NUMERIC_FIELDS), _existing_kind(f))

    def read(what: str) -> Column:
        by_kind = F.when(kind == "bool", F.col(f"_edit.{what}_bool")).when(kind == "int", F.col(f"_edit.{what}_int"))
        return by_kind.otherwise(F.col(f"_edit.{what}_float"))

    met = out.withColumns({"_set": read("set"), "_unit": read("unit"), "_field_revert": F.col("_edit.back")})
    # a field as it was read, without a sound edit of its own, meets no revert
    as_read = F.coalesce(~f["modified"] & f["working"].isNotNull(), F.lit(False))
    meets = ~as_read | F.col("_set").isNotNull() | F.col("_field_revert").isNotNull()
    for name in ("_package_revert", "_job_revert"):
        met = met.withColumn(name, F.when(meets, F.col(name)))
    return _settled(met, keep)


def _settled(joined: DataFrame, keep: list[str]) -> DataFrame:
    """Fields after their last settings (_set, _unit) and reverts of the field, its package and its job."""
    f = F.col("field")
    joined = joined.withColumn("_back", F.greatest("_field_revert", "_package_revert", "_job_revert"))
    reverted = F.col("_back")
    since = F.coalesce(reverted, F.lit(-1))
    base_unit = F.when(reverted.isNotNull() | f["working"].isNull(), f["source"]["unit"]).otherwise(f["working"]["unit"])
    unit = F.when(F.coalesce(F.col("_unit.edit_ord") > since, F.lit(False)), F.col("_unit.unit")).otherwise(base_unit)
    joined = joined.withColumns({"_touched": F.coalesce(F.col("_set.edit_ord") > since, F.lit(False)), "_now_unit": unit})
    touched, unit = F.col("_touched"), F.col("_now_unit")
    value, kind = F.col("_set.new_value"), F.col("_set.new_kind")
    same = same_value(
        value, kind, f["source"]["value"], F.coalesce(f["source"]["value_kind"], F.lit("null"))
    ) & unit.eqNullSafe(f["source"]["unit"])
    joined = joined.withColumn("_same", same)
    same = F.col("_same")

    def working(value, kind, unit, origin, actor, reason) -> Column:
        return F.struct(
            value.alias("value"),
            kind.alias("value_kind"),
            unit.alias("unit"),
            origin.alias("origin"),
            actor.alias("modified_by"),
            reason.alias("reason"),
        )

    null = F.lit(None).cast("string")
    edited = working(
        value,
        kind,
        unit,
        F.when(same, "source").otherwise("user_edit"),
        F.when(~same, F.col("_set.actor")),
        F.when(~same, blank_to_null(strip(F.col("_set.reason")))),
    )
    restored = working(
        f["source"]["value"], f["source"]["value_kind"], f["source"]["unit"], F.lit("source"), null, null
    )
    new_working = F.when(touched, edited).when(reverted.isNotNull(), restored).otherwise(f["working"])
    modified = F.when(touched, ~same).when(reverted.isNotNull(), False).otherwise(f["modified"])
    field = F.struct(
        f["source"].alias("source"),
        new_working.alias("working"),
        modified.alias("modified"),
        f["required"].alias("required"),
    )
    return joined.select(*keep, field.alias("field"))


def reverted_counts(fields: DataFrame, reverts: DataFrame) -> DataFrame:
    """How many changed fields a package or job revert resets, per revert."""
    changed = fields.filter(F.col("field.modified")).select("job_id", package_of(F.col("path")).alias("_package"))
    per_package = changed.groupBy("job_id", "_package").agg(F.count("*").alias("_n"))
    per_job = per_package.groupBy("job_id").agg(F.sum("_n").alias("_all"))
    return (
        reverts.join(per_package.withColumnRenamed("_package", "path"), ["job_id", "path"], "left")
        .join(per_job, "job_id", "left")
        .select(
            "job_id",
            "op",
            "path",
            F.coalesce(F.when(F.col("op") == REVERT_JOB, F.col("_all")).otherwise(F.col("_n")), F.lit(0)).alias("changed"),
        )
    )


def job_status(fields: DataFrame) -> DataFrame:
    """'edited' when any field is changed, else 'mapped'; the sales order follows its working value."""
    sales = F.when(F.col("path") == "order.sales_order", current_value(F.col("field")))
    return fields.groupBy("job_id").agg(
        F.when(F.bool_or("field.modified"), "edited").otherwise("mapped").alias("status"),
        F.max(sales).alias("sales_order"),
    )


def _met(part: Listed, rows: DataFrame) -> DataFrame:
    """``rows`` (job_id, _record, _row with a path) with kind, values and units of the field of each known path; narrow records move."""
    met = rows.join(part.rows.withColumn("_record", part.record), ["job_id", "_record"])
    listed = F.array(
        *[F.struct(part.paths[n].alias("_at"), _existing_kind(f).alias("_kind"), *_base(f)) for n, f in part.fields.items()]
    )
    here = F.filter(listed, lambda field: field["_at"] == F.col("_row.path"))
    return met.select("job_id", "_record", "_row", F.inline(here)).drop("_at")


def _sound_edits(part: Listed, rows: DataFrame) -> DataFrame:
    """The edits in _row that can be applied, with new_value and new_kind beside."""
    e = F.col("_row")
    value, kind, problem = coerced(e["path"], F.col("_kind"), e["value"])
    sound = path_allowed(e["path"]) & ((e["op"] == REVERT) | ((e["op"] == SET) & problem.isNull()))
    return _met(part, rows).filter(sound).select("job_id", "_record", "_row", value.alias("new_value"), kind.alias("new_kind"))


def _edit_rows(edits: DataFrame) -> DataFrame:
    rows = edits.filter(F.col("op").isin(SET, REVERT))
    one = F.struct(*[c for c in edits.columns if c != "job_id"])
    return rows.select("job_id", record_of(F.col("path")).alias("_record"), one.alias("_row"))


def record_change_log(parts: list[Listed], edits: DataFrame) -> DataFrame:
    """``change_log`` over the fields of narrow records: edits meet records, no table of all fields moves."""
    rows, out = _edit_rows(edits), None
    for part in parts:
        own = rows.filter(part.own(F.col("_record")))
        sound = _sound_edits(part, own).select("job_id", "_record", F.struct("_row.*", "new_value", "new_kind").alias("_row"))
        met = _met(part, sound).drop("_kind").select("job_id", "_row.*", "_value", "_unit", "_source_value", "_source_unit")
        out = met if out is None else out.unionByName(met)
    return _logged(out)


def _base(f: Column) -> list[Column]:
    return [
        current_value(f).alias("_value"),
        F.when(f["working"].isNotNull(), f["working"]["unit"]).otherwise(f["source"]["unit"]).alias("_unit"),
        f["source"]["value"].alias("_source_value"),
        f["source"]["unit"].alias("_source_unit"),
    ]


def change_log(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Before and after value and unit of every sound field edit, in order."""
    base = fields.select("job_id", "path", *_base(F.col("field")))
    return _logged(checked_edits(fields, edits).filter(F.col("error").isNull()).join(base, ["job_id", "path"]))


def _logged(rows: DataFrame) -> DataFrame:
    is_set = F.col("op") == SET
    rows = rows.withColumn(
        "_now", F.struct(F.when(is_set, F.col("new_value")).otherwise(F.col("_source_value")).alias("v"))
    ).withColumn(
        "_now_unit",
        F.when(~is_set, F.struct(F.col("_source_unit").alias("u"))).when(
            F.col("unit").isNotNull(), F.struct(F.col("unit").alias("u"))
        ),
    )
    before = {"_now": "_before", "_now_unit": "_before_unit"}
    rows = carried_all(
        rows.select("job_id", "edit_ord", "path", "op", "_value", "_unit", *before), ["job_id", "path"], "edit_ord", before, inclusive=False, dense=False
    )
    before_unit = F.when(F.col("_before_unit").isNotNull(), F.col("_before_unit.u")).otherwise(F.col("_unit"))
    return rows.select(
        "job_id",
        "edit_ord",
        "path",
        "op",
        F.when(F.col("_before").isNotNull(), F.col("_before.v")).otherwise(F.col("_value")).alias("before_value"),
        before_unit.alias("before_unit"),
        F.col("_now.v").alias("after_value"),
        F.when(F.col("_now_unit").isNotNull(), F.col("_now_unit.u")).otherwise(before_unit).alias("after_unit"),
    )


# ---- proposals -----------------------------------------------------------


def checked_proposals(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """Proposed changes that can be applied: sound paths and values, the first per path of a proposal.

    A change that fails does not take its path from a later one.
    """
    return _first_changes(checked_edits(fields, _usable(changes)).filter(F.col("error").isNull()))


def checked_record_proposals(parts: list[Listed], changes: DataFrame) -> DataFrame:
    """``checked_proposals`` over the fields of narrow records."""
    rows, out = _edit_rows(_usable(changes)), None
    for part in parts:
        sound = _sound_edits(part, rows.filter(part.own(F.col("_record")))).select("job_id", "_row.*", "new_value", "new_kind")
        out = sound if out is None else out.unionByName(sound)
    return _first_changes(out)


def _usable(changes: DataFrame) -> DataFrame:
    path = strip(F.coalesce(F.col("path"), F.lit("")))
    usable = ~((path == "") | F.contains(path, F.lit(".source")) | F.contains(path, F.lit(".working")) | path.startswith("_"))
    return changes.withColumn("path", path).filter(usable).withColumn("op", F.lit(SET))


def _first_changes(sound: DataFrame) -> DataFrame:
    picked = sound.groupBy("job_id", "proposal_id", "path").agg(
        F.min_by(F.struct("change_ord", "new_value", "new_kind", "unit", "reason"), "change_ord").alias("_c")
    )
    return picked.select("job_id", "proposal_id", "path", "_c.*")


def proposal_decisions(fields: DataFrame, proposals: DataFrame, changes: DataFrame) -> DataFrame:
    """Which pending proposals apply, decided one after the other in the order of their ids: all changes must be sound.

    A change is read by the kind of the value it replaces, and what earlier
    changes leave decides that kind: once one has emptied a field, the kind of
    its source counts again, and stays. So the whole state that matters of a
    path is the first proposal that emptied it. Verdicts start from the fields
    as they are and are worked out again from the proposals that apply until
    they stay; the first proposals of a job are right in the first round, the
    next ones in the next, and there is no loop over rows.
    """
    f = F.col("field")
    known = fields.select("job_id", "path", _existing_kind(f).alias("_now"), f["source"]["value_kind"].alias("_source"), F.lit(True).alias("_known"))
    open_ = proposals.filter(F.col("status") == "pending").select("proposal_id")
    rows = changes.join(open_, "proposal_id", "left_semi").join(known, ["job_id", "path"], "left")
    lost = F.when(~path_allowed(F.col("path")) | F.col("_known").isNull(), F.lit(True))
    refused = {name: F.coalesce(lost, coerced(F.col("path"), F.col(kind), F.col("value"))[2].isNotNull()) for name, kind in (("now", "_now"), ("source", "_source"))}
    empties = blank_to_null(strip(F.col("value"))).isNull()
    rows = rows.select("job_id", "proposal_id", "change_ord", "path", empties.alias("empties"), *[e.alias(name) for name, e in refused.items()])
    own = rows.filter("empties").groupBy("job_id", "proposal_id", "path").agg(F.min("change_ord").alias("own"))
    rows = rows.join(own, ["job_id", "proposal_id", "path"], "left")
    rows = written(rows.withColumn("now", F.when(F.col("own") < F.col("change_ord"), F.col("source")).otherwise(F.col("now"))), "proposal-changes")

    emptied, seen = rows.filter(F.lit(False)).select("job_id", "path", F.col("proposal_id").alias("first")), None
    while True:
        refusal = F.when(F.col("first") < F.col("proposal_id"), F.col("source")).otherwise(F.col("now"))
        sound = rows.join(emptied, ["job_id", "path"], "left").groupBy("proposal_id").agg((~F.bool_or(refusal)).alias("_sound")).filter("_sound")
        sound = written(sound, "sound-proposals")
        state = sound.agg(F.count("*"), F.sum(F.xxhash64("proposal_id").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        emptied = rows.filter("empties").join(sound, "proposal_id", "left_semi").groupBy("job_id", "path").agg(F.min("proposal_id").alias("first"))

    pending = F.col("status") == "pending"
    counts = changes.groupBy("proposal_id").agg(F.count("*").alias("changes"))
    return proposals.join(counts, "proposal_id", "left").join(sound, "proposal_id", "left").select(
        "proposal_id",
        "job_id",
        F.coalesce("changes", F.lit(0)).alias("changes"),
        F.when(pending & F.col("_sound").isNotNull(), "applied").otherwise(F.col("status")).alias("status"),
        F.when(~pending, F.concat(F.lit("Proposal is already "), F.col("status"), F.lit(".")))
        .when(F.col("_sound").isNull(), "A proposed change can not be applied.")
        .alias("problem"),
    )


def apply_proposals(fields: DataFrame, decisions: DataFrame, changes: DataFrame, actor: str) -> DataFrame:
    """Fields with the changes of all proposals decided as applied, in the order of proposals and of their changes.

    Of a path only the last change shows, on what the ones before left of it:
    their last unit, and nothing where one of them had emptied the field.
    """
    taken = changes.join(decisions.filter(F.col("status") == "applied").select("proposal_id"), "proposal_id", "left_semi")
    taken = taken.withColumn("_at", F.struct("proposal_id", "change_ord"))
    last = taken.groupBy("job_id", "path").agg(F.max("_at").alias("_last"))
    taken = taken.join(last, ["job_id", "path"])
    empties = blank_to_null(strip(F.col("value"))).isNull()
    before = (
        taken.filter(F.col("_at") < F.col("_last"))
        .groupBy("job_id", "path")
        .agg(
            F.bool_or(empties).alias("_emptied"),
            F.max_by("value", "_at").alias("_value"),
            F.max(F.when(F.col("unit").isNotNull(), F.struct("_at", "unit")))["unit"].alias("unit"),
            F.max_by("reason", "_at").alias("reason"),
        )
        .withColumn("value", F.when(~F.col("_emptied"), F.col("_value")))
    )

    def edits(rows: DataFrame) -> DataFrame:
        return rows.select("job_id", F.lit(1).cast("long").alias("edit_ord"), F.lit(SET).alias("op"), "path", "value", "unit", F.lit(actor).alias("actor"), "reason")

    return apply_edits(apply_edits(fields, edits(before)), edits(taken.filter(F.col("_at") == F.col("_last"))))


def rejected(proposals: DataFrame) -> DataFrame:
    return proposals.withColumn(
        "status", F.when(F.col("status") == "pending", "rejected").otherwise(F.col("status"))
    )


# ---- mapping again -------------------------------------------------------


def package_replacements(
    packages: DataFrame, changed: DataFrame, remapped: DataFrame, requests: DataFrame
) -> DataFrame:
    """For each request (job_id, pkg_ord, discard): the newly mapped package that takes its place, or why not.

    ``packages`` and ``remapped`` have (job_id, pkg_ord, case_number); in
    ``remapped`` the job is the request's own. The new package is the one of
    the same case, else the only one.
    """
    edited = changed.filter(F.col("modified")).select("job_id", "pkg_ord", F.lit(True).alias("_edited"))
    case = F.col("case_number")
    same = (
        remapped.filter(case.isNotNull())
        .groupBy("job_id", "case_number")
        .agg(F.min("pkg_ord").alias("_same"))
    )
    alone = (
        remapped.groupBy("job_id")
        .agg(F.count("*").alias("_n"), F.min("pkg_ord").alias("_only"))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )
    rows = (
        requests.join(packages.select("job_id", "pkg_ord", "case_number"), ["job_id", "pkg_ord"])
        .join(edited, ["job_id", "pkg_ord"], "left")
        .join(same, ["job_id", "case_number"], "left")
        .join(alone, "job_id", "left")
    )
    locked = F.col("_edited").isNotNull() & ~F.col("discard")
    target = F.coalesce("_same", "_only")
    return rows.select(
        "job_id",
        "pkg_ord",
        "case_number",
        F.when(~locked, target).alias("mapped_ord"),
        F.when(locked, "case was edited by hand")
        .when(target.isNull(), "new mapping has no single match")
        .alias("problem"),
    )


def replace_packages(packages: DataFrame, remapped: DataFrame, replacements: DataFrame, names: list[str]) -> DataFrame:
    """Packages with the replaced ones taken from the new mapping, at their old place."""
    done = replacements.filter(F.col("problem").isNull()).select("job_id", "pkg_ord", "mapped_ord")
    new = remapped.withColumnRenamed("pkg_ord", "mapped_ord").join(done, ["job_id", "mapped_ord"])
    columns = ["job_id", "pkg_ord", *names]
    kept = packages.join(done.select("job_id", "pkg_ord"), ["job_id", "pkg_ord"], "left_anti")
    return kept.select(*columns).unionByName(new.select(*columns))


def replace_fields(fields: DataFrame, remapped: DataFrame, replacements: DataFrame, requests: DataFrame) -> DataFrame:
    """Single fields taken again from the new mapping: source and working side, unmodified.

    ``requests`` names (job_id, pkg_ord, path); the package index in the path
    is moved to the matched package.
    """
    done = (
        requests.join(replacements.filter(F.col("problem").isNull()), ["job_id", "pkg_ord"])
        .withColumn(
            "_mapped_path",
            F.concat(
                F.lit("packages["),
                (F.col("mapped_ord") - 1).cast("string"),
                F.lit("]"),
                F.regexp_replace("path", r"^packages\[[0-9]+\]", ""),
            ),
        )
        .select("job_id", "path", "_mapped_path")
    )
    new = remapped.select("job_id", F.col("path").alias("_mapped_path"), F.col("field").alias("_new"))
    taken = done.join(new, ["job_id", "_mapped_path"]).select(
        "job_id", "path", F.col("_new").withField("modified", F.lit(False)).alias("_new")
    )
    joined = fields.join(taken, ["job_id", "path"], "left")
    return joined.withColumn("field", F.coalesce("_new", "field")).drop("_new")


def jobs_with_changes(fields: DataFrame) -> DataFrame:
    """Jobs whose working data differs from their source: mapping them again needs a confirmation."""
    f = F.col("field")
    differs = f["modified"] | (
        f["working"].isNotNull()
        & (
            ~f["working"]["value"].eqNullSafe(f["source"]["value"])
            | ~f["working"]["unit"].eqNullSafe(f["source"]["unit"])
        )
    )
    return fields.groupBy("job_id").agg(F.bool_or(differs).alias("needs_confirmation"))
