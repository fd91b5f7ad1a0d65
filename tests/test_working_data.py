"""Rules, edits, acknowledgements and the registry on small inputs."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cargolens.functions.values import lift
from cargolens.operators import edits, fields, queries, rules

SMALL = "/root/testdata/sf0.001"


def packages(spark, rows):
    df = spark.createDataFrame(rows, "job_id long, pkg_ord long, c string, g string, gu string, n string, nu string")
    return df.select(
        "job_id", "pkg_ord", F.lit("CM").alias("dim_unit"),
        lift(F.col("c")).alias("case_number"),
        lift(F.col("g"), F.col("gu")).alias("gross_weight"),
        lift(F.col("n"), F.col("nu")).alias("net_weight"),
    )


def test_unit_aware_filter(spark):
    df = packages(spark, [(1, 1, "C-1", "1600", "KG", "1", "KG"), (1, 2, "C-2", "1200", "KG", "1", "KG"), (1, 3, "C-3", "4000", "LB", "1", "LB"), (1, 4, None, "x", "KG", "1", "KG")])
    got = {r.pkg_ord: r.outcome for r in queries.classify_packages(df, "gross_weight", "gt", 1500, "kg").collect()}
    assert got == {1: "match", 2: "no_match", 3: "skipped_unit", 4: "missing"}
    lines = queries.match_lines(queries.filter_packages(df, "gross_weight", "gt", 1500, "KG")).collect()
    assert [r.line for r in lines] == ["C-1 (1600 KG)"]


def test_case_and_weight_rules(spark):
    df = packages(
        spark,
        [(1, 1, "A", " ", "KG", "", "KG"), (1, 2, " A ", "5", "", "7", "stone"), (1, 3, None, "nan", "KG", "1", "KG")],
    )
    got = {(r.pkg_ord, r.code) for r in rules.package_issues(df).collect()}
    assert got == {
        (1, "GROSS_WEIGHT_INVALID"), (1, "NET_WEIGHT_MISSING"), (2, "CASE_NUMBER_DUPLICATE"),
        (2, "GROSS_WEIGHT_UNIT_MISSING"), (2, "NET_WEIGHT_UNIT_UNKNOWN"), (2, "GROSS_BELOW_NET"),
        (3, "CASE_NUMBER_MISSING"),
    }


def test_one_job_with_a_third_of_all_records(spark):
    """A hot job is cut into pieces; its later uses of a case are still found once each."""
    rows = [(0, n, "A" if n % 2 else f"B{n}", "1", "KG", "1", "KG") for n in range(1, 401)]
    rows += [(j, 1, "A", "1", "KG", "1", "KG") for j in range(1, 801)]
    found = rules.package_issues(packages(spark, rows), {"CASE_NUMBER_DUPLICATE"})
    assert {(r.job_id, r.pkg_ord) for r in found.collect()} == {(0, n) for n in range(3, 401, 2)}


def test_edits_fold_in_order(spark):
    base = fields.package_fields_long(packages(spark, [(1, 1, "A", "10", "KG", "3", "KG")]), ["gross_weight", "net_weight"])
    path, other = "packages[0].gross_weight", "packages[0].net_weight"
    rows = [
        (1, 1, "set", path, "12", "LB"), (1, 2, "revert_package", "packages[0]", None, None),
        (1, 3, "set", path, "14", None), (1, 4, "set", path, "bad", "G"), (1, 5, "set", other, "4", "G"),
        (1, 6, "revert", other, None, None), (1, 7, "set", "packages[9].net_weight", "1", None),
    ]
    df = spark.createDataFrame(rows, "job_id long, edit_ord long, op string, path string, value string, unit string")
    df = df.withColumns({"actor": F.lit("me"), "reason": F.lit(" ")})
    got = {
        r.path: (r.field.working.value, r.field.working.unit, r.field.modified, r.field.working.modified_by, r.field.source.value)
        for r in edits.apply_edits(base, df).collect()
    }
    assert got == {path: ("14", "KG", True, "me", "10"), other: ("3", "KG", False, None, "3")}
    errors = {r.edit_ord: r.error for r in edits.checked_edits(base, df).collect() if r.error}
    assert set(errors) == {4, 7}


def test_proposals_apply_one_after_the_other(spark):
    """Against a turn by turn application: kinds follow what earlier proposals left."""
    import random

    rng = random.Random(5)
    paths = ["packages[0].gross_weight", "packages[0].net_weight"]
    base = fields.package_fields_long(packages(spark, [(j, 1, "A", "10", "KG", "3", "KG") for j in range(40)]), ["gross_weight", "net_weight"])
    # read as whole numbers, later edited as numbers, or the other way round
    f = F.col("field")
    kinds = F.when(F.col("job_id") % 2 == 0, F.array(F.lit("int"), F.lit("float"))).otherwise(F.array(F.lit("float"), F.lit("int")))
    working = F.struct(f["source"]["value"].alias("value"), kinds[1].alias("value_kind"), f["source"]["unit"].alias("unit"), F.lit("user_edit").alias("origin"), F.lit("x").alias("modified_by"), F.lit(None).cast("string").alias("reason"))
    base = base.withColumn("field", F.struct(f["source"].withField("value_kind", kinds[0]).alias("source"), working.alias("working"), F.lit(True).alias("modified"), f["required"].alias("required")))
    changes, proposals = [], []
    for j in range(40):
        for k in range(rng.randint(1, 6)):
            proposals.append((100 * j + k, j, rng.choice(["pending", "pending", "pending", "rejected"])))
            changes += [(100 * j + k, j, c, rng.choice([*paths, paths[0]]), rng.choice(["12", "1.5", " ", "7", "2.25", "oops"][: 5 + (k == 3)]), rng.choice([None, None, "LB"]), "r") for c in range(rng.randint(0, 3))]
    state, status = {}, {}
    for p, j, now in sorted(proposals):
        before = dict(state)
        own = sorted(c for c in changes if c[0] == p)
        sound = bool(own)
        for _, _, _, path, value, unit, _ in own:
            source, first = ("int", "float") if j % 2 == 0 else ("float", "int")
            text, kind, held = state.get((j, path), ("10", first, "KG"))
            kind = kind if text is not None else source
            new = value.strip() or None
            sound &= new is None or new != "oops" and (kind != "int" or "." not in new)
            state[j, path] = (new, kind, unit or held)
        status[p] = "applied" if now == "pending" and sound else now
        if status[p] != "applied":
            state = before
    changed = spark.createDataFrame(changes, "proposal_id long, job_id long, change_ord long, path string, value string, unit string, reason string")
    decided = edits.proposal_decisions(base, spark.createDataFrame(proposals, "proposal_id long, job_id long, status string"), changed)
    assert {r.proposal_id: r.status for r in decided.collect()} == status
    after = {(r.job_id, r.path): (r.field.working.value, r.field.working.unit) for r in edits.apply_proposals(base, decided, changed, "user").collect()}
    assert {k: after[k] for k in state} == {k: (v, unit) for k, (v, _, unit) in state.items()} and len(set(status.values())) == 3


def test_acknowledging_again_makes_active(spark):
    rows = [(1, "f", "WARNING", 1, "acknowledge", "a", ""), (1, "f", "WARNING", 2, "revoke", "b", None), (1, "f", "WARNING", 3, "acknowledge", "c", "ok"), (1, "g", "BLOCKING", 1, "acknowledge", "a", "")]
    df = spark.createDataFrame(rows, "job_id long, fingerprint string, severity string, action_ord int, action string, actor string, reason string")
    got = [tuple(r) for r in rules.acknowledgement_state(df).collect()]
    assert got == [(1, "f", "active", "c", "ok", None)]


def test_registry_and_entry(spark):
    names = entry.queries()
    assert len(names) >= 190 and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["q3_sum_by_unit", "v12_gross_below_net", "m2_segment_merge", "w5_project_row_index", "c1_chunks", "l3_last_progress"])
def test_against_sql(spark, name):
    from check_oracle import connect, rows_of

    df = entry.queries()[name](spark, SMALL)
    cursor = connect(SMALL).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())
