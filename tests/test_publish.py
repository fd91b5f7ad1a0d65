"""Publishing output: refused, discarded and completed projects, and what readers see after several runs."""

import pytest
from pyspark.sql import functions as F

from cargolens.operators.context import ROW_COLUMNS
from cargolens.sources import publish as P

HEADERS = "project_id long, ref string, value string, numeric boolean"


def _rows(spark, values):
    rows = spark.createDataFrame(values, "project_id long, job_id long, excel_row int, N string, S string")
    return rows.select("project_id", "job_id", "excel_row", *[F.col(c) if c in "NS" else F.lit(None).cast("string").alias(c) for c in ROW_COLUMNS])


def _run(spark, path, values, gates):
    headers = spark.createDataFrame([(p, "E9", "EUR", False) for p, _ in gates], HEADERS)
    blocking = spark.createDataFrame(gates, "project_id long, blocking long")
    return {r.project_id: r for r in P.publish(_rows(spark, values), headers, blocking, str(path)).collect()}


def _seen(spark, path):
    return sorted((r.project_id, r.N, r.S) for r in P.published(spark, str(path)).collect())


def test_runs_release_what_was_read_back(spark, tmp_path):
    assert P.published(spark, str(tmp_path)) is None
    values = [(1, 10, 23, "1.50", "a"), (1, 11, 24, "2", ""), (2, 20, 23, "7", "b"), (3, 30, 23, "inf", "c")]
    got = _run(spark, tmp_path, values, [(1, 0), (2, 1), (3, 0), (4, 0), (5, None)])
    assert {p: r.status for p, r in got.items()} == {1: "completed", 2: "refused", 3: "discarded", 4: "discarded", 5: "refused"}
    cells = 2 * len(ROW_COLUMNS) + 1
    assert (got[1].rows_written, got[1].cells_written, got[1].filled_cells, got[1].mismatches) == (2, cells, 4, 0)
    assert (got[3].refused_cells, got[2].rows_written) == (1, 0)
    assert _seen(spark, tmp_path) == [(1, "1.50", "a"), (1, "2", "")]

    # 1 is blocked now and keeps its output, 2 is free, 3 is not asked for
    got = _run(spark, tmp_path, [(1, 10, 23, "9", "z"), (2, 20, 23, "7", "b"), (3, 30, 23, "8", "c")], [(1, 2), (2, 0)])
    assert {p: r.status for p, r in got.items()} == {1: "refused", 2: "completed", 3: "kept", 4: "kept", 5: "kept"}
    assert _seen(spark, tmp_path) == [(1, "1.50", "a"), (1, "2", ""), (2, "7", "b")]


def test_a_run_that_dies_before_its_rename_changes_nothing(spark, tmp_path, monkeypatch):
    _run(spark, tmp_path, [(1, 10, 23, "1", "a")], [(1, 0)])

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(P, "_commit", dies)
    with pytest.raises(OSError):
        _run(spark, tmp_path, [(1, 10, 23, "2", "b")], [(1, 0)])
    assert _seen(spark, tmp_path) == [(1, "1", "a")]


def test_two_runs_do_not_take_one_number(spark, tmp_path):
    _run(spark, tmp_path, [(1, 10, 23, "1", "a")], [(1, 0)])
    spark.range(1).write.parquet(f"{tmp_path}/staging/other")
    with pytest.raises(RuntimeError):
        P._commit(spark, f"{tmp_path}/staging/other", str(tmp_path), 1)


def test_cells_that_differ_are_named(spark):
    cells = spark.createDataFrame([(1, f"S{i}", "x", False) for i in range(23, 40)] + [(1, "N23", "1.0", True), (1, "T23", "", False)], HEADERS)
    again = spark.createDataFrame([(1, f"S{i}", "y" if i > 25 else "x", False) for i in range(23, 39)] + [(1, "N23", "1", True), (1, "T23", None, False)], HEADERS)
    row = P.cell_outcomes(cells, again).first()
    assert (row.mismatches, row.cells_written, row.refused_cells) == (14, 18, 0)
    assert row.first_mismatches == [f"S{i}" for i in range(26, 36)]
    same = P.cell_outcomes(cells, cells.orderBy(F.desc("ref"))).first()
    assert same.mismatches == 0 and same.fingerprint == P.cell_outcomes(cells, cells).first().fingerprint
