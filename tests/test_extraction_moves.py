"""Lines find their package and table header in one move, also in a document of several pieces."""

from cargolens.operators import extraction as X
from cargolens.operators.ordinals import PIECE_ROWS, numbered_along

ALIASES = {"Case Number": X.CASE_FIELD, "Net Weight": "package.net_weight", "Item": X.ITEM_START, "Quantity": "item.quantity"}


def lines_of(spark):
    far = PIECE_ROWS * 2 + 5
    rows = [
        (1, 1, "p", "Net Weight: 3 kg"), (1, 2, "p", "Case Number: A"), (1, 3, "p", "Net Weight: 4 kg"),
        (1, 4, "p", "Item | Quantity"), (1, 5, "p", "x | 1"), (1, far, "q", "y | 2"), (1, far + 1, "q", "Net Weight: 5 kg"),
        (1, far + 2, "q", "z | 3"), (1, far + 3, "q", "Case Number: B"), (1, far + 4, "q", "Item: w"), (1, far + 5, "q", "Quantity: 7 PC"),
        (2, 1, "p", "no | table"), (2, 2, "p", "Case Number: C"), (2, 3, "p", None), (None, 1, "p", "Case Number: D"),
    ]
    return spark.createDataFrame(rows, "job_id long, line_no long, locator string, text string").repartition(4), far


def test_items_and_packages_over_pieces(spark):
    lines, far = lines_of(spark)
    packages, items, _ = X.extract_packages(lines, X.alias_table(spark, ALIASES))
    assert {(r.job_id, r.pkg_ord, r.case_number.value) for r in packages.collect()} == {(1, 1, "A"), (1, 2, "B"), (2, 1, "C")}
    got = {(r.job_id, r.pkg_ord, r.item_ord, r.item_number.value, r.quantity.value, r.uom and r.uom.value) for r in items.collect()}
    assert got == {(1, 1, 1, "x", "1", None), (1, 1, 2, "y", "2", None), (1, 2, 1, "w", "7", "PC")}
    values = X.label_values(lines, X.alias_table(spark, ALIASES))
    placed = {(r.job_id, r.line_no): r.pkg_line for r in X.package_lines(values.unionByName(values)).collect()}
    assert placed == {(1, 1): None, (1, 2): 2, (1, 3): 2, (1, far + 1): 2, (1, far + 3): far + 3, (1, far + 4): far + 3, (1, far + 5): far + 3, (2, 2): 2}
    again = X.with_package(values.select("job_id", "line_no"), values)
    assert {(r.job_id, r.line_no): r.pkg_line for r in again.collect()} == placed


def test_numbers_go_on_over_pieces(spark):
    df = spark.createDataFrame([(g, n * PIECE_ROWS // 2) for g in (1, 2) for n in range(1, 6)], "g long, n long")
    got = {(r.g, r.n): r.at for r in numbered_along(df, ["g"], "n", "at").collect()}
    assert got == {(g, n * PIECE_ROWS // 2): n for g in (1, 2) for n in range(1, 6)}


def test_lines_move_once(spark, tmp_path):
    lines, _ = lines_of(spark)
    X.label_values(lines, X.alias_table(spark, ALIASES)).write.parquet(str(tmp_path / "v"))
    values = spark.read.parquet(str(tmp_path / "v"))
    plan = X.package_lines(values)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    # of all lines a single exchange; the others are of lines behind the first piece
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_piece" in x]
    assert len(moved) <= 2
