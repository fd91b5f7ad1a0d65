"""Records are numbered, compared and replaced in few moves, with the same rows."""

import random

from pyspark.sql import functions as F

from cargolens.operators import edits, merge, ordinals

RANK = merge.STATUS_RANK
NAMES = ["order_project", "shipment_hs_code"]



def test_conflicts_over_pieces_equal_a_fold(spark):
    rng = random.Random(5)
    rows = []
    for job in range(6):
        for at in sorted(rng.sample(range(1, 400), 12)) if job else range(1, 13):
            ord_ = 1 if at == 1 else at * ordinals.PIECE_ROWS // 40
            rows.append((job, ord_, ord_, *[x for _ in NAMES for x in (rng.choice([None, "", "a", "b", "c"]), rng.choice(list(RANK)))]))
    rows.append((None, 1, 1, "a", "CONFIRMED", "b", "CONFIRMED"))
    schema = "job_id long, pkg_ord long, segment_no long, " + ", ".join(f"v{i} string, s{i} string" for i in range(len(NAMES)))
    frame = spark.createDataFrame(rows, schema).repartition(3)
    fields = {n: merge.mapped(F.col(f"v{i}"), status=F.col(f"s{i}")) for i, n in enumerate(NAMES)}
    want = set()
    for job in range(6):
        for i, n in enumerate(NAMES):
            held = None
            for r in sorted(r for r in rows if r[0] == job):
                value, status = r[3 + 2 * i], r[4 + 2 * i]
                if not value:
                    continue
                wins = held is None or RANK[status] > RANK[held[1]]
                if held and held[0] != value:
                    kept = (value, status) if wins else held
                    want.add((job, r[1], n, held[0], value, *kept))
                held = (value, status) if wins else held
    got = merge.document_conflicts(frame, fields)
    columns = ["job_id", "pkg_ord", "name", "left_value", "right_value", "kept_value", "kept_status"]
    found = [tuple(r) for r in got.select(*columns).collect()]
    assert want and len(found) == len(want) and set(found) == want
    wide = frame.select("job_id", "pkg_ord", "segment_no", *[c.alias(n) for n, c in fields.items()])
    assert {tuple(r) for r in merge.document_conflicts(wide).select(*columns).collect()} == want


def test_numbers_of_small_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "PIECE_ROWS", 20)
    rows = [(g, n % 7 if n % 5 else None, n) for g in (1, 2, None) for n in range(60 if g == 1 else 9)]
    df = spark.createDataFrame(rows, "g long, p long, n long")
    got = {(r.g, r.n): r.at for r in ordinals.numbered(df, ["g"], {"_p": F.col("p")}, ["n"], "at").collect()}
    want = {}
    for g in (1, 2):
        for i, (p, n) in enumerate(sorted((-1 if p is None else p, n) for k, p, n in rows if k == g), 1):
            if p >= 0:
                want[(g, n)] = i
    assert got == want


def test_small_groups_move_once(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("n"), (F.col("id") % 9).alias("g")).write.parquet(str(tmp_path / "t"))
    df = ordinals.numbered(spark.read.parquet(str(tmp_path / "t")), ["g"], {"_p": F.col("n")}, ["n"], "at")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and plan.index("LeftAnti") > plan.index("Union")


def test_narrow_records_are_replaced(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "job_id long, pkg_ord long, gross_value string")
    new = spark.createDataFrame([(1, 9, "x"), (2, 9, "y")], old.schema)
    places = spark.createDataFrame([(1, 2, 9, None), (2, 1, 9, "no")], "job_id long, pkg_ord long, mapped_ord long, problem string")
    after = edits.replace_packages(old, new, places, ["gross_value"])
    assert {tuple(r) for r in after.collect()} == {(1, 1, "a"), (1, 2, "x"), (2, 1, "c")}
