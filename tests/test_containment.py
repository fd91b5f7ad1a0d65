import random

from pyspark.sql import functions as F

from cargolens.functions.text import folded
from cargolens.operators import containment as C
from cargolens.operators import evidence as E


def tier_of(left, right, fold=str):
    if left == right:
        return 0
    if left.startswith(right + ",") or right.startswith(left + ","):
        return 1
    return 2 if fold(left) in fold(right) or fold(right) in fold(left) else None


def names(rng, n):
    stems = ["Page 1", "page 1", "Page 12", "", "P", ",", "Sheet A, row", "Document", "Straße", "a,b,c", "a,b", "a,,"]
    return [rng.choice(stems) + rng.choice(["", "", ", part 2", ",", f", part {rng.randint(1, 9)}, line {rng.randint(1, 9)}"]) for _ in range(n)]


def test_graded_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    left = [(j, x) for j in (1, 2) for x in names(rng, 60)]
    right = [(j, x) for j in (1, 2, 3) for x in names(rng, 25)]
    got = C.graded(
        spark.createDataFrame([*left, (1, None)], "job long, left string"), spark.createDataFrame([*right, (1, None)], "job long, right string"), ["job"], folded
    )
    fold = lambda x: x.lower().replace("ß", "ss")
    want = {(j, a, b, t) for j, a in left for k, b in right if j == k and (t := tier_of(a, b, fold)) is not None}
    rows = [tuple(r) for r in got.select("job", "left", "right", "tier").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_third_of_all_chunks_in_one_job(spark):
    """No join on the job alone: the plan joins on locators, and the answers equal a search of all chunks."""
    rng = random.Random(4)
    chunks = []
    for i in range(3000):
        job = 0 if i % 3 == 0 else i
        chunks.append((job, i % 40, i, rng.choice(["Page", "page", "Sheet B, row"]) + f" {rng.randint(1, 300)}" + rng.choice(["", ", part 1"]), f"text {i}"))
    asked = [(k, 0, rng.choice([f"page {rng.randint(1, 300)}", f"PAGE {rng.randint(1, 300)}, part 1", " sheet b", "ge 17", "none of them"])) for k in range(200)]
    asked += [(500, 0, ""), (501, 0, None), (502, 99999, "page 1")]
    frame = spark.createDataFrame(chunks, "job_id long, document_id long, position long, locator string, text string")
    found = E.find_evidence(frame, spark.createDataFrame(asked, "request_id long, job_id long, locator string"), limit=4)
    want = set()
    for request, job, locator in asked:
        wanted = (locator or "").strip().lower()
        ranked = sorted((t, p, d, x) for j, d, p, loc, x in chunks if wanted and j == job and (t := tier_of(loc.lower(), wanted)) is not None)
        want |= {(request, place, t, p, x) for place, (t, p, _, x) in enumerate(ranked[:4], 1)}
    got = {tuple(r) for r in found.select("request_id", "place", "rank", "position", "text").collect()}
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    joins = [line for line in plan.split("\n") if "Join Inner" in line or "Join LeftSemi" in line]
    assert joins and all(line.count(" = ") + line.count("<=>") > 1 for line in joins if "job_id" in line)


def test_nothing_to_match(spark):
    none = spark.createDataFrame([], "job_id long, document_id long, position long, locator string, text string")
    asked = spark.createDataFrame([(1, 1, "page 1")], "request_id long, job_id long, locator string")
    assert E.find_evidence(none, asked).count() == 0
    assert E.excerpts(none, asked).count() == 0
    some = spark.createDataFrame([(1, 1, 1, None, "x"), (1, 1, 2, "Page 3", "y")], none.schema)
    assert {r.text: r.rank for r in E.find_evidence(some, asked.withColumn("locator", F.lit("page 3, part 1"))).collect()} == {"x": 2, "y": 1}


def test_few_strings_of_a_group_take_no_grams(spark):
    """A request a job is compared as it is: more than FEW of a group still go by grams, with the same pairs."""
    rng = random.Random(6)
    left = [(j, x) for j in range(4) for x in names(rng, 40)]
    right = [(j, x) for j in range(4) for x in names(rng, 30 if j == 0 else 1)]
    frames = spark.createDataFrame(left, "job long, left string"), spark.createDataFrame(right, "job long, right string")
    rows = [tuple(r) for r in C.graded(*frames, ["job"]).select("job", "left", "right", "tier").collect()]
    want = {(j, a, b, t) for j, a in left for k, b in right if j == k and (t := tier_of(a, b)) is not None}
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = C.graded(*frames, ["job"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_deal" in plan
