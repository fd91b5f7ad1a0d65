import hashlib
from collections import Counter

import pytest

from cargolens.llm import sharding


def plain_table(shards, slots):
    """Turn after turn, each shard walks its own full permutation to its best free slot."""
    walks = []
    for s in shards:
        offset, step = sharding.preferences(s, slots)
        walks.append(iter([(offset + j * step) % slots for j in range(slots)]))
    owner = {}
    while len(owner) < slots:
        for s, walk in zip(shards, walks):
            if len(owner) < slots:
                owner[next(x for x in walk if x not in owner)] = s
    return owner


def test_table_is_the_plain_one_and_even():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    assert [names[k] for k in table] == [plain_table(names, 1009)[i] for i in range(1009)]
    shares = Counter(table.tolist())
    assert max(shares.values()) - min(shares.values()) <= 1


def test_few_slots_move_when_a_shard_leaves():
    names = [f"s{i}" for i in range(10)]
    before, after = sharding.lookup_table(names, 10007), sharding.lookup_table(names[:-1], 10007)
    moved = sum(a != b for a, b in zip(before, after) if b != 9 and a != 9)
    assert moved < 0.15 * 10007


@pytest.mark.parametrize("names, slots", [([], 101), (["a", "a"], 101), (["a"], 100), (["a", "b", "c"], 2)])
def test_bad_tables_are_refused(names, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, slots)


def test_placement(clashing, empty):
    names = ["a", "b", "c"]
    rows = sharding.place(clashing, "doc_id", names, 1009).collect()
    assert len(rows) == clashing.count()
    owner = plain_table(names, 1009)
    for r in rows:
        text = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 1009
        assert (r.slot, r.shard) == (slot, owner[slot])
    assert sharding.place(empty, "doc_id", names, 1009).count() == 0


def test_written_shards_hold_every_row(clashing, tmp_path):
    sharding.write_shards(clashing, "doc_id", ["a", "b"], str(tmp_path / "out"), 101)
    back = clashing.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == clashing.count()
    assert {r.shard for r in back.select("shard").distinct().collect()} <= {"a", "b"}
