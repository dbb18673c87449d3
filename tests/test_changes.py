"""Merge, update, delete and the changes between versions, against the same steps on lists."""

import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from tablework.operators import changes as CH
from tablework.operators import tables as TB

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def keyed(spark, name):
    TB.create_keyed_table(spark, name, SCHEMA, "k", history=True)
    TB.upsert(frame(spark, [(i, "old") for i in range(12)] + [(3, "twin"), (4, "old")]), name)
    return name


def content(spark, table):
    return Counter(tuple(r) for r in TB.keyed_rows(spark, table).collect())


def changes(spark, table, after, upto=None):
    return Counter(tuple(r) for r in CH.changes_between(spark, table, after, upto).collect())


def test_merge_updates_deletes_and_inserts(spark, keyed):
    source = frame(spark, [(1, "x"), (2, "kill"), (3, "y"), (4, "skip"), (50, "new"), (51, "kill")])
    got = CH.merge_rows(
        source,
        keyed,
        update={"v": "concat(t.v, s.v)"},
        update_when="s.v <> 'skip' AND t.v <> 'twin'",
        delete_when="s.v = 'kill'",
        insert_when="s.v = 'new'",
    )
    assert got == CH.Merged(updated=2, deleted=1, inserted=1, version=CH.version_of(spark, keyed))
    want = Counter([(i, "old") for i in range(12) if i not in (1, 2, 3)])
    want += Counter([(4, "old"), (3, "twin"), (1, "oldx"), (3, "oldy"), (50, "new")])
    assert content(spark, keyed) == want
    assert changes(spark, keyed, 1) == Counter(
        [
            (1, "old", "before"),
            (1, "oldx", "after"),
            (2, "old", "removed"),
            (3, "old", "before"),
            (3, "oldy", "after"),
            (50, "new", "added"),
        ]
    )


def test_delete_one_of_several_rows_then_all(spark, keyed):
    assert CH.delete_rows(spark, keyed, "v = 'twin'").deleted == 1
    assert content(spark, keyed) == Counter([(i, "old") for i in range(12)] + [(4, "old")])
    assert changes(spark, keyed, 1) == Counter([(3, "twin", "before")])
    assert CH.delete_rows(spark, keyed).deleted == 13
    assert content(spark, keyed) == Counter()
    assert CH.delete_rows(spark, keyed).deleted == 0
    TB.upsert(frame(spark, [(3, "back")]), keyed)
    assert content(spark, keyed) == Counter([(3, "back")])


def test_update_and_what_is_undone(spark, keyed):
    assert CH.update_rows(spark, keyed, {"v": "'new'"}, "k < 2").updated == 2
    first = CH.version_of(spark, keyed)
    assert CH.update_rows(spark, keyed, {"v": "'old'"}, "k = 0").updated == 1
    assert changes(spark, keyed, 1) == Counter([(1, "old", "before"), (1, "new", "after")])
    assert changes(spark, keyed, first) == Counter([(0, "new", "before"), (0, "old", "after")])
    assert changes(spark, keyed, first, first) == Counter()


def test_random_steps_with_compaction(spark, name):
    """Every version is read again and every pair of versions compared after some steps of all kinds."""
    rng = random.Random(5)
    TB.create_keyed_table(spark, name, SCHEMA, "k", history=True)
    rows, known = {}, {0: {}}
    for step in range(7):
        picked = {k: f"s{step}" for k in rng.sample(range(12), 4)}
        kind = ("upsert", "merge", "delete", "merge", "upsert", "delete", "merge")[step]
        if kind == "upsert":
            TB.upsert(frame(spark, list(picked.items())), name)
            rows = rows | picked
        elif kind == "delete":
            limit = rng.randrange(3, 8)
            CH.delete_rows(spark, name, f"k < {limit}")
            rows = {k: v for k, v in rows.items() if k >= limit}
        else:
            CH.merge_rows(frame(spark, list(picked.items())), name, update={"v": "s.v"}, delete_when="s.k % 2 = 0")
            rows = {k: v for k, v in rows.items() if k not in picked or k % 2} | {
                k: v for k, v in picked.items() if k % 2 or k not in rows
            }
        known[CH.version_of(spark, name)] = rows
        assert content(spark, name) == Counter(rows.items())
    assert TB._state(spark, name).compacted
    for version, want in known.items():
        assert Counter(tuple(r) for r in CH.rows_at(spark, name, version).collect()) == Counter(want.items())
    for after, upto in ((0, max(known)), (1, max(known)), sorted(known)[2:5:2]):
        old, new = known[after], known[upto]
        want = Counter()
        for k in old.keys() | new.keys():
            if old.get(k) != new.get(k):
                if k in old:
                    want[(k, old[k], "before" if k in new else "removed")] += 1
                if k in new:
                    want[(k, new[k], "after" if k in old else "added")] += 1
        assert changes(spark, name, after, upto) == want


def test_forgotten_versions_cannot_be_read(spark, keyed):
    CH.update_rows(spark, keyed, {"v": "'a'"})
    last = CH.version_of(spark, keyed)
    before = content(spark, keyed)
    TB.forget(spark, keyed, last)
    assert content(spark, keyed) == before
    with pytest.raises(LookupError):
        CH.rows_at(spark, keyed, 1)
    with pytest.raises(ValueError):
        TB.forget(spark, keyed, last + 1)


def test_rows_without_key(spark, keyed):
    with pytest.raises(ValueError, match="have no k"):
        CH.merge_rows(frame(spark, [(None, "n")]), keyed, update={"v": "s.v"})
    assert CH.merge_rows(frame(spark, [(None, "n"), (None, "m")]), keyed, null_keys="keep").inserted == 2
    assert changes(spark, keyed, 1) == Counter([(None, "n", "added"), (None, "m", "added")])
    with pytest.raises(ValueError, match="without k"):
        CH.delete_rows(spark, keyed)
    assert CH.delete_rows(spark, keyed, "k >= 0").deleted == 14
    assert content(spark, keyed) == Counter([(None, "n"), (None, "m")])


def test_errors_leave_the_table_as_it_is(spark, keyed):
    before = content(spark, keyed)
    for rows, options, match in (
        ([(1, "a"), (1, "b")], {}, "several rows"),
        ([(1, "a")], {"update": {"k": "9"}}, "cannot update"),
        ([(1, "a")], {"update": {"x": "9"}}, "cannot update"),
        ([(77, "a")], {"insert": {"x": "9"}}, "no columns"),
    ):
        with pytest.raises(ValueError, match=match):
            CH.merge_rows(frame(spark, rows), keyed, **options)
    with pytest.raises(ValueError, match="do not fit"):
        CH.merge_rows(spark.sql("SELECT 1.5D AS k, 'a' AS v"), keyed)
    assert content(spark, keyed) == before


def test_a_change_that_fails_before_its_commit_leaves_nothing(spark, keyed, monkeypatch):
    before = content(spark, keyed)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(TB, "_commit", broken)
        with pytest.raises(RuntimeError):
            CH.delete_rows(spark, keyed, "k < 6")
    assert content(spark, keyed) == before
    TB.upsert(frame(spark, [(30, "new")]), keyed)
    assert content(spark, keyed) == before + Counter([(30, "new")])


def test_empty_table_and_empty_source(spark, name, keyed):
    empty = name + "b"
    TB.create_keyed_table(spark, empty, SCHEMA, "k")
    assert CH.merge_rows(frame(spark, []), empty) == CH.Merged(0, 0, 0, 0)
    assert CH.delete_rows(spark, empty) == CH.Merged(0, 0, 0, 0)
    assert CH.merge_rows(frame(spark, [(1, "a")]), empty, update={"v": "s.v"}).inserted == 1
    assert content(spark, empty) == Counter([(1, "a")])
    assert CH.merge_rows(frame(spark, []), keyed).version == 1
