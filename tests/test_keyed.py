"""The keyed table: versions, stopped and competing writers, and what a write touches."""

import pytest

from quern.sources.keyed import Conflict, KeyedTable

SCHEMA = "id bigint, content string, owner string, v int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(table, version=None):
    return {r.id: (r.content, r.owner) for r in table.read(version).collect()}


def test_versions_and_touched_buckets(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", "id", SCHEMA, buckets=8)
    assert t.read().count() == 0 and t.upsert(rows(spark), ["content"], "v") == 0
    assert t.upsert(rows(spark, *[(i, "a", "x", 1) for i in range(100)], (None, "null", "n", 1)), ["content"], "v") == 1
    assert t.upsert(rows(spark, (5, "b", "y", 1), (5, "c", "z", 2), (500, "new", "w", 1)), ["content"], "v") == 2
    assert content(t)[5] == ("c", "x") and content(t)[500] == ("new", "w") and content(t)[None] == ("null", "n") and len(content(t)) == 102
    assert content(t, 1)[5] == ("a", "x") and 500 not in content(t, 1)
    one, two = (t.manifest(v)["buckets"] for v in (1, 2))
    assert 1 <= sum(one[b] != two[b] for b in one) <= 2
    assert t.upsert(rows(spark, (5, "d", "y", 1)), ["content"], "v") == 3
    assert t.vacuum(keep=1) >= 1 and content(t)[5] == ("d", "x") and len(content(t)) == 102 and t.versions() == [3]


def test_a_stopped_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"{tmp_path}/t", "id", SCHEMA, buckets=4)
    t.upsert(rows(spark, (1, "a", "x", 1)), ["content"], "v")

    def stopped(*args):
        raise KeyboardInterrupt

    for step in ("commit", "manifest"):
        with monkeypatch.context() as m:
            m.setattr(t, step, stopped)
            with pytest.raises(KeyboardInterrupt):
                t.upsert(rows(spark, (1, "b", "x", 2)), ["content"], "v")
        assert content(t) == {1: ("a", "x")}
    # stopped between draft and rename
    class Broken:
        def rename(self, *args):
            raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(t, "_context", Broken())
        with pytest.raises(KeyboardInterrupt):
            t.upsert(rows(spark, (1, "b", "x", 2)), ["content"], "v")
    assert content(t) == {1: ("a", "x")} and t.versions() == [1]
    t.upsert(rows(spark, (1, "b", "x", 2)), ["content"], "v")
    assert content(t) == {1: ("b", "x")}


def test_two_writers_commit_one_after_the_other(spark, tmp_path, monkeypatch):
    a, b = (KeyedTable(spark, f"{tmp_path}/t", "id", SCHEMA, buckets=1) for _ in range(2))
    a.upsert(rows(spark, (1, "a", "x", 1)), ["content"], "v")
    commit, calls = a.commit, []

    def late(version, buckets):
        if not calls:
            b.upsert(rows(spark, (2, "b", "y", 1)), ["content"], "v")  # overtakes
        calls.append(version)
        return commit(version, buckets)

    monkeypatch.setattr(a, "commit", late)
    assert a.upsert(rows(spark, (3, "c", "z", 1)), ["content"], "v") == 3 and calls == [2, 3]
    assert content(a) == content(b) == {1: ("a", "x"), 2: ("b", "y"), 3: ("c", "z")}
    with pytest.raises(Conflict):
        commit(3, {})
    # a rename onto a version that came meanwhile fails, too
    draft = a._at("drafts", "x")
    a._files.create(draft, True).close()
    with pytest.raises(Exception):
        a._context.rename(draft, a._at("manifests", f"{3:020d}.json"), a._no_overwrite)
