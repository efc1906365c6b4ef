"""The driver's entry points."""

import __spark_entry__ as entry


def test_names_and_smoke(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).count() >= 0


def test_missing_modules_are_not_there(tmp_path, monkeypatch):
    (tmp_path / "leftover").mkdir()
    monkeypatch.syspath_prepend(str(tmp_path))
    assert not entry._there("leftover") and not entry._there("no_such_module") and entry._there("quern.scratch")
