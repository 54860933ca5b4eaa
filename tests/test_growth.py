"""Queries whose files grow with their tables."""

import pytest

from raremill.plans import catalog


def rows(spark, folder, name):
    return sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect()))


@pytest.mark.parametrize("name,made", [("numbered_lenient_scan", "lines"), ("numbered_table", "events")])
def test_no_task_sorts_more_than_a_file(spark, folder, tmp_path, monkeypatch, name, made):
    want = rows(spark, folder, name)
    monkeypatch.setattr(catalog, "_run_folder", lambda _: str(tmp_path / "run"))
    monkeypatch.setattr(catalog, "_FILE_ROWS", 100, raising=False)
    assert rows(spark, folder, name) == want
    assert len(list((tmp_path / "run" / made).glob("part-*"))) == 10


def test_copied_tables_are_compressed(spark, folder, tmp_path, monkeypatch):
    want = rows(spark, folder, "copied_run_sizes")
    monkeypatch.setattr(catalog, "_run_folder", lambda _: str(tmp_path / "run"))
    assert rows(spark, folder, "copied_run_sizes") == want
    made = [p.name for p in (tmp_path / "run").rglob("part-*")]
    assert made and all(name.endswith(".gz") for name in made)
