import os

import pytest

from stringloom.plans import flows, staging
from stringloom.sinks import versions, writers


def strings(spark, *texts):
    rows = [(t.lower().replace(" ", "_").replace("\n", "_"), t, "a.dart", 1, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "key string, value string, first_path string, first_pattern int, first_match int")


def texts_of(spark, target):
    return {r["key"]: r["english"] for r in flows.read_version(spark, target).collect()}


def test_merge_takes_its_stored_side_from_the_current_version(spark, tmp_path):
    target = str(tmp_path / "shop")
    assert flows.read_version(spark, target) is None
    flows.export_strings(strings(spark, "One", "Two\nlines"), None, target)
    assert texts_of(spark, target) == {"one": "One", "two_lines": "Two\nlines"}
    counts = flows.export_strings(strings(spark, "Two\nlines", "Three"), None, target)
    assert tuple(counts.first()) == (1, 0, 2, 3)
    assert texts_of(spark, target) == {"one": "One", "two_lines": "Two\nlines", "three": "Three"}
    flows.export_strings(strings(spark, "Four"), None, target, mode="overwrite")
    assert texts_of(spark, target) == {"four": "Four"}
    assert [v.number for v in versions.history(spark, target)] == [3, 2, 1]
    assert {name: versions.current(spark, target).rows(name) for name in ("csv", "json", "merged")} == {"csv": 1, "json": 1, "merged": 1}


def test_a_run_that_ends_between_csv_and_json(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "shop")
    flows.export_strings(strings(spark, "One"), None, target)
    former = versions.current(spark, target)

    def ended(*args, **options):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(writers, "write_catalog_json", ended)
        with pytest.raises(KeyboardInterrupt):
            flows.export_strings(strings(spark, "Two"), None, target)
    assert versions.current(spark, target) == former and texts_of(spark, target) == {"one": "One"}
    flows.export_strings(strings(spark, "Two"), None, target)
    assert texts_of(spark, target) == {"one": "One", "two": "Two"}
    assert versions.drop_versions(spark, target) == 1  # what the ended run had written
    assert versions.drop_versions(spark, target, keep=1) == 1
    assert texts_of(spark, target) == {"one": "One", "two": "Two"} and len(os.listdir(f"{target}/versions")) == 1


def test_a_reader_keeps_the_version_that_it_began_with(spark, tmp_path):
    target = str(tmp_path / "shop")
    flows.export_strings(strings(spark, "One"), None, target)
    reading = flows.read_version(spark, target)
    flows.export_strings(strings(spark, "Two"), None, target, mode="overwrite")
    assert [r["key"] for r in reading.collect()] == ["one"] and set(texts_of(spark, target)) == {"two"}


def test_two_writers(spark, tmp_path):
    target = str(tmp_path / "t")
    first, second = versions.begin(spark, target), versions.begin(spark, target)
    for draft in (first, second):
        draft.write_table("rows", spark.range(3))
    assert first.commit(tag=7).tag == 7
    with pytest.raises(versions.VersionConflict):
        second.commit()
    assert versions.current(spark, target).number == 1


def test_a_part_that_is_gone_is_an_error(spark, tmp_path):
    target = str(tmp_path / "t")
    draft = versions.begin(spark, target)
    draft.write_table("rows", spark.range(3).coalesce(1))
    version = draft.commit()
    part = version.datasets["rows"]["parts"][0]["name"]
    os.remove(f"{version.path('rows')}/{part}")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, target)


def test_a_moved_target(spark, tmp_path):
    draft = versions.begin(spark, str(tmp_path / "a"))
    draft.write_table("rows", spark.range(3))
    draft.commit()
    os.rename(tmp_path / "a", tmp_path / "b")
    moved = versions.current(spark, str(tmp_path / "b"))
    assert moved.number == 1 and spark.read.parquet(moved.path("rows")).count() == 3


def test_staged_tables_are_deleted_by_their_owner(spark):
    outer = staging.stage(spark.range(2), "kept")
    paths = []
    with pytest.raises(ValueError), staging.owned_tables(spark):
        for _ in range(2):
            paths.append(staging.stage(spark.range(2), "own").inputFiles()[0])
        with staging.owned_tables(spark):
            paths.append(staging.stage(spark.range(2), "inner").inputFiles()[0])
        raise ValueError
    assert outer.count() == 2 and not any(os.path.exists(p.removeprefix("file://")) for p in paths)


def test_an_export_leaves_no_staged_table(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    flows.export_strings(strings(spark, "One"), None, str(tmp_path / "t"))
    flows.export_strings(strings(spark, "Two"), None, str(tmp_path / "t"))
    assert set(os.listdir(folder)) == before
