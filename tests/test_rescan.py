import os
import random

import pytest
from pyspark.sql import functions as F

from stringloom.functions.text import make_key
from stringloom.operators import extract
from stringloom.plans import rescan
from stringloom.sinks import versions
from stringloom.sources import files as sources


def code(draw):
    return "//\n" + "\n".join(draw.choice(['Text("{}")', "title: '{}'", "// {}"]).format(draw.choice(["One", "two", "Drei ü", "4"])) for _ in range(draw.randint(0, 5)))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def full(spark, folder):
    return extract.unique_strings(extract.occurrences(extract.scan_files(sources.read_code_files(spark, folder))))


def test_scans_equal_full_scans_and_read_what_changed(spark, tmp_path, monkeypatch):
    draw, tree, target = random.Random(6), tmp_path / "src", str(tmp_path / "scan")
    for i in range(12):
        (tree / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (tree / f"d{i % 3}/f{i}.dart").write_text(code(draw))
    (tree / "x_intl.dart").write_text('Text("never")')
    (tree / "bad.dart").write_bytes(b'Text("\xff")')
    names = []
    state = rescan._file_states
    monkeypatch.setattr(rescan, "_file_states", lambda files, rule: (names.append({r["path"].rsplit("/", 1)[1] for r in files.select("path").collect()}), state(files, rule))[1])
    rescan.rescan(spark, str(tree), target)
    assert plain(rescan.read_strings(spark, target)) == plain(full(spark, str(tree))) and len(names[0]) == 13
    (tree / "d0/f0.dart").write_text('Text("Changed here")')
    os.remove(tree / "d1/f1.dart")
    (tree / "d1/new [1].dart").write_text('Text("One")\nText("Brand new")')
    os.utime(tree / "d2/f2.dart", (1, 1))  # touched only
    rescan.rescan(spark, str(tree), target)
    assert plain(rescan.read_strings(spark, target)) == plain(full(spark, str(tree)))
    assert {r["path"].rsplit("/", 1)[1]: r["state"] for r in rescan.read_difference(spark, target).collect()} == {
        "f0.dart": "changed", "f1.dart": "gone", "new%20%5B1%5D.dart" if "new%20%5B1%5D.dart" in names[1] else "new [1].dart": "new", "f2.dart": "changed"}
    assert len(names[1]) == 3
    rescan.rescan(spark, str(tree), target)
    assert not names[2] and plain(rescan.read_strings(spark, target)) == plain(full(spark, str(tree)))
    assert [v.number for v in versions.history(spark, target)] == [3, 2, 1]


def test_an_empty_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    rescan.rescan(spark, str(tmp_path / "src"), str(tmp_path / "scan"))
    assert rescan.read_strings(spark, str(tmp_path / "scan")).count() == 0


@pytest.mark.parametrize("most", [0, 100])
def test_reading_by_name_or_from_the_tree(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(rescan, "MOST_PATHS", most)
    for name in ("a.dart", "b.dart", "c.dart"):
        (tmp_path / name).write_text(name)
    listed = rescan.list_files(spark, str(tmp_path))
    read = rescan.read_changed(spark, str(tmp_path))(listed.where("path not like '%b.dart'"))
    assert sorted(bytes(r["data"]) for r in read.collect()) == [b"a.dart", b"c.dart"]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("rule", ["line", "suffix"])
def test_states_are_grouped_inside_the_row_of_a_file(spark, rule):
    draw = random.Random(7)
    rows = [(f"f{i}.dart", code(draw) + draw.choice(["", "\nText('One').tr", "\ntitle: 'One' // .i18n", "\nText(\u00a0'oNE!')\nText('42')"]), f"h{i}") for i in range(40)]
    rows += [("empty.dart", "", "e"), ("noise.dart", "Text('...')", "n"), ("f0.dart", "Text('Another')", "h0b")]
    files = spark.createDataFrame(rows, "path string, content string, hash string")
    states = rescan._file_states(files, rule)
    assert "Exchange" not in states._jdf.queryExecution().executedPlan().toString()
    found = extract.file_occurrences(files.selectExpr("path || '#' || hash as path", "content"), rule)
    want = found.groupBy(F.substring_index("path", "#", 1).alias("path"), F.substring_index("path", "#", -1).alias("hash"), make_key("value").alias("key"))
    want = want.agg(F.max(F.struct("pattern_id", "match_ord", "value")).alias("last"), F.min(F.struct("pattern_id", "match_ord", "line_no")).alias("first"), F.count("value").alias("uses"))
    got = states.selectExpr("path", "hash", "key", "last.pattern_id", "last.match_ord", "last.value", "first.pattern_id", "first.match_ord", "first.line_no", "uses")
    assert plain(got.where("key is not null")) == plain(want.where("key is not null").selectExpr("path", "hash", "key", "last.*", "first.*", "uses"))
    assert plain(states.select("path", "hash").distinct()) == sorted(((p, h) for p, _, h in rows), key=repr)
    none = plain(states.where("key is null").select("path", "hash"))
    assert ("empty.dart", "e") in none and ("noise.dart", "n") in none and not {*none} & {*plain(got.where("key is not null").select("path", "hash"))}
    assert states.where("key is not null and (last.path <> path or first.path <> path)").count() == 0
