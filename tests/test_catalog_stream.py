import json
import random

import pytest
from pyspark.sql import Row, functions as F

from stringloom.operators import catalog, extract
from stringloom.plans import queries
from stringloom.sinks import versions
from stringloom.streaming import catalog_stream

SCHEMA = "path string, content string"


def code(draw):
    words = ["One", "Two", "two", "Three x", "https://no", "4", "Fünf", "Ok"]
    lines = [draw.choice(['Text("{}")', "title: '{}'", '  x = "{}";', "// {}"]).format(draw.choice(words)) for _ in range(draw.randint(0, 6))]
    return "\n" * draw.randint(0, 2) + "\n".join(lines)


def plain(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


class Stream:
    """Files that arrive in batches, and what a batch run over the newest versions gives."""

    def __init__(self, spark, folder, stored=None):
        self.spark, self.folder, self.stored, self.files = spark, str(folder), stored, {}

    def arrive(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.files |= dict(rows)

    def run(self, **options):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        catalog_stream.start_catalog(
            stream, f"{self.folder}/target", f"{self.folder}/ck", self.stored, available_now=True, **options).awaitTermination()

    def check(self):
        rows = [(p, c) for p, c in self.files.items() if c is not None]
        files = self.spark.createDataFrame(rows, SCHEMA)
        expected = extract.unique_strings(extract.occurrences(extract.scan_files(files)))
        target = f"{self.folder}/target"
        assert plain(catalog_stream.read_strings(self.spark, target)) == plain(expected)
        if self.stored is not None:
            assert plain(catalog_stream.read_merged(self.spark, target)) == plain(catalog.smart_merge(expected, self.stored))


@pytest.fixture
def stored(spark):
    rows = [("one", "Uno", {"app_fr": "Un"}, 0), ("gone", "Gone", {}, 1), ("two", "", {"app_fr": "Deux"}, 2)]
    return spark.createDataFrame(rows, "key string, english string, translations map<string,string>, ord int")


def test_edits_deletions_and_restarts_equal_the_batch(spark, tmp_path, stored):
    draw = random.Random(4)
    stream = Stream(spark, tmp_path, stored)
    paths = [f"f{i}.dart" for i in range(9)] + ["x_intl.dart", "notes.txt", "é.dart"]
    for step in range(3):
        for _ in range(2):
            chosen = draw.sample(paths, draw.randint(1, 6))
            stream.arrive([(p, None if draw.random() < 0.2 else code(draw)) for p in chosen])
        stream.run(buckets=2)  # a new query each time: state and target are taken up again
        stream.check()
    assert versions.current(spark, f"{tmp_path}/target").tag == 5


def test_only_changed_keys_come_out(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.arrive([("a.dart", 'Text("One")\nText("Two")'), ("b.dart", 'Text("Two")')])
    stream.run()
    stream.arrive([("a.dart", 'Text("One")\nText("Three")'), ("b.dart", 'Text("Two")')])
    stream.run()
    stream.check()
    assert plain(catalog_stream.read_changed(spark, f"{tmp_path}/target")) == [("three",), ("two",)]
    stream.arrive([("a.dart", None), ("c.dart", None)])
    stream.run()
    stream.check()
    assert plain(catalog_stream.read_strings(spark, f"{tmp_path}/target").select("key", "uses")) == [("two", 1)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, stored):
    target = str(tmp_path / "t")
    columns = "key string, bucket int, first_path string, last_path string, first_pattern int, first_match int, first_line int, " \
              "last_pattern int, last_match int, last_value string, uses bigint"
    change = lambda key, uses: (key, 0, "p", "p", 1, 1, 1, 1, 1, key.upper(), uses)
    first = spark.createDataFrame([change("one", 1), change("new", 2)], columns)
    catalog_stream.apply_changes(first, target, 0, stored)
    version = versions.current(spark, target)
    catalog_stream.apply_changes(spark.createDataFrame([change("one", 0)], columns), target, 0, stored)
    assert versions.current(spark, target) == version
    catalog_stream.apply_changes(spark.createDataFrame([change("one", 0)], columns), target, 1, stored)
    assert plain(catalog_stream.read_strings(spark, target).select("key", "uses")) == [("new", 2)]
    status = {r["key"]: r["status"] for r in catalog_stream.read_merged(spark, target).collect()}
    assert status == {"new": "new", "one": "removed", "two": "removed", "gone": "removed"}


def test_every_file_has_a_row(spark):
    draw = random.Random(8)
    files = spark.createDataFrame([(f"f{i}.dart", code(draw)) for i in range(40)], SCHEMA)
    for rule in ("line", "suffix"):
        found = extract.file_occurrences(files, rule)
        assert found.select("path").distinct().count() == 40
        assert plain(found.where("value is not null")) == plain(extract.occurrences(files, localized_rule=rule))


class Held:
    """A map state, and how often it is called."""

    def __init__(self):
        self.entries, self.calls = {}, 0

    def getMapState(self, name, key, value):
        return self.__dict__.setdefault(f"of_{name}", Held())

    def exists(self):
        self.calls += 1
        return bool(self.entries)

    def getValue(self, key):
        self.calls += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.entries[key]

    def iterator(self):
        return iter([*self.entries.items()])


def said(name, at, value):
    return [name, "1", str(at), str(at), "1", str(at), value, "1"]


def test_calls_to_the_store_are_by_slot(monkeypatch):
    """Edits and deletions of many paths in one group, against all that is held, in few calls."""
    monkeypatch.setattr(catalog_stream, "GROUPS", 1)
    monkeypatch.setattr(catalog_stream, "SLOTS", 8)
    monkeypatch.setattr(catalog_stream, "CHARS", 2_000)
    monkeypatch.setattr(catalog_stream, "ENTRIES", 50)
    draw = random.Random(5)
    files, keys = Held(), Held()
    first, second = catalog_stream.FileChanges(), catalog_stream.KeyStates()
    first.init(files)
    second.init(keys)
    held, states = {}, {}
    for _ in range(6):
        chosen = draw.sample(range(300), 200)
        new = {f"f{i}": {f"k {draw.choice([0, 1, 2, i])}": n for n in range(draw.choice([0, 1, 4]))} for i in chosen}
        rows = [Row(slot=hash(p) % 8, path=p, bucket=len(p) % 2, found=json.dumps([said(k, n, f"{p} {n}") for k, n in ks.items()]))
                for p, ks in new.items()]
        held |= new
        before = [h.calls for h in (files.of_files, keys.of_paths, keys.of_ends)]
        changes = list(first.handleInputRows((0,), iter(rows), None))
        out = [e for r in second.handleInputRows((0,), iter(changes), None) for e in json.loads(r["entries"])]
        after = [h.calls for h in (files.of_files, keys.of_paths, keys.of_ends)]
        # Per slot a call to read and one to write, for each run of entries, besides the question whether there is any.
        runs = -(-sum(len(r["entries"]) for r in changes) // 2_000)
        assert runs > 1 and all(b - a <= 1 + 16 * n for a, b, n in zip(before, after, (1, runs, 1), strict=True))
        states |= {(e[0], e[1]): e[2:] for e in out}
        want = {}
        for path in sorted(held):
            for k, n in held[path].items():
                place = said(k, n, f"{path} {n}")[1:]
                state = want.setdefault((k, str(len(path) % 2)), [path, *place[:3], None, None, None, None, 0])
                state[4:] = path, *place[3:6], state[8] + 1
        assert {k: [*s[:8], int(s[8])] for k, s in states.items() if s[8] != "0"} == want


def test_tables_that_are_folders_arrive(spark, tmp_path):
    part = "p_partkey long, p_name string, p_type string, p_size int, p_brand string"
    spark.createDataFrame([(i, "red ring", "TIN", 3, "B") for i in range(4)], part).coalesce(1).write.parquet(f"{tmp_path}/p")
    (file,) = (tmp_path / "p").glob("*.parquet")
    (tmp_path / "sf").mkdir()
    (tmp_path / "sf" / "part.parquet").write_bytes(file.read_bytes())
    spark.createDataFrame([(1, "<a>")], "page_id long, html string").write.parquet(f"{tmp_path}/sf/pages.parquet")
    docs = spark.createDataFrame([(i, 'Text("One")') for i in range(5)], "doc_id long, text string")
    docs.repartition(2).write.parquet(f"{tmp_path}/sf/documents.parquet")
    paths = []
    stream = queries._arriving(spark, f"{tmp_path}/sf").writeStream.trigger(availableNow=True)
    stream.foreachBatch(lambda batch, _: paths.extend(r["path"].split("/")[0] for r in batch.collect())).start().awaitTermination()
    assert sorted(paths) == ["docs"] * 5 + ["lib"] * 4 + ["web"]
