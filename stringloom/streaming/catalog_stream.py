"""A catalog that is kept up to date by the changes of arriving files alone.

Two stateful operators turn versions of files into changes of strings. The first holds, per path, what
its last version said of each key, and passes on the keys that differ. The second holds, per key, what
each path says of it, and gives out the key's new state. Keys are cut into ``BUCKETS`` by path, so that
a key that stands in a great part of all files has several states, which merge like those of a scan.

A call from Python to the state store costs far more than the entry that it brings, and so does a group. So both
operators hash paths and keys into ``GROUPS`` groups, whose state has ``SLOTS`` texts of JSON with the entries of
many paths or keys, and rows between them carry many entries. A batch makes at most two calls per slot that it touches.

A batch's changes are applied to the former version of the target under the batch's number, so a batch
that runs again changes nothing, and no batch reads what older ones brought.
"""

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.catalog import smart_merge
from ..operators.extract import finish_states, merge_states, packed_states, scannable
from ..plans.staging import owned_tables, stage
from ..sinks import versions

BUCKETS = 32
# A state is laid out by these two; a stream keeps the numbers that it was started with.
GROUPS, SLOTS = 1024, 256
# Characters of entries that a task looks at together, and entries that a row holds.
CHARS, ENTRIES = 8 << 20, 1_000
# A batch of more changed states is not broadcast. Their file says little of their size, since it is compressed.
BROADCAST_ROWS = 100_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PACK = "group int, entries string"
_SAID = "s.first.pattern_id, s.first.match_ord, s.first.line_no, s.last.pattern_id, s.last.match_ord, s.last.value, s.uses"
_STATE = "key string, bucket int, first_path string, first_pattern int, first_match int, first_line int, " \
    "last_path string, last_pattern int, last_match int, last_value string, uses bigint"
_UNSAID = [None] * 6  # of a key that a path lost


class _Slots:
    """Texts of a map state by their slot, read and written once between two writes. Of a state that was empty, only
    slots that were written since are read."""

    def __init__(self, state) -> None:
        self.state, self.held, self.raw = state, {}, {}
        self.filled = None if state.exists() else set()

    def __getitem__(self, slot: int) -> dict:
        if slot not in self.held:
            found = self.state.getValue((slot,)) if self.filled is None or slot in self.filled else None
            self.raw[slot] = found and found[0]
            self.held[slot] = json.loads(found[0]) if found else {}
        return self.held[slot]

    def write(self) -> None:
        for slot, entries in self.held.items():
            text = _text(entries) if entries else None
            if text == self.raw[slot]:
                continue
            if text is None:
                self.state.removeKey((slot,))
            else:
                self.state.updateValue((slot,), (text,))
                if self.filled is not None:
                    self.filled.add(slot)
        self.held, self.raw = {}, {}


def _text(entries) -> str:
    return json.dumps(entries, ensure_ascii=False, separators=(",", ":"))


class FileChanges(StatefulProcessor):
    """Per path: the keys of the last version, and those that a new version says something else of.

    A key that the path lost has a use count of 0. Rows (slot, path, bucket, found) of a group of paths give rows
    of ``key, path, bucket, place…, uses`` for a group of keys.
    """

    def init(self, handle) -> None:
        self.files = handle.getMapState("files", "slot int", "said string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = defaultdict(dict)
        for row in rows:
            if row["path"] is not None:
                arrived[row["slot"]].setdefault(row["path"], (str(row["bucket"]), []))[1].append(row["found"])
        out, n = defaultdict(list), 0
        files = _Slots(self.files)
        for slot, paths in arrived.items():
            held = files[slot]
            for path, (bucket, found) in paths.items():
                new, old = _said(found), held.pop(path, {})
                if new:
                    held[path] = new
                changes = [(name, [*_UNSAID, "0"]) for name in old if name not in new]
                changes += [(name, place) for name, place in new.items() if old.get(name) != place]
                for name, place in changes:
                    out[crc32(f"{bucket} {name}".encode()) % GROUPS].append([name, path, bucket, *place])
                n += len(changes)
            files.write()
            if n >= ENTRIES * 100:
                yield from _packed(out)
                out, n = defaultdict(list), 0
        yield from _packed(out)

    def close(self) -> None:
        pass


def _said(found: list[str]) -> dict[str, list[str]]:
    """What the parts of a file say of each key: place first, last and how often."""
    new: dict[str, list[str]] = {}
    for part in found:
        for name, *place in json.loads(part):
            old = new.get(name)
            if old is not None:
                first = place[:3] if _before(place[:2], old[:2]) else old[:3]
                last = old[3:6] if _before(place[3:5], old[3:5]) else place[3:6]
                place = [*first, *last, str(int(old[6]) + int(place[6]))]
            new[name] = place
    return new


def _before(one: list[str], other: list[str]) -> bool:
    return [*map(int, one)] < [*map(int, other)]


def _packed(out: dict[int, list]) -> Iterator[Row]:
    for group, entries in out.items():
        for at in range(0, len(entries), ENTRIES):
            yield Row(group=group, entries=_text(entries[at : at + ENTRIES]))


class KeyStates(StatefulProcessor):
    """Per key and bucket: what its paths say, and the state that follows, with a use count of 0 when none is left.

    ``ends`` has first path and place, last path and place, and uses of each.
    """

    def init(self, handle) -> None:
        self.paths = handle.getMapState("paths", "slot int", "said string")
        self.ends = handle.getMapState("ends", "slot int", "said string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        paths, ends, changed, lost = _Slots(self.paths), _Slots(self.ends), {}, set()
        for entries in _together(rows):
            by_slot = defaultdict(list)
            for name, path, bucket, *place in entries:
                name = f"{bucket} {name}"
                code = crc32(name.encode())
                changed[name] = code // GROUPS % SLOTS
                by_slot[crc32(path.encode(), code) % SLOTS].append((name, path, place))
            for slot, some in by_slot.items():
                held = paths[slot]
                for name, path, place in some:
                    self._change(held, ends[changed[name]], lost, name, path, place)
                paths.write()
        lost = {name for name in lost if name in ends[changed[name]]}
        if lost:  # an end was lost; the paths are gone through one by one
            for name, end in self._searched(lost).items():
                ends[changed[name]][name][:8] = end
        states = []
        for name, slot in changed.items():
            bucket, name_only = name.split(" ", 1)
            states.append([name_only, bucket, *ends[slot].get(name, [*_UNSAID, None, None, "0"])])
        ends.write()
        yield from _packed({key[0]: states})

    @staticmethod
    def _change(held: dict, ends: dict, lost: set, name: str, path: str, place: list) -> None:
        said = held.setdefault(name, {})
        old, end = said.pop(path, None), ends.get(name)
        uses = (int(end[8]) if end else 0) - (int(old[6]) if old else 0) + int(place[6])
        if place[6] != "0":
            said[path] = place
            if end is None:
                end = ends[name] = [path, *place[:3], path, *place[3:6], ""]
            if path <= end[0]:
                end[:4] = path, *place[:3]
            if path >= end[4]:
                end[4:8] = path, *place[3:6]
        elif end and path in (end[0], end[4]):
            lost.add(name)
        if not said:
            del held[name]
        if not uses:
            ends.pop(name, None)
        elif end:
            end[8] = str(uses)

    def _searched(self, names: set[str]) -> dict[str, list]:
        """First path and place, last path and place of keys of this group."""
        found: dict[str, list] = {}
        for _, (text,) in self.paths.iterator():
            held = json.loads(text)
            for name in names & held.keys():
                said, end = held[name], found.setdefault(name, [])
                first, last = min(said), max(said)
                if not end:
                    end[:] = first, *said[first][:3], last, *said[last][3:6]
                if first < end[0]:
                    end[:4] = first, *said[first][:3]
                if last > end[4]:
                    end[4:8] = last, *said[last][3:6]
        return found

    def close(self) -> None:
        pass


def _together(rows: Iterable[Row]) -> Iterator[list]:
    """The entries of the rows, of ``CHARS`` characters at least at once but for the last."""
    entries, chars = [], 0
    for row in rows:
        entries += json.loads(row["entries"])
        chars += len(row["entries"])
        if chars >= CHARS:
            yield entries
            entries, chars = [], 0
    if entries:
        yield entries


def changed_states(files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Changed states (``key, bucket, …``) of a stream of (path, content). A null content says that a file is gone."""
    content = F.when(scannable(), F.col("content"))
    states = packed_states(files.select("path", F.coalesce(content, F.lit("")).alias("content")))
    found = f"to_json(transform(states, s -> array(s.key, {', '.join(f'cast({c} as string)' for c in _SAID.split(', '))})))"
    hashed = F.xxhash64("path")
    rows = states.select(
        F.pmod(F.shiftright(hashed, 8), F.lit(GROUPS)).cast("int").alias("group"),
        F.pmod(F.shiftright(hashed, 32), F.lit(SLOTS)).cast("int").alias("slot"), "path",
        F.pmod(hashed, F.lit(buckets)).cast("int").alias("bucket"), F.expr(found).alias("found"))
    changes = rows.groupBy("group").transformWithState(FileChanges(), _PACK, "update", "none")
    packed = changes.groupBy("group").transformWithState(KeyStates(), _PACK, "update", "none")
    # A text of any length is read, and one that is no JSON is an error.
    read = F.from_json("entries", "array<array<string>>", {"maxStringLen": str(2**31 - 1), "mode": "FAILFAST"})
    return packed.select(F.explode(read).alias("e")).select(*[
        F.col("e")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(c.split() for c in _STATE.split(", "))])


def start_catalog(
    files: DataFrame, target: str, checkpoint: str, stored: DataFrame | None = None, available_now: bool = False,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the strings of a stream of (path, content), and their merge with ``stored``, as versions of ``target``.

    A version has the tables ``states``, ``changed`` (the keys that its batch changed) and ``merged``.
    """
    spark = files.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_changes(batch, target, batch_id, stored)

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # the store that keeps maps by entry; a query takes the setting when it starts
    try:
        writer = changed_states(files, buckets).writeStream.outputMode("update").foreachBatch(apply)
        writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def apply_changes(changes: DataFrame, target: str, batch_id: int, stored: DataFrame | None = None) -> None:
    """Make the version that follows from the current one and the changed states of a batch."""
    spark = changes.sparkSession
    former = versions.current(spark, target)
    if former is not None and former.tag is not None and former.tag >= batch_id:
        return  # a batch that runs again
    with owned_tables(spark):
        draft = versions.begin(spark, target)
        changes = stage(changes, "changes")
        how = "broadcast" if changes.count() <= BROADCAST_ROWS else "merge"
        states = changes.where("uses > 0")
        if former:
            states = _table(spark, former, "states").join(changes.hint(how), ["key", "bucket"], "left_anti").unionByName(states)
        draft.write_table("states", states)
        draft.write_table("changed", changes.select("key").distinct())
        keys = spark.read.schema("key string").parquet(draft.path("changed")).hint(how)
        states = spark.read.schema(states.schema).parquet(draft.path("states"))
        now = strings_of(states.join(keys, "key", "left_semi") if former else states)
        if stored is None:
            stored = spark.createDataFrame([], "key string, english string, translations map<string,string>, ord int")
        if former:
            kept = _table(spark, former, "merged").join(keys, "key", "left_anti")
            merged = kept.unionByName(smart_merge(now, stored.join(keys, "key", "left_semi")))
        else:
            merged = smart_merge(now, stored)
        draft.write_table("merged", merged)
        draft.commit(tag=batch_id)
    versions.drop_versions(spark, target)


def strings_of(states: DataFrame) -> DataFrame:
    """Strings, as ``extract.unique_strings`` gives them, of the states of all buckets."""
    parts = states.select(
        "key", F.struct(_column("last_path", "path"), _column("last_pattern", "pattern_id"), _column("last_match", "match_ord"),
                        _column("last_value", "value")).alias("last"),
        F.struct(_column("first_path", "path"), _column("first_pattern", "pattern_id"), _column("first_match", "match_ord"),
                 _column("first_line", "line_no")).alias("first"), "uses")
    return finish_states(merge_states(parts))


def _column(name: str, alias: str) -> Column:
    return F.col(name).alias(alias)


def read_strings(spark: SparkSession, target: str) -> DataFrame:
    """The strings of all files so far."""
    return strings_of(_table(spark, versions.current(spark, target), "states"))


def read_merged(spark: SparkSession, target: str) -> DataFrame:
    """The merge of all strings so far with the stored catalog, as ``catalog.smart_merge`` gives it."""
    return _table(spark, versions.current(spark, target), "merged")


def read_changed(spark: SparkSession, target: str) -> DataFrame:
    """The keys that the last batch changed."""
    return _table(spark, versions.current(spark, target), "changed")


def _table(spark: SparkSession, version: versions.Version, name: str) -> DataFrame:
    return spark.read.parquet(version.path(name))
