"""SimHash near-duplicates by covering locality-sensitive hashing.

Null, empty and blank texts have the fingerprint zero and link like any other. A repeated row is
linked to its twin and keeps its own row in the result. A row whose ``doc_id`` is null gets the
component of its fingerprint. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stringloom.llm.common import arrow_rows, row_key, stage, without
from stringloom.llm.components import connected_components
from stringloom.operators.skew import count_keys, hot_keys, spread_join

SHINGLE, RADIUS, SEED = 4, 4, 42
# A bucket of more rows is cut into tiles; each pair of tiles is a task group of its own.
TILE_ROWS = 4096
_CHUNK = 1 << 16


def text_fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of the hash bits of a text's word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: max(0, len(words) - shingle)] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        parts = [joined[a:b] for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, key, key2, fp`` (the 64 bits as a signed long), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow_rows(batches, "text"):
            fps = np.array([text_fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps)], ["doc_id", "key", "key2", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key bigint, key2 bigint, fp bigint")


def covering_masks(radius: int) -> list[int]:
    """Masks of which one, at least, misses any ``radius`` chosen bits.

    Each bit position has a nonzero vector of radius + 1 bits. A mask keeps the positions whose vector
    has an odd product with the mask's own. ``radius`` vectors never span the whole space, so some
    mask has an even product with all of them and keeps none of the bits in which a pair differs.
    """
    top = 1 << (radius + 1)
    masks = []
    for own in range(1, top):
        masks.append(sum(1 << i for i in range(64) if bin((i % (top - 1) + 1) & own).count("1") % 2))
    return masks


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``a, b`` between the ``rep`` values of distinct fingerprints at most ``radius`` bits apart.

    ``fps(fp, rep)`` has one row per fingerprint. The links join exactly the fingerprints that chains
    of such pairs join: inside a bucket only a spanning forest is returned, never all pairs. Buckets
    above ``tile_rows`` are compared tile by tile, in as many groups as there are pairs of tiles.
    """
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in covering_masks(radius)])
    spread = fps.select("fp", "rep", F.posexplode(masks).alias("table", "mask"))
    spread = spread.select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")
    sizes = spread.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "table", "key", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))
    # Spark sizes the spread rows as one per fingerprint instead of one per mask, and would broadcast them.
    rows = spread.hint("merge").join(sizes, ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "table", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "rep")
    group = ["table", "key", "low", "high"]
    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(lambda batches: _forest(batches, radius), "a bigint, b bigint").distinct()


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Per sorted group, links of each row to the smallest row it is chained to."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        last = _group_numbers(table)
        cut = int(np.searchsorted(last, last[-1])) if len(last) else 0
        held = table.slice(cut)
        if cut:
            yield _links(table.slice(0, cut), last[:cut], radius)
    if held is not None and held.num_rows:
        yield _links(held, _group_numbers(held), radius)


def _group_numbers(table: pa.Table) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    for name in ("table", "key", "low", "high"):
        values = table[name].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def _links(table: pa.Table, group: np.ndarray, radius: int) -> pa.RecordBatch:
    fp = table["fp"].to_numpy().view(np.uint64)
    label = np.arange(len(fp))
    at, step = np.arange(len(fp)), 1
    while True:
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        label = unite(label, near, near + step)
        step += 1
    rep = table["rep"].to_numpy(zero_copy_only=False)
    own = np.flatnonzero(label != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[label[own]])], ["a", "b"])


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``."""
    return _grouped(docs, doc_id, text, shingle, radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, key, key2, fp, component, component_id``: the smallest fingerprint and the smallest id of the group.

    Fingerprints link by themselves, so those of rows without an id join chains too, and rows that
    share an id are not joined by it.
    """
    prints = stage(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    reps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    groups = connected_components(link_fingerprints(reps.select("fp", F.col("fp").alias("rep")), radius))
    linked = stage(reps.join(groups, reps["fp"] == groups["node"]).select("fp", "rep", "component"), "linked")
    tops = linked.groupBy("component").agg(F.min("rep").alias("top"))
    hot = hot_keys(count_keys(linked, ["component"]), ["component"])
    named = spread_join(linked.select("fp", "component"), tops, ["component"], ["fp"], hot)
    # Written, so that the join with the prints has a shuffle of its own, in which a hot fingerprint is split.
    names = stage(reps.join(named, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"),
        F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("top")).alias("component_id")), "names")
    return prints.join(names, "fp")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``docs``, with the smallest ``doc_id``; a row without an id stays.

    Of different texts under the smallest id one stays, chosen by a hash. Of rows that agree in id and
    text, with or without an id, one stays, the first by its JSON form.
    """
    keys = row_key(doc_id, text)
    found = stage(_grouped(docs, doc_id, text).select("doc_id", "key", "key2", "component"), "groups")
    named = found.where("doc_id is not null")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "key", "key2")).alias("first")).select("first.key", "first.key2")
    rows = stage(found.groupBy("key", "key2").agg(
        F.count(F.lit(1)).alias("n"), F.first("doc_id").isNull().alias("nameless")), "rows")
    gone = rows.where("not nameless").join(first, ["key", "key2"], "left_anti").select("key", "key2")
    twins = rows.where("n > 1").select("key", "key2")
    single = without(docs, gone.unionByName(twins), keys)
    # The row travels as one struct, so a column of ``docs`` may have any name.
    several = docs.select(F.struct("*").alias("_row"), *keys).join(twins, ["key", "key2"]).join(gone, ["key", "key2"], "left_anti")
    several = several.groupBy("key", "key2").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return single.unionByName(several.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
