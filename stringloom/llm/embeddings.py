"""Embedding near-duplicates: int8 tile products with proven error bounds, full precision where they leave it open.

Vectors are compared inside a label only. Equal vectors are one node with a weight. Two linked vectors
differ by at most the threshold's angle, so their angles to any fixed pivot do too: cells that wide over
a few pivots bring linked nodes into the same or adjoining cells. Cells above ``TILE`` nodes are cut into
tiles, and each pair of tiles is one product.

A vector x is kept as x' = scale * int8 with the length of x - x'. The product of x' and y' then differs
from that of x and y by at most |x'| e(y) + e(x) |y'| + e(x) e(y); only pairs that may reach the threshold
are worked out in double precision.

A null label, and a vector that is null, zero, empty or has null or non-finite components, links with
nothing; vectors of different lengths do not link. Repeated rows are vectors of their own and link. A
null ``vec_id`` is never a component's name. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stringloom.llm.common import stage
from stringloom.llm.components import connected_components
from stringloom.llm.simhash import unite

THRESHOLD = 0.98
TILE = 1024
PIVOTS = 2
_SLACK = 1e-6  # above all rounding in products of 32-bit floats of this size
_PAIRS = 1 << 20


def usable() -> F.Column:
    """Whether a vector can link at all."""
    parts = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(
        F.col("label").isNotNull() & (F.size("embedding") > 0) & parts & F.exists("embedding", lambda x: x != 0), F.lit(False))


def keys() -> list[F.Column]:
    return [F.xxhash64(F.lit(i), "label", "embedding").alias(name) for i, name in enumerate(("key", "key2"))]


def quantised(nodes: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS) -> DataFrame:
    """``nodes(node, label, embedding, weight)`` with ``dim, cell, q, scale, error, unit`` in place of the vector."""
    step = float(np.arccos(threshold)) * (1 + 1e-9) + 1e-7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = pa.compute.list_value_length(column).to_numpy()
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                x = np.asarray(column.take(pa.array(own)).flatten(), np.float64).reshape(len(own), dim)
                x /= np.abs(x).max(axis=1, keepdims=True)  # lest squares vanish
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                turn = np.random.default_rng(dim).normal(size=(dim, pivots))
                turn /= np.linalg.norm(turn, axis=0)
                cell = np.floor(np.arccos(np.clip(x @ turn, -1, 1)) / step).astype(np.int32)
                scale = np.abs(x).max(axis=1) / 127
                q = np.rint(x / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(x - q * scale[:, None], axis=1)
                rest = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), rest.column(1).cast(pa.string()), rest.column(3), pa.array(np.full(len(own), dim, np.int32)),
                     pa.array(cell.tolist(), pa.list_(pa.int32())), pa.array([r.tobytes() for r in q], pa.binary()),
                     pa.array(scale), pa.array(error), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["node", "label", "weight", "dim", "cell", "q", "scale", "error", "unit"])

    return nodes.select("node", "label", "embedding", "weight").mapInArrow(
        run, "node bigint, label string, weight bigint, dim int, cell array<int>, q binary, scale double, error double, unit binary")


def _neighbours(cell: F.Column, pivots: int) -> F.Column:
    """All cells at most one step away in each pivot, as an array."""
    steps = F.array(*[F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=pivots)])
    return F.transform(steps, lambda s: F.zip_with(cell, s, lambda at, step: at + step))


def tile_pairs(points: DataFrame, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """Every pair of tiles that may hold a link: ``label, dim, one, two`` (tile names, ``one <= two``)."""
    cells = points.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    near = cells.withColumn("beside", F.explode(_neighbours(F.col("cell"), pivots)))
    other = cells.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("cell").alias("beside"), F.col("tiles").alias("tiles2"))
    pairs = near.join(other, (near["label"] == other["l"]) & (near["dim"] == other["d"]) & (near["beside"] == other["beside"]))
    pairs = pairs.select("label", "dim", "cell", other["beside"].alias("cell2"), F.explode(
        F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"), "tiles2")
    pairs = pairs.withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)))
    one, two = F.concat(F.col("cell"), F.array("t")), F.concat(F.col("cell2"), F.array("t2"))
    return pairs.select("label", "dim", one.alias("one"), two.alias("two")).where("one <= two")


def links_of_tiles(points: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """``node, links, root``: per pair of tiles, the weight linked to a node and a node it is chained to."""
    points = stage(points, "points")
    pairs = stage(tile_pairs(points, tile, pivots), "tile-pairs")
    sizes = points.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    points = points.join(sizes, ["label", "dim", "cell"]).withColumn(
        "own", F.concat("cell", F.array(F.pmod(F.xxhash64("node"), "tiles").cast("int")))).drop("cell", "tiles")
    sides = pairs.select("*", F.lit(0).alias("side"), F.col("one").alias("own")).unionByName(
        pairs.where("one != two").select("*", F.lit(1).alias("side"), F.col("two").alias("own")))
    rows = sides.join(points, ["label", "dim", "own"])
    group = ["label", "dim", "one", "two"]
    key = F.xxhash64(*group)
    rows = rows.withColumns({"g": key, "h": F.xxhash64(F.lit(1), *group)}).select(
        "g", "h", "side", "node", "weight", "dim", "q", "scale", "error", "unit")
    dealt = rows.repartition("g", "h").sortWithinPartitions("g", "h")
    return dealt.mapInArrow(lambda b: _products(b, threshold), "node bigint, links bigint, root bigint")


def _products(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        cuts = _cuts(table)
        for a, b in zip(cuts[:-1], cuts[1:-1], strict=False):
            yield _tile(table.slice(a, b - a), threshold)
        held = table.slice(cuts[-2]) if len(cuts) > 1 else table
    if held is not None and held.num_rows:
        yield _tile(held, threshold)


def _cuts(table: pa.Table) -> list[int]:
    g, h = table["g"].to_numpy(), table["h"].to_numpy()
    return [0, *(np.flatnonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1])) + 1).tolist(), len(g)]


def _tile(table: pa.Table, threshold: float) -> pa.RecordBatch:
    n, dim = table.num_rows, table["dim"][0].as_py()
    q = np.frombuffer(b"".join(table["q"].to_pylist()), np.int8).reshape(n, dim).astype(np.float32)
    unit = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(n, dim)
    scale, error = table["scale"].to_numpy(), table["error"].to_numpy()
    size = np.linalg.norm(q.astype(np.float64), axis=1) * scale
    node, weight = table["node"].to_numpy(), table["weight"].to_numpy()
    side = table["side"].to_numpy()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    links, label = np.zeros(n, np.int64), np.arange(n)
    rows = max(1, _PAIRS // max(1, len(right)))
    for first in range(0, len(left), rows):
        own = left[first : first + rows]
        # Sums of int8 products stay below 2**24 for up to 1,040 components and are exact; the slack covers more.
        about = (q[own] @ q[right].T).astype(np.float64) * scale[own, None] * scale[right]
        bound = size[own, None] * error[right] + error[own, None] * (size[right] + error[right])
        i, j = np.nonzero(about * (1 + _SLACK) + bound + _SLACK >= threshold)
        a, b = own[i], right[j]
        keep = a < b if alone else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        a, b = a[near], b[near]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        label = unite(label, a, b)
    own = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(node[own]), pa.array(links[own]), pa.array(node[label[own]])], ["node", "links", "root"])


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    rows = rows.withColumn("usable", usable())
    nodes = rows.where("usable").groupBy(*keys()).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = stage(links_of_tiles(quantised(nodes, threshold, pivots), threshold, tile, pivots), "tile-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found, "node", "root")
    tops = nodes.select("node", "rep").join(groups, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    names = tops.groupBy("component").agg(F.min("rep").alias("name"))
    told = nodes.select("node", "key", "key2", "weight").join(counts, "node", "left").join(
        tops.select("node", "component"), "node").join(names, "component").select(
        "key", "key2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "name")
    linked = rows.where("usable").select("vec_id", *keys()).join(told, ["key", "key2"]).select(
        "vec_id", F.col("links").alias("n_links"), F.col("name").alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
