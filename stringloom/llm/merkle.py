"""Merkle manifest of a dataset: a content-addressed tree per source, and proofs by descent from the root.

A leaf is the digest of a row's fields. The leaves of a source stand in ascending ``doc_id`` (nulls
first, then by digest); every run of ``FAN`` nodes becomes a node of the next level until one is left,
the source's subroot. The subroots, in order of source (null first), become the root likewise.

The store has a record ``digest -> children`` for every inner node, once, however many places the node
has. Requests start at the root: at each level the digits of a leaf's rank choose a child and the other
children are collected, so a path segment is carried once for all requests below a node. Reversed, the
segments lead from the leaf to the root.

Null fields have a mark of their own. Rows that agree in all fields are leaves of their own with equal
digests. An empty table has no root and gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stringloom.llm.common import append_ends, global_running_sum, new_folder, stage, width
from stringloom.operators.skew import count_keys, hot_keys, spread_join

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
SPAN = 6  # levels that are built from one block of FAN ** SPAN nodes, and descended between two writes


@dataclass
class Manifest:
    """Written tables: ``leaves(tree, rank, doc_id, leaf, shown)``, ``sources(tree, source, n, subroot)`` and the store."""

    leaves: DataFrame
    sources: DataFrame
    root: str | None
    source_store: dict[int, DataFrame]
    root_store: dict[int, DataFrame]


def digest(values: list[Column]) -> Column:
    """Hex digest of values, each preceded by its length; a null is a dash."""
    parts = []
    for value in values:
        own = value.cast("string")
        parts.append(F.when(own.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own)))
    return F.sha2(F.concat(*parts), 256)


def depth(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.pow(F.lit(float(FAN)), k).cast("decimal(20,0)"))
    return F.size(F.filter(steps, lambda reach: reach < n))


def _bytes(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def rank_leaves(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source",
    text: str = "text", altered: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``leaves(tree, rank, doc_id, leaf, shown)`` and ``sources(tree, source, n)``.

    ``shown`` is the leaf of the row as it stands now, with ``altered`` (where not null) in place of its
    text. Texts are read once and never shuffled. The order comes from ranges over source and id, so a
    source with most rows is spread over tasks.
    """
    spark = docs.sparkSession
    leaf = digest([F.col(f) for f in fields])
    shown = leaf if altered is None else F.when(altered.isNull() | (altered == F.col(text)), leaf).otherwise(
        digest([altered if f == text else F.col(f) for f in fields]))
    rows = docs.select(
        F.col(source).isNotNull().alias("named"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
        F.col(doc_id).alias("doc_id"), F.unhex(leaf).alias("leaf"), F.unhex(shown).alias("shown"),
        F.monotonically_increasing_id().alias("tie"))
    rows = stage(rows, "leaves")
    order = [F.col(c) for c in ("named", "name", "doc_id", "leaf", "tie")]
    ranked = stage(append_ends(rows, order, width(spark)).withColumnRenamed("_part", "range"), "ranks")
    # A row per source and range: how many rows, and where they begin.
    parts = ranked.groupBy("named", "name", "range").agg(F.count(F.lit(1)).alias("here"), F.min("_row").alias("first"))
    before = Window.partitionBy("named", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))), "parts")
    sources = parts.groupBy("named", "name").agg(F.sum("here").alias("n"), F.lit(1).alias("one"))
    sources = stage(global_running_sum(sources, ["named", "name"], "one", "tree", width(spark)), "sources")
    starts = spread_join(parts, sources.select("named", "name", "tree", "n"), ["named", "name"], ["range"],
                         hot_keys(count_keys(parts, ["named", "name"]), ["named", "name"]))
    numbered = ranked.join(starts, ["named", "name", "range"]).select(
        "tree", (F.col("before") + F.col("_row") - F.col("first")).alias("rank"), "n", "doc_id", "leaf", "shown")
    named = F.when(F.col("named"), F.col("name"))
    return stage(numbered, "numbered"), sources.select("tree", named.alias("source"), "n")


def _climb(nodes: DataFrame) -> tuple[dict[int, DataFrame], DataFrame]:
    """Records per level and the top of each tree (``tree, digest``) of ``nodes(tree, idx, n, digest)``.

    A block of FAN ** SPAN neighbours climbs SPAN levels inside one row, so the nodes are shuffled once
    per SPAN levels; the tops of all blocks are the nodes of the next round.
    """
    spark, block = nodes.sparkSession, FAN**SPAN
    store: dict[int, DataFrame] = {}
    tops = nodes.where("n = 1").select("tree", "digest")
    base, todo = 0, nodes.where("n > 1")
    most = nodes.agg(F.max("n")).first()[0] or 0
    schema = "tree bigint, idx bigint, n bigint, digest binary, children array<binary>, level int"
    while most > 1:
        steps = F.least(F.lit(SPAN), depth(F.col("n")))
        rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", _hex(F.col("digest")).alias("d")))), lambda x: x["d"])
        blocks = todo.groupBy("tree", "n", F.floor(F.col("idx") / block).alias("block")).agg(rows.alias("row"))

        def up(levels: Column, _: Column) -> Column:
            last = F.element_at(levels, -1)
            runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / FAN).cast("int"))
            return F.concat(levels, F.array(F.transform(
                runs, lambda i: F.sha2(F.array_join(F.slice(last, i * FAN + 1, F.lit(FAN)), ""), 256))))

        climbed = blocks.withColumn("levels", F.aggregate(F.sequence(F.lit(1), steps), F.array("row"), up))
        level = climbed.select("tree", "n", "block", "levels", F.explode(F.sequence(F.lit(1), F.size("levels") - 1)).alias("step"))
        one = level.select("tree", "n", "block", "step", F.get("levels", F.col("step") - 1).alias("below"),
                           F.posexplode(F.get("levels", F.col("step"))).alias("i", "d"))
        kept = one.select(
            "tree", (F.col("block") * F.pow(F.lit(FAN), SPAN - F.col("step")).cast("long") + F.col("i")).alias("idx"),
            F.col("n").cast("long"), F.unhex("d").alias("digest"),
            F.transform(F.slice("below", F.col("i") * FAN + 1, F.lit(FAN)), F.unhex).alias("children"),
            (F.col("step") + base).cast("int").alias("level"))
        folder = new_folder(spark, "nodes")
        kept.write.partitionBy("level").parquet(folder)
        nodes = spark.read.schema(schema).parquet(folder)
        records = new_folder(spark, "store")
        nodes.groupBy("level", "digest").agg(F.first("children").alias("children")).write.partitionBy("level").parquet(records)
        held = spark.read.schema("digest binary, children array<binary>, level int").parquet(records)
        for k in range(1, SPAN + 1):
            store[base + k] = held.where(F.col("level") == base + k).select("digest", "children")
        ended = depth(F.col("n")) + base == F.col("level")
        tops = tops.unionByName(nodes.where(ended).select("tree", "digest"))
        base += SPAN
        todo = nodes.where((F.col("level") == base) & ~ended).select(
            "tree", "idx", F.ceil(F.col("n") / block).cast("long").alias("n"), "digest")
        most = -(-most // block)
    return store, stage(tops, "tops")


def build_manifest(docs: DataFrame, altered: Column | None = None, **columns) -> Manifest:
    """The trees of all sources and the tree above them, as written tables."""
    leaves, sources = rank_leaves(docs, altered=altered, **columns)
    store, tops = _climb(leaves.select("tree", F.col("rank").alias("idx"), "n", F.col("leaf").alias("digest")))
    sources = stage(sources.join(tops.withColumnRenamed("digest", "subroot"), "tree"), "subroots")
    n = sources.count()
    root_store, top = _climb(sources.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("long").alias("n"), F.col("subroot").alias("digest")))
    root = top.select(_hex(F.col("digest"))).first()  # one row
    return Manifest(leaves, sources, root and root[0], store, root_store)


def _descend(tops: DataFrame, store: dict[int, DataFrame], wanted: DataFrame | None) -> DataFrame:
    """``tree, idx, digest, path, …`` of the leaves below ``tops(tree, n, digest, path, …)``.

    ``path`` grows by the unselected children, those left and those right of the chosen one. With
    ``wanted(tree, rank)`` only nodes above a wanted leaf are followed.
    """
    start = tops.withColumns({"idx": F.lit(0).cast("long"), "level": depth(F.col("n"))}).drop("n")
    start = stage(start, "tops")
    here = None
    for level in range(start.agg(F.max("level")).first()[0] or 0, -1, -1):
        enter = start.where(F.col("level") == level).drop("level")
        here = enter if here is None else here.unionByName(enter)
        if wanted is not None:
            above = wanted.select("tree", F.floor(F.col("rank") / FAN**level).alias("idx")).distinct()
            here = here.join(above, ["tree", "idx"], "left_semi")
        if level % SPAN == 0 or level == 0:
            here = stage(here, "frontier")
        if level:
            met = here.join(store[level], "digest")
            met = met.select(*[c for c in met.columns if c != "digest"], F.posexplode("children").alias("digit", "digest"))
            segment = F.struct(
                _bytes(F.slice("children", F.lit(1), F.col("digit"))).alias("left"),
                _bytes(F.slice("children", F.col("digit") + 2, F.lit(FAN))).alias("right"))
            here = met.withColumns({"path": F.concat("path", F.array(segment)), "idx": F.col("idx") * FAN + F.col("digit")})
            here = here.drop("children", "digit")
    return here


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """``tree, rank, digest, subroot, path`` of all leaves, or of those in ``wanted(tree, rank)``."""
    sources = manifest.sources
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    trees = None if wanted is None else wanted.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"))
    top = sources.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit(0).cast("long").alias("tree"), "n", F.unhex(F.lit(manifest.root)).alias("digest"), none.alias("path"))
    subroots = _descend(top, manifest.root_store, trees).select(
        F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "digest", "path")
    found = _descend(subroots.join(sources.select("tree", "n"), "tree"), manifest.source_store, wanted)
    return found.withColumnRenamed("idx", "rank")


def verify(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of the table.

    The proof is folded from the leaf as it stands now; it ends at the root only if that leaf is unchanged.
    """
    proofs = prove(manifest, wanted).select("tree", "rank", "subroot", F.reverse("path").alias("path"))
    rows = manifest.leaves.join(proofs, ["tree", "rank"])
    siblings = F.aggregate("path", F.lit(b""), lambda done, s: F.concat(done, s["left"], s["right"]))
    folded = F.aggregate("path", _hex(F.col("shown")), lambda node, s: F.sha2(
        F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))
    root = F.lit(manifest.root).cast("string")
    return rows.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(_hex(siblings), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
