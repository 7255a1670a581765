"""Mix sources to target weights by a low-discrepancy schedule of blocks of words.

Documents of a source stand in a hashed order and form one stream of words, beginning anew after the
last. The stream up to the source's target, to the word, is cut into equal blocks, the last one shorter.
Slot i of the mix falls on the i-th van der Corput point; the source whose interval of the cumulative
targets holds that point gets the slot, and its r-th slot is joined to its r-th block. The mix is what
the joined blocks hold, in slot order. A null text has no words; a source without words takes nothing; a null source
counts as a source of its own, the last. Repeated rows are documents of their own. No documents give
no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stringloom.llm.common import global_running_sum, small, stage, width

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
_POINT_BITS = 44
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GRID = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def twin(doc_id: str = "doc_id", text: str = "text", second: bool = False) -> Column:
    """Half of a 128-bit key that rows share if they agree in id and text."""
    return F.xxhash64(F.lit(int(second)), doc_id, text)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source, source_size, weight, target`` from ``sizes(source, size)``.

    ``share`` of all words is dealt by weight. A source's target stops at ``most`` times its size; the
    excess is dealt again among the others, which ends at one level per unit of weight. The loop moves
    a few sums per round to the driver, never the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = global_running_sum(totals, ["source"], "one", "rank", max(1, width(sizes.sparkSession) // 4))
    own = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stage(ranked.select(
        "source", "source_size", "rank", own.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level
        n, held, rest = sources.agg(
            F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total * share - held) / rest
    return sources.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)).cast("double"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """``slot, source, rank, turn``: which source each slot of the mix belongs to, and the how-manieth of it.

    Slots meet the intervals of the cumulative targets over a grid of the unit interval, so the join
    has equal keys and the points are spread evenly over them. A source with a target whose interval
    holds no point shares a slot that a hash of its rank chooses.
    """
    spark = targets.sparkSession
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = max(1, round(total / block_words)) if total else 0
    summed = global_running_sum(targets, ["rank"], "target", "start", max(1, width(spark) // 4))
    low, high = F.col("start") / max(total, 1.0), (F.col("start") + F.col("target")) / max(total, 1.0)
    spans = summed.where("target > 0").select("source", "rank", low.alias("low"), high.alias("high")).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") * _GRID), F.floor(F.col("high") * _GRID))))
    # The top interval also holds the points that rounding leaves above the last sum.
    last = summed.where("target > 0").agg(F.max("rank")).first()[0]
    spans = spans.withColumn("high", F.when(F.col("rank") == F.lit(last), 2.0).otherwise(F.col("high")))
    point = F.conv(F.reverse(F.lpad(F.bin("id"), _POINT_BITS, "0")), 2, 10).cast("long") / float(1 << _POINT_BITS)
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn(
        "cell", F.floor(F.col("point") * _GRID))
    dealt = stage(points.join(spans, "cell").where("point >= low and point < high").select("slot", "source", "rank"), "dealt")
    missed = targets.where("target > 0").join(dealt.select("rank").distinct(), "rank", "left_anti").select(
        F.pmod(F.xxhash64("rank"), F.lit(max(1, slots))).alias("slot"), "source", "rank")
    return _turns(dealt.unionByName(missed))


def _turns(slots: DataFrame, run: int = 1 << 16) -> DataFrame:
    """Number the slots of each source in slot order: counts per run of slots first, then inside the runs."""
    rows = stage(slots.withColumn("run", F.floor(F.col("slot") / run)), "slots")
    before = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("rank", "run").agg(F.count(F.lit(1)).alias("n")).select(
        "rank", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "run").orderBy("slot")
    return rows.join(offsets, ["rank", "run"]).select(
        "slot", "source", "rank", (F.col("offset") + F.row_number().over(inside) - 1).alias("turn"))


def block_size(targets: DataFrame) -> int:
    """Words that a slot stands for: a thousandth of the mean source, between 16 and 4,096."""
    n, total = targets.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    return max(16, min(4096, (total or 0) // max(1, n) // 1000))


def place(docs: DataFrame, seed: int = 7, rows_per_run: int = 20_000) -> DataFrame:
    """``docs`` (source, size, twin, twin2) with ``begin``: words before it in its source's stream.

    The order is a hash of the id and the text, alike in every run. Words are summed per slice of the
    hash range, slices over a source, and rows inside a slice, so a source of any size is spread.
    """
    n = docs.count()
    bits = max(0, (n // rows_per_run).bit_length())
    mixed = docs.withColumn("_order", F.xxhash64(F.lit(seed), "twin", "twin2"))
    mixed = mixed.withColumn("_run", F.shiftright(F.shiftright("_order", 1), 63 - bits))
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = mixed.groupBy("source", "_run").agg(F.sum("size").alias("_n")).select(
        F.col("source").alias("_source"), F.col("_run").alias("_slice"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_run").orderBy("_order", "twin", "twin2").rowsBetween(
        Window.unboundedPreceding, -1)
    summed = mixed.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_run") == F.col("_slice"))
    return summed.join(small(offsets, F.coalesce(F.octet_length("_source"), F.lit(0))), same).withColumn("begin", F.col("_offset") + F.col("_before")).drop(
        "_order", "_run", "_source", "_slice", "_offset", "_before")


def pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options
) -> tuple[DataFrame, DataFrame]:
    """Placed rows (``row, doc_id, twin, twin2, size, source_size, target, begin``) and the pieces of them in the mix.

    A piece (``row, pass, start, words, slot, turn``) is what a block holds of one pass over a document. The
    blocks of a source are as long as its goal takes to fill its slots; blocks without a slot hold nothing.
    """
    most = options.get("most", MOST)
    rows = stage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        twin(doc_id, text).alias("twin"), twin(doc_id, text, second=True).alias("twin2"), word_count(F.col(text)).alias("size")), "sizes")
    targets = stage(source_targets(rows, **options), "targets")
    slots = stage(schedule(targets, block_size(targets)), "schedule")
    turns = slots.groupBy("rank").agg((F.max("turn") + 1).alias("turns"))
    goal = F.least(F.round("target"), F.floor(F.col("source_size") * most)).cast("long")
    plan = targets.join(turns, "rank", "left").select(
        F.col("source").alias("_of"), "rank", "source_size", "target", goal.alias("goal"),
        F.ceil(goal / F.coalesce("turns", F.lit(1))).alias("block"))
    plan = small(plan, F.coalesce(F.octet_length("_of"), F.lit(0)))
    placed = stage(place(rows).join(plan, F.col("source").eqNullSafe(F.col("_of"))).drop("_of"), "placed")
    taken = placed.where("size > 0 and begin < goal").withColumn(
        "pass", F.explode(F.expr("sequence(0L, (goal - 1 - begin) div source_size)")))
    taken = taken.withColumn("start", F.expr("pass * source_size + begin"))
    taken = taken.withColumn("end", F.least(F.col("start") + F.col("size"), F.col("goal")))
    taken = taken.withColumn("turn", F.explode(F.expr("sequence(start div block, (end - 1) div block)")))
    words = F.least("end", (F.col("turn") + 1) * F.col("block")) - F.greatest("start", F.col("turn") * F.col("block"))
    met = taken.withColumn("words", words).join(slots.select("rank", "turn", "slot"), ["rank", "turn"])
    return placed, met.select("row", "twin", "twin2", "size", "pass", "start", "words", "slot", "turn")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, begin, slot, turn``, one row per row of ``docs``.

    ``begin`` is the document's place in its source's stream and ``taken`` the words that its pieces hold.
    ``slot`` is the first slot of the mix that has any of them, and ``turn`` the how-manieth of its source
    that is; both are null where the mix takes nothing.
    """
    placed, met = pieces(docs, doc_id, text, source, **options)
    sums = met.groupBy("row").agg(F.sum("words").alias("words"), F.min(F.struct("slot", "turn")).alias("_first"))
    return placed.join(sums, "row", "left").select(
        "doc_id", "twin", "twin2", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"), "begin",
        "_first.slot", "_first.turn")


def first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """The head of each text up to the end of its n-th word."""

    def head(text: str | None, n: int) -> str | None:
        if text is None:
            return None
        end = next(islice((m.end() for m in _WORD.finditer(text)), int(n) - 1, None), len(text))
        return text[:end]

    return pd.Series([head(t, n) for t, n in zip(texts, counts, strict=True)], dtype=object)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows the mix takes, in slot order: a document once per pass, and its first words where the last ends in it.

    A row keeps all columns of ``docs``; ``n_chars``, where there is one, follows the text.
    """
    _, met = pieces(docs)
    passes = met.groupBy("row", "pass", "twin", "twin2").agg(
        F.min("slot").alias("slot"), F.first("start").alias("start"), F.sum("words").alias("words"), F.first("size").alias("size"))
    shares = passes.groupBy("row", "twin", "twin2").agg(
        F.sort_array(F.collect_list(F.struct("slot", "start", "words", "size"))).alias("_share"))  # one per pass
    # Rows repeated with their id share a key; each of them takes one of the places found for it.
    taken = shares.groupBy("twin", "twin2").agg(F.sort_array(F.collect_list("_share")).alias("_shares"))
    # The row travels as one struct, so a column of ``docs`` may have any name.
    rows = docs.select(F.struct("*").alias("_row"), twin().alias("_twin"), twin(second=True).alias("_twin2"))
    rows = rows.join(taken, (F.col("_twin") == F.col("twin")) & (F.col("_twin2") == F.col("twin2")))
    nth = F.row_number().over(Window.partitionBy("_twin", "_twin2").orderBy(F.lit(0)))
    rows = rows.withColumn("_own", F.get("_shares", nth - 1)).where("_own is not null")
    rows = rows.select("_row", F.explode("_own").alias("_piece"))
    rows = rows.repartitionByRange(width(docs.sparkSession), "_piece.slot", "_piece.start").sortWithinPartitions(
        "_piece.slot", "_piece.start")
    rows = rows.withColumn("_take", F.when(F.col("_piece.words") == F.col("_piece.size"), F.lit(-1).cast("long")).otherwise(
        F.col("_piece.words")))
    text = F.col("_row")["text"]
    cut = F.pandas_udf(first_words, "string")(F.when(F.col("_take") >= 0, text), F.greatest("_take", F.lit(0)))
    rows = rows.withColumn("_text", F.when(F.col("_take") < 0, text).otherwise(cut))
    put = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[put.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
