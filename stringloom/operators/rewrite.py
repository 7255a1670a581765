"""Match literals to keys, plan source rewrites and apply them.

Occurrences come from ``extract.occurrences``; the catalog is ``sources.bundles.load_bundles`` (key,
value and its position path, ord). The occurrences are read twice here, so stage them first.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed_values import REVIEW_BATCH, REWRITE_SKIP_PARTS
from ..functions.text import replacement_expr, utrim
from ..plans.staging import stage
from .extract import ORDER, contains_any
from .quoted import replace_all
from .skew import HOT_ROWS, count_keys, hot_keys, spread_join

# So many path hashes, a long each, are sent to every task.
MOST_HASHES = 2_000_000


def match_values(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """value, key: the key of each distinct text, by exact, case-insensitive, then trimmed match.

    Within a tier the first key in catalog order wins. The three tiers are one join: each text asks
    for three forms, and each catalog text is filed under its exact and its lower-case form.
    """
    place = F.struct("path", "ord")
    forms = catalog.select(
        F.inline(F.array(
            F.struct(F.lit("exact").alias("form"), F.col("value").alias("text")),
            F.struct(F.lit("lower").alias("form"), F.lower("value").alias("text")),
        )), "key", place.alias("_place"),
    ).groupBy("form", "text").agg(F.min_by("key", "_place").alias("key"))
    asked = values.select("value", F.inline(F.array(
        F.struct(F.lit(1).alias("tier"), F.lit("exact").alias("form"), F.col("value").alias("text")),
        F.struct(F.lit(2).alias("tier"), F.lit("lower").alias("form"), F.lower("value").alias("text")),
        F.struct(F.lit(3).alias("tier"), F.lit("exact").alias("form"), utrim("value").alias("text")),
    )))
    return asked.join(forms, ["form", "text"]).groupBy("value").agg(
        F.min_by("key", "tier").alias("key"), F.min("tier").alias("tier")
    )


def match_keys(found: DataFrame, catalog: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Occurrences with key and tier (null without a match).

    Each distinct text is matched once. The keys then go back to the occurrences by one join, in
    which a text that fills a large share of the rows is split.
    """
    counts = count_keys(found, ["value"])
    matched = match_values(counts.select("value"), catalog)
    hot = hot_keys(counts, ["value"], hot_rows)
    return spread_join(found, matched, ["value"], ["path", "match_ord"], hot, "left")


def rewritable(found: DataFrame) -> DataFrame:
    """Without asset, image, icon and color files and generated code, which are never rewritten."""
    return found.where(F.expr("not " + contains_any("lower(path)", REWRITE_SKIP_PARTS)))


def plan_replacements(matched: DataFrame, fmt: str) -> DataFrame:
    """path, pattern_id, match_ord, line_no, original, replacement, key for ``match_keys`` rows."""
    return matched.where(F.col("key").isNotNull()).select(
        *ORDER, "line_no", F.col("value").alias("original"),
        replacement_expr("key", fmt).alias("replacement"), "key",
    )


def missed_strings(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("key").isNull()).select(*ORDER, "line_no", "value")


def plan_text(plan: DataFrame) -> DataFrame:
    """Two-line difference of each replacement."""
    return plan.select(*ORDER, F.concat(
        F.lit("Line "), F.col("line_no").cast("string"), F.lit(": - "), "original",
        F.lit("\n         + "), "replacement",
    ).alias("text"))


def missed_text(missed: DataFrame) -> DataFrame:
    return missed.select(*ORDER, F.concat(
        "path", F.lit(":"), F.col("line_no").cast("string"), F.lit(' - "'), "value", F.lit('"')
    ).alias("text"))


def replacements_by_file(plan: DataFrame) -> DataFrame:
    return plan.groupBy("path").agg(F.count(F.lit(1)).alias("planned")).orderBy("path")


def review_batches(plan: DataFrame, size: int = REVIEW_BATCH) -> DataFrame:
    """Plan rows numbered from 1 in their file, in batches. The rows of one file are numbered by one task,
    and there are no more of them than the file has literals."""
    in_file = Window.partitionBy("path").orderBy("pattern_id", "match_ord")
    return plan.withColumn("idx", F.row_number().over(in_file)).withColumn(
        "batch", (F.floor((F.col("idx") - 1) / size) + 1).cast("int")
    )


def drop_reviewed(batches: DataFrame, skips: DataFrame) -> DataFrame:
    """Plan rows without those a reviewer named by (path, batch, idx).

    An index outside the batch it was given for is ignored.
    """
    return batches.join(skips, ["path", "batch", "idx"], "left_anti")


def apply_by_line(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Rewritten files: path, content, planned, applied. Unchanged files are left out.

    On its line ``"original"`` is replaced, or else ``'original'``. Replacements of one line apply in
    plan order. Only the planned lines are rebuilt; the text between them is taken over as it is, so
    a file costs its length, however many replacements it has.
    """
    steps = plan.groupBy("path", "line_no").agg(F.sort_array(F.collect_list(
        F.struct("pattern_id", "match_ord", "original", "replacement"))).alias("steps"))
    steps = steps.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "steps"))).alias("_plan"),
        F.sum(F.size("steps")).alias("planned"),
    )
    lines = F.split("content", "\r\n|\r|\n")
    # A line break at the end does not start another line.
    lines = F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    work = _with_steps(files, steps).withColumn("_lines", lines)
    work = work.withColumn("_plan", F.filter("_plan", lambda p: p["line_no"] <= F.size("_lines")))
    work = work.withColumn("_done", F.transform("_plan", lambda p: F.aggregate(
        p["steps"],
        F.struct(F.get("_lines", p["line_no"] - 1).alias("line"), F.lit(0).alias("n")),
        _replace_on_line,
    )))
    work = work.withColumn("applied", F.aggregate("_done", F.lit(0), lambda n, d: n + d["n"]))
    pieces = F.transform("_plan", lambda p, i: F.concat(
        _between("_lines", F.coalesce(F.get("_plan", i - 1)["line_no"], F.lit(0)), p["line_no"]),
        F.array(F.get("_done", i)["line"]),
    ))
    last = F.coalesce(F.get("_plan", F.size("_plan") - 1)["line_no"], F.lit(0))
    text = F.array_join(F.concat(F.flatten(pieces), _between("_lines", last, F.size("_lines") + 1)), "\n")
    return _changed(work, text, F.col("planned"), F.col("applied"))


def apply_by_content(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Rewritten files: path, content, planned, applied. Unchanged files are left out.

    Every replacement applies to the whole text, in plan order: ``"original"``, or else
    ``'original'``, or else either with white space inside the quotes. Later replacements see the
    result of earlier ones. A file costs its length and its hits, however many replacements it has.
    """
    steps = plan.groupBy("path").agg(F.sort_array(F.collect_list(
        F.struct("pattern_id", "match_ord", "original", "replacement"))).alias("_plan"))
    work = _with_steps(files, steps).where(F.col("content").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, todo = (batch.column(k)[i].as_py() for k in range(3))
                text, applied = replace_all(content, [(step["original"], step["replacement"]) for step in todo])
                if applied:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([text]), pa.array([len(todo)], pa.int32()), pa.array([applied], pa.int32())],
                        ["path", "content", "planned", "applied"])

    return work.select("path", "content", "_plan").mapInArrow(run, "path string, content string, planned int, applied int")


def _with_steps(files: DataFrame, steps: DataFrame) -> DataFrame:
    """path, content and the columns of ``steps``, for the files that have a row there.

    A file without one is left out before the shuffle, by the hashes of the planned paths: an inner join,
    since a condition could move below the columns that files are made of. The steps are staged, so the
    hashes are counted and sent only up to ``MOST_HASHES``; beyond it all files are shuffled.
    """
    steps = stage(steps, "steps")
    files = files.select("path", "content")
    if steps.count() <= MOST_HASHES:
        planned = steps.select(F.xxhash64("path").alias("_hash")).distinct()
        files = files.withColumn("_hash", F.xxhash64("path")).join(F.broadcast(planned), "_hash").drop("_hash")
    return files.join(steps.hint("merge"), "path")


def _changed(work: DataFrame, content: Column, planned: Column, applied: Column) -> DataFrame:
    """Files with a replacement. A condition on ``applied`` would move into the join below and be
    worked out there a second time; as the input of a generator it is worked out once."""
    row = F.struct(content.alias("content"), planned.alias("planned"), applied.alias("applied"))
    return work.select("path", F.inline(F.filter(F.array(row), lambda r: r["applied"] > 0)))


def _between(lines: str, after: Column, before: Column) -> Column:
    return F.slice(lines, after + 1, before - after - 1)


def _quoted(text: Column, quote: str) -> Column:
    return F.concat(F.lit(quote), text, F.lit(quote))


def _replace_on_line(state: Column, step: Column) -> Column:
    line, double, single = state["line"], _quoted(step["original"], '"'), _quoted(step["original"], "'")
    hit = line.contains(double) | line.contains(single)
    new = F.when(line.contains(double), F.replace(line, double, step["replacement"])).otherwise(
        F.replace(line, single, step["replacement"]))
    return F.struct(new.alias("line"), (state["n"] + hit.cast("int")).alias("n"))
