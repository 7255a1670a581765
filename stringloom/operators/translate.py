"""Enrichment: work list, translation memory, a pluggable translator, write-back and quota."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import split_fields
from ..functions.fixed_values import (
    CHARS_PER_STRING_ESTIMATE, FREE_QUOTA_CHARS, QUOTA_NEAR_PERCENT, SERVICE_LANGUAGES,
)
from ..functions.text import csv_escape, utf16_length, utrim
from ..sources.sheets import header_fields, row_range, sheet_lines
from .skew import HOT_ROWS, count_keys, hot_keys, running_sum, spread_join

# What a translator raises through a mistake in its code, not because it refuses a text.
PROGRAM_ERRORS = (NameError, AttributeError, TypeError, ImportError)
_PAIR = ["english", "lang"]


def select_langs(langs: DataFrame, choice: str, numbers: list[int] | None = None) -> DataFrame:
    """Part of a language table (…, ord, lang): ``es_ar``, ``top10``, ``numbers`` or ``all``."""
    if choice == "es_ar":
        return langs.where(F.col("lang").contains("es") | F.col("lang").contains("ar"))
    if choice == "top10":
        return langs.where(F.col("ord") <= 10)
    if choice == "numbers":
        return langs.where(F.col("ord").isin(list(numbers or [])))
    return langs


def supported_langs(langs: DataFrame, column: str = "lang") -> DataFrame:
    """Rows whose language code the service accepts, in any case."""
    return langs.where(F.upper(column).isin(SERVICE_LANGUAGES))


def translation_work(rows: DataFrame, langs: list[str]) -> DataFrame:
    """Rows with an English text, once per target language."""
    targets = F.array(*[F.lit(lang) for lang in langs])
    return rows.where(F.col("english") != "").withColumn("lang", F.explode(targets))


def translate_tm(work: DataFrame, memory: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Work list with ``text`` from the translation memory (null where it has none).

    ``memory`` is (english, lang, text); should it repeat a pair, the smallest text is taken. A text
    that fills a large share of the work list is split.
    """
    known = memory.groupBy("english", "lang").agg(F.min("text").alias("text"))
    return attach_texts(work, known, hot_rows)


def translate_texts(
    work: DataFrame, translate: Callable[[pd.DataFrame], pd.DataFrame], tasks: int | None = None
) -> DataFrame:
    """english, lang, text, error: every distinct text of the work list, sent once to a translator.

    Batches run on the executors, ``tasks`` at a time (by default as many as the session has cores).
    ``translate`` gets a frame (english, lang) and returns it with
    ``text``, in any order. A failing batch is cut in halves until the texts that fail stand alone, so
    a text is sent at least once, and the others of its batch about log2(batch) times more. A text
    that fails, gets no answer or gets several keeps its row, without a translation and with the
    error; answers to texts that were not sent are ignored. Errors that point at a fault in the
    translator's code (``PROGRAM_ERRORS``) end the job. Stage the result, so that nothing is sent twice;
    ``ledger.translate_within_quota`` also outlives a run that is ended midway.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield answer_batch(translate, batch)

    tasks = tasks or work.sparkSession.sparkContext.defaultParallelism
    distinct = work.select("english", "lang").distinct().repartition(tasks, "english", "lang")
    return distinct.mapInPandas(run, "english string, lang string, text string, error string")


def answer_batch(translate: Callable[[pd.DataFrame], pd.DataFrame], batch: pd.DataFrame) -> pd.DataFrame:
    """The rows of the batch with ``text`` and ``error``, sent at once or in halves.

    All calls are made first; their answers are matched to what each call asked once per batch.
    """
    calls: list[pd.DataFrame] = []
    answers: list[pd.DataFrame] = []
    waiting = [batch]
    while waiting:
        part = waiting.pop()
        try:
            answer = translate(part.copy())
        except PROGRAM_ERRORS:
            raise
        except Exception as error:
            if len(part) > 1:
                half = len(part) // 2
                waiting += [part.iloc[half:], part.iloc[:half]]
                continue
            calls.append(part.assign(error=f"{type(error).__name__}: {error}"))
            continue
        answers.append(answer[[*_PAIR, "text"]].assign(_call=len(calls)))
        calls.append(part)
    sent = pd.concat([part.assign(_call=i) for i, part in enumerate(calls)]) if calls else batch.assign(_call=0)
    return match_answers(sent, pd.concat(answers) if answers else sent.iloc[:0].assign(text=None))


def match_answers(sent: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """``sent`` (english, lang, _call and maybe error), each row with the one answer that its call gave to it,
    or with the reason why it has none."""
    key = [*_PAIR, "_call"]
    several = answers.duplicated(key, keep=False)
    told = sent.reset_index(drop=True).merge(answers.loc[~several, [*key, "text"]], "left", key)
    error = told["error"].astype(object) if "error" in told else pd.Series(None, told.index, dtype=object)
    error[told["text"].isna() & error.isna()] = "no answer"
    if several.any():
        twice = told.merge(answers.loc[several, key].drop_duplicates(), "left", key, indicator="_several")["_several"] == "both"
        error[twice.to_numpy()] = "several answers"
    text = told["text"].astype(object)
    return told.assign(text=text.where(text.notna(), None), error=error.where(error.notna(), None))[[*_PAIR, "text", "error"]]


def attach_texts(work: DataFrame, texts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Work list (sheet, row_no, english, lang, …) with the columns of ``texts``, which has one row
    per (english, lang). A text that fills a large share of the work list is split."""
    pair = ["english", "lang"]
    hot = hot_keys(count_keys(work, pair), pair, hot_rows)
    return spread_join(work, texts, pair, ["sheet", "row_no"], hot, "left")


def apply_translations(rows: DataFrame, translated: DataFrame) -> DataFrame:
    """Rows (sheet, row_no, translations) with the returned texts written over their languages."""
    new = _texts_per_row(translated)
    kept = F.map_filter("translations", lambda lang, _: ~F.map_contains_key("_new", lang))
    merged = F.when(F.col("_new").isNull(), F.col("translations")).otherwise(F.map_concat(kept, "_new"))
    return rows.join(new, ["sheet", "row_no"], "left").withColumn("translations", merged).drop("_new")


def sheet_texts(rows: DataFrame, first: int = 4, last: int | None = None, dialect: str = "escaped") -> DataFrame:
    """sheet, row_no, key, english of the sheet rows (path, row_no, line) in a range."""
    fields = split_fields(F.col("line"), dialect)
    return row_range(rows, first, last).select(
        F.col("path").alias("sheet"), "row_no", F.get(fields, F.lit(0)).alias("key"),
        F.coalesce(F.get(fields, F.lit(1)), F.lit("")).alias("english"),
    )


def write_back(
    files: DataFrame, translated: DataFrame, header_row: int = 2, dialect: str = "escaped", blank: str = "trim"
) -> DataFrame:
    """Sheet lines (sheet, row_no, line) with returned texts in the columns of their languages.

    A code that the header repeats is filled in its first column. ``blank`` is the rule of
    ``sheet_rows`` that numbered the rows of ``translated``. Rows without a text stay as they are. A changed row is written with full quoting, and a short one
    is filled up to its header.
    """
    codes = _column_codes(header_fields(header_row, dialect, blank))
    rows = files.select(
        F.col("path").alias("sheet"), codes.alias("_codes"), F.posexplode(sheet_lines(blank)).alias("_pos", "line")
    ).withColumn("row_no", F.col("_pos") + 1)
    return _write_rows(rows, translated, dialect)


def write_back_lines(
    rows: DataFrame, translated: DataFrame, header_row: int = 2, dialect: str = "escaped", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``write_back`` for line tables (path, row_no, line), for sheets of any size.

    The header reaches the rows by a join on the sheet; the rows of a large sheet are split.
    """
    rows = rows.withColumnRenamed("path", "sheet")
    header = rows.where(F.col("row_no") == header_row).select(
        "sheet", _column_codes(split_fields(F.col("line"), dialect)).alias("_codes"))
    hot = hot_keys(count_keys(rows, ["sheet"]), ["sheet"], hot_rows)
    headed = spread_join(rows, header, ["sheet"], ["row_no"], hot, "left")
    none = F.array().cast("array<string>")
    return _write_rows(headed.withColumn("_codes", F.coalesce("_codes", none)), translated, dialect)


def _column_codes(header: Column) -> Column:
    """Per column the code it is filled for. The first field of a header belongs to the keys."""
    codes = F.transform(header, utrim)
    return F.transform(codes, lambda code, i: F.when(
        (i > 0) & (F.array_position(F.slice(codes, 2, F.size(codes)), code) == i), code))


def _write_rows(rows: DataFrame, translated: DataFrame, dialect: str) -> DataFrame:
    joined = rows.join(_texts_per_row(translated), ["sheet", "row_no"], "left")
    joined = joined.withColumn("_fields", split_fields(F.col("line"), dialect))
    width = F.greatest(F.size("_fields"), F.size("_codes"))
    cells = F.transform(F.sequence(F.lit(0), width - 1), lambda i: csv_escape(F.coalesce(
        F.try_element_at("_new", F.get("_codes", i)), F.get("_fields", i), F.lit(""))))
    line = F.when(F.col("_new").isNull(), F.col("line")).otherwise(F.array_join(cells, ","))
    return joined.select("sheet", "row_no", line.alias("line"))


def quota_estimate(rows: DataFrame, n_langs: int, quota: int = FREE_QUOTA_CHARS) -> DataFrame:
    """Cost before a run: strings × 20 characters × languages, its share of the quota, and the exact sum."""
    counted = rows.agg(
        F.count(F.lit(1)).alias("strings"),
        F.coalesce(F.sum(utf16_length("english")), F.lit(0)).alias("_chars"),
    )
    estimated = F.col("strings") * CHARS_PER_STRING_ESTIMATE * n_langs
    return counted.select(
        "strings", F.lit(n_langs).alias("languages"), estimated.alias("estimated_chars"),
        (F.col("_chars") * n_langs).alias("exact_chars"),
        _percent(estimated, quota).alias("percent"), (estimated > quota).alias("exceeds"),
    )


def quota_usage(translated: DataFrame, quota: int = FREE_QUOTA_CHARS) -> DataFrame:
    """Characters used by a work list (sheet, row_no, english, lang, text) that has been translated, and
    the state of the quota after it. Texts without an answer use nothing."""
    used = _used(translated).agg(F.coalesce(F.sum(utf16_length("english")), F.lit(0)).alias("used"))
    return used.select(
        "used", (quota - F.col("used")).alias("remaining"), _percent(F.col("used"), quota).alias("percent"),
        *_flags(F.col("used"), quota),
    )


def quota_running(translated: DataFrame, quota: int = FREE_QUOTA_CHARS, block: int = 65_536) -> DataFrame:
    """sheet, row_no, english, used and the quota flags: characters used after each row of a sheet that
    got an answer, in row order."""
    rows = _used(translated).groupBy("sheet", "row_no", "english").agg(F.count(F.lit(1)).alias("_langs"))
    used = running_sum(
        rows, ["sheet"], F.floor(F.col("row_no") / block), "row_no", utf16_length("english") * F.col("_langs"), "used"
    )
    return used.drop("_langs").select("*", *_flags(F.col("used"), quota))


def _used(translated: DataFrame) -> DataFrame:
    return translated.where((F.col("english") != "") & F.col("text").isNotNull())


def _texts_per_row(translated: DataFrame) -> DataFrame:
    """One map per row; a row has one text per target language, so a gathered group is bounded."""
    return translated.where(F.col("text").isNotNull()).groupBy("sheet", "row_no").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("_new")
    )


def _percent(used: Column, quota: int) -> Column:
    return F.lit(100.0) if quota == 0 else used / quota * 100


def _flags(used: Column, quota: int) -> list[Column]:
    return [
        (_percent(used, quota) >= QUOTA_NEAR_PERCENT).alias("near"), (used >= quota).alias("exceeded")
    ]
