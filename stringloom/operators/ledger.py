"""Translation that stops at its quota and goes on where it was ended.

The ledger is a folder of small files of JSON lines, one per event of a call to the translator: ``sent`` before it,
then ``done`` with the answers, or ``failed`` if all of it was refused. A file gets its name when it is
complete, so a run that is ended at any point leaves whole events. Reading the folder back gives what
was answered, what was refused, and how many units were spent.

Admission is a prefix of the texts in the order of their first rows: the running sum of their lengths over
the whole table, after what the ledger has spent, stays within the quota. Calls are cut from that order
too, so a task that runs again makes the same calls and finds the answers that it has already got.
"""

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import utf16_length
from ..plans.staging import stage
from .skew import prefix_sums
from .translate import PROGRAM_ERRORS, match_answers

EVENTS = "call string, event string, english string, lang string, units bigint, text string, error string"
CALL_TEXTS = 1_000
_PAIR = ["english", "lang"]


class Events:
    """The event files of a ledger, as a task sees them."""

    def __init__(self, ledger: str):
        uri = ledger if "://" in ledger else ledger.replace("file:/", "file:///", 1) if ledger.startswith("file:/") else None
        self.system, path = fs.FileSystem.from_uri(uri) if uri else (fs.LocalFileSystem(), ledger)
        self.folder = f"{path}/events"
        self.system.create_dir(self.folder, recursive=True)

    def put(self, call: str, event: str, rows: pd.DataFrame) -> None:
        """Write an event; it is there as a whole or not at all."""
        lines = rows.assign(call=call, event=event).to_dict("records")
        body = "".join(json.dumps({k: None if v is None or v != v else v for k, v in line.items()}) + "\n" for line in lines)
        hidden = f"{self.folder}/_{call}-{event}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(hidden) as out:
            out.write(body.encode())
        self.system.move(hidden, f"{self.folder}/{call}-{event}.json")

    def get(self, call: str, event: str) -> pd.DataFrame | None:
        path = f"{self.folder}/{call}-{event}.json"
        if self.system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.system.open_input_stream(path) as source:
            rows = [json.loads(line) for line in source.read().decode().splitlines()]
        return pd.DataFrame(rows, columns=[*_PAIR, "units", "text", "error"], dtype=object)


def read_events(spark: SparkSession, ledger: str) -> DataFrame:
    Events(ledger)  # makes the folder of a new ledger
    return spark.read.schema(EVENTS).json(f"{ledger}/events")


def outcomes(events: DataFrame) -> DataFrame:
    """english, lang, units, text, error: one row per text with an outcome; an answer counts before a refusal."""
    done = events.where(F.col("event") == "done")
    best = F.max(F.struct(F.col("text").isNotNull().alias("good"), "text", "error", "units"))
    return done.groupBy(*_PAIR).agg(best.alias("_best")).select(*_PAIR, "_best.units", "_best.text", "_best.error")


def spent(events: DataFrame) -> int:
    """Units of answered texts, and of calls without an outcome: those may have been answered too."""
    answered = events.where((F.col("event") == "done") & F.col("text").isNotNull()).select("units")
    ended = events.where(F.col("event") != "sent").select("call").distinct()
    doubt = events.where(F.col("event") == "sent").join(ended, "call", "left_anti").select("units")
    return answered.unionByName(doubt).agg(F.sum("units")).first()[0] or 0


def texts_in_order(work: DataFrame) -> DataFrame:
    """english, lang, sheet, row_no: the distinct texts of a work list with the first row that has them."""
    first = F.min(F.struct("sheet", "row_no")).alias("_first")
    return work.groupBy(*_PAIR).agg(first).select(*_PAIR, "_first.*")


def admit_texts(texts: DataFrame, quota: int, used: int = 0) -> DataFrame:
    """``texts`` (english, lang, sheet, row_no) with units, used, place and admitted.

    ``used`` runs over the whole table in row order and starts at what was spent before. Admitted are the
    texts up to the one that would go beyond the quota.
    """
    units = utf16_length("english").cast("long")
    counted = prefix_sums(
        texts.withColumn("units", units), ["sheet", "row_no", *_PAIR], {"used": F.col("units"), "place": F.lit(1)})
    return counted.withColumns({"used": F.col("used") + used}).withColumn("admitted", F.col("used") <= quota)


def send_texts(admitted: DataFrame, translate: Callable[[pd.DataFrame], pd.DataFrame], ledger: str, call_texts: int = CALL_TEXTS) -> DataFrame:
    """english, lang, units, text, error of ``admitted`` (english, lang, units, place), each call told to the ledger.

    A failing call is cut in halves until the texts that fail stand alone. Faults in the translator's code
    end the job.
    """
    run = uuid.uuid4().hex
    calls = admitted.select(*_PAIR, "units", "place", F.floor((F.col("place") - 1) / call_texts).alias("call"))

    def send(group: pd.DataFrame) -> pd.DataFrame:
        events, out = Events(ledger), []
        group = group.sort_values("place", kind="stable")
        waiting = [(f"{run}-{group['call'].iloc[0]:010d}", group[[*_PAIR, "units"]])]
        while waiting:
            name, part = waiting.pop()
            known = events.get(name, "done")
            if known is None and events.get(name, "failed") is None:
                known = _call(events, name, part, translate)
            if known is not None:
                out.append(known)
                continue
            half = len(part) // 2
            waiting += [(name + "b", part.iloc[half:]), (name + "a", part.iloc[:half])]
        return pd.concat(out)[[*_PAIR, "units", "text", "error"]]

    return calls.groupBy("call").applyInPandas(send, "english string, lang string, units bigint, text string, error string")


def _call(events: Events, name: str, part: pd.DataFrame, translate: Callable) -> pd.DataFrame | None:
    """The answers to one call, or nothing if all of a call of several texts was refused."""
    events.put(name, "sent", part)
    try:
        answer = translate(part[_PAIR].copy())
    except PROGRAM_ERRORS:
        events.put(name, "failed", part)
        raise
    except Exception as error:
        if len(part) > 1:
            events.put(name, "failed", part)
            return None
        told = part.assign(text=None, error=f"{type(error).__name__}: {error}")
    else:
        sent = part[_PAIR].assign(_call=0)
        told = match_answers(sent, answer[[*_PAIR, "text"]].assign(_call=0)).assign(units=part["units"].to_numpy())
    events.put(name, "done", told)
    return told


def translate_within_quota(
    work: DataFrame, translate: Callable[[pd.DataFrame], pd.DataFrame], ledger: str, quota: int,
    retry_refused: bool = False, call_texts: int = CALL_TEXTS,
) -> DataFrame:
    """english, lang, units, text, error, state of every distinct text of ``work`` (sheet, row_no, english, lang).

    ``state`` is ``answered``, ``refused`` or ``over quota``. What the ledger has is not sent again, refused
    texts only with ``retry_refused``; the quota holds for all runs with the same ledger together. The
    result is read from the ledger, so it is the same whether or not the run was ended in between.
    """
    spark = work.sparkSession
    texts = stage(texts_in_order(work), "texts")
    events = stage(read_events(spark, ledger), "events")
    known = outcomes(events)
    if retry_refused:
        known = known.where(F.col("text").isNotNull())
    rest = texts.join(known.select(*_PAIR), _PAIR, "left_anti")
    admitted = stage(admit_texts(rest, quota, spent(events)).where("admitted"), "admitted")
    send_texts(admitted, translate, ledger, call_texts).write.format("noop").mode("overwrite").save()
    told = outcomes(stage(read_events(spark, ledger), "events")).drop("units")
    state = F.when(F.col("text").isNotNull(), "answered").when(F.col("error").isNotNull(), "refused").otherwise("over quota")
    return texts.select(*_PAIR, utf16_length("english").cast("long").alias("units")).join(told, _PAIR, "left").withColumn("state", state)


def compact_ledger(spark: SparkSession, ledger: str, target: str) -> None:
    """A ledger with the same outcomes and the same spent units in few files, for runs after this one."""
    events = stage(read_events(spark, ledger), "events")
    known = outcomes(events)
    answered = events.where((F.col("event") == "done") & F.col("text").isNotNull())
    # A text that was answered twice was paid for twice.
    extra = answered.groupBy(*_PAIR).agg(F.sum("units").alias("all")).join(known, _PAIR).where("all > units")
    ended = events.where(F.col("event") != "sent").select("call").distinct()
    doubt = events.where(F.col("event") == "sent").join(ended, "call", "left_anti")
    paid = extra.select(F.lit("paid").alias("call"), F.lit("sent").alias("event"), *_PAIR, (F.col("all") - F.col("units")).alias("units"), *[
        F.lit(None).cast("string").alias(c) for c in ("text", "error")])
    done = known.select(F.lit("compacted").alias("call"), F.lit("done").alias("event"), *_PAIR, "units", "text", "error")
    done.unionByName(paid).unionByName(doubt).write.option("ignoreNullFields", "false").json(f"{target}/events")
