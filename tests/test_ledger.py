import os
import uuid

import pytest
from pyspark.sql import functions as F

from stringloom.operators import ledger, translate
from stringloom.operators.skew import prefix_sums
from stringloom.plans import flows


def work_of(spark, texts, langs=("app_fr",)):
    rows = [("s", i, t) for i, t in enumerate(texts, 1)]
    return translate.translation_work(spark.createDataFrame(rows, "sheet string, row_no int, english string"), list(langs))


def counting(folder, stop_after=None, refuse="no"):
    """A translator that notes every call in a folder and ends the job after some calls."""
    os.makedirs(folder, exist_ok=True)

    def translator(frame):
        if frame["english"].str.contains(refuse).any():
            raise ValueError("refused")
        if stop_after is not None and len(os.listdir(folder)) >= stop_after:
            raise NameError("ended midway")
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(frame["lang"] + "\t" + frame["english"]))
        return frame.assign(text=frame["lang"] + ":" + frame["english"])

    return translator


def sent(folder):
    return [line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split("\n")]


def states(result):
    return {(r["lang"], r["english"]): r["state"] for r in result.collect()}


def test_prefix_sums(spark):
    rows = [(i, (i * 7919) % 101) for i in range(1, 1000)]
    df = spark.createDataFrame(rows, "n int, x int").repartition(7)
    got = prefix_sums(df, ["n"], {"total": F.col("x"), "place": F.lit(1)}).orderBy("n").collect()
    total = 0
    for place, (row, (n, x)) in enumerate(zip(got, rows, strict=True), 1):
        total += x
        assert tuple(row) == (n, x, total, place)
    assert prefix_sums(df.limit(0), ["n"], {"total": F.col("x")}).collect() == []


def test_a_run_stops_at_its_quota(spark, tmp_path):
    texts = [f"t{i:03d}" for i in range(100)]  # four units each
    for quota, expected in ((0, 0), (3, 0), (4, 1), (101, 25), (10_000, 100)):
        folder = str(tmp_path / f"calls{quota}")
        result = ledger.translate_within_quota(
            work_of(spark, texts), counting(folder), str(tmp_path / f"ledger{quota}"), quota, call_texts=7)
        assert sorted(k[1] for k, s in states(result).items() if s == "answered") == texts[:expected]
        assert len(sent(folder)) == expected
        assert sum(len(line.split("\t")[1]) for line in sent(folder)) <= quota


def test_an_ended_run_goes_on(spark, tmp_path):
    texts = [f"text {i:03d}" for i in range(90)]
    work = work_of(spark, texts, ("app_fr", "app_ar")).coalesce(1)
    folder, book = str(tmp_path / "calls"), str(tmp_path / "ledger")
    with pytest.raises(Exception, match="ended midway"):
        ledger.translate_within_quota(work, counting(folder, stop_after=3), book, 10_000, call_texts=10)
    before = sent(folder)
    assert 0 < len(before) < 180
    answered = ledger.outcomes(ledger.read_events(spark, book)).where("text is not null").count()
    assert answered == len(before)  # every answer is kept
    result = ledger.translate_within_quota(work, counting(folder), book, 10_000, call_texts=10)
    assert set(states(result).values()) == {"answered"} and len(states(result)) == 180
    assert len(sent(folder)) == len(set(sent(folder))) == 180  # nothing answered was sent again
    again = ledger.translate_within_quota(work, counting(folder), book, 10_000, call_texts=10)
    assert len(sent(folder)) == 180 and sorted(map(tuple, again.collect())) == sorted(map(tuple, result.collect()))


def test_a_call_without_an_outcome_counts_as_spent(spark, tmp_path):
    """Killed between a call and its answer: the units may have been used, so they are not admitted anew."""
    book = str(tmp_path / "ledger")
    lost = work_of(spark, ["abcd", "efgh"]).toPandas().assign(units=4)[["english", "lang", "units"]]
    ledger.Events(book).put("lost-0", "sent", lost)
    assert ledger.spent(ledger.read_events(spark, book)) == 8
    result = states(ledger.translate_within_quota(work_of(spark, ["abcd", "efgh", "x"]), counting(str(tmp_path / "c")), book, 12))
    assert result == {("app_fr", "abcd"): "answered", ("app_fr", "efgh"): "over quota", ("app_fr", "x"): "over quota"}


def test_refused_texts_cost_nothing_and_wait(spark, tmp_path):
    texts = ["aa", "no1", "bb", "no2", "cc", ""]
    folder, book = str(tmp_path / "calls"), str(tmp_path / "ledger")
    run = lambda quota, **options: states(ledger.translate_within_quota(
        work_of(spark, texts), counting(folder), book, quota, **options))
    assert {k[1]: s for k, s in run(12).items()} == {
        "aa": "answered", "no1": "refused", "bb": "answered", "no2": "refused", "cc": "answered"}
    assert ledger.spent(ledger.read_events(spark, book)) == 6
    assert sorted(sent(folder)) == ["app_fr\taa", "app_fr\tbb", "app_fr\tcc"]
    accepting = counting(folder, refuse="never")
    result = ledger.translate_within_quota(work_of(spark, texts), accepting, book, 12, retry_refused=True)
    assert set(states(result).values()) == {"answered"}
    assert ledger.spent(ledger.read_events(spark, book)) == 12


def test_a_repeated_task_finds_its_answers(tmp_path):
    """The second attempt of a task makes the same calls and reads what the first one got."""
    import pandas as pd

    events, folder = ledger.Events(str(tmp_path / "ledger")), str(tmp_path / "calls")
    part = pd.DataFrame({"english": ["a", "b"], "lang": "app_fr", "units": [1, 1]})
    first = ledger._call(events, "run-0", part, counting(folder))
    assert events.get("run-0", "failed") is None and len(os.listdir(folder)) == 1
    again = events.get("run-0", "done")
    assert again.astype(str).equals(first[list(again.columns)].astype(str))


def test_compacted_ledger(spark, tmp_path):
    book, small, folder = str(tmp_path / "ledger"), str(tmp_path / "small"), str(tmp_path / "calls")
    work = work_of(spark, [f"t{i}" for i in range(30)] + ["no"])
    first = ledger.translate_within_quota(work, counting(folder), book, 40, call_texts=4)
    lost = work.limit(1).toPandas().assign(units=2)[["english", "lang", "units"]]
    ledger.Events(book).put("lost-0", "sent", lost)
    ledger.Events(book).put("twice-0", "done", lost.assign(text="x", error=None))
    ledger.compact_ledger(spark, book, small)
    old, new = ledger.read_events(spark, book), ledger.read_events(spark, small)
    assert ledger.spent(new) == ledger.spent(old)
    assert sorted(map(tuple, ledger.outcomes(new).collect()), key=repr) == sorted(map(tuple, ledger.outcomes(old).collect()), key=repr)
    assert first.where("state = 'over quota'").count() > 0


def test_flow_with_a_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, f"w{i}", {}) for i in range(6)], "sheet string, row_no int, english string, translations map<string,string>")
    memory = spark.createDataFrame([("w0", "app_fr", "known")], "english string, lang string, text string")
    done = flows.translate_rows(rows, ["app_fr"], memory, counting(str(tmp_path / "c")), ledger=str(tmp_path / "book"), quota=6)
    assert {r["row_no"]: r["translations"].get("app_fr") for r in done.collect()} == {
        0: "known", 1: "app_fr:w1", 2: "app_fr:w2", 3: "app_fr:w3", 4: None, 5: None}
