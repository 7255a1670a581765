import pandas as pd
import pytest
from pyspark.sql import functions as F

from stringloom.operators import translate
from stringloom.plans import flows


def rows(spark):
    return spark.createDataFrame([
        ("s", 1, "OK", {"app_fr": "old", "app_ar": ""}), ("s", 2, "", {"app_fr": "keep"}), ("s", 3, "bad", {}),
        ("s", 4, "OK", {}), ("s", 5, "Hi 😀", {"app_ar": "stay"}),
    ], "sheet string, row_no int, english string, translations map<string,string>")


def make_translator():
    def translator(frame):
        if (frame["english"] == "bad").any():
            raise RuntimeError("no")
        return frame.assign(text=frame["lang"] + ":" + frame["english"])

    return translator


def test_work_and_memory(spark):
    work = translate.translation_work(rows(spark).drop("translations"), ["app_fr", "app_ar"])
    assert work.count() == 8
    memory = spark.createDataFrame([("OK", "app_fr", "D'accord"), ("OK", "app_fr", "Oui")], "english string, lang string, text string")
    got = translate.translate_tm(work, memory).where("text is not null").select("row_no", "lang", "text")
    assert sorted(map(tuple, got.collect())) == [(1, "app_fr", "D'accord"), (4, "app_fr", "D'accord")]


def test_translator_errors_stay_with_their_text(spark):
    work = translate.translation_work(rows(spark).drop("translations"), ["app_fr"])
    texts = translate.translate_texts(work, make_translator())
    got = {r["english"]: (r["text"], r["error"]) for r in texts.collect()}
    assert got == {"OK": ("app_fr:OK", None), "Hi 😀": ("app_fr:Hi 😀", None), "bad": (None, "RuntimeError: no")}


def test_failing_batches_are_halved():
    sent = []

    def translator(frame):
        sent.extend(frame["english"])
        if (frame["english"] == "t5").any():
            raise RuntimeError("no")
        return frame.assign(text=frame["english"].str.upper()).iloc[::-1]

    batch = pd.DataFrame({"english": [f"t{i}" for i in range(64)], "lang": "app_fr"})
    got = translate.answer_batch(translator, batch)
    assert list(got["english"]) == list(batch["english"])
    assert list(got.loc[got["error"].notna(), "english"]) == ["t5"]
    assert all(got["text"].dropna() == got.loc[got["english"] != "t5", "english"].str.upper())
    assert len(sent) == 64 + 64 + 32 + 16 + 8 + 4 + 2


def test_answers_are_joined_to_what_was_asked(spark):
    def translator(frame):
        assert "text" not in frame
        frame["text"] = "x"  # the batch itself stays as it is
        kept = frame[frame["english"] != "bad"].iloc[::-1]
        extra = pd.DataFrame({"english": ["other"], "lang": ["app_fr"], "text": ["y"]})
        return pd.concat([kept, kept[kept["english"] == "OK"], extra])

    work = translate.translation_work(rows(spark).drop("translations"), ["app_fr"])
    got = {r["english"]: (r["text"], r["error"]) for r in translate.translate_texts(work, translator).collect()}
    assert got == {"OK": (None, "several answers"), "Hi 😀": ("x", None), "bad": (None, "no answer")}


def test_a_fault_in_the_translator_ends_the_job(spark):
    work = translate.translation_work(rows(spark).drop("translations"), ["app_fr"])
    with pytest.raises(Exception, match="NameError"):
        translate.translate_texts(work, lambda frame: undefined(frame)).collect()  # noqa: F821


def test_a_repeated_code_is_filled_once(spark):
    files = spark.createDataFrame([("s", "k\napp_fr,app_en,app_fr, app_fr\n \nkey,OK,a,b\n")], "path string, content string")
    memory = spark.createDataFrame([("OK", "app_fr", "Oui")], "english string, lang string, text string")
    for blank, row in (("trim", 3), ("empty", 4)):
        lines = flows.translate_sheets(files, ["app_fr"], memory, first=3, blank=blank)
        assert lines.where(f"row_no = {row}").first()["line"] == "key,OK,Oui,b"


def test_rows_from_memory_then_translator(spark):
    memory = spark.createDataFrame([("OK", "app_fr", "D'accord")], "english string, lang string, text string")
    done = flows.translate_rows(rows(spark), ["app_fr", "app_ar"], memory, make_translator())
    assert {r["row_no"]: r["translations"] for r in done.collect()} == {
        1: {"app_fr": "D'accord", "app_ar": "app_ar:OK"}, 2: {"app_fr": "keep"}, 3: {},
        4: {"app_fr": "D'accord", "app_ar": "app_ar:OK"}, 5: {"app_fr": "app_fr:Hi 😀", "app_ar": "app_ar:Hi 😀"}}
    only_memory = flows.translate_rows(rows(spark), ["app_fr"], memory)
    assert {r["row_no"]: r["translations"] for r in only_memory.collect()}[5] == {"app_ar": "stay"}


def test_quota(spark):
    estimate = translate.quota_estimate(rows(spark), 2, 100).first()
    assert tuple(estimate) == (5, 2, 200, 2 * 12, 200.0, True)
    work = translate.translation_work(rows(spark).drop("translations"), ["app_fr", "app_ar"])
    done = work.withColumn("text", F.expr("case when english <> 'bad' and (row_no < 5 or lang = 'app_fr') then 'x' end"))
    usage = translate.quota_usage(done, 13).first()
    assert tuple(usage) == (13, 0, 100.0, True, True)
    assert translate.quota_usage(done, 0).first()["percent"] == 100.0
    assert translate.quota_usage(done.limit(0), 10).first()["used"] == 0
    running = translate.quota_running(done, 10, block=2).orderBy("row_no")
    assert [tuple(r) for r in running.select("row_no", "used", "near", "exceeded").collect()] == [
        (1, 4, False, False), (4, 8, True, False), (5, 13, True, True)]


def test_languages(spark):
    langs = spark.createDataFrame([(i, c) for i, c in enumerate(["app_en", "app_es", "app_ar"] + [f"x{i}" for i in range(10)], 1)], "ord int, lang string")
    picked = lambda *a: [r["lang"] for r in translate.select_langs(langs, *a).orderBy("ord").collect()]
    assert picked("es_ar") == ["app_es", "app_ar"]
    assert len(picked("top10")) == 10 and len(picked("all")) == 13
    assert picked("numbers", [2, 99]) == ["app_es"]
    codes = spark.createDataFrame([("en",), ("Pt-Br",), ("xx",)], "lang string")
    assert [r["lang"] for r in translate.supported_langs(codes).collect()] == ["en", "Pt-Br"]


def test_sheets_are_written_back(spark):
    text = ",1\n,app_en,app_fr, app_ar\nKey,E,F,A\n\nok,OK\nb,bad,x,y\nc,,keep,\nd,\"a, b\",,z\ne,OK,old,old\n"
    files = spark.createDataFrame([("s.csv", text)], "path string, content string")
    memory = spark.createDataFrame([("OK", "app_fr", 'D"accord')], "english string, lang string, text string")
    lines = flows.translate_sheets(files, ["app_fr", "app_ar"], memory, make_translator(), last=7)
    assert [r["line"] for r in lines.orderBy("row_no").collect()] == [
        ",1", ",app_en,app_fr, app_ar", "Key,E,F,A", 'ok,OK,"D""accord",app_ar:OK', "b,bad,x,y", "c,,keep,",
        'd,"a, b","app_fr:a, b","app_ar:a, b"', "e,OK,old,old"]
    toggled = flows.translate_sheets(files, ["app_fr"], memory, dialect="toggle")
    assert toggled.where("row_no = 8").first()["line"] == 'e,OK,"D""accord",old'
