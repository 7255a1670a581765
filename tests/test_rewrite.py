import re
import time

from hypothesis import given, settings, strategies as st

from stringloom.operators import extract, quoted, rewrite
from stringloom.plans.staging import stage
from stringloom.sources import bundles


def entries(spark, *pairs):
    return spark.createDataFrame([(k, v, "a.arb", i) for i, (k, v) in enumerate(pairs)], "key string, value string, path string, ord int")


def code(spark, *texts):
    return spark.createDataFrame([(f"lib/f{i}.dart", t) for i, t in enumerate(texts)], "path string, content string")


def plan(spark, files, catalog, fmt="getx"):
    matched = rewrite.match_keys(rewrite.rewritable(extract.occurrences(files)), catalog)
    return rewrite.plan_replacements(matched, fmt)


def test_tiers(spark):
    catalog = entries(
        spark, ("upper", "GO"), ("exact", "Go"), ("later", "Go"), ("low1", "stop"), ("low2", "Stop"), ("trim", "a b"), ("Trim", "A B"))
    values = spark.createDataFrame([("Go",), ("gO",), ("STOP",), (" a b ",), (" A b ",), ("none",)], "value string")
    got = {r["value"]: (r["key"], r["tier"]) for r in rewrite.match_values(values, catalog).collect()}
    assert got == {"Go": ("exact", 1), "gO": ("upper", 2), "STOP": ("low1", 2), " a b ": ("trim", 3)}


def test_plan_and_misses(spark):
    files = code(spark, 'Text("Go")\nText("other")')
    files = files.unionByName(spark.createDataFrame([("lib/generated/x.dart", 'Text("Go")'), ("lib/App_Icons.dart", 'Text("Go")')], files.schema))
    matched = stage(rewrite.match_keys(rewrite.rewritable(extract.occurrences(files)), entries(spark, ("go", "Go"))), "matched")
    planned = rewrite.plan_replacements(matched, "arb")
    assert [tuple(r) for r in planned.collect()] == [("lib/f0.dart", 1, 1, 1, "Go", "AppLocalizations.of(context).go", "go")]
    assert [r["text"] for r in rewrite.plan_text(planned).collect()] == ["Line 1: - Go\n         + AppLocalizations.of(context).go"]
    missed = rewrite.missed_text(rewrite.missed_strings(matched))
    assert [r["text"] for r in missed.collect()] == ['lib/f0.dart:2 - "other"']
    assert [tuple(r) for r in rewrite.replacements_by_file(planned).collect()] == [("lib/f0.dart", 1)]


def test_review(spark):
    files = code(spark, "\n".join(f'Text("w {i}")' for i in range(25)))
    planned = stage(plan(spark, files, entries(spark, *((f"w{i}", f"w {i}") for i in range(25)))), "plan")
    batches = rewrite.review_batches(planned)
    assert {(r["batch"], r["count"]) for r in batches.groupBy("batch").count().collect()} == {(1, 10), (2, 10), (3, 5)}
    skips = spark.createDataFrame([("lib/f0.dart", 1, 2), ("lib/f0.dart", 1, 15), ("lib/f0.dart", 3, 21)], "path string, batch int, idx int")
    assert {r["idx"] for r in rewrite.drop_reviewed(batches, skips).collect()} == set(range(1, 26)) - {2, 21}


def apply_lines(content, steps):
    """Line-wise replacement as a loop."""
    lines = re.split("\r\n|\r|\n", content)
    if lines[-1] == "":
        lines.pop()
    applied = 0
    for line_no, original, new in steps:
        if line_no > len(lines):
            continue
        old = lines[line_no - 1]
        changed = old.replace(f'"{original}"', new)
        if changed == old:
            changed = old.replace(f"'{original}'", new)
        applied += changed != old
        lines[line_no - 1] = changed
    return "\n".join(lines), applied


SPACE = "[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]*"


def apply_text(content, steps):
    applied = 0
    for _, original, new in steps:
        for pattern in (f'"{re.escape(original)}"', f"'{re.escape(original)}'",
                        f'"{SPACE}{re.escape(original)}{SPACE}"', f"'{SPACE}{re.escape(original)}{SPACE}'"):
            changed = re.sub(pattern, lambda _: new, content)
            if changed != content:
                content = changed
                applied += 1
                break
    return content, applied


PIECES = [
    'Text("Go")', "Text('Go')", 'text: " Go "', "= 'go'", '= "a.b"', "return 'x(1)'", "\n", "\n\n", " ", "// 'Go' \"Go\"",
    "title: 'go', 'go'", '= "k\\\\E"', '"  a.b\t"',
]


@settings(max_examples=2, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=15, max_size=25))
def test_apply_against_loops(spark, texts):
    files = code(spark, *texts)
    catalog = entries(spark, ("go", "Go"), ("go", "go"), ("ab", "a.b"), ("x", "x(1)"), ("$k", "k\\\\E"))
    for fmt in ("getx", "arb"):
        planned = stage(plan(spark, files, catalog, fmt), "plan")
        steps = {}
        for r in planned.orderBy("path", "pattern_id", "match_ord").collect():
            steps.setdefault(r["path"], []).append((r["line_no"], r["original"], r["replacement"]))
        for apply, model in ((rewrite.apply_by_line, apply_lines), (rewrite.apply_by_content, apply_text)):
            got = {r["path"]: (r["content"], r["applied"]) for r in apply(files, planned).collect()}
            want = {p: model(texts[int(p[5:-5])], s) for p, s in steps.items()}
            assert got == {p: w for p, w in want.items() if w[1]}


def test_line_breaks(spark):
    files = code(spark, "a\r\nText(\"Go\")\r\nb\r\n", 'Text("Go")')
    got = {r["path"]: r["content"] for r in rewrite.apply_by_line(files, plan(spark, files, entries(spark, ("go", "Go")))).collect()}
    assert got == {"lib/f0.dart": "a\nText('go'.tr)\nb", "lib/f1.dart": "Text('go'.tr)"}


def test_bundle_to_plan(spark):
    bundle = spark.createDataFrame([("l10n/app_en.arb", '{"@@locale":"en","select_image":"Select Image"}')], "path string, content string")
    planned = plan(spark, code(spark, 'Text("Select Image")'), bundles.load_bundles(bundle), "arb")
    assert planned.first()["replacement"] == "AppLocalizations.of(context).select_image"


def test_files_without_a_plan_are_left_out_before_the_shuffle(spark, monkeypatch):
    files = code(spark, *(f'Text("w {i}")' for i in range(40)))
    planned = stage(plan(spark, files, entries(spark, ("w3", "w 3"), ("w7", "w 7"))), "plan")
    for apply in (rewrite.apply_by_line, rewrite.apply_by_content):
        monkeypatch.setattr(rewrite, "MOST_HASHES", 2)
        by_hash = apply(files, planned)
        assert "BroadcastHashJoin" in by_hash._jdf.queryExecution().toString()
        monkeypatch.setattr(rewrite, "MOST_HASHES", 1)
        assert sorted(by_hash.collect()) == sorted(apply(files, planned).collect())
        assert {r["path"] for r in by_hash.collect()} == {"lib/f3.dart", "lib/f7.dart"}
        assert apply(files, planned.limit(0)).count() == 0


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.sampled_from([*PIECES, '"', "'", "a", " a ", "b", '"a"', "'a'", '"a"b"', '""', "''", '"  "', "\u3000", '" \t', "\\"]), max_size=30).map("".join),
    st.lists(st.tuples(st.sampled_from(["a", "b", "", " ", " a", "a ", "Go", "go", "a.b", 'x"y', "b'", "\t"]),
                       st.sampled_from(["'a'.tr", "X", "", '"b"', "'", "a", "'go'.tr", '"a""a"', "'' \" a"])), max_size=12))
def test_pieces_against_the_loop(text, steps):
    """Replacements that make new hits, hits that share a quote, originals with quotes or blanks, empty ones."""
    assert quoted.replace_all(text, steps) == apply_text(text, [(0, *step) for step in steps])


def test_many_steps_cost_the_length_of_the_file():
    n = 10_000
    text = "\n".join(f'Text("word {i}"),' for i in range(n))
    start = time.process_time()
    new, applied = quoted.replace_all(text, [(f"word {i}", f"'key_{i}'.tr") for i in range(n)])
    assert applied == n and new == "\n".join(f"Text('key_{i}'.tr)," for i in range(n))
    hot = 'x("Go") ' * n
    new, applied = quoted.replace_all(hot, [("Go", "'go'.tr")] * n)
    assert applied == 1 and new == "x('go'.tr) " * n
    assert time.process_time() - start < 5


def test_a_replacement_that_stands_there_already():
    for text, step in (('"a"b"', ("b", '"b"')), ("'b'", ("b", "'b'")), ('" b "  b "', ("b", '" b "')), ('"x"y"', ('x"y', '"x"y"'))):
        assert quoted.replace_all(text, [step]) == apply_text(text, [(0, *step)]) == (text, 0)
