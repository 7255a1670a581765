"""Personal data: seeds against the plain patterns, contexts and scores against plain Python."""

import hashlib
import random
import re

import pytest

from stringloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id long, text string, kind int, row string, spans string, seed int"
WORDS = "lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor ut labore".split()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((n, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@pytest.mark.parametrize("letters", ["0123456789" * 3 + "..  --++@@()aZ%é\n_,", "0011223456789.. -+("])
def test_seeds(letters):
    draw = random.Random(len(letters))
    for _ in range(20_000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        assert pii.seeds(text) == brute(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + " 1", "a.b@" * 70_000, "+1(" + "(" * 300_000, "1." * 150_000, "1-" * 150_000, "@ " * 150_000):
        list(pii.candidates(text, pii.seeds(text)))


def phrase(draw):
    return " ".join(draw.choice(WORDS) for _ in range(draw.randint(2, 8)))


def card(draw):
    head = "".join(draw.choice("0123456789") for _ in range(15))
    return next(head + c for c in "0123456789" if luhn(head + c))


def corpus():
    draw = random.Random(9)
    rows = [(i, f"{phrase(draw)} card number: {card(draw)} {phrase(draw)}") for i in range(40)]
    rows += [(100 + i, f"{phrase(draw)} reach me at +1 ({200 + i}) 555-{draw.randint(1000, 9999)} {phrase(draw)}") for i in range(40)]
    rows += [(200 + i, f"mail to <u{i}@x.org> the v{i}@x.org {phrase(draw)} the {phrase(draw)} the") for i in range(40)]
    return rows + [
        (300, "our card number: 4111111111111112 ends"),  # fails Luhn, but stands where card numbers stand
        (301, "lorem 4111111111111112 again"),  # the same one elsewhere
        (302, "please reach me at (555) 123 4567!"),
        (303, "mail to <root@localhost> now"),
        (304, "the other@localhost"),  # "the" is a common word
        (305, "lorem 20240115 ipsum 999.1.1.1"),
        (306, "or 1 (200) 555-" + rows[40][1].split("555-")[1][:4]),  # a seed in another form
        (307, None), (307, ""), (None, "a@b.c"), (None, "a@b.c"), (308, "x" * 2_000_000 + " c@d.ef")]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "r", "s", 2) for r in rows], SCHEMA).repartition(6)
    return sorted([tuple(r) for r in pii.find_personal_data(docs, **options).collect()], key=repr)


def test_find_personal_data(spark):
    rows = corpus()
    extra = {300: "card:17:33", 301: "card:6:22", 302: "phone:19:33", 303: "email:9:23", 306: "phone:3:19"}
    expected = []
    for doc, text in rows:
        # The plain pattern takes quadratic time on a long word.
        spans = [(0, len(text) - 6, len(text))] if doc == 308 else brute(text or "")
        shown = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for k, a, b in spans)
        counts = [sum(k == n for k, _, _ in spans) for n in range(4)]
        expected.append((doc, *counts, hashlib.sha256(shown.encode()).hexdigest(), extra.get(doc, shown), int(doc in extra)))
    assert found(spark, rows) == sorted(expected, key=repr)
    # Without rounds only what a seed has in another form is found.
    assert [r[0] for r in found(spark, rows, rounds=0) if r[-1]] == [306]


def test_empty(spark):
    assert found(spark, []) == []


def test_contexts():
    assert pii.contexts("call me 5", 8, 9) == ["me", "call me"]
    assert pii.contexts("x\n(5", 3, 4) == ["x"]
    assert pii.contexts("mail:5", 5, 6) == [] == pii.contexts("5", 0, 1)
    assert pii.contexts("y" * 60 + " z 5", 63, 64) == ["z"]  # a word cut off by the reach counts for nothing


def test_count_contexts(spark):
    texts = ["a b a b", "b  a\nb", None, "", "ab"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    wanted = spark.createDataFrame([(0, "b", 1), (0, "a b", 1), (1, "ab", 1), (1, "none", 1)], "kind int, pattern string, n long")
    counts = pii.count_contexts(docs, wanted)
    assert {tuple(r) for r in wanted.join(counts, "pattern").select("pattern", "total").collect()} == {("b", 4), ("a b", 3), ("ab", 1)}
    assert pii.count_contexts(docs, wanted.limit(0)).collect() == []


def test_score_rounds(spark):
    """A pattern that only a found identifier supports counts in the next round."""
    seeds = [(0, f"s{i}") for i in range(30)]
    edges = [(0, "p", i) for _, i in seeds] + [(0, "p", "new")] + [(0, "q", i) for _, i in seeds] + [(0, "q", "new"), (0, "q", "far")]
    patterns = [(0, "p", 1_000_000), (0, "q", 760_000)]
    args = [spark.createDataFrame(edges, "kind int, pattern string, identity string"),
            spark.createDataFrame(patterns, "kind int, pattern string, reach long"),
            spark.createDataFrame(seeds, "kind int, identity string")]
    one = {r["identity"]: r["score"] for r in pii.score(*args, rounds=1).collect()}
    two = {r["identity"]: r["score"] for r in pii.score(*args, rounds=2).collect()}
    p, q = 30_000_000 // 33 , 30_000_000 // 34 * 760_000 // 1_000_000
    assert one["s1"] == 1_000_000 and abs(one["new"] - p) <= 2 and "far" not in one and q < 700_000
    assert two["far"] >= 700_000 - 1 if (30_000_000 + one["new"]) // 34 * 760_000 // 1_000_000 >= 700_000 else "far" not in two
