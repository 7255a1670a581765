"""Suffix, line, fingerprint and vector dedup against brute force on small rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from stringloom.llm import embeddings, lines, repeats, simhash
from stringloom.llm.common import stage
from stringloom.llm.components import connected_components

TOP = 2**63 - 1
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, kept int, batch string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], DOCS).repartition(4)


def plain(rows):
    return sorted([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows], key=repr)


def covered(docs, length):
    first = {}
    texts = [(TOP if i is None else i, (t or "").encode()) for i, t in docs]
    for key, b in texts:
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], TOP), key)
    out = []
    for (doc, _), (key, b) in zip(docs, texts, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((doc, len(b), sum(gone), runs, bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return plain(out)


@pytest.mark.parametrize("length", [50, 20])
def test_repeats(spark, length):
    draw = random.Random(length)
    base = ["".join(draw.choice("ab é\n") for _ in range(draw.randint(0, 400))) for _ in range(20)]

    def part():
        at = draw.randint(0, 300)
        return draw.choice(base)[at : at + draw.randint(1, 160)]

    docs = [(draw.choice([i, i, i, i // 2, None]), draw.choice(["".join(part() for _ in range(3))] * 4 + ["ab" * 90, None, ""]))
            for i in range(150)]
    assert plain(repeats.remove_repeats(table(spark, docs), length=length).collect()) == covered(docs, length)


def test_repeats_in_a_text_longer_than_a_piece(spark):
    draw = random.Random(1)
    long = "".join(draw.choices("abcdefgh", k=9_000_000))
    seam = 4 << 20
    docs = [(1, long), (2, long[seam - 90 : seam + 90]), (3, "z" * 60)]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(table(spark, docs)).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"]) == (0, 180, 0)
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def key_of(line):
    key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    return key if len(key) >= 10 else None


def test_lines(spark):
    draw = random.Random(2)
    pool = ["  Hello World yes ", "hello world yes\t", "HELLO WORLD YES\r", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "éé", "short", "",
            "a b c d e f", "日本語日本語日本語日", "x" * 50]
    docs = [(draw.choice([i, i, i // 2, -i, None]),
             draw.choice(["\n".join(draw.choice(pool) for _ in range(draw.randint(0, 6)))] * 3 + [None, ""])) for i in range(80)]
    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if key_of(line):
                holders.setdefault(key_of(line), set()).add(TOP if doc is None else doc)
    want = []
    for doc, text in docs:
        own = (text or "").split("\n")
        stay = [x for x in own if not key_of(x) or len(holders[key_of(x)]) < 2
                or min(holders[key_of(x)]) == (TOP if doc is None else doc)]
        want.append((doc, len(own), len(own) - len(stay), "\n".join(stay)))
    assert plain(lines.drop_repeated_lines(table(spark, docs)).collect()) == plain(want)
    assert lines.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_perfect_hash():
    draw = np.random.default_rng(0)
    a, b = (draw.integers(0, 1 << 64, 50_000, np.uint64) for _ in range(2))
    found = lines.PerfectHash.build(a, b)
    again = lines.PerfectHash.unpack(*found.pack())
    assert np.array_equal(np.sort(again.places(a, b)), np.arange(50_000))
    assert lines.PerfectHash.build(a[:0], b[:0]).places(a[:3], b[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError, match="distinct"):
        lines.PerfectHash.build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


def test_every_close_pair_shares_a_masked_key():
    masks = simhash.covering_masks(4)
    draw = random.Random(4)
    for _ in range(3000):
        differ = sum(1 << i for i in draw.sample(range(64), draw.randint(0, 4)))
        assert any(not m & differ for m in masks)


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    shingles = [" ".join(words[j : j + 4]) for j in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    draw = random.Random(6)
    words = [f"w{i}É" for i in range(400)]
    docs = [(None, "A b"), (500, "a\tB"), (501, None), (502, " \n"), (502, " \n"), (503, "a b")]
    for group in range(12):
        own = draw.choices(words, k=300)
        for copy in range(6):
            text = list(own)
            for _ in range(copy // 2):
                text[draw.randrange(300)] = "new"
            docs.append((group * 10 + copy, " ".join(text)))
    prints = [fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))
    for _ in docs:
        for x in range(len(docs)):
            for y in range(len(docs)):
                if (prints[x] ^ prints[y]).bit_count() <= 4:
                    label[x] = label[y] = min(label[x], label[y])
    want = []
    for (doc, _), fp, mine in zip(docs, prints, label, strict=True):
        ids = [d for (d, _), other in zip(docs, label, strict=True) if other == mine and d is not None]
        want.append((doc, format(fp, "016x"), min(ids)))
    assert plain(simhash.near_duplicates(table(spark, docs)).collect()) == plain(want)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = {r["doc_id"] for r in simhash.keep_first(table(spark, docs)).collect()}
    assert kept == {d for d, _, top in want if d is None or d == top}


def test_odd_rows_of_near_copies(spark, monkeypatch):
    chain = {"a": 0, "b": 0b1111, "c": 0b11111111}  # b is 4 bits from both others, which are 8 apart
    far = {"x": 0xFFFFFFFF, "y": 0xFFFF << 48, "z": 0xFFFFFF << 20}
    monkeypatch.setattr(simhash, "text_fingerprint", lambda t, n=4, f=chain | far: f[t.decode()])
    docs = [(1, "a"), (None, "b"), (2, "c"), (3, "x"), (3, "x"), (4, "x"), (5, "y"), (5, "z"), (None, "b")]
    found = {(r["doc_id"], r["fingerprint"][-2:], r["component_id"]) for r in simhash.near_duplicates(table(spark, docs)).collect()}
    assert {(1, "00", 1), (None, "0f", 1), (2, "ff", 1)} <= found
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_first(table(spark, docs)).collect()]
    assert plain(kept) == plain([(1, "a"), (None, "b"), (3, "x"), (5, "y"), (5, "z")])


def test_hot_bucket_is_tiled(spark):
    """All fingerprints lie within a few bits of each other, so every table has one bucket of all rows."""
    draw = random.Random(8)
    fps = sorted({sum(1 << i for i in draw.sample(range(12), draw.randint(0, 3))) for _ in range(400)})
    rows = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, rep long")
    one, many = (
        {tuple(r) for r in connected_components(simhash.link_fingerprints(rows, tile_rows=t)).collect()} for t in (4096, 16))
    assert one == many == {(i, 0) for i in range(len(fps))}


def test_spread_fingerprints_are_never_broadcast(spark):
    """The rows of all masks are many times what Spark takes the fingerprints for, however few those seem."""
    rows = stage(spark.createDataFrame([(i, i) for i in range(50)], "fp long, rep long"), "reps")
    plan = simhash.link_fingerprints(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


@pytest.mark.parametrize("tile", [1024, 8])
def test_embeddings(spark, tile):
    draw = np.random.default_rng(9)
    rows = []
    for label in (1, 2):
        for _ in range(12):
            center = draw.normal(size=16)
            for _ in range(draw.integers(1, 9)):
                rows.append([len(rows), (center * draw.uniform(0.5, 2) + draw.normal(size=16) * draw.choice([0, 0.1, 0.16])).tolist(), label])
    rows += [[len(rows) + i, list(rows[0][1]), 1] for i in range(20)]
    rows += [[1000, rows[0][1], None], [1001, None, 1], [1002, [0.0] * 16, 1], [1003, [float("nan")] * 16, 1], [1004, [], 1],
             [1005, [float("inf")] + [1.0] * 15, 2], [1006, [None] + [1.0] * 15, 2], [1007, [1.0, 0.0], 2], [1008, [2.0, 0.0], 2],
             [1009, [1e-30] * 16, 2], [1010, [1e30] * 16, 2], [5, rows[5][1], 1]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = [None if not v or any(c is None or not np.isfinite(c) for c in v) or not any(v) or label is None
         else np.array(v, np.float32).astype(float) for _, v, label in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and rows[i][2] == rows[j][2]:
                link[i, j] = x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98
    ids = np.array([r[0] for r in rows])
    name = ids.copy()
    for _ in range(n):
        name = np.minimum(name, np.where(link, name[None], TOP).min(axis=1))
    want = [(int(i), int(k), int(c), bool(i == c)) for i, k, c in zip(ids, link.sum(axis=1), name, strict=True)]
    assert plain(embeddings.near_duplicates(frame, tile=tile).collect()) == plain(want)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_long_texts_lose_no_line_and_no_fingerprint(spark):
    """A text of several megabytes beside short ones."""
    long = "\n".join(f"line number {i} of a long text" for i in range(120_000))
    rows = [(1, long), (2, "line number 77 of a long text\nown line here"), (3, long), (None, None)]
    docs = table(spark, rows)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.drop_repeated_lines(docs).collect()}
    assert got == {1: (120_000, 0), 2: (2, 1), 3: (120_000, 120_000), None: (1, 0)}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found[1] == found[3] and found[1][1] == 1 and found[2][1] == 2


def test_vectors_beside_columns_of_any_name(spark):
    rows = [(i, [1.0, 0.01 * (i % 3), 0.0], "a" if i % 2 else "b", "x", 1.0, True, 5) for i in range(12)]
    names = "vec_id long, embedding array<float>, label string, node string, weight double, usable boolean, key int"
    plain_rows = spark.createDataFrame(rows, names)
    bare = plain_rows.select("vec_id", "embedding", "label")
    assert sorted(map(tuple, embeddings.near_duplicates(plain_rows).collect())) == sorted(map(tuple, embeddings.near_duplicates(bare).collect()))
