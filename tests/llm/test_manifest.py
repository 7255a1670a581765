"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stringloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, tree string, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for row in tree[:-1]:
        first = i // 3 * 3
        run = row[first : first + 3]
        out.append((run[: i - first], run[i - first + 1 :]))
        i //= 3
    return out


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append((row, leaf(row[0], row[3], row[2], row[4], row[1])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))
    trees = {s: levels([d for _, d in by[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (row, own) in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(row[0], s, row[2], row[4], text)
            for left, right in path:
                node = sha("".join(left) + node + "".join(right))
            proof = sha("".join(x for left, right in path for x in left + right))
            out.append((row[0], own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "t", "d") for r in rows], SCHEMA).repartition(5)


def verified(docs):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    manifest = merkle.build_manifest(docs, altered=F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))
    return sorted([tuple(r) for r in merkle.verify(manifest).collect()], key=repr)


def corpus(n):
    draw = random.Random(n)
    ids = [draw.choice([i, i, i, None if i % 50 == 0 else i // 2]) for i in range(n)]
    texts = ["a\nb", "", None, "é\n\n", "long " * 40_000]
    rows = [(i, draw.choice(texts), draw.choice(["en", None]), draw.choice([None, "s", "s", "s", "t", "é", "z", f"q{i}"]),
             draw.choice([1, None])) for i in ids]
    return rows + rows[:5] * 3


@pytest.mark.parametrize("n", [1, 3, 40, 900])
def test_manifest(spark, n):
    """Hot source, null and repeated ids, repeated rows, a very long text, sources of one row, clashing columns."""
    rows = corpus(n)
    assert verified(table(spark, rows)) == brute(rows)


def test_empty(spark):
    assert verified(table(spark, [])) == []


def test_requests(spark):
    """Some leaves only: the same proofs as in the proofs of all."""
    manifest = merkle.build_manifest(table(spark, corpus(300)))
    every = {(r["tree"], r["rank"]): (r["digest"], r["path"]) for r in merkle.prove(manifest).collect()}
    wanted = [t for i, t in enumerate(sorted(every)) if i % 37 == 0]
    some = merkle.prove(manifest, spark.createDataFrame(wanted, "tree long, rank long")).collect()
    assert {(r["tree"], r["rank"]): (r["digest"], r["path"]) for r in some} == {t: every[t] for t in wanted}


def test_store_holds_a_node_once(spark):
    """Equal subtrees share their record."""
    rows = [(1, "same", "en", "s", 4)] * 81
    manifest = merkle.build_manifest(table(spark, rows))
    assert [manifest.source_store[k].count() for k in (1, 2, 3, 4)] == [1, 1, 1, 1]
    assert verified(table(spark, rows)) == brute(rows)


def test_depth(spark):
    for n, steps in ((1, 0), (2, 1), (3, 1), (4, 2), (9, 2), (10, 3), (3**20, 20), (3**20 + 1, 21)):
        assert spark.range(1).select(merkle.depth(F.lit(n).cast("long"))).first()[0] == steps
