"""Cross-tokenizer alignment against both tokenizers over whole texts."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stringloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["Hello", "the", " ", "  ", "   ", "\n", "\n\n", "\t", " \n ", "é", "ñandú", "漢字", "🙂", "<|endoftext|>", "<s>", "</s>",
         "<0x0A>", "<unk>", "▁", "don't", "'s", "1234567", "x" * 60, " ", "​", "᠎", "　", "\x1c", "\x85",
         "á", "\r\n", "...", "!!", "foo bar", "العربية", "﻿", "\x00"]


@pytest.fixture(scope="module")
def tokens():
    """Ids and bytes of both tokenizers, or nothing where the bytes are not those of the text."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    byte_of = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(rest)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def run(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [piece(i) for i in ids_b]
        whole = (" " + text).encode()
        return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None

    return run


def walk(ids_a, bytes_a, ids_b, bytes_b):
    """Groups and links, one token after the other."""
    groups, links = [([ids_a[0]], [ids_b[0]])], [(ids_a[0], ids_b[0])]
    i = j = 0
    end_a, end_b = len(bytes_a[0]), len(bytes_b[0])
    while i + 1 < len(ids_a) or j + 1 < len(ids_b):
        both = end_a == end_b
        if both:
            groups.append(([], []))
        if both or end_a < end_b:
            step = True
            i += 1
            groups[-1][0].append(ids_a[i])
        else:
            step = False
        old_a, old_b = end_a, end_b
        if step:
            end_a += len(bytes_a[i])
        if both or old_b < old_a:
            j += 1
            groups[-1][1].append(ids_b[j])
            end_b += len(bytes_b[j])
        links.append((ids_a[i], ids_b[j]))
    return groups, links


def brute(rows, tokens):
    found = [tokens(text) for _, text in rows]
    parts = [walk(*f) if f else ([], []) for f in found]
    held = collections.Counter(pair for _, links in parts for pair in set(links))
    most = collections.Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (doc, _), own, (groups, links) in zip(rows, found, parts, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, len(own[0]) if own else 0, len(own[2]) if own else 0, len(groups), len(links),
                    sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if own else ""))
    return sorted(out, key=repr)


def corpus(n, seed):
    draw = random.Random(seed)

    def text():
        return "".join(draw.choice(PARTS) + draw.choice([" ", "", " "]) for _ in range(draw.randint(1, 40)))

    rows = [(None if i % 9 == 0 else i, draw.choice([None, "", " ", "\n", "  a", "a  ", *(text() for _ in range(6))])) for i in range(n)]
    return rows + rows[:20]


def aligned(spark, rows, kind="long"):
    docs = spark.createDataFrame([(*r, 1, b"x", 2) for r in rows], f"doc_id {kind}, text string, radix int, body binary, batch int")
    return sorted([tuple(r) for r in alignment.align(docs.repartition(5), A, B).collect()], key=repr)


def test_alignment(spark, tokens, monkeypatch):
    """Odd blanks, special strings as text, texts without tokens, null and repeated ids, repeated rows, clashing columns."""
    rows = corpus(700, 3)
    expected = brute(rows, tokens)
    assert aligned(spark, rows) == expected
    monkeypatch.setattr(alignment, "FAN_IN", 2)  # merges of merges, counts dealt to several tasks
    assert aligned(spark, rows) == expected


def test_few_rows(spark, tokens):
    assert aligned(spark, []) == []
    for rows in ([(1, None)], [(1, "")], [(1, "one")], [(2, "▁"), (3, "two two")]):
        assert aligned(spark, rows) == brute(rows, tokens)
    text_ids = [("a", "one two"), (None, "two")]
    assert aligned(spark, text_ids, "string") == brute(text_ids, tokens)


def test_long_text_and_frequent_pair(spark, tokens):
    """A text of a megabyte, a word without blanks, and one pair in all documents."""
    draw = random.Random(1)
    long = " ".join("".join(draw.choice("abcde") for _ in range(draw.randint(1, 9))) for _ in range(200_000))
    rows = [(1, long), (2, "ab" * 20_000), *((i, "the") for i in range(3, 600))]
    assert aligned(spark, rows) == brute(rows, tokens)


def test_forgetting_changes_nothing(tokens, monkeypatch):
    own = alignment.Aligner(A, B)
    texts = [(t or "").encode() for _, t in corpus(60, 5)]
    expected = alignment._batch(own, texts)
    monkeypatch.setattr(alignment, "CACHE_WORDS", 10)
    monkeypatch.setattr(alignment, "LEARN_WORDS", 7)
    columns, runs = alignment._batch(own, texts)
    assert {k: list(v) for k, v in columns.items()} == {k: list(v) for k, v in expected[0].items()} and runs == expected[1]


def test_merge_runs(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 3)
    draw, bodies, total = random.Random(2), [], collections.Counter()
    for _ in range(9):
        codes = sorted(draw.sample(range(60), draw.randint(0, 40)))
        docs = [draw.randint(1, 9) for _ in codes]
        total.update(dict(zip(codes, docs, strict=True)))
        bodies.append(alignment.pack_run(np.array(codes, np.uint64), np.array(docs, np.uint64)))
    merged = [(c, n) for codes, docs in alignment.merge_runs(bodies) for c, n in zip(codes.tolist(), docs.tolist(), strict=True)]
    assert merged == sorted(total.items())
    assert list(alignment.merge_runs([])) == []
