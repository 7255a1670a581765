"""Decontamination, quality, token files, mixing, WARC and the pipeline on small rows and the smallest tables."""

import base64
import hashlib
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stringloom.llm import decontaminate, mixing, quality, tokens, warc
from stringloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TOKENIZER = corpus_pipeline.TOKENIZER
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key int, size string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, 1, "x") for i, t, s in rows], DOCS).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())


def words(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_contamination(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten + " eleven"), (22, "Été À la"), (3, "the the the"), (4, None), (5, "--"), (None, "lone word"), (7, "lone word"),
             (8, "never seen here"), (9, "K")]
    docs = [(1, f"x {ten.upper()}. eleven y"), (2, "one,two-three four five six seven eight nine nope"), (3, "Été À la é"), (4, "été à la"),
            (5, "the the the the"), (6, None), (7, ""), (None, "a lone--word!"), (9, "the " * 5000), (9, "the " * 5000), (10, "K k")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, place int")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, wid int")
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[s : s + 10]) for s in range(max(1, len(w) - 9)) if w]
    want = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, w in windows:
            for s in range(len(own) - len(w) + 1):
                if own[s : s + len(w)] == w:
                    hit.update(range(s, s + len(w)))
                    found |= {str(item)} if item is not None else set()
        listed = ",".join(sorted(found))
        want.append((doc, len(own), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in decontaminate.contamination(frame, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    clean = decontaminate.contamination(frame, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)


def test_contamination_where_lower_case_depends_on_neighbours(spark):
    texts = ["ΠΑΣ.ΟΚ ΟΔΟΣ'Α ΝΟΜΟΣ:Β", "ΟΔΟΣ", "ΟΔΟΣ'Α", "AΣ.B", "ΜΑΣ", "İI I", "ΑΣ\u0301Α"]
    items = [(i, t) for i, t in enumerate(texts)]
    docs = [(i, f"x.{t}'y") for i, t in enumerate(texts)] + [(20 + i, f"{t.lower()} Α") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for doc, text in docs:
        own, hit, found = words(text), set(), 0
        for _, item in items:
            w = words(item)
            at = [s for s in range(len(own) - len(w) + 1) if own[s : s + len(w)] == w]
            found += bool(at)
            hit.update(p for s in at for p in range(s, s + len(w)))
        assert got[doc] == (len(hit), found), text


def test_proximity(spark):
    frame = spark.createDataFrame([(1, "red big fox jumps"), (2, "red fox jumps"), (3, "red a b c fox jumps")], "doc_id long, text string")
    windows, _ = decontaminate.benchmark_windows(spark.createDataFrame([(1, "red fox jumps")], "item_id long, text string"))
    terms = decontaminate.vocabulary(windows)
    index = decontaminate.build_index(frame, terms)
    ids = index.select("key", "doc_id").distinct()
    near = decontaminate.proximity_matches(index, windows, terms, 1).join(ids, "key")
    assert {r["doc_id"] for r in near.collect()} == {1, 2}


def test_no_python_on_the_native_path(spark, capsys):
    decontaminate.contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.classify(docs, labels).join(labels, "doc_id").where("held_out")
    n, right, kept = scored.agg(
        F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int")),
        F.sum(((F.col("predicted") == 1) & (F.col("quality") == 1)).cast("int"))).first()
    good = scored.where("quality = 1").count()
    assert right / n > 0.98 and kept / good > 0.99


def test_quality_without_labels_and_odd_texts(spark):
    docs = table(spark, [(1, None, "a"), (2, "", "a"), (None, "word " * 40_000, "a"), (1, None, "a")])
    none = spark.createDataFrame([(1, None), (2, 7)], "doc_id long, quality int")
    rows = quality.classify(docs, none).collect()
    assert len(rows) == 4 and {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {1}
    some = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.classify(docs, some).collect())
    assert quality.classify(docs.limit(0), none).count() == 0


def test_isotonic():
    at, share = quality.isotonic(np.arange(5.0), np.array([0, 2, 1, 3, 3]), np.array([4, 4, 4, 4, 3]))
    assert np.all(np.diff(share) >= 0) and share[0] == 0 and share[-1] == 1


def test_rank_coding():
    draw = np.random.default_rng(3)
    for n in (0, 1, 7, 1000):
        ranks = (draw.integers(0, 1 << 32, n, np.uint64) >> draw.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = tokens.pack_ranks(ranks)
        assert len(control) == -(-n // 4) and np.array_equal(tokens.unpack_ranks(control, data, n), ranks)


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 50)
    texts = ["<|endoftext|> a<|startoftext|>b", "I'll don't 'SAY' it's", "İstanbul Σίσυφος ΣΑΣ ﬁ ½ x²", "a\x1cb\x85c d e　f",
             "don'T!!! $$$ 12345 a1b2", "", None, "\x00 nul", "😀👍🏽 日本語", "<| endoftext |> <|", "word " * 3000, "x" * 5000]
    rows = [(i * 3, t, "s") for i, t in enumerate(texts)] + [(None, "none", "s"), (6, "twin", "s"), (6, "twin", "s")]
    plain = Tokenizer.from_file(TOKENIZER)
    want, start = [], 0
    coded = [(i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows]
    for i, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0], len(x[1]))):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokens.token_digests(table(spark, rows), TOKENIZER).collect()]
    by_place = sorted(got, key=lambda r: r[1])
    assert [(r[0], r[1], r[2]) for r in by_place] == [(r[0], r[1], r[2]) for r in want]
    assert sorted((str(r[0]), r[3]) for r in got) == sorted((str(r[0]), r[3]) for r in want)
    assert tokens.token_digests(table(spark, rows).limit(0), TOKENIZER).count() == 0


def test_encoder_forgets_and_learns_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    own, plain = tokens.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = ["a b", "A b C", "a d", "b e f g h", "a b", "H\u0331 h\u0331 I\u0307 \u00c9TE", "<|ENDOFTEXT|> <|endoftext|>"]
    got = own.encode([t.encode() for t in texts], 2)
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def level(sizes):
    """Targets by dealing the excess again until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rows = [(i, "word\t" * (i % 37), ["é", "z", None, "a", "Z", ""][i * i % 6]) for i in range(400)]
    rows += [(7, None, "a"), (8, "twin x", "a"), (8, "twin x", "a"), (None, "w " * 3000, "z"), (999, "", "only empty")]
    docs = table(spark, rows)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "twin").collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    target = level(sizes)
    assert {round(r["target"], 6) for r in got} == {round(t, 6) for t in target.values()}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken = {}
    for r in got:
        taken.setdefault(round(r["target"], 6), []).append(r["taken"])
    for t, found in taken.items():  # sources of one weight may share a target
        share = sum(x for x in target.values() if round(x, 6) == t)
        assert abs(sum(found) - share) <= max(100, 0.03 * share)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken", "twin").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_small_sources_beside_a_hot_one_reach_their_targets(spark):
    sizes = {"hot": 3_000_000, "a": 5, "b": 900, "c": 5_000, None: 1, "none": 0}
    rows = [(i, "w " * 10_000, "hot") for i in range(300)] + [(1000, "w " * 5, "a"), (1001, "w", None), (1002, "", "none")]
    rows += [(2000 + i, "w " * 30, "b") for i in range(30)] + [(3000 + i, "w " * 100, "c") for i in range(50)]
    docs = table(spark, rows)
    target = {sizes[s]: round(t) for s, t in level(sizes).items()}
    found = mixing.mix(docs).groupBy("source_size").agg(F.sum("taken")).collect()
    assert {r[0]: r[1] for r in found} == target
    said = mixing.mixed_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in said} == {s: target[n] for s, n in sizes.items() if n}
    dealt = mixing.schedule(mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")), 4096)
    assert {r["source"] for r in dealt.collect()} == {s for s, n in sizes.items() if n}
    first = mixing.mix(docs).where("turn = 0").select("source_size").distinct().collect()
    assert {r[0] for r in first} == {n for n in sizes.values() if n}


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, f"w{i} " * (20 + i), "abc"[i % 3]) for i in range(60)] + [(5, "twin\nx", "a")] * 3
    docs = table(spark, rows)
    out = mixing.mixed_documents(docs).collect()
    said = sum(len((r["text"] or "").split()) for r in out)
    assert said == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    whole = {t for _, t, _ in rows}
    assert all(any(t.startswith(r["text"]) for t in whole) and r["n_chars"] == len(r["text"]) for r in out)


def test_slots_make_the_mix(spark, monkeypatch):
    """Without slots there is no mix; a document's words are those of its blocks; the mix stands in slot order."""
    rows = [(i, f"w{i} " * (20 + i), "abc"[i % 3]) for i in range(60)]
    docs = table(spark, rows)
    placed, met = mixing.pieces(docs)
    assert {r["taken"] for r in mixing.mix(docs).collect()} != {0}
    slots = {r["slot"] for r in met.collect()}
    assert min(slots) >= 0 and len(slots) > 50
    sums = {r["row"]: r["n"] for r in met.groupBy("row").agg(F.sum("words").alias("n")).collect()}
    taken = {(r["twin"], r["twin2"]): r["taken"] for r in mixing.mix(docs).collect()}
    assert {(r["twin"], r["twin2"]): sums.get(r["row"], 0) for r in placed.collect()} == taken
    first = {r["doc_id"]: r["slot"] for r in mixing.mix(docs).collect()}
    seen, order = set(), []
    for r in mixing.mixed_documents(docs).collect():  # in the order of the written rows
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            order.append(first[r["doc_id"]])
    assert order == sorted(order) and len(order) > 50
    schedule = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *args: schedule(*args).limit(0))
    assert {r["taken"] for r in mixing.mix(docs).collect()} == {0}
    assert mixing.mixed_documents(docs).count() == 0
    monkeypatch.setattr(mixing, "schedule", lambda *args: schedule(*args).where("turn % 2 = 0"))
    half = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert 0.45 < half / sum(taken.values()) < 0.6


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ", 2000)
    pages = [(i, f"http://x/{i} y\n", "same page" if i % 3 == 0 else "é" * (i * 40)) for i in range(40)]
    pages += [(3, "http://x/3 y\n", "same page"), (None, None, "same page"), (None, "u", "alone"), (50, "u", None), (51, "u", "")]
    frame = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, digest int").repartition(3)
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    want = []
    for page, _, html in pages:
        body = (html or "").encode()
        top = first.get(html or "")
        again = top is not None and page != top
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page, len(body), digest, "revisit" if again else "response", top if again else None))
    index, folder = warc.archive(frame)
    read = warc.read_records(index, folder)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in read.select(*names).collect()), key=repr) == sorted(want, key=repr)
    for r in read.where("record_type = 'response'").collect():
        assert len(r["payload"]) == r["payload_bytes"]
    some = warc.read_records(index.where("page_id in (1, 39)"), folder)
    assert {r["url"] for r in some.collect()} == {"http://x/1%20y%0A", "http://x/39%20y%0A"}
    every, at = warc.archive(frame, least=10**6)
    assert {r["record_type"] for r in warc.read_records(every, at).collect()} == {"response"}
    none, at = warc.archive(frame.limit(0))
    assert warc.read_records(none, at).count() == 0


def test_merged_ranges():
    rows = [{"file": f, "at": a, "bytes": b} for f, a, b in [("a", 0, 10), ("a", 10, 5), ("a", 200_000, 5), ("b", 0, 5)]]
    assert [len(run) for run in warc.merged(rows)] == [2, 1, 1]


def test_rows_are_judged_by_their_own_text(spark, monkeypatch):
    rows = [(None, "a b c", "s"), (None, "fine", "s"), (1, "a b c", "s"), (1, "fine", "s"), (2, None, "s"), (None, None, "s")]
    stay = sorted([(i, t) for i, t, _ in rows if t != "a b c"], key=repr)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    clean = decontaminate.keep_clean(table(spark, rows), items)
    assert sorted([(r["doc_id"], r["text"]) for r in clean.collect()], key=repr) == stay
    waves = np.zeros((len(quality.FEATURES), 1))
    waves[0] = 10  # the score falls with the size: only the text of five bytes is bad
    model = quality.QualityModel(waves=waves, weights=np.array([1.0, 0.0]), steps=(np.array([0.2, 0.21]), np.array([0.0, 1.0])))
    monkeypatch.setattr(quality, "fit", lambda rows: model)
    good = quality.keep_good(table(spark, rows), spark.createDataFrame([], "doc_id long, quality int"))
    assert sorted([(r["doc_id"], r["text"]) for r in good.collect()], key=repr) == stay


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)  # as written and read again
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == counts[4] and len({r["start"] for r in out}) == len(out)


# Names that the stages use themselves.
CLASHES = (
    "_bad", "_gone", "_id", "_own", "_row", "_shares", "_take", "_text", "_twin", "_twin2", "begin", "component", "cut",
    "features", "fingerprint", "fp", "key", "key2", "label", "node", "passes", "place", "quality", "rep", "score", "size",
    "taken", "target", "term", "twin", "twin2", "u", "v", "words",
)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_with_clashing_names_and_odd_rows(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    odd = [(None, "no id", "en", "web", 5), (900, None, None, None, None), (901, "", "en", None, 0), (901, "", "en", None, 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    step, columns = corpus_pipeline.STAGES[stage][1], docs.columns
    plain = step(spark, docs, SF)
    wide = step(spark, docs.withColumns({c: F.lit(c) for c in CLASHES}), SF)
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert wide.columns == [*columns, *CLASHES]
        assert all(r[c] == c for r in wide.collect() for c in CLASHES)
        assert step(spark, docs.limit(0), SF).count() == 0
    else:
        columns = plain.columns
    assert sorted(map(repr, wide.select(columns).collect())) == sorted(map(repr, plain.collect()))


def test_quality_against_a_dense_fit(spark):
    """The partition-summed fit is that of one matrix on one machine."""
    draw = np.random.default_rng(3)
    features = draw.uniform(size=(400, len(quality.FEATURES)))
    label = (features[:, 0] + 0.3 * draw.normal(size=400) > 0.5).astype(int)
    fold = draw.integers(0, 5, 400)
    rows = spark.createDataFrame(
        [(f.tolist(), int(y), int(k)) for f, y, k in zip(features, label, fold, strict=True)], "features array<double>, label int, fold long")
    model = quality.fit(rows.repartition(7), waves=32)
    x, y = features[fold != 0], label[fold != 0].astype(float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    again = np.random.default_rng(11)
    waves, shift = again.normal(size=(x.shape[1], 32)) / 3.0, again.uniform(0, 2 * np.pi, 32)
    lift = lambda f: np.hstack([np.sqrt(2 / 32) * np.cos(np.clip((f - mean) / scale, -6, 6) @ waves + shift), np.ones((len(f), 1))])
    z = lift(x)
    penalty = np.eye(33) * 1e-2 * len(x) / 32
    penalty[-1, -1] = 0
    weights = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(model.weights, weights, atol=1e-6)
    assert np.allclose(model.raw(features), lift(features) @ weights, atol=1e-6)
    at = np.clip(np.round((lift(features[fold == 0]) @ weights + 1) / 3 * 2048), 0, 2048) * 3 / 2048 - 1
    places, held = np.unique(at), label[fold == 0]
    steps = quality.isotonic(places, np.array([held[at == u].sum() for u in places]), np.array([(at == u).sum() for u in places]))
    assert np.allclose(model.steps[0], steps[0]) and np.allclose(model.steps[1], steps[1])


def test_isotonic_against_min_max():
    """Pool by pool, the fit is max over starts of min over ends of the mean between."""
    draw = random.Random(8)
    for _ in range(50):
        n = [draw.randint(1, 4) for _ in range(12)]
        ones = [draw.randint(0, k) for k in n]
        mean = lambda i, j: sum(ones[i : j + 1]) / sum(n[i : j + 1])
        fit = [max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        _, shares = quality.isotonic(np.arange(12.0), np.array(ones), np.array(n))
        assert np.allclose(sorted(set(np.round(fit, 9))), np.round(shares, 9))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_with_any_tokenizer(name):
    """A tokenizer that keeps blanks or case takes whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    own, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    assert own.by_word == (name == "word_bpe_49k.json")
    texts = ["Hello  World\n don't", "", "É x 12", "  a\t", "ÀB ab Ab"]
    got = own.encode([t.encode() for t in texts] + [None], 2)
    assert [x.tolist() for x in got] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts] + [[2]]


def test_token_files_roll_over(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, [(i, f"word{i} " * 30, "s") for i in range(40)]).coalesce(1)
    expected = sorted(map(tuple, tokens.token_digests(docs, path).collect()))
    monkeypatch.setattr(tokens, "FILE_BYTES", 100)
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 64)
    index, _, _ = tokens.token_files(docs, path)
    assert index.select("file").distinct().count() > 8
    assert sorted(map(tuple, tokens.token_digests(docs, path).collect())) == expected
