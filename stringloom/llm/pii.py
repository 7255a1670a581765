"""Personal data by bootstrapped contextual extraction.

Seeds are what strict patterns find: e-mail addresses, IP addresses, card numbers that pass Luhn and
phone numbers. Candidates are further identifiers (runs with digits or an at sign) that no seed covers.
The last word and the last two words before a place are its lexical patterns. In rounds, a pattern's
confidence in a kind is the mean score of its identifiers of that kind, times the share of its places in
the whole corpus where such an identifier follows; so a common word is no pattern, however many seeds it
met. An identifier's score is that of all its confident patterns together (one less the product of their
doubts). Only patterns with ``LEAST_SEEDS`` different seeds count. Identifiers whose score reaches
``ACCEPT``, and the seeds' own in another form, are found wherever they stand.

Texts are read once for places, and once more to count how often the patterns in question occur, if there
are any. Only places are joined, pre-aggregated to pairs of pattern and identifier. Scores are whole
numbers, so sums do not depend on order and reruns agree. The edges of a frequent pattern or identifier
are split over tasks.

Offsets are code points. A null text is empty. Rows that share an id are documents of their own; ids may
have any type. No rows give no rows. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stringloom.llm.common import arrow_rows, stage
from stringloom.operators.skew import count_keys, hot_keys, spread_join

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 5  # different seeds that make a pattern count
CONFIDENT, ACCEPT = 0.7, 0.9
PRIOR = 2  # identifiers of no kind that every pattern is taken to have met
_ONE = 1_000_000
_BITS = 1 << 20

# The forms of the seeds. Local parts and digits are found around their rarest character.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# A candidate: a word with a digit or an at sign, without the marks around it, and groups of digits that follow.
_HEAD = re.compile(r"[^\s\"'`<>(){}\[\],;|=]*+")
_TAIL = re.compile(r"[^\s\"'`<>(){}\[\],;|=]*+(?:(?:[\x20-]|\)[\x20-]?)[0-9(][0-9().-]*+)*+")
_EDGE = ".:!?*#$%&~_/\\"
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK, _OPENING = " \t\n\x0b\x0c\r", "\"'(<[{"
CONTEXT, LONGEST = 48, 254  # characters that a context reaches, and that an identifier has at most

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        found = _AT.match(text, at)
        if found:
            back = _LOCAL.match(text[end:at][::-1]).end()
            if back:
                end = found.end()
                yield at - back, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for found in _DOTTED.finditer(text):
        if found.group().count(".") < 3:
            continue
        at, parts = found.start(), found.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _DIGITS.finditer(text):
        if found.end() - found.start() >= 12:
            digits = found.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, found.group())) <= 15:
            yield found.span()


def seeds(text: str) -> list[Span]:
    """Spans of all kinds by start, then kind as listed."""
    if not _ANY.search(text):
        return []
    finders = (emails, addresses, cards, phones)
    return sorted(((kind, *span) for kind, find in enumerate(finders) for span in find(text)), key=lambda s: (s[1], s[0]))


def shapes(word: str) -> list[int]:
    """Kinds that a candidate may be of."""
    digits = sum("0" <= c <= "9" for c in word)
    out = []
    if "@" in word[1:-1]:
        out.append(0)
    if digits and re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:[:/][0-9]{1,5})?|(?=.*:.*:)[0-9A-Fa-f:.]{3,45}", word):
        out.append(1)
    if 12 <= digits <= 19 and re.fullmatch(r"[0-9][0-9 .-]*[0-9]", word):
        out.append(2)
    if 7 <= digits <= 15 and re.fullmatch(r"[0-9(][0-9 ().-]*[0-9]", word):
        out.append(3)
    return out


def identity(kind: int, word: str) -> str:
    """What equal identifiers share."""
    return word.lower() if kind < 2 else "".join(c for c in word if "0" <= c <= "9")


def candidates(text: str, found: list[Span]) -> Iterator[Span]:
    """Identifiers outside the seeds, once per kind that they may be of."""
    if not _ANY.search(text):
        return
    at = done = 0
    covered = sorted((a, b) for _, a, b in found)
    while match := _ANY.search(text, done):
        start = match.start() - _HEAD.match(text[done : match.start()][::-1]).end()
        end = done = _TAIL.match(text, match.start()).end()
        if start and text[start - 1] == "(" and ")" in text[start:end]:
            start -= 1
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE + "-":
            end -= 1
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if end - start > LONGEST or at < len(covered) and covered[at][0] < end:
            continue
        for kind in shapes(text[start:end]):
            yield kind, start, end


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: the last word before it, and the last two. Opening marks are skipped;
    a place inside a word has none, nor has one after a word that is longer than ``CONTEXT``."""
    while start and text[start - 1] in _OPENING:
        start -= 1
    if not start or text[start - 1] not in _BLANK:
        return []
    first = max(0, start - CONTEXT)
    words = [m.group() for m in _WORD.finditer(text, first, start)]
    if first and words and text[first - 1] not in _BLANK and text[first] not in _BLANK:
        del words[0]  # cut off
    return [" ".join(words[-n:]) for n in (1, 2) if len(words) >= n]


def count_contexts(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """``pattern, total``: places of the ``wanted`` patterns in all texts, whatever follows them.

    Tasks get a bit map of the patterns, which has one size whatever their number, and count what hits
    it; a hit that is no pattern finds no partner when the counts are joined.
    """
    keys = wanted.select("pattern").unionByName(wanted.select(F.regexp_extract("pattern", r"[^ ]+$", 0).alias("pattern")))
    bits = keys.select(F.xxhash64("pattern").bitwiseAND(F.lit(_BITS - 1)).alias("bit")).distinct().toPandas()["bit"].to_numpy()
    if not len(bits):
        return wanted.select("pattern", F.lit(0).cast("long").alias("total")).limit(0)
    marked = np.zeros(_BITS, bool)
    marked[bits] = True
    packed = np.packbits(marked).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)

        def hit(pattern: str) -> bool:
            return bool(marks[xxhash.xxh64_intdigest(pattern.encode(), 42) & (_BITS - 1)])

        for _, texts in arrow_rows(batches, "text"):
            rows = [_WORD.findall((raw or b"").decode("utf-8", "replace")) for raw in texts]
            ends = {w for w in {w for words in rows for w in words} if hit(w)}
            counts: Counter[str] = Counter()
            for words in rows:
                at = [i for i, w in enumerate(words) if w in ends]
                counts.update(words[i] for i in at)
                counts.update(f"{words[i - 1]} {words[i]}" for i in at if i)
            counts = {p: n for p, n in counts.items() if hit(p)}
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             ["pattern", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "pattern string, n bigint")
    return rows.groupBy("pattern").agg(F.sum("n").alias("total"))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


_ROWS = ("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, "
         "kind int, first bigint, end bigint, seed boolean, identity string, patterns array<string>")


def read_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document (kind null) and one per occurrence of a seed or a candidate; written once."""
    schema = pa.schema([
        ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()),
        ("base_sha256", pa.string()), ("base", pa.string()), ("kind", pa.int32()), ("first", pa.int64()),
        ("end", pa.int64()), ("seed", pa.bool_()), ("identity", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow_rows(batches, "text"):
            owners, rows = [], []
            for i, raw in enumerate(texts):
                plain = (raw or b"").decode("utf-8", "replace")
                found = seeds(plain)
                base = listed(found)
                counts = [0] * len(KINDS)
                for kind, _, _ in found:
                    counts[kind] += 1
                owners.append(i)
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), base, *[None] * 6))
                for seed, spans in ((True, found), (False, candidates(plain, found))):
                    for kind, start, end in spans:
                        owners.append(i)
                        rows.append((*[None] * 6, kind, start, end, seed, identity(kind, plain[start:end]),
                                     contexts(plain, start, end)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            own = batch.select(["row", "doc_id"]).take(pa.array(owners))
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], ["row", "doc_id", *schema.names])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                       F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"row bigint, doc_id {kind}, {_ROWS}"), "spans")


def _doubt(confidence: Column) -> Column:
    """Doubt in parts of a million, as a logarithm that whole numbers can add up."""
    return F.round(F.log(F.greatest(1 - confidence / _ONE, F.lit(1e-6))) * _ONE).cast("long")


def score(edges: DataFrame, patterns: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind, identity, score`` in parts of a million, the ``known(kind, identity)`` with all of them.

    Each round scores the patterns (``kind, pattern, reach``) by their identifiers in
    ``edges(kind, pattern, identity)``, then the identifiers by their patterns.
    """
    by_identity, by_pattern = ["kind", "identity"], ["kind", "pattern"]
    hot_identity = stage(hot_keys(count_keys(edges, by_identity), by_identity), "hot")
    hot_pattern = stage(hot_keys(count_keys(edges, by_pattern), by_pattern), "hot")
    known = known.withColumn("score", F.lit(_ONE).cast("long"))
    scores = known
    for _ in range(rounds):
        held = spread_join(edges, scores, by_identity, ["pattern"], hot_identity, "left")
        means = held.groupBy(*by_pattern).agg(
            F.floor(F.sum(F.coalesce("score", F.lit(0))) / (F.count(F.lit(1)) + PRIOR)).alias("mean"))
        confidence = F.floor(F.col("mean") * F.col("reach") / _ONE).cast("long")
        sure = means.join(patterns, by_pattern).where(confidence >= round(CONFIDENT * _ONE)).select(
            *by_pattern, _doubt(confidence).alias("doubt"))
        met = spread_join(edges, sure, by_pattern, ["identity"], hot_pattern)
        new = met.groupBy(*by_identity).agg(
            F.floor((1 - F.exp(F.sum("doubt") / _ONE)) * _ONE).cast("long").alias("score"))
        scores = stage(known.unionByName(new.join(known.select(*by_identity), by_identity, "left_anti")), "scores")
    return scores


def find_personal_data(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS,
    accept: float = ACCEPT,
) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found`` per row of ``docs``.

    The counts and ``base_sha256`` are those of the seeds; ``spans`` has the found identifiers too, and
    ``n_found`` their number. A place that is accepted for several kinds is listed for each.
    """
    rows = read_texts(docs, doc_id, text)
    places = rows.where(F.col("kind").isNotNull()).select("row", "kind", "first", "end", "seed", "identity", "patterns")
    known = stage(places.where("seed").select("kind", "identity").distinct(), "known")
    edges = places.select("kind", "identity", "seed", F.explode("patterns").alias("pattern")).groupBy(
        "kind", "pattern", "identity").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    edges = stage(edges, "edges")
    # Patterns with seeds enough that also met something else; no others can find anything.
    wanted = stage(edges.groupBy("kind", "pattern").agg(
        F.count_if("seed").alias("seeds"), F.count_if(~F.col("seed")).alias("others"), F.sum("n").alias("n"),
    ).where((F.col("seeds") >= least_seeds) & (F.col("others") > 0)).select("kind", "pattern", "n"), "patterns")
    reach = F.floor(F.col("n") * _ONE / F.greatest("n", "total")).cast("long")
    patterns = stage(wanted.join(count_contexts(docs, wanted, text), "pattern").select("kind", "pattern", reach.alias("reach")), "reach")
    kept = stage(spread_join(edges.drop("seed", "n"), patterns.select("kind", "pattern"), ["kind", "pattern"], ["identity"],
                             hot_keys(count_keys(edges, ["kind", "pattern"]), ["kind", "pattern"]), "left_semi"), "edges")
    scores = score(kept, patterns, known, rounds)
    good = stage(scores.where(F.col("score") >= round(accept * _ONE)).select("kind", "identity"), "accepted")
    open_places = places.where(~F.col("seed"))
    pair = ["kind", "identity"]
    new = spread_join(open_places, good, pair, ["row", "first"], hot_keys(count_keys(open_places, pair), pair), "left_semi")
    new = stage(new.select("row", "kind", "first", "end", "seed"), "found")
    # Only documents with a new span get their list made anew; a list is as long as its text allows.
    base = places.where("seed").join(new.select("row").distinct(), "row", "left_semi").select("row", "kind", "first", "end", "seed")
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    told = base.unionByName(new).select(
        "row", "seed", F.struct("first", "kind", "end", F.concat_ws(":", names, "first", "end").alias("shown")).alias("span"))
    lists = told.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("span")), lambda s: s["shown"]), ",").alias("all"),
        F.count_if(~F.col("seed")).alias("n_found"))
    own = rows.where(F.col("kind").isNull()).select("row", "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base")
    return own.join(lists, "row", "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.coalesce("all", "base").alias("spans"),
        F.coalesce("n_found", F.lit(0)).alias("n_found"))
