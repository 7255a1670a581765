"""Benchmark decontamination by a positional inverted index, in DataFrame functions alone.

The index holds a posting (term, document, place) for every word of the corpus that the benchmark has
too. A window of a benchmark item is looked up from its rarest words: their postings, moved by the
word's place in the window, must meet in one start. What meets is compared word by word.

Words are compared with A-Z lower-cased. The index itself folds case further, which only adds
candidates: both sides are folded alike, word by word, since the lower case of a letter can depend on
its neighbours. So only texts with candidates have their A-Z folded as a whole. Null and empty texts have no words, and items without words no windows. Repeated document
rows get a row each; a null ``item_id`` hits but is not listed. Only the named columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from stringloom.llm.common import small, stage, without

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased as well as after
WINDOW = 10
RAREST = 2
END = ""  # no word is empty; its posting says how many words a document has


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def exact(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def folded(word: Column) -> Column:
    """The form of a single word under which the index has it, the same before and after A-Z are lower-cased."""
    return F.lower(word)


def benchmark_windows(
    items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW
) -> tuple[DataFrame, DataFrame]:
    """``wid, words, folded`` of every distinct window, and ``wid, item_id``.

    A window has 62 words at most, one bit of a long each.
    """
    if not 1 <= window <= 62:
        raise ValueError(f"a window of {window} words")
    words = F.explode(F.array(words_of(exact(F.col(text))))).alias("words")
    rows = items.select(F.col(item_id).alias("item_id"), words).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))
    rows = rows.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("words"))
    rows = rows.distinct()
    windows = stage(rows.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()).withColumn(
        "folded", F.transform("words", folded)), "windows")
    return windows, stage(rows.join(windows, "words").select("wid", "item_id"), "window-items")


def vocabulary(windows: DataFrame) -> DataFrame:
    """``term, term_id`` of every word of the windows, and of the end mark (-1)."""
    terms = windows.select(F.explode("folded").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id())
    end = terms.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(-1).cast("long").alias("term_id"))
    return stage(terms.unionByName(end), "terms")


def document_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits that rows share if they agree in id and text."""
    return [F.xxhash64(F.lit(i), doc_id, text).alias(name) for i, name in enumerate(("key", "key2"))]


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``term_id, row, place``, written without a shuffle. The end mark's also have ``doc_id, key, key2``."""
    words = F.concat(words_of(F.col(text)), F.array(F.lit(END)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), *document_key(doc_id, text),
                       words.alias("words"))
    rows = rows.select("row", "doc_id", "key", "key2", F.posexplode("words").alias("place", "term"))
    rows = rows.withColumn("term", folded(F.col("term")))
    known = small(terms, F.octet_length("term"))
    ends = [F.when(F.col("term_id") == -1, F.col(c)).alias(c) for c in ("doc_id", "key", "key2")]
    return stage(rows.join(known, "term").select("term_id", "row", "place", *ends), "postings")


def owners_of(index: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``key, key2`` in place of its ``row``; rows that agree share a key."""
    return found.join(index.where("term_id = -1").select("row", "key", "key2"), "row").drop("row").distinct()


def lookups(index: DataFrame, windows: DataFrame, terms: DataFrame, rarest: int | None = RAREST) -> DataFrame:
    """``term_id, wid, off, bit, full``: the rarest places of each window all of whose words occur."""
    counts = index.groupBy("term_id").agg(F.count(F.lit(1)).alias("n")).join(terms, "term_id")
    places = windows.select("wid", F.size("words").alias("len"), F.posexplode("folded").alias("off", "term"))
    places = places.join(counts, "term")
    whole = Window.partitionBy("wid")
    order = whole.orderBy("n", "off")
    places = places.withColumn("found", F.count(F.lit(1)).over(whole)).where("found = len")
    places = places.withColumn("nth", F.row_number().over(order) - 1)
    if rarest is not None:
        places = places.where(F.col("nth") < rarest)
    used = F.col("len") if rarest is None else F.least("len", F.lit(rarest))
    power = F.expr("shiftleft(1L, nth)")
    return stage(places.withColumn("used", used).select(
        "term_id", "wid", "off", power.alias("bit"), F.expr("shiftleft(1L, used) - 1").alias("full")), "lookups")


def intersect(index: DataFrame, lookup: DataFrame, slop: int = 0) -> DataFrame:
    """``row, wid, start`` where the postings of all looked-up places meet, ``slop`` words apart at most."""
    found = index.join(small(lookup, F.lit(0)), "term_id").withColumn("start", F.col("place") - F.col("off"))
    if slop:
        found = found.withColumn("start", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)))
    met = found.where("start >= 0").groupBy("row", "wid", "start").agg(
        F.bit_or("bit").alias("bits"), F.first("full").alias("full"))
    return met.where("bits = full").select("row", "wid", "start")


def phrase_matches(
    docs: DataFrame, index: DataFrame, windows: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, key2, wid, start, len``: every place of a document at which a whole window stands."""
    candidates = owners_of(index, intersect(index, lookups(index, windows, terms)))
    lengths = windows.select("wid", F.size("words").alias("len"))
    candidates = candidates.join(lengths, "wid").groupBy("key", "key2").agg(
        F.collect_list(F.struct("wid", "start", "len")).alias("places"))  # of one document's words
    rows = docs.select(*document_key(doc_id, text), F.col(text).alias("text")).join(candidates, ["key", "key2"])
    # The explode keeps the split from being worked out anew for each place.
    rows = rows.select("key", "key2", "places", F.explode(F.array(words_of(exact(F.col("text"))))).alias("words"))
    cut = F.transform("places", lambda p: F.struct(
        p["wid"].alias("wid"), p["start"].alias("start"), p["len"].alias("len"),
        F.slice(F.col("words"), p["start"] + 1, p["len"]).alias("seen")))
    rows = rows.select("key", "key2", F.explode(cut).alias("p")).select("key", "key2", "p.*")
    same = windows.select(F.col("wid").alias("_wid"), "words")
    met = rows.join(same, (F.col("wid") == F.col("_wid")) & (F.col("seen") == F.col("words")))
    return met.select("key", "key2", "wid", "start", "len").distinct()


def proximity_matches(index: DataFrame, windows: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """``key, key2, wid, start``: all words of a window, each at most ``slop`` words from its place."""
    return owners_of(index, intersect(index, lookups(index, windows, terms, rarest=None), slop))


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row per row of ``docs``."""
    return _judged(docs, items, doc_id, text, item_id, item_text, window).drop("key", "key2")


def _judged(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """The columns of :func:`contamination`, with ``key, key2`` of the row."""
    windows, owners = benchmark_windows(items, item_id, item_text, window)
    terms = vocabulary(windows)
    index = build_index(docs, terms, doc_id, text)
    matches = stage(phrase_matches(docs, index, windows, terms, doc_id, text), "matches")
    hit = matches.select("key", "key2", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("place"))
    hits = hit.distinct().groupBy("key", "key2").agg(F.count(F.lit(1)).alias("hit"))
    listed = matches.select("key", "key2", "wid").distinct().join(owners, "wid").groupBy("key", "key2").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("listed"))
    found = hits.join(listed, ["key", "key2"])
    rows = index.where("term_id = -1").select("doc_id", "key", "key2", F.col("place").cast("long").alias("n_words"))
    n_hit, listed = F.coalesce("hit", F.lit(0)), F.coalesce("listed", F.array().cast("array<string>"))
    return rows.join(found, ["key", "key2"], "left").select(
        "key", "key2", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window stands, each judged by its own text."""
    return without(docs, _judged(docs, items).where("contaminated"), document_key())
