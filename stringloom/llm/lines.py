"""Line dedup: documents probe a sharded minimal perfect hash over all distinct line keys.

A key is a line without blanks at its ends, A-Z lower-cased; keys shorter than ``least`` code points
count for nothing. A shard maps each of its keys to a place of its own, where arrays hold the key's
fingerprint, the number of its documents and the smallest of their ids. A document's line goes if its
key stands in two documents at least and the smallest is another.

Document ids are integers. Keys are told apart by 128 bits, half of which is the stored fingerprint. A null or empty text is one
empty line. Rows that share an id are one document; a null id counts as the largest, and rows without
an id are one document too. Empty tables give no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stringloom.llm.batches import Bodies, Documents, pack_arrays, questions, unpack_arrays, visit, write_batches
from stringloom.llm.common import stage, width

LEAST = 10
SHARD_KEYS = 200_000
_ROOM = 2  # bits of a level per key still without a place


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a ^ b * np.uint64(2 * level + 0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash: on each level the keys that alone hit a bit get it; the others go one level down."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits) - 1

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(a):
            size = max(8, _ROOM * len(a))
            at = (_mix(a, b, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = ~alone[at]
            a, b = a[left], b[left]
            if len(sizes) > 200:
                raise ValueError("the keys are not distinct")
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for some keys that were not built in (others get any place)."""
        out, left, base = np.full(len(a), -1), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mix(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
            if not len(left):
                break
        return out

    def pack(self) -> tuple[list[int], bytes]:
        return self.sizes, np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, sizes: list[int], bits: bytes) -> PerfectHash:
        return cls(sizes, np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool))


def _keys(docs: Documents, least: int) -> tuple[list[list[bytes]], list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; per line the number of its key or -1; both halves and the ids of every (key, document)."""
    lines, numbers, number, known, held = [], [], {}, [], []
    for doc, text in enumerate(docs.texts):
        own = text.split(b"\n")
        found = []
        for line in own:
            key = line_key(line, least)
            if key is None:
                found.append(-1)
                continue
            n = number.get(key)
            if n is None:
                n = number[key] = len(known)
                known.append(xxhash.xxh3_128_intdigest(key))
            found.append(n)
        for n in set(found):
            if n >= 0:
                held.append((n, doc))
        lines.append(own)
        numbers.append(found)
    halves = np.array([(h >> 64, h & 0xFFFFFFFFFFFFFFFF) for h in known], np.uint64).reshape(-1, 2)
    return lines, numbers, halves[:, 0], halves[:, 1], np.array(held, np.int64).reshape(-1, 2)


def distinct_keys(index: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """``a, b, docs, first``: every key once, with the number and the smallest id of its documents.

    A batch sends a key once; Spark adds the batches up.
    """

    def work(docs: Documents, _: Bodies) -> Iterator[pa.RecordBatch]:
        _, _, a, b, held = _keys(docs, least)
        ids = docs.ids[held[:, 1]]
        order = np.lexsort((ids, held[:, 0]))
        which, ids = held[order, 0], ids[order]
        new = np.r_[True, which[1:] != which[:-1]][: len(which)]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(which)][: len(begin)] - 1
        several = np.r_[False, (which[1:] == which[:-1]) & (ids[1:] != ids[:-1])][: len(which)]
        other = np.add.reduceat(several, begin) if len(begin) else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[which[begin]].view(np.int64)), pa.array(b[which[begin]].view(np.int64)), pa.array(ids[begin]),
             pa.array(ids[end]), pa.array(other.astype(np.int64) + 1)], ["a", "b", "first", "last", "docs"])

    found = visit(index, folder, [], "a bigint, b bigint, first bigint, last bigint, docs bigint", work)
    # Rows of one id in several batches are one document: then first and last are the same.
    one = F.min("first") == F.max("last")
    return found.groupBy("a", "b").agg(F.when(one, 1).otherwise(F.sum("docs")).alias("docs"), F.min("first").alias("first"))


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the hash's level sizes and bits, and the arrays of fingerprints, counts and first ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None

        def finish() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            a, b = (table[c].to_numpy().view(np.uint64) for c in ("a", "b"))
            found = PerfectHash.build(a, b)
            place = found.places(a, b)
            arrays = [np.empty(len(a), k) for k in ("<u8", "<i8", "<i8")]
            for array, column in zip(arrays, (b, table["docs"].to_numpy(), table["first"].to_numpy()), strict=True):
                array[place] = column
            sizes, bits = found.pack()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([sizes], pa.list_(pa.int64())), pa.array([bits], pa.binary()),
                 *(pa.array([x.tobytes()], pa.binary()) for x in arrays)],
                ["shard", "sizes", "bits", "prints", "docs", "first"])

        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if held and own[x] != shard:
                    yield finish()
                    held = []
                shard = int(own[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield finish()

    rows = keys.select(F.pmod(F.col("a"), F.lit(shards)).alias("shard"), "a", "b", "docs", "first")
    dealt = rows.repartition(max(width(keys.sparkSession), 1), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard bigint, sizes array<bigint>, bits binary, prints binary, docs binary, first binary")


def probe(shards: DataFrame, asked: DataFrame) -> DataFrame:
    """``batch, shard, body``: for each key that a batch asked a shard for, the first id, and whether there are others."""
    rows = shards.select("shard", F.lit(-1).cast("long").alias("batch"), F.lit(None).cast("binary").alias("body"),
                         "sizes", "bits", "prints", "docs", "first")
    none = F.lit(None)
    rows = rows.unionByName(asked.select(
        "shard", "batch", "body", none.cast("array<bigint>").alias("sizes"),
        *[none.cast("binary").alias(c) for c in ("bits", "prints", "docs", "first")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            answers = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["batch"] < 0:
                    arrays = [np.frombuffer(row[c], k) for c, k in (("prints", "<u8"), ("docs", "<i8"), ("first", "<i8"))]
                    index = (PerfectHash.unpack(row["sizes"], row["bits"]), *arrays)
                    continue
                a, b = unpack_arrays(row["body"], "<u8", "<u8")
                found, prints, docs, first = index
                place = found.places(a, b)
                known = (place >= 0) & (prints[place] == b) & (docs[place] > 1)
                answers.append((row["batch"], row["shard"], pack_arrays(first[place], known)))
            if answers:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*answers, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["batch", "shard", "body"])

    dealt = rows.repartition(max(width(asked.sparkSession), 1), "shard").sortWithinPartitions("shard", "batch")
    return dealt.mapInArrow(run, "batch bigint, shard bigint, body binary")


def _order(a: np.ndarray, b: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys by shard, and by value inside one."""
    shard = a.view(np.int64) % shards
    order = np.lexsort((b, a, shard))
    return order, shard[order]


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` (the lines that stay), one row per row of ``docs``."""
    index, folder = write_batches(docs, doc_id, text)
    keys = stage(distinct_keys(index, folder, least), "line-keys")
    shards = max(1, keys.count() // SHARD_KEYS)

    def question(docs: Documents, _: Bodies) -> Iterator[pa.RecordBatch]:
        _, _, a, b, _ = _keys(docs, least)
        order, shard = _order(a, b, shards)
        cuts = np.searchsorted(shard, np.arange(shards + 1)).tolist()
        own = [(s, order[x:y]) for s, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
        yield questions([(s, pack_arrays(a[o], b[o])) for s, o in own])

    def work(docs: Documents, bodies: Bodies) -> Iterator[pa.RecordBatch]:
        lines, numbers, a, b, _ = _keys(docs, least)
        told = [(None, False)] * len(a)
        parts = [unpack_arrays(x, "<i8", "?") for _, _, x in bodies]
        answers = [x for first, several in parts for x in zip(first.tolist(), several.tolist(), strict=True)]
        for n, answer in zip(_order(a, b, shards)[0].tolist(), answers, strict=True):
            told[n] = answer
        dropped, kept = [], []
        for own, found, me in zip(lines, numbers, docs.ids.tolist(), strict=True):
            stay = [x for x, n in zip(own, found, strict=True) if n < 0 or not told[n][1] or told[n][0] == me]
            dropped.append(len(own) - len(stay))
            kept.append(b"\n".join(stay))
        yield pa.RecordBatch.from_arrays(
            [docs.doc_ids, pa.array([len(x) for x in lines], pa.int64()), pa.array(dropped, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    asked = visit(index, folder, [], "batch bigint, shard bigint, body binary", question, keep_batch=True)
    answers = stage(probe(build_shards(keys, shards), asked), "line-answers")
    return visit(index, folder, [answers], "doc_id bigint, n_lines bigint, n_dropped bigint, text string", work)
