"""Remove the byte strings that an earlier document has, by three rounds of hashes at sampled suffixes.

Every window of ``length`` bytes lies on one sampled suffix: the place of its smallest hashed prefix of
about half that length, leftmost on ties. Names of prefixes grow round by round, and each round sorts
(name, document) pairs and goes on only with names that are not unique:

1. prefixes of half the length at the sampled suffixes: unique ones end here;
2. all windows of a suffix as one string: where an earlier document has the same string, all its
   windows are repeats; of strings that differ, the first holder's go on;
3. the single windows of ``length`` bytes, past which nothing need be told apart.

Names are 64-bit polynomial hashes (48 bits in round 1, which only selects). Removed are all bytes of
windows that start in a document with a smaller id, judged on the input. Documents of one id do not
remove each other's bytes; ids are integers, and a null id counts as the largest. Texts shorter than ``length``, empty and
null texts lose nothing. A row is returned for every row; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stringloom.llm.batches import Bodies, Documents, ask, by_range, pack_arrays, questions, unpack_arrays, visit, write_batches

LENGTH = 50
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK, _BATCH = 1 << 19, 1 << 20  # bytes that are hashed at once, and that ask at once
_SHARD_VALUES = 1 << 21


@cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers of the bytes; powers of the base and of its inverse."""
    table = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    powers = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, inverse)]
    return table, *powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(31))


class Piece:
    """Half a megabyte of documents: its sampled suffixes, and names of any of its strings."""

    def __init__(self, parts: list[tuple[int, int, bytes]], length: int):
        self.length, prefix = length, length // 2 - 1
        sizes = np.array([len(p) for _, _, p in parts])
        self.ends = np.cumsum(sizes)
        codes = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        table, powers, self.inverse = _tables(_CHUNK + 2 * length)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(table[codes] * powers[: len(codes)], out=self.sums[1:])
        n = len(codes) - prefix + 1
        names = self.name(np.arange(n), prefix)
        best = names & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
        span, have = length - prefix + 1, 1
        while have < span:  # smallest of `have` neighbours, then of more
            step = min(have, span - have)
            best = np.minimum(best[:-step], best[step:])
            have += step
        # Window s of the buffer stands on suffix at[s]; windows over the end of a document are left out.
        at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del best
        owner = np.repeat(np.arange(len(parts)), sizes)[: len(at)]
        good = np.arange(len(at)) + length <= self.ends[owner]
        starts = np.flatnonzero(good)
        at, owner = at[starts], owner[starts]
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]) if len(at) else np.zeros(0, int)
        last = np.r_[cut[1:], len(at)] - 1 if len(at) else cut
        self.low, self.high, self.part = starts[cut], starts[last], owner[cut]
        self.names48 = names[at[cut]] >> np.uint64(16)
        begins = self.ends - sizes
        self.doc = np.array([d for d, _, _ in parts])[self.part]
        self.shift = (np.array([o for _, o, _ in parts]) - begins)[self.part]

    def name(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        size = np.uint64(length) if isinstance(length, int) else length.astype(np.uint64)
        return _mix((self.sums[at + length] - self.sums[at]) * self.inverse[at] + size)

    def spans(self, which: np.ndarray) -> np.ndarray:
        """Names of all windows of a suffix as one string."""
        return self.name(self.low[which], self.high[which] - self.low[which] + self.length)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, starts in the buffer and suffix of each single window."""
        counts = self.high[which] - self.low[which] + 1
        of = np.repeat(which, counts)
        starts = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + self.low[of]
        return self.name(starts, self.length), starts, of


def pieces(texts: list[bytes], length: int) -> Iterator[Piece]:
    """The documents in pieces of half a megabyte; longer ones are cut with an overlap that loses no window."""
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for doc, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), _CHUNK - length):
            part = text[at : at + _CHUNK - 1]
            if len(part) < length:
                continue
            if total + len(part) >= _CHUNK:
                yield Piece(held, length)
                held, total = [], 0
            held.append((doc, at, part))
            total += len(part)
    if held:
        yield Piece(held, length)


def _least(keys: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, with the smallest and the largest id of each."""
    order = np.lexsort((docs, *keys[::-1]))
    keys, docs = [k[order] for k in keys], docs[order]
    new = np.zeros(len(docs), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(docs)][: len(first)] - 1
    return [*(k[first] for k in keys), docs[first], docs[last]]


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class Rounds:
    """What a batch asks in each round, worked out anew from its texts and the answers so far."""

    def __init__(self, length: int, shards: int):
        self.length, self.shards = length, shards

    def _names(self, docs: Documents, every: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
        names = _joined([p.names48 for p in every], np.uint64)
        ids = _joined([docs.ids[p.doc] for p in every], np.int64)
        names, low, high = _least([names], ids)
        return names, low < high

    def first(self, docs: Documents, bodies: Bodies) -> Iterator[pa.RecordBatch]:
        names, many = self._names(docs, list(pieces(docs.texts, self.length)))
        yield questions([(s, pack_arrays(names[c], many[c])) for s, c in by_range(names, self.shards, 48)])

    def _pairs(self, docs: Documents, every: list[Piece], bodies: Bodies) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Per piece the suffixes whose prefix is not unique and their spans; distinct (name, span) with the first id."""
        names, _ = self._names(docs, every)
        kept = _joined([np.unpackbits(np.frombuffer(b[8:], np.uint8), count=int.from_bytes(b[:8], "little"))
                        for k, _, b in bodies if k == 1], np.uint8).astype(bool)
        names = names[kept]
        which = [np.flatnonzero(_inside(p.names48, names)) for p in every]
        spans = [p.spans(w) for p, w in zip(every, which, strict=True)]
        pairs = _least(
            [_joined([p.names48[w] for p, w in zip(every, which, strict=True)], np.uint64), _joined(spans, np.uint64)],
            _joined([docs.ids[p.doc[w]] for p, w in zip(every, which, strict=True)], np.int64))
        return which, spans, pairs

    def second(self, docs: Documents, bodies: Bodies) -> Iterator[pa.RecordBatch]:
        _, _, (names, spans, ids, _) = self._pairs(docs, list(pieces(docs.texts, self.length)), bodies)
        yield questions([(s, pack_arrays(names[c], spans[c], ids[c])) for s, c in by_range(names, self.shards, 48)])

    def _split(self, docs: Documents, every: list[Piece], bodies: Bodies) -> Iterator[tuple[Piece, np.ndarray, np.ndarray]]:
        """Per piece the suffixes that repeat as a whole, and those whose windows have to be asked for."""
        which, spans, pairs = self._pairs(docs, every, bodies)
        told = [unpack_arrays(b, "<i8", "u1") for k, _, b in bodies if k == 2]
        first = _joined([t[0] for t in told], np.int64)
        several = _joined([t[1] for t in told], np.uint8)
        place = pairs[0] * np.uint64(0x9E3779B97F4A7C15) ^ pairs[1]  # one number per pair, for the look-up
        order = np.argsort(place)
        for p, w, s in zip(every, which, spans, strict=True):
            own = order[np.searchsorted(place, p.names48[w] * np.uint64(0x9E3779B97F4A7C15) ^ s, sorter=order)] if len(w) else w
            ids = docs.ids[p.doc[w]]
            yield p, w[first[own] < ids], w[(first[own] == ids) & (several[own] > 0)]

    def _asked(self, docs: Documents, split: list[tuple[Piece, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        found = [(p, *p.windows(w)) for p, _, w in split]
        return _least([_joined([n for _, n, _, _ in found], np.uint64)],
                      _joined([docs.ids[p.doc[of]] for p, _, _, of in found], np.int64))

    def third(self, docs: Documents, bodies: Bodies) -> Iterator[pa.RecordBatch]:
        names, ids, _ = self._asked(docs, list(self._split(docs, list(pieces(docs.texts, self.length)), bodies)))
        yield questions([(s, pack_arrays(names[c], ids[c])) for s, c in by_range(names, self.shards, 64)])

    def last(self, docs: Documents, bodies: Bodies) -> Iterator[pa.RecordBatch]:
        split = list(self._split(docs, list(pieces(docs.texts, self.length)), bodies))
        names, _, _ = self._asked(docs, split)
        first = _joined([unpack_arrays(b, "<i8")[0] for k, _, b in bodies if k == 3], np.int64)
        doc, low, high = [], [], []
        for p, whole, single in split:
            name, starts, of = p.windows(single)
            hit = first[np.searchsorted(names, name)] < docs.ids[p.doc[of]] if len(name) else np.zeros(0, bool)
            starts, of = starts[hit], of[hit]
            doc += [p.doc[whole], p.doc[of]]
            low += [p.low[whole] + p.shift[whole], starts + p.shift[of]]
            high += [p.high[whole] + p.shift[whole], starts + p.shift[of]]
        doc, low, high = (_joined(x, np.int64) for x in (doc, low, high))
        order = np.argsort(doc, kind="stable")
        doc, low, high = doc[order], low[order], high[order]
        cuts = np.searchsorted(doc, np.arange(len(docs.texts) + 1)).tolist()
        removed, spans, kept = [], [], []
        for i, text in enumerate(docs.texts):
            a, b = cuts[i], cuts[i + 1]
            if a == b:
                removed.append(0), spans.append(0), kept.append(text)
                continue
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, low[a:b], 1)
            np.add.at(edge, high[a:b] + self.length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        sizes = pa.array([len(t) for t in docs.texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [docs.doc_ids, sizes, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _inside(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _cut(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def not_unique(bodies: list[bytes]) -> list[bytes]:
    """Round 1: for each name, whether two documents have it."""
    told = [unpack_arrays(b, "<u8", "?") for b in bodies]
    names, many = np.concatenate([t[0] for t in told]), np.concatenate([t[1] for t in told])
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    same = ranked[1:] == ranked[:-1]
    keep = np.r_[False, same] | np.r_[same, False]
    many[order] |= keep
    sizes = [len(t[0]) for t in told]
    return [n.to_bytes(8, "little") + np.packbits(m).tobytes() for n, m in zip(sizes, _cut(many, sizes), strict=True)]


def first_holders(bodies: list[bytes]) -> list[bytes]:
    """Round 2: for each (name, span), the smallest id that has it, and whether the name has other spans."""
    told = [unpack_arrays(b, "<u8", "<u8", "<i8") for b in bodies]
    names, spans, ids = (np.concatenate([t[i] for t in told]) for i in range(3))
    order = np.lexsort((ids, spans, names))
    a, b = names[order], spans[order]
    other_name = np.r_[True, a[1:] != a[:-1]]
    other = other_name | np.r_[True, b[1:] != b[:-1]]
    first = np.empty(len(ids), np.int64)
    first[order] = ids[order][np.flatnonzero(other)[np.cumsum(other) - 1]]
    group = np.cumsum(other_name) - 1
    several = np.empty(len(ids), np.uint8)
    several[order] = (np.bincount(group, weights=other) > 1)[group]
    sizes = [len(t[0]) for t in told]
    return [pack_arrays(f, s) for f, s in zip(_cut(first, sizes), _cut(several, sizes), strict=True)]


def first_windows(bodies: list[bytes]) -> list[bytes]:
    """Round 3: for each window, the smallest id that has it."""
    told = [unpack_arrays(b, "<u8", "<i8") for b in bodies]
    names, ids = (np.concatenate([t[i] for t in told]) for i in range(2))
    order = np.lexsort((ids, names))
    ranked = names[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    first = np.empty(len(ids), np.int64)
    first[order] = ids[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return [pack_arrays(f) for f in _cut(first, [len(t[0]) for t in told])]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay), one row per row of ``docs``."""
    index, folder = write_batches(docs, doc_id, text, _BATCH)
    raw = index.agg(F.sum("raw")).first()[0] or 0
    rounds = Rounds(length, max(1, raw // 10 // _SHARD_VALUES))
    asked = "batch bigint, shard bigint, body binary"
    answers: list[DataFrame] = []
    for work, answer in ((rounds.first, not_unique), (rounds.second, first_holders), (rounds.third, first_windows)):
        answers.append(ask(visit(index, folder, list(answers), asked, work, keep_batch=True), answer, "answers"))
    return visit(index, folder, answers, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", rounds.last)
