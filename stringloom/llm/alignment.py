"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often in how many documents.

Tokenizer A (a ``tokenizers`` file) gets a space and the text, tokenizer B (a ``sentencepiece`` model)
the text, to which it adds the space itself. Offsets where tokens of both end cut the bytes into groups;
a link is a pair of occurrences whose bytes overlap. The count of an id pair is the number of documents
that hold it linked; a link is best if no other pair of its A id has a higher count.

External spill counting: the pairs of a batch of documents are sorted A-major and radix-partitioned by
the A id into zstd runs: a directory (pair, documents) and its postings (document, links). A k-way heap
merge of the directories of a partition adds up the counts; as an A id's pairs stand together, its
maximum is known when it ends. Then every run streams its postings past the counts, and what they add
up to goes back to its batch in one body per partition. The radix is fixed, so bodies grow with the
input only; a frequent A id is met once per run when counting, and its postings are dealt by run.

Texts that are null or empty, and those whose joined tokens are not the space and the text in either
tokenizer, have no tokens: zeros and ''. Rows that share an id are documents of their own; ids may have
any type. No rows give no rows. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stringloom.llm.batches import pack_arrays, unpack_arrays
from stringloom.llm.common import arrow_rows, stage, width

RADIX_BITS = 6
FAN_IN = 256  # runs that one merge opens
FRAME = 4096  # pairs that a merge holds of a run
CACHE_WORDS, CACHE_CHARS = 400_000, 16 << 20  # what a worker remembers
LEARN_WORDS = 32_768  # words that are joined and tokenized at a time
_B_BITS, _A_BITS = 20, 20
# Blanks that a word cannot be cut at without a look around: white space before a space, and spaces at the ends.
_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |^ | $"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Tokens of both tokenizers and their links, worked out once per distinct word of a batch.

    Both tokenizers cut before a space that follows anything but white space: A splits words off before
    it merges, and no piece of B has a space after another character, which is checked here. So the words
    of a batch are joined into one text, tokenized once, and cut again where words begin.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        spelled = pre_tokenizers.ByteLevel.alphabet()
        plain = [b for b in range(256) if chr(b) in spelled and chr(b).isprintable() and not chr(b).isspace()]
        byte_of = {chr(b): b for b in plain}
        for n, b in enumerate(x for x in range(256) if x not in plain):
            byte_of[chr(256 + n)] = b
        words = {i: w for w, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(byte_of[c] for c in words[i]) if i in words and all(c in byte_of for c in words[i])
                        else words.get(i, "").encode() for i in range(max(words) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.text_a = np.array([str(i) for i in range(len(self.bytes_a))], object)
        self.text_b = np.array([str(i) for i in range(len(self.bytes_b))], object)
        self.known = Words()
        # Words may be taken one by one only if no merge of B can cross the space between them.
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        if max(len(self.bytes_a) >> _A_BITS, len(self.bytes_b) >> _B_BITS):
            raise ValueError("a vocabulary has more ids than a pair has room for")

    def words(self, text: str) -> list[str]:
        """The text cut before single spaces; other white space stays inside a word."""
        if not self.by_word:
            return [text]
        out: list[str] = []
        for word in text.split(" "):
            if out and (not out[-1] or out[-1][-1].isspace()):
                out[-1] += " " + word
            else:
                out.append(word)
        if len(out) > 1 and not out[-1].strip():
            out[-2:] = [out[-2] + " " + out[-1]]
        return out

    def cut(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Words per text, the places of all of them in a list of distinct words, and that list."""
        plain = pa.array([text or b"" for text in texts], pa.large_binary())
        try:
            plain = plain.cast(pa.large_string())
        except pa.ArrowInvalid:
            plain = pa.array([(text or b"").decode("utf-8", "replace") for text in texts], pa.large_string())
        split = pc.split_pattern(plain, " ")
        odd = pc.match_substring_regex(plain, _BLANKS).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        odd |= np.array([not text for text in texts], bool)
        if odd.any():
            rows = [self.words(plain[i].as_py()) if len(plain[i].as_py()) else [] for i in np.flatnonzero(odd).tolist()]
            both = pa.chunked_array([split, pa.array(rows, split.type)]).combine_chunks()
            place = np.arange(len(texts))
            place[odd] = len(texts) + np.arange(len(rows))
            split = both.take(pa.array(place))
        coded = pc.dictionary_encode(split.flatten())
        return (pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64),
                coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist())

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or nothing where the bytes of one are not those of the text."""
        plain = (" " + text).encode()
        ids_a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != plain:
            return None
        ids_b = self.b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, ids_b)) != plain:
            return None
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64)

    def learn(self, words: list[str]) -> None:
        """Add the groups and links of new words, each with its space, to what is known."""
        # B writes a space and its own mark alike; a word that has the mark never has the bytes of its text.
        # A word that ends in white space is the last of its text, and would not be cut off from another.
        good = [i for i, w in enumerate(words) if w and "▁" not in w and not w[-1].isspace()]
        found = self._encode(" ".join([words[i] for i in good])) if good else None
        alone = range(len(words)) if good and found is None else sorted(set(range(len(words))) - set(good))
        parts = [(i, part) for i in alone if (part := self._encode(words[i])) is not None]
        good = (good if found is not None else []) + [i for i, _ in parts]
        found = [([] if found is None else [found[k]]) + [part[k] for _, part in parts] for k in (0, 1)]
        found = (np.concatenate(found[0]), np.concatenate(found[1])) if good else None
        rest = set(range(len(words))) - set(good)
        self.known.add(self, [words[i] for i in [*good, *rest]], len(good), found)

    def places(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in ``known``. When it has grown too large, words that were met again stay."""
        new = [w for w in words if w not in self.known.place]
        if len(self.known.place) + len(new) > CACHE_WORDS or self.known.chars > CACHE_CHARS:
            self.known = self.known.met_again()
            new = [w for w in words if w not in self.known.place]
        for at in range(0, len(new), LEARN_WORDS):
            self.learn(new[at : at + LEARN_WORDS])
        found = np.fromiter(map(self.known.place.__getitem__, words), np.int64, len(words))
        self.known.meet(found)
        return found


class Words:
    """Per word: token, group and link counts, the groups as text, and the linked pairs."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.good = np.zeros(0, bool)
        self.batches = np.zeros(0, np.int64)
        self.counts = np.zeros((4, 0), np.int64)
        self.pairs, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def meet(self, places: np.ndarray) -> None:
        """Note that a batch has these words."""
        self.batches = np.concatenate([self.batches, np.zeros(len(self.place) - len(self.batches), np.int64)])
        self.batches[places] += 1

    def met_again(self) -> Words:
        """Those words that several batches had since they were learnt or last sorted out, at most half of the room."""
        out = Words()
        again = np.flatnonzero(self.batches > 1)
        again = np.sort(again[np.argsort(-self.batches[again], kind="stable")][: CACHE_WORDS // 2])
        words = list(self.place)
        kept = [words[i] for i in again.tolist()]
        out.chars = sum(map(len, kept))
        if out.chars > CACHE_CHARS // 2:
            return Words()
        out.place = dict(zip(kept, range(len(kept)), strict=True))
        out.groups = [self.groups[i] for i in again.tolist()]
        out.good, out.counts = self.good[again], self.counts[:, again]
        sizes = out.counts[3]
        out.at = np.concatenate([[0], np.cumsum(sizes)])
        out.pairs = self.pairs[np.repeat(self.at[again] - out.at[:-1], sizes) + np.arange(sizes.sum())]
        out.batches = np.zeros(len(kept), np.int64)
        return out

    def add(self, own: Aligner, words: list[str], good: int, found: tuple[np.ndarray, np.ndarray] | None) -> None:
        """``found`` has the tokens of the first ``good`` words, one word after the other."""
        n = len(words)
        self.chars += sum(map(len, words))
        self.place.update(zip(words, range(len(self.place), len(self.place) + n), strict=True))
        marks, counts, groups = np.zeros(n, bool), np.zeros((4, n), np.int64), [""] * n
        marks[:good] = True
        if found is not None:
            a, b = found
            end_a, end_b = np.cumsum(own.size_a[a]), np.cumsum(own.size_b[b])
            both = np.intersect1d(end_a, end_b, assume_unique=True)
            ends = np.cumsum([len(words[i].encode()) + 1 for i in range(good)])
            if not np.isin(ends, both, assume_unique=True).all():
                raise ValueError("a token crosses the space between two words")
            cut_a, cut_b = np.searchsorted(end_a, both, "right"), np.searchsorted(end_b, both, "right")
            in_word = np.searchsorted(ends, both)
            n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
            for row, values in enumerate((n_a, n_b, np.ones_like(n_a), n_a + n_b - 1)):
                np.add.at(counts[row], in_word, values)
            # Two rows of intervals over the same bytes: the links are the cells of their common refinement.
            cuts = np.union1d(end_a, end_b)
            links = own_pairs(a[np.searchsorted(end_a, cuts)], b[np.searchsorted(end_b, cuts)])
            self.pairs = np.concatenate([self.pairs, links])
            # Ids as text with the mark that follows: a comma, or at the end of a group's side a bar or semicolon.
            texts = np.concatenate([own.text_a[a], own.text_b[b]])
            ends_side = np.zeros(len(texts), bool)
            ends_side[cut_a - 1] = ends_side[len(a) + cut_b - 1] = True
            marks_of = np.repeat(np.array(["|", ";"], object), [len(a), len(b)])
            texts += np.where(ends_side, marks_of, ",")
            group = np.concatenate([np.repeat(np.arange(len(both)), n_a), np.repeat(np.arange(len(both)), n_b)])
            texts = texts[np.argsort(group, kind="stable")].tolist()
            upto = np.cumsum(counts[0][:good] + counts[1][:good]).tolist()
            groups[:good] = ["".join(texts[lo:hi])[:-1] for lo, hi in zip([0, *upto], upto, strict=False)]
        self.groups += groups
        self.good = np.concatenate([self.good, marks])
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts[3])])


def own_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs as numbers: radix of A, then the rest of A, then B, so that a sort puts them A-major by partition."""
    low = a & ((1 << RADIX_BITS) - 1)
    return (low << (_A_BITS + _B_BITS - RADIX_BITS)) | (a >> RADIX_BITS << _B_BITS) | b


def radix_of(pairs: np.ndarray) -> np.ndarray:
    return pairs >> (_A_BITS + _B_BITS - RADIX_BITS)


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _batch(own: Aligner, texts: list[bytes | None]) -> tuple[dict[str, list], list[tuple[int, bytes, bytes]]]:
    """Columns of the documents of a batch, and its runs (partition, directory, postings)."""
    lengths, word, distinct = own.cut(texts)
    word = own.places(distinct)[word]
    words, n = own.known, len(texts)
    doc = np.repeat(np.arange(n), lengths)
    whole = np.ones(n, bool)
    whole[doc[~words.good[word]]] = False
    columns: dict[str, list] = {}
    for name, count in zip(_COUNTS, words.counts, strict=True):
        sums = np.bincount(doc, count[word], n).astype(np.int64) if len(word) else np.zeros(n, np.int64)
        columns[name] = np.where(whole, sums, 0)
    listed, ends = list(map(words.groups.__getitem__, word.tolist())), np.cumsum(lengths).tolist()
    columns["groups_sha256"] = [
        hashlib.sha256(";".join(listed[lo:hi]).encode()).hexdigest() if ok and hi > lo else ""
        for lo, hi, ok in zip([0, *ends], ends, whole.tolist(), strict=False)]
    kept = whole[doc]
    return columns, _runs(words, doc[kept], word[kept], n)


def _runs(words: Words, doc: np.ndarray, word: np.ndarray, n_docs: int) -> list[tuple[int, bytes, bytes]]:
    if not len(word):
        return []
    distinct, word = np.unique(word, return_inverse=True)
    met, times = np.unique(doc * len(distinct) + word, return_counts=True)  # a word once per document
    doc, word = met // len(distinct), met % len(distinct)
    # The pairs of the batch's words, and where each word's begin.
    sizes = words.counts[3][distinct]
    begin = np.cumsum(sizes) - sizes
    own, place = np.unique(words.pairs[np.repeat(words.at[distinct] - begin, sizes) + np.arange(sizes.sum())], return_inverse=True)
    sizes = sizes[word]
    start = np.repeat(begin[word] - np.cumsum(sizes) + sizes, sizes)
    cells = place[start + np.arange(len(start))] * n_docs + np.repeat(doc, sizes)
    order = np.argsort(cells, kind="stable")
    cells, links = cells[order], np.repeat(times, sizes)[order]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    links, cells = np.add.reduceat(links, first), cells[first]
    pair, doc = cells // n_docs, cells % n_docs
    begins = np.flatnonzero(np.diff(pair, prepend=-1))
    codes, docs = own[pair[begins]], np.diff(np.append(begins, len(pair)))
    out = []
    radix = radix_of(codes)
    cuts = [0, *(np.flatnonzero(np.diff(radix)) + 1).tolist(), len(radix)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        upto = begins[hi] if hi < len(begins) else len(pair)
        part = slice(begins[lo], upto)
        out.append((int(radix[lo]), pack_run(codes[lo:hi], docs[lo:hi]),
                    pack_arrays(doc[part].astype("<u4"), links[part].astype("<u4"))))
    return out


def pack_run(codes: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted pairs and their documents in frames, so that a merge holds one frame of each run."""
    out = []
    for at in range(0, len(codes), FRAME):
        body = pack_arrays(codes[at : at + FRAME].astype("<u8"), docs[at : at + FRAME].astype("<u8"))
        out += [len(body).to_bytes(4, "little"), body]
    return b"".join(out)


def read_run(body: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(body):
        size = int.from_bytes(body[at : at + 4], "little")
        codes, docs = unpack_arrays(body[at + 4 : at + 4 + size], "<u8", "<u8")
        yield codes, docs
        at += 4 + size


def merge_runs(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in order with the sum of their documents over all runs.

    The heap holds each run's frame by its last pair. All pairs up to the least of these are settled:
    they are cut off the frames that reach so far, added up and given out.
    """
    runs = [read_run(body) for body in bodies]
    frames = {i: frame for i, run in enumerate(runs) if (frame := next(run, None)) is not None}
    heap = [(int(codes[-1]), i) for i, (codes, _) in frames.items()]
    heapq.heapify(heap)
    while heap:
        upto = heap[0][0]
        parts = []
        for i, (codes, docs) in frames.items():
            if codes[0] <= upto:
                cut = int(np.searchsorted(codes, upto, "right"))
                parts.append((codes[:cut], docs[:cut]))
                frames[i] = codes[cut:], docs[cut:]
        while heap and heap[0][0] == upto:
            _, i = heapq.heappop(heap)
            frame = next(runs[i], None)
            if frame is None:
                del frames[i]
            else:
                frames[i] = frame
                heapq.heappush(heap, (int(frame[0][-1]), i))
        codes = np.concatenate([c for c, _ in parts])
        order = np.argsort(codes, kind="stable")
        codes, docs = codes[order], np.concatenate([d for _, d in parts])[order]
        first = np.flatnonzero(np.diff(codes, prepend=codes[:1] ^ np.uint64(1)))
        yield codes[first], np.add.reduceat(docs, first)


def best_pairs(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its A id; the pairs stand A-major."""
    side = codes >> np.uint64(_B_BITS)
    first = np.flatnonzero(np.diff(side, prepend=side[:1] ^ np.uint64(1)))
    most = np.repeat(np.maximum.reduceat(docs, first), np.diff(np.append(first, len(codes))))
    return docs == most


_RUNS = ("batch bigint, kind int, radix int, doc bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)
         + ", groups_sha256 string, directory binary, postings binary")


def write_runs(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of kind 0 are documents, rows of kind 1 runs; written once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, batch, schema = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, None
        for rows_in, texts in arrow_rows(rows, "text"):
            n = len(texts)
            columns, runs = _batch(own, texts)
            none = pa.nulls(n, pa.binary())
            head = pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()),
                 pa.array(np.arange(n)), *[pa.array(columns[c]) for c in _COUNTS], pa.array(columns["groups_sha256"]),
                 none, none, rows_in.column(0)], [*names, "doc_id"])
            yield head
            m = len(runs)
            if m:
                longs = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, batch)), pa.array(np.ones(m, np.int32)), pa.array([r for r, _, _ in runs], pa.int32()),
                     longs, *[longs] * len(_COUNTS), pa.nulls(m, pa.string()), pa.array([d for _, d, _ in runs], pa.binary()),
                     pa.array([p for _, _, p in runs], pa.binary()), pa.nulls(m, rows_in.schema.field(0).type)],
                    [*names, "doc_id"])
            batch += 1

    names = [c.split()[0] for c in _RUNS.split(", ")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"{_RUNS}, doc_id {kind}"), "runs")


def count_pairs(runs: DataFrame, fan_in: int | None = None) -> DataFrame:
    """``radix, part, body``: one merged run per partition. Above ``fan_in`` runs, merges are merged again."""
    spark, fan = runs.sparkSession, fan_in or FAN_IN
    batches = runs.where("kind = 0").select("batch").distinct().count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bodies = None, []

        def finish() -> pa.RecordBatch:
            merged = list(merge_runs(bodies))
            body = pack_run(*(np.concatenate([m[k] for m in merged]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays(
                [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int64()), pa.array([body], pa.binary())],
                ["radix", "part", "directory"])

        for batch in batches:
            for radix, part, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (radix, part) != place:
                    if place is not None:
                        yield finish()
                    place, bodies = (radix, part), []
                bodies.append(body)
        if place is not None:
            yield finish()

    rows, parts = runs.where("kind = 1").select("radix", F.col("batch").alias("part"), "directory"), batches
    while True:
        parts = -(-parts // fan) or 1
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts)) if parts > 1 else F.lit(0).cast("long"))
        dealt = dealt.repartition(max(width(spark), 1), "radix", "part").sortWithinPartitions("radix", "part")
        rows = stage(dealt.mapInArrow(run, "radix int, part bigint, directory binary"), "counts")
        if parts == 1:
            return rows


def send_back(runs: DataFrame, counts: DataFrame, fan_in: int | None = None) -> DataFrame:
    """``batch, body``: per run, what its postings add to the sums of its batch's documents.

    The counts of a partition are repeated for every ``fan_in`` runs, so that no task has all postings
    of a frequent id.
    """
    spark = runs.sparkSession
    own = runs.where("kind = 1").select("radix", "batch", "directory", "postings")
    parts = max(1, -(-runs.where("kind = 0").select("batch").distinct().count() // (fan_in or FAN_IN)))
    deals = counts.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("deal"),
                          F.lit(None).cast("long").alias("batch"), "directory", F.lit(None).cast("binary").alias("postings"))
    own = own.select("radix", F.pmod(F.xxhash64("batch"), F.lit(parts)).alias("deal"), "batch", "directory", "postings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = docs = best = None
        for rows in batches:
            out: list[tuple[int, bytes]] = []
            for batch, directory, postings in zip(*(rows.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                frames = list(read_run(directory))
                own_codes, own_docs = (np.concatenate([f[k] for f in frames]) for k in (0, 1))
                if batch is None:  # the counts of a partition come before its runs
                    codes, docs, best = own_codes, own_docs.astype(np.int64), best_pairs(own_codes, own_docs)
                    continue
                doc, links = unpack_arrays(postings, "<u4", "<u4")
                at = np.repeat(np.searchsorted(codes, own_codes), own_docs.astype(np.int64))
                links = links.astype(np.int64)
                sums = np.zeros((2, int(doc.max()) + 1), np.int64)
                np.add.at(sums[0], doc, links * best[at])
                np.add.at(sums[1], doc, links * docs[at])
                some = np.flatnonzero(sums[1])
                out.append((batch, pack_arrays(some.astype("<u4"), sums[0][some], sums[1][some])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["batch", "body"])

    dealt = deals.unionByName(own).repartition(max(width(spark), 1), "radix", "deal")
    return dealt.sortWithinPartitions("radix", "deal", F.col("batch").asc_nulls_first()).mapInArrow(run, "batch bigint, body binary")


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``."""
    runs = write_runs(docs, path_a, path_b, doc_id, text)
    sums = send_back(runs, count_pairs(runs))
    names = ["batch", "doc", "doc_id", *_COUNTS, "groups_sha256"]
    own = runs.where("kind = 0").select(*names, F.lit(None).cast("binary").alias("body"))
    kind = own.schema["doc_id"].dataType.simpleString()
    back = sums.select("batch", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in names[1:]], "body")
    out = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums, held = None, np.zeros((2, 0), np.int64), []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for lo, hi in _stretches(numbers):
                part = batch.slice(lo, hi - lo)
                if numbers[lo] != place:
                    place, sums = numbers[lo], np.zeros((2, 1), np.int64)
                bodies = part.column(part.schema.get_field_index("body"))
                for body in bodies.drop_null().to_pylist():
                    doc, best, total = unpack_arrays(body, "<u4", "<i8", "<i8")
                    if doc[-1] >= sums.shape[1]:
                        sums = np.pad(sums, ((0, 0), (0, int(doc[-1]) + 1 - sums.shape[1])))
                    sums[0][doc] += best
                    sums[1][doc] += total
                part = part.filter(pa.compute.is_null(bodies))
                if part.num_rows:
                    doc = part.column(1).to_numpy()
                    wide = np.pad(sums, ((0, 0), (0, max(0, int(doc.max()) + 1 - sums.shape[1]))))
                    held = [part.column(2), *[part.column(3 + i) for i in range(4)], pa.array(wide[0][doc]), pa.array(wide[1][doc]), part.column(7)]
                    yield pa.RecordBatch.from_arrays(held, out)

    dealt = own.unionByName(back).repartition(max(width(docs.sparkSession), 1), "batch")
    dealt = dealt.sortWithinPartitions("batch", F.col("body").isNull())  # bodies come before the documents
    return dealt.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in out[1:7]) + ", groups_sha256 string")


def _stretches(numbers: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
