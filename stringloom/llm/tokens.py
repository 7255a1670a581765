"""Token ids of whole texts in binary files: frequency-ranked, byte-aligned, with separate control bytes.

A file is a row of blocks. A block holds whole documents: a header of five little-endian longs
(documents, tokens, control bytes, data bytes, bytes of all), the document ids, a byte each that is 0
for a null id, the token counts, the control bytes and the data bytes. A control byte has two bits for
each of four ids: the bytes of its rank less one. Ranks follow the ids' frequency in all texts.

Document ids are integers. A null or empty text has the end id alone. Rows stand in ascending order of id (nulls first), rows of
one id by their tokens, and repeated rows are all written. No rows give no blocks.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from stringloom.llm.common import arrow_rows, new_folder, open_folder, stage, width

BLOCK_TOKENS = 1 << 20
FILE_BYTES = 256 << 20
CACHE_WORDS = 1_000_000
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
# Letters that stay single code points in every step before the model, then marks that begin no special token.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"([{_LETTERS}]*)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{{}}~]*)")
_encoders: dict[str, Encoder] = {}
# What a short cut could get wrong: case, accents, marks, digits, other scripts, blanks of all kinds.
_PROBES = "Hello WORLD don't naïve École straße x,y (a)... [b]!! 2024 a1b2 ÀÉÎ  two\tthree\nfour\r\nfive\u00a0six  漢字 ñandú end "


def kind_of(size: int) -> str:
    """How staged ids below ``size`` are held."""
    return "<u2" if size <= 1 << 16 else "<u4"


class Encoder:
    """Ids of a text through the tokenizer, each word between blanks once as long as it is remembered.

    Words alone do for a tokenizer that drops white space and folds case; words of plain letters and marks then
    go to its model directly. Whether the tokenizer is of that kind is tried on probes; with any other, whole
    texts take the whole way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = kind_of(self.size)
        self.known: dict[bytes, bytes] = {}
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {i: spell(chr(i))[0][0] for i in range(0xC0, 0x100)}
        words = _PROBES.split()
        self._learn([w.encode() for w in words])
        alone = [np.frombuffer(self.known[w.encode()], self.kind).tolist() for w in words]
        whole = [found.ids for found in self.tokenizer.encode_batch_fast([*words, _PROBES, _PROBES.lower()], add_special_tokens=False)]
        self.by_word = alone == whole[:-2] and sum(alone, []) == whole[-2] == whole[-1]

    def _learn(self, words: list[bytes]) -> None:
        tokenize, other = self.tokenizer.model.tokenize, []
        for word in words:
            if plain := _PLAIN.fullmatch(word.decode("utf-8", "replace")):
                letters, marks = plain.groups()
                parts = (letters.lower().translate(self.spelling), marks)
                ids = [t.id for part in parts if part for t in tokenize(part)]
                self.known[word] = np.array(ids, self.kind).tobytes()
            else:
                other.append(word)
        for word, found in zip(other, self.tokenizer.encode_batch_fast(
                [w.decode("utf-8", "replace") for w in other], add_special_tokens=False), strict=True):
            self.known[word] = np.array(found.ids, self.kind).tobytes()

    def encode(self, texts: list[bytes | None], end: int) -> list[np.ndarray]:
        tail, out = np.array([end], self.kind).tobytes(), []
        if not self.by_word:
            plain = [(t or b"").decode("utf-8", "replace") for t in texts]
            found = self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)
            return [np.array([*own.ids, end], self.kind) for own in found]
        for text in texts:
            text = text or b""
            # The tokenizer folds case itself. Doing A-Z first changes nothing without special tokens and without
            # combining marks (U+0300 to U+036F begin with these bytes), and fewer words have to be learnt.
            if not any(x in text for x in (b"<|", b"\xcc", b"\xcd")):
                text = text.lower()
            words = text.split()
            known = self.known
            found = list(map(known.get, words))
            if None in found:
                new = list({w for w, ids in zip(words, found, strict=True) if ids is None})
                if len(known) + len(new) > CACHE_WORDS:
                    known.clear()
                    new = list(set(words))
                self._learn(new)
                found = list(map(known.get, words))
            found.append(tail)
            out.append(np.frombuffer(b"".join(found), self.kind))
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(docs: DataFrame, path: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (compressed), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch, texts in arrow_rows(batches, "text"):
            ids = own.encode(texts, end)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([pack.compress(x.tobytes()) for x in ids], pa.binary())],
                ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def _unpack(column: pa.Array, size: int) -> list[np.ndarray]:
    unpack, kind = zstandard.ZstdDecompressor(), kind_of(size)
    return [np.frombuffer(unpack.decompress(x), kind) for x in column.to_pylist()]


def rank_ids(encoded: DataFrame, size: int) -> np.ndarray:
    """Ids by falling frequency (ties: smaller id first): at most ``size`` counts come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = _unpack(batch.column(0).slice(first, 256), size)
                total += np.bincount(np.concatenate(part), minlength=size)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(
        F.sum("n").alias("n")).toPandas()
    n = np.zeros(size, np.int64)
    n[counts["id"]] = counts["n"]
    return np.argsort(-n, kind="stable").astype(np.uint32)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of a row of ranks."""
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    grid = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), grid[np.arange(4) < lengths[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of :func:`pack_ranks`, through a table of the lengths of each control byte."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    grid = np.zeros((n, 4), np.uint8)
    grid[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return grid.view("<u4").reshape(-1)


def _block(ids: list[int | None], tokens: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    all_ids = np.concatenate(tokens)
    control, data = pack_ranks(rank_of[all_ids])
    parts = [
        np.array([0 if i is None else i for i in ids], "<i8").tobytes(), bytes(i is not None for i in ids),
        np.array([len(t) for t in tokens], "<i8").tobytes(), control, data]
    head = np.array([len(ids), len(all_ids), len(control), len(data), 40 + sum(map(len, parts))], "<i8").tobytes()
    return head + b"".join(parts)


def read_block(block: bytes, id_of: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and all token ids of one block."""
    docs, tokens, n_control, n_data, _ = np.frombuffer(block, "<i8", 5).tolist()
    at = 40
    ids = np.frombuffer(block, "<i8", docs, at).tolist()
    at += 8 * docs
    ids = [i if known else None for i, known in zip(ids, block[at : at + docs], strict=True)]
    at += docs
    counts = np.frombuffer(block, "<i8", docs, at)
    at += 8 * docs
    ranks = unpack_ranks(block[at : at + n_control], block[at + n_control : at + n_control + n_data], tokens)
    return ids, counts, id_of[ranks]


def write_files(encoded: DataFrame, folder: str, id_of: np.ndarray) -> DataFrame:
    """Write the blocks in ascending ``doc_id`` order and return their index.

    The index: ``part, block, file, at, bytes, tokens``. A task names its files by itself alone, and only
    the files that the index names count, so a task that runs twice does no harm.
    """
    rank_of = np.empty(len(id_of), np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    names = ["part", "block", "file", "at", "bytes", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        out, file, at, number, part = None, "", 0, 0, 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, file, at, number, ids, tokens, held
            if out is None or at > FILE_BYTES:
                if out is not None:
                    out.close()
                file, at = f"tokens-{part:05d}-{uuid.uuid4().hex}.bin", 0
                out = system.open_output_stream(f"{path}/{file}")
            block = _block(ids, tokens, rank_of)
            out.write(block)
            row = pa.RecordBatch.from_pylist([dict(zip(names, (part, number, file, at, len(block), held), strict=True))])
            at, number, ids, tokens, held = at + len(block), number + 1, [], [], 0
            return row

        for batch in batches:
            part = batch.column(3)[0].as_py() if batch.num_rows else part
            for first in range(0, batch.num_rows, 256):
                own = batch.slice(first, 256)
                for doc, found in zip(own.column(0).to_pylist(), _unpack(own.column(2), len(id_of)), strict=True):
                    ids.append(doc)
                    tokens.append(found)
                    held += len(found)
                    if held >= BLOCK_TOKENS:
                        yield flush()
        if ids:
            yield flush()
        if out is not None:
            out.close()

    ordered = encoded.repartitionByRange(width(encoded.sparkSession), "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    return ordered.withColumn("part", F.spark_partition_id()).mapInArrow(
        run, "part bigint, block bigint, file string, at bigint, bytes bigint, tokens bigint")


def read_files(index: DataFrame, folder: str, id_of: np.ndarray) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files that ``index`` names."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = index.groupBy("part").agg(F.sum("tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # one row per part
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.join(offsets, "part").select(
        "file", "at", "bytes", (F.col("offset") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{path}/{row['file']}") as source:
                    ids, counts, tokens = read_block(source.read_at(row["bytes"], row["at"]), id_of)
                ends = np.cumsum(counts)
                wide = tokens.astype("<u4")
                sums = [zlib.crc32(wide[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(row["start"] + ends - counts), pa.array(counts),
                     pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.repartition(width(index.sparkSession), "file", "at").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(
    docs: DataFrame, path: str, end: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, str, np.ndarray]:
    """Write ``docs`` as token files: the index, the folder, and the id of each rank."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    encoded = stage(encode_texts(docs, path, end, doc_id, text), "encoded")
    id_of = rank_ids(encoded, encoder(path).size)
    system, plain = open_folder(folder)
    with system.open_output_stream(f"{plain}/ids-by-rank.u32") as out:
        out.write(id_of.astype("<u4").tobytes())
    return stage(write_files(encoded, folder, id_of), "token-index"), folder, id_of


def token_digests(docs: DataFrame, path: str, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files, read them back and return ``doc_id, start, n_tokens, ids_crc32``."""
    index, folder, id_of = token_files(docs, path, end, doc_id, text)
    return read_files(index, folder, id_of)
