"""Whole texts in batches that tasks visit again and again, and packed questions between them.

A batch is a slice of some megabytes of documents. It is written once, compressed, to a file of the
shared folder; later rounds read it there, so texts are never shuffled. What a round wants to know of
the whole corpus goes as packed arrays to shards by value; each shard answers every batch that asked.
An array holds a value once per batch, however often the batch has it, so a value that a third of all
documents share costs a shard one entry per batch.

Document ids are integers. A null id counts as the largest id. A null text is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stringloom.llm.common import SLICE_BYTES, arrow_rows, new_folder, open_folder, stage, width

NO_ID = np.iinfo(np.int64).max
Bodies = list[tuple[int, int, bytes]]  # kind, shard, packed arrays
_ROWS = "batch bigint, kind int, shard bigint, file string, at bigint, bytes bigint, body binary"


def write_batches(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES
) -> tuple[DataFrame, str]:
    """Write the batches: their index (``batch, file, at, bytes, raw``) and their folder.

    A task names its file by itself alone and only files in the index count, so a task may run twice.
    """
    folder = new_folder(docs.sparkSession, "batches")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        first, number, at, out = TaskContext.get().partitionId() << 32, 0, 0, None
        file = f"{first >> 32:06d}-{uuid.uuid4().hex}.arrow"
        pack = zstandard.ZstdCompressor(level=6)
        for batch, texts in arrow_rows(rows, "text", slice_bytes):
            ids = pa.compute.fill_null(batch.column(0), NO_ID)
            has = pa.compute.is_valid(batch.column(0))
            body = pa.RecordBatch.from_arrays([ids, has, pa.array([t or b"" for t in texts], pa.large_binary())], ["id", "has", "text"])
            packed = pack.compress(body.serialize().to_pybytes())
            out = out or system.open_output_stream(f"{path}/{file}")
            out.write(packed)
            raw = sum(len(t or b"") for t in texts)
            yield pa.RecordBatch.from_pylist(
                [{"batch": first + number, "file": file, "at": at, "bytes": len(packed), "raw": raw}])
            number, at = number + 1, at + len(packed)
        if out is not None:
            out.close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    index = rows.mapInArrow(run, "batch bigint, file string, at bigint, bytes bigint, raw bigint")
    return stage(index, "batch-index"), folder


class Documents:
    """One batch as read back."""

    SCHEMA = pa.schema([("id", pa.int64()), ("has", pa.bool_()), ("text", pa.large_binary())])

    def __init__(self, packed: bytes):
        rows = pa.ipc.read_record_batch(pa.py_buffer(zstandard.ZstdDecompressor().decompress(packed)), self.SCHEMA)
        self.ids: np.ndarray = rows.column(0).to_numpy()
        self.doc_ids = pa.array(self.ids, mask=~rows.column(1).to_numpy(zero_copy_only=False))
        self.texts: list[bytes] = rows.column(2).to_pylist()


def visit(
    index: DataFrame, folder: str, answers: list[DataFrame], schema: str,
    work: Callable[[Documents, Bodies], Iterator[pa.RecordBatch]], keep_batch: bool = False,
) -> DataFrame:
    """Call ``work`` for every batch with what ``answers[k]`` (``batch, shard, body``) holds for it, as kind k + 1.

    With ``keep_batch`` the rows that ``work`` yields get the batch's number as their first column.
    """
    none = F.lit(None)
    rows = index.select("batch", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("shard"), "file", "at", "bytes",
                        none.cast("binary").alias("body"))
    for kind, answer in enumerate(answers, 1):
        rows = rows.unionByName(answer.select(
            "batch", F.lit(kind).alias("kind"), "shard", none.cast("string").alias("file"), none.cast("long").alias("at"),
            none.cast("long").alias("bytes"), "body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        place, bodies = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            with system.open_input_file(f"{path}/{place['file']}") as source:
                packed = source.read_at(place["bytes"], place["at"])
            for out in work(Documents(packed), bodies):
                if keep_batch:
                    own = pa.array(np.full(out.num_rows, place["batch"]))
                    out = pa.RecordBatch.from_arrays([own, *out.columns], ["batch", *out.schema.names])
                yield out

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if place is not None:
                        yield from finish()
                    place, bodies = row, []
                else:
                    bodies.append((row["kind"], row["shard"], row["body"]))
        if place is not None:
            yield from finish()

    parts = max(width(index.sparkSession), 1)
    dealt = rows.repartition(parts, "batch").sortWithinPartitions("batch", "kind", "shard")
    return dealt.mapInArrow(run, schema)


def ask(questions: DataFrame, answer: Callable[[list[bytes]], list[bytes]], name: str) -> DataFrame:
    """Per shard, call ``answer`` with all its bodies; its answers go back as ``batch, shard, body``, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, who, bodies = None, [], []

        def finish() -> pa.RecordBatch:
            out = answer(bodies)
            return pa.RecordBatch.from_arrays(
                [pa.array(who, pa.int64()), pa.array([shard] * len(who), pa.int64()), pa.array(out, pa.binary())],
                ["batch", "shard", "body"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if who:
                        yield finish()
                    shard, who, bodies = row["shard"], [], []
                who.append(row["batch"])
                bodies.append(row["body"])
        if who:
            yield finish()

    dealt = questions.repartition(max(width(questions.sparkSession), 1), "shard").sortWithinPartitions("shard", "batch")
    return stage(dealt.mapInArrow(run, "batch bigint, shard bigint, body binary"), name)


def questions(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _ in parts], pa.int64()), pa.array([b for _, b in parts], pa.binary())], ["shard", "body"])


def by_range(values: np.ndarray, shards: int, bits: int) -> list[tuple[int, slice]]:
    """Slices of sorted unsigned ``values`` of so many bits, one per shard that has any."""
    edges = np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)
    cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
    return [(s, slice(a, b)) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one body: integers as byte planes, the first (sorted) as differences."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in (first, *arrays[1:])]
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_arrays(body: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(body[:8], "little")
    plain, at, out = zstandard.ZstdDecompressor().decompress(body[8:]), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(plain, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out
