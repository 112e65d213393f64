"""Token-id files: one array of ids, with Elias-Fano coded document boundaries behind it.

A file holds, in this order: the ids (16 bits each where the vocabulary allows it,
else 32), then two Elias-Fano sequences (where each document ends; the ascending
document ids less the first), then a footer with the sections' lengths. Every file
is written in one pass, and a document is found in it by two select calls.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .shared import new_folder, parts, small_batches, valid
from .word_ids import word_ids

MAGIC = b"TWIDS\x00\x00\x01"
#: width of an id; documents; documents without an id; first document id; for both sequences: values, low bits, bytes of its three sections
_FOOTER = struct.Struct("<qqqq" + 2 * "qqqqq" + "8s")
#: A file takes no further document once it has so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 24, 1 << 20


def _opened(uri: str, mode: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        where.create_dir(path.rpartition("/")[0], recursive=True)
        return where.open_output_stream(path, compression=None)
    return where.open_input_file(path)


class TokenFileWriter:
    """Writes one file; add() takes documents in ascending order of their ids."""

    def __init__(self, uri: str, width: int) -> None:
        self.uri, self.width, self.out = uri, width, _opened(uri, "w")
        self.ends, self.doc_ids, self.nulls, self.n_ids = array("q"), array("q"), 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.n_ids += len(ids) // self.width
        self.ends.append(self.n_ids)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self) -> None:
        first = self.doc_ids[0] if self.doc_ids else 0
        both = [EliasFano.of(np.array(self.ends, np.uint64)), EliasFano.of((np.array(self.doc_ids, np.int64) - first).astype(np.uint64))]
        sizes = []
        for x in both:
            for section in x.sections():
                self.out.write(section)
            sizes += [x.n, x.low_bits, *map(len, x.sections())]
        self.out.write(_FOOTER.pack(self.width, len(self.ends), self.nulls, first, *sizes, MAGIC))
        self.out.close()


class TokenFile:
    """Reads a file: `len`, `document(i)` by select, and `documents()` in order."""

    def __init__(self, uri: str) -> None:
        self.file = _opened(uri, "r")
        size = self.file.size()
        *head, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token-id file: {uri}")
        self.width, self.n, self.nulls, self.first = head[:4]
        at = size - _FOOTER.size - sum(head[6:9]) - sum(head[11:14])
        self.kind, coded = np.dtype(f"<u{self.width}"), []
        for n, low_bits, *sizes in (head[4:9], head[9:14]):
            sections = []
            for x in sizes:
                sections.append(self.file.read_at(x, at))
                at += x
            coded.append(EliasFano(n, low_bits, *sections))
        self.ends, self.ids_of = coded

    def __len__(self) -> int:
        return self.n

    def document(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """Id, first place and token ids of the i-th document, by select alone."""
        start, end = self.ends.select(i - 1) if i else 0, self.ends.select(i)
        doc_id = None if i < self.nulls else self.first + self.ids_of.select(i - self.nulls)
        return doc_id, start, np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All documents in order, each found by select; no more of the sequences than their coded bytes is held."""
        start = 0
        self.file.seek(0)
        for i in range(self.n):
            end, doc_id = self.ends.select(i), None if i < self.nulls else self.first + self.ids_of.select(i - self.nulls)
            yield doc_id, start, np.frombuffer(self.file.read((end - start) * self.width), self.kind)
            start = end


@dataclass(frozen=True)
class TokenFiles:
    """What write_token_files wrote: for each file, in order, its path, documents and ids."""

    files: list[tuple[str, int, int]]

    def starts(self) -> list[tuple[str, int]]:
        at, out = 0, []
        for path, _, n_ids in self.files:
            out.append((path, at))
            at += n_ids
        return out


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, file_ids: int = FILE_IDS) -> TokenFiles:
    """Encodes docs (doc_id, text) and writes them in ascending order of doc_id.

    Null texts are empty; null ids come first; rows of equal id stand in the order of
    their texts' hashes; an empty table gives no files. Other columns are not read.
    Each task names its files anew and reports those it finished, so a task that runs
    again leaves nothing behind that is read. The driver gets one row for each file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, store, file, roll = TaskContext.get().partitionId(), word_ids(tokenizer_path), None, 0
        end = np.array([end_id], store.kind).tobytes()
        done: list[tuple[int, int, str, int, int]] = []

        def finish() -> None:
            file.close()
            done.append((part, roll, file.uri, len(file.ends), file.n_ids))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), store.ids(batch.column(1).to_pylist()), strict=True):
                if file is not None and (file.n_ids >= file_ids or len(file.ends) >= FILE_DOCS):
                    finish()
                    file, roll = None, roll + 1
                if file is None:
                    file = TokenFileWriter(f"{folder}/ids-{part:06d}-{roll:04d}-{uuid.uuid4().hex}.twids", store.kind.itemsize)
                file.add(doc_id, ids + end)
        if file is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "roll", "path", "docs", "ids"])

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text").alias("text"))
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(parts(spark), "doc_id", "tie", "row")
        .sortWithinPartitions("doc_id", "tie", "row")
        .select("doc_id", "text")
        .mapInArrow(run, "part long, roll long, path string, docs long, ids long")
        .collect()
    )
    return TokenFiles([(r.path, r.docs, r.ids) for r in sorted(rows, key=lambda r: (r.part, r.roll))])


def read_token_files(spark: SparkSession, written: TokenFiles) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    most = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, start, ids in TokenFile(path).documents():
                    rows.append((doc_id, base + start, len(ids), ids.astype("<u4").tobytes()))
                    held += len(ids)
                    if held >= most:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    if not written.files:
        return spark.createDataFrame([], schema)
    starts = spark.createDataFrame(written.starts(), "path string, base long")
    return starts.repartitionByRange(min(len(written.files), 100_000), "base").mapInArrow(run, schema)
