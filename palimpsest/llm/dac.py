"""Token ids in directly addressable codes.

File format, little-endian: magic ``DAC1``; u8 chunk bits, u8 levels, u16 zero;
u64 ids, u64 documents; the documents' first places as u64, one more at the end;
their doc_ids as i64 and a u8 each that is 1 for a null one.  Then each level:
u64 chunks; the chunks, one or two bytes each; and but for the last level the
continuation bitmap (bit i of byte i // 8, 1 where chunk i goes on in the next
level) and the rank directory: before every 512th chunk, the number of ones
as u64.  Chunk i of level 0 belongs to id i; its next chunk has the place
rank(i) of level 1, and so on: any id is read without decoding others.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize
from .tokens import Encoder

MAGIC, BITS, RANK = b"DAC1", 8, 512
#: Files that one task reads, one after the other.
FILES_EACH = 4
END_ID, TEXTS, SEGMENT = 2, 3000, 2_000_000
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def encode(ids: np.ndarray, starts: np.ndarray, docs: list[int | None], bits: int = BITS) -> bytes:
    """A file of ``ids``; document j begins at ``starts[j]``."""
    kind = np.dtype("u1") if bits == 8 else np.dtype("<u2")
    left, levels = ids.astype(np.uint32 if ids.max(initial=0) >> 16 else np.uint16), []
    while True:
        chunk = (left & left.dtype.type((1 << bits) - 1)).astype(kind)
        more = left >> left.dtype.type(bits) if bits < left.itemsize * 8 else np.zeros_like(left)
        goes = more > 0
        if not goes.any():
            levels.append(struct.pack("<Q", len(chunk)) + chunk.tobytes())
            break
        bitmap = np.packbits(goes, bitorder="little")
        per = ONES[np.pad(bitmap, (0, -len(bitmap) % (RANK // 8)))].reshape(-1, RANK // 8).sum(axis=1)
        levels.append(struct.pack("<Q", len(chunk)) + chunk.tobytes() + bitmap.tobytes() + np.r_[0, np.cumsum(per)[:-1]].astype("<u8").tobytes())
        left = more[goes]
    head = MAGIC + struct.pack("<BBHQQ", bits, len(levels), 0, len(ids), len(docs))
    return head + np.r_[starts, len(ids)].astype("<u8").tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], "u1").tobytes() + b"".join(levels)


class Reader:
    """Random access to a file's ids, over its bytes."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a DAC1 file")
        self.bits, levels, _, self.n, n_docs = struct.unpack_from("<BBHQQ", data, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.docs = [None if x else int(d) for d, x in zip(ids, nulls, strict=True)]
        self.levels = []
        for i in range(levels):
            n = int(take("<u8", 1)[0])
            chunk = take("u1" if self.bits == 8 else "<u2", n)
            self.levels.append((chunk, *((take("u1", -(-n // 8)), take("<u8", -(-n // RANK))) if i < levels - 1 else (None, None))))

    @staticmethod
    def _rank(bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Ones before place i."""
        block = i // RANK
        if block == len(directory):  # the end of a bitmap of whole blocks
            block -= 1
        out = int(directory[block]) + int(ONES[bitmap[block * RANK // 8 : i // 8]].sum())
        return out + (int(ONES[int(bitmap[i // 8]) & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for chunk, bitmap, directory in self.levels:
            out |= int(chunk[i]) << shift
            if bitmap is None or not bitmap[i // 8] >> (i % 8) & 1:
                return out
            i, shift = self._rank(bitmap, directory, i), shift + self.bits
        return out

    def ids(self, a: int, z: int) -> np.ndarray:
        """The ids at places a to z - 1; of the rest nothing is decoded."""
        out, where, shift = self.levels[0][0][a:z].astype(np.uint32), None, 0
        for chunk, bitmap, directory in self.levels:
            if shift:
                out[where] |= chunk[a:z].astype(np.uint32) << np.uint32(shift)
            if bitmap is None or a == z:
                break
            goes = np.unpackbits(bitmap[a // 8 : -(-z // 8)], bitorder="little")[a % 8 : a % 8 + z - a].astype(bool)
            where = np.flatnonzero(goes) if where is None else where[goes]
            a = self._rank(bitmap, directory, a)
            z, shift = a + int(goes.sum()), shift + self.bits
        return out

    def document(self, j: int) -> np.ndarray:
        """The ids of document j."""
        return self.ids(int(self.starts[j]), int(self.starts[j + 1]))


def store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder and its path there; Hadoop's names of S3 are S3."""
    scheme, _, rest = folder.partition("://")
    try:
        return pyarrow.fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else folder)
    except (pa.ArrowException, OSError) as error:
        raise ValueError(f"token files need a folder that pyarrow opens (local or mounted, hdfs, s3 or s3a, gs), not {folder}") from error


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, bits: int = BITS, segment: int = SEGMENT) -> DataFrame:
    """Write all texts' ids to files below ``folder``, in ascending doc_id order, nulls first; the files' table.

    Columns: file, part, segment (their order), n_tokens.  Texts are encoded
    whole by the byte-level vocabulary at ``path`` and end in ``end_id``;
    a null text is empty.  Rows are dealt by ranges of (doc_id, the text's hash),
    so even a doc_id that many rows repeat is split, and a file ends after
    ``segment`` ids.  Names are unique to the attempt that writes them, and the
    table lists those of tasks that ended well, so a lost executor
    leaves at most files that nobody reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part = Encoder.of(path, "bytes"), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        held: list[bytes] = []
        names: list[int | None] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            data = encode(np.frombuffer(b"".join(held), "<u4"), np.cumsum(lengths) - lengths, names, bits)
            file = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{root}/{file}") as f:
                f.write(data)
            row = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], names=["file", "part", "segment", "n_tokens"])
            held.clear()
            names.clear()
            size, number = 0, number + 1
            return row

        for b in batches:
            for a in range(0, b.num_rows, TEXTS):
                some = b.slice(a, TEXTS)
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1)), strict=True):
                    held.append(ids + end)
                    names.append(doc)
                    size += len(ids) // 4 + 1
                    if size >= segment:
                        yield flush()
        if held:
            yield flush()

    store(folder)  # tells at once if it cannot be opened
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text").alias("tie")
    ordered = rows.select("doc_id", "text", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return materialize(ordered.select("doc_id", "text").mapInArrow(run, "file string, part long, segment long, n_tokens long"), "dac-files")


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; files: as :func:`write_ids` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    reader = Reader(f.read_buffer())
                ids, cuts = memoryview(reader.ids(0, reader.n).astype("<u4").tobytes()), (reader.starts * 4).tolist()
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(reader.docs, pa.int64()), pa.array(reader.starts[:-1] + base), pa.array(np.diff(reader.starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # Parts are as many as tasks; files are placed within their part.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("segment")), F.lit(0))
    listed = files.join(parts, "part").select("file", (F.col("first") + within).cast("long").alias("base"))
    return listed.repartition(-(-files.count() // FILES_EACH) or 1, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, path: str, end_id: int = END_ID, bits: int = BITS, segment: int = SEGMENT) -> DataFrame:
    """Write the ids of ``docs`` below the session's shared folder and read them back.

    See :func:`write_ids` and :func:`read_ids`.  Rows that share a doc_id follow
    in the order of their texts' hashes; rows without one come first;
    an empty table gives no rows; only doc_id and text are read.
    """
    folder = fresh_path(docs.sparkSession, "dac")
    return read_ids(write_ids(docs, folder, path, end_id, bits, segment), folder)
