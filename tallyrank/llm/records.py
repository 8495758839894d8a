"""Token ids as length-delimited binary records with a separate offset index.

A record is: payload length (u64), masked checksum of those 8 bytes (u32), payload, masked
checksum of the payload (u32); all little-endian. The checksum is CRC-32, rotated right by 15
bits with a constant added, so that a checksum stored inside data is not its own checksum.
A payload is: 1 if the document has an id, else 0 (u8), bytes per id (u8), document id (i64), ids.

Records stand in ascending document order: rows are range-partitioned by id and sorted inside
each partition, and a partition starts a new file when one is full. The index (Parquet) names
the file, record number, byte offset and size of every record, so a shuffled reader seeks
straight to its records. A file's name has the attempt that wrote it and only committed attempts
reach the index, so a task that is run again leaves at most an unused file behind.

Null texts count as empty and hold the end id alone. A null id sorts first. Rows that repeat an
id are all written, in the order of their texts' hash. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.llm.common import texts_of
from tallyrank.llm.tokens import END_ID, encoder, tokenizer_path
from tallyrank.session import materialize, scratch_path

#: Rotation constant of the masked checksum.
MASK_DELTA = 0xA282EAD8
HEAD, PAYLOAD = struct.Struct("<QI"), struct.Struct("<BBq")
FILE_BYTES = 128 << 20
INDEX = ("part int, file_no int, file string, record bigint, offset bigint, size bigint, doc_id bigint, n_tokens bigint")
READ = "part int, file_no int, record bigint, doc_id bigint, n_tokens bigint, before bigint, ids_crc32 bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return PAYLOAD.pack(doc_id is not None, width, doc_id or 0) + ids


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    has_id, width, doc_id = PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=PAYLOAD.size)
    return (doc_id if has_id else None), ids.astype("<u4")


def read_frame(stream) -> bytes | None:
    """The next payload, or None at the end; raises where a checksum or length does not hold."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or masked(head[:8]) != HEAD.unpack(head)[1]:
        raise ValueError("damaged record length")
    size = HEAD.unpack(head)[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("damaged record")
    return body[:size]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID,
                  file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write `docs` (doc_id, text) as records under `folder`; returns the index, read from its
    own Parquet files in `folder`/index."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, attempt = encoder(path), TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        end = b"" if end_id is None else np.array([end_id], enc.width).tobytes()
        width, out, file_no, record, at, name = enc.width.itemsize, None, -1, 0, 0, ""
        try:
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        file_no, record, at = file_no + 1, 0, 0
                        name = f"part-{part:05d}-{file_no:04d}-{attempt}.rec"
                        out = store.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                    ids = enc.encode(text) + end
                    data = frame(payload_of(doc, ids, width))
                    out.write(data)
                    rows.append((part, file_no, name, record, at, len(data), doc, len(ids) // width))
                    record, at = record + 1, at + len(data)
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5)
                    names = [c.split()[0] for c in INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_files(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the indexed files, read front to back, one task per file: its document,
    number of ids, ids before it in the file, and checksum of its 32-bit ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                rows, before, record = [], 0, 0
                with store.open_input_stream(f"{root}/{row['file']}", buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc, ids = parse(payload)
                        rows.append((row["part"], row["file_no"], record, doc, len(ids), before, zlib.crc32(ids.tobytes())))
                        before, record = before + len(ids), record + 1
                kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 5)
                names = [c.split()[0] for c in READ.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    files = index.select("part", "file_no", "file").distinct()
    n = max(files.sparkSession.sparkContext.defaultParallelism, 4)
    return files.repartition(4 * n, "part", "file_no").mapInArrow(run, READ)


def read_at(index: DataFrame, folder: str) -> DataFrame:
    """The indexed records by offset, in the order the rows of `index` come in: doc_id and ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for batch in batches:
            docs, ids_of, opened = [], [], {}
            for row in batch.to_pylist():
                if row["file"] not in opened:
                    for old in opened.values():
                        old.close()
                    opened = {row["file"]: store.open_input_file(f"{root}/{row['file']}")}
                opened[row["file"]].seek(row["offset"])
                doc, ids = parse(read_frame(opened[row["file"]]))
                docs.append(doc)
                ids_of.append(ids.astype(np.int64))
            for old in opened.values():
                old.close()
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(ids_of, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return index.mapInArrow(run, "doc_id bigint, ids array<bigint>")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "records")
    index = write_records(docs, folder)
    read = materialize(read_files(index, folder), "read")
    # one row per file: a running sum over files, in order
    per_file = read.groupBy("part", "file_no").agg(F.sum("n_tokens").alias("_n"))
    earlier = W.orderBy("part", "file_no").rowsBetween(W.unboundedPreceding, -1)
    per_file = per_file.select("part", "file_no", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return read.join(per_file, ["part", "file_no"]).select(
        "doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
