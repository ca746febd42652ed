"""Token ids in ORC files.

Rows are in ascending doc_id order within and across files. ids is an array<int>, which ORC stores run-length encoded
(RLE v2) in stripes with row indexes; doc_id carries a Bloom filter, so that a look-up by id skips files and row groups, and
stripes are read in parallel. start_in_file counts the ids before a row in its file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roiforge.llm.common import partitions, sliced, small_batches, text_or_empty, token_bytes, tokenizer_path

_ROW = "doc_id long, start_in_file long, n_ids int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, tokenizer: str | None = None, stripe_mb: int = 16, stride: int = 1000) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes the ids to ORC files in path.

    Only doc_id and text of docs are read. Null ids come first; equal ids follow one another ordered by text. Texts are
    shuffled once, by ranges of doc_id, and encoded where they arrive, so that the wider ids never move. An empty table gives
    files without rows.
    """
    spark = docs.sparkSession
    vocabulary = tokenizer or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for b in sliced(batches):
            coded = [x + end for x in token_bytes(b.column(1).to_pylist(), vocabulary)]
            n = np.fromiter((len(x) // 4 for x in coded), dtype=np.int32, count=len(coded))
            before = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            ids = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(before[:-1] + start), pa.array(n), ids], names=["doc_id", "start_in_file", "n_ids", "ids"])
            start += int(before[-1])

    ordered = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(stride), "orc.stripe.size": str(stripe_mb << 20), "orc.compress": "ZSTD", "compression": "zstd"}
    with small_batches(spark):
        ordered.mapInArrow(run, _ROW).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files of write_tokens: doc_id, start (ids of all documents before it), ids array<int>.

    The files' totals, one row for each file, are broadcast: as many rows as the writer had partitions.
    """
    files = spark.read.schema(_ROW).orc(path)
    totals = files.groupBy(F.input_file_name().alias("file")).agg(F.sum("n_ids").alias("n"), F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.max("doc_id").alias("last")).collect()
    base, sofar = [], 0
    for r in sorted(totals, key=lambda r: (not r["nulls"], r["first"] is not None, r["first"] or 0, r["last"] or 0)):
        base.append((r["file"], sofar))
        sofar += r["n"]
    bases = spark.createDataFrame(base, "file string, base long")
    return files.withColumn("file", F.input_file_name()).join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "ids")


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of given documents; the predicate reaches the ORC reader, which prunes by min-max indexes and Bloom filters."""
    return spark.read.schema(_ROW).orc(path).where(F.col("doc_id").isin([int(x) for x in doc_ids])).select("doc_id", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            at = np.asarray(ids.offsets)
            data = memoryview(np.ascontiguousarray(np.asarray(ids.values)).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * int(s) : 4 * int(e)]) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
