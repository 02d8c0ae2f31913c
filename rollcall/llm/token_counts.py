"""Token counts of documents in flat, unindexed token files, found by a vectorised scan for end-of-document ids.

Blocks are scanned on their own; a prefix scan over what they begin and end with stitches documents that straddle them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm import tokens as T
from rollcall.llm.common import documents, rebatched
from rollcall.storage import new_path, ship

END_OF_DOCUMENT, BLOCK_TOKENS = 50256, 1 << 18
BLOCKS = "file long, block long, tokens binary"


def _flatten(path: str, eod: int, size: int, width: int):
    kind = {2: "<u2", 4: "<u4"}[width]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in rebatched(batches):
            for text in batch.column(1).to_pylist():
                ids = T.encode(text or "", path, special=False)
                if (ids == eod).any():
                    raise ValueError(f"a text holds the end-of-document id {eod}")
                held.append(np.append(ids, np.uint32(eod)).astype(kind))
                n += len(held[-1])
                if n >= size:
                    flat = np.concatenate(held)
                    while len(flat) >= size:
                        yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([flat[:size].tobytes()], pa.binary())], names=["file", "block", "tokens"])
                        block, flat = block + 1, flat[size:]
                    held, n = [flat], len(flat)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["file", "block", "tokens"])

    return f


def id_width(path: str, eod: int) -> int:
    """Bytes that hold every id of a vocabulary and the end-of-document id: 2 or 4."""
    return 2 if max(T.tokenizer(path).get_vocab_size(), eod + 1) <= 1 << 16 else 4


def write_flat(docs: DataFrame, path: str | None = None, eod: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token files of all documents, one per task, as a table of blocks: each document's ids and an end-of-document id.

    Nothing says where documents begin; their order in a file is that in which the task reads them. Ids take id_width()
    bytes. Strings of special tokens are ordinary text, so that only ends of documents are end-of-document ids; with an
    `eod` that texts encode to it raises an error.
    """
    ship(docs.sparkSession)
    path = path or T.vocabulary_path()
    out = new_path(docs.sparkSession, "tokens")
    flat = docs.select("doc_id", "text").mapInArrow(_flatten(path, eod, block_tokens, id_width(path, eod)), BLOCKS)
    flat.write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.parquet(out)


def file_blocks(spark: SparkSession, files: list[str], block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """Raw token files of little-endian ids as blocks; each task reads only its ranges. Files are numbered in the order given."""
    from pyarrow import fs

    rows = []
    for k, file in enumerate(files):
        store, path = fs.FileSystem.from_uri(file)
        size = store.get_file_info(path).size
        rows += [(k, b, file, b * block_tokens * width, min(block_tokens * width, size - b * block_tokens * width)) for b in range(-(-size // (block_tokens * width)))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            for file, block, uri, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    f.seek(offset)
                    data = f.read(length)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "tokens"])

    ship(spark)
    schema = "file long, block long, uri string, offset long, length long"
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 10000)), "file", "block").mapInArrow(read, BLOCKS)


SCANNED = "file long, block long, n long, lead long, tail long, inner array<long>"


def _scan(eod: int, width: int):
    kind = {2: "<u2", 4: "<u4"}[width]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 16):
            n, lead, tail, inner = [], [], [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), kind) if data.is_valid else np.zeros(0, kind)
                at = np.flatnonzero(ids == eod)
                n.append(len(ids))
                lead.append(int(at[0]) if len(at) else None)
                tail.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                inner.append((np.diff(at) - 1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(lead, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], names=["file", "block", "n", "lead", "tail", "inner"])

    return f


def count_tokens(blocks: DataFrame, eod: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """file, ordinal (from 0), n_tokens of every document, its end-of-document id not counted.

    blocks: file, block, tokens (little-endian ids of `width` bytes), each block whole. Documents of no tokens count 0. A
    file's last document may lack its end-of-document id; it counts if it has tokens. Null blocks are empty. The prefix
    scan sees one row per block.
    """
    ship(blocks.sparkSession)
    seen = blocks.select("file", "block", "tokens").mapInArrow(_scan(eod, width), SCANNED)
    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.col("lead").isNotNull(), F.size("inner") + 1).otherwise(0)
    seen = seen.withColumn("ends", ends).withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumn("cut", F.when(F.col("lead").isNotNull(), F.col("upto") - F.col("tail")))  # place after the last separator
    seen = seen.withColumns({
        "first": F.coalesce(F.sum("ends").over(before), F.lit(0)),
        "carry": F.col("upto") - F.col("n") - F.coalesce(F.last("cut", ignorenulls=True).over(before), F.lit(0)),
        "final": F.lead("block").over(w).isNull(),
    })
    lengths = F.when(F.col("lead").isNotNull(), F.concat(F.array(F.col("carry") + F.col("lead")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("lead").isNotNull(), F.col("tail")).otherwise(F.col("carry") + F.col("n"))
    lengths = F.concat(lengths, F.when(F.col("final") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    return seen.select("file", "first", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens")


def document_token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document, by way of flat token files and a manifest of the order of documents in them.

    Null texts have no tokens. One row per input row, null and repeated ids included; an empty table gives no rows.
    Columns other than doc_id and text are ignored. Strings of special tokens in a text are ordinary text.
    """
    path = path or T.vocabulary_path()
    few = documents(docs).select("doc_id", "text")
    flat_dir, eod, size = new_path(docs.sparkSession, "tokens"), END_OF_DOCUMENT, BLOCK_TOKENS
    width = id_width(path, eod)
    flatten = _flatten(path, eod, size, width)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, ordinal = TaskContext.get().partitionId(), [0]
        told: list[pa.RecordBatch] = []

        def watch() -> Iterator[pa.RecordBatch]:
            for batch in rebatched(batches):
                n = batch.num_rows
                told.append(pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(ordinal[0], ordinal[0] + n), pa.int64()), batch.column(0)], names=names))
                ordinal[0] += n
                yield batch

        names = ["file", "block", "tokens", "ordinal", "doc_id"]
        for b in flatten(watch()):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=names)
            yield from told
            told.clear()
        yield from told

    # blocks and manifest come from the same reading of the same task, so their orders agree
    few.mapInArrow(both, f"{BLOCKS}, ordinal long, doc_id long").write.option("compression", "zstd").parquet(flat_dir)
    table = docs.sparkSession.read.parquet(flat_dir)
    counts = count_tokens(table.where("block is not null"), eod, width)
    manifest = table.where("ordinal is not null").select("file", "ordinal", "doc_id")
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
