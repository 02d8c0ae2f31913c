"""Best-fit packing of documents into sequences: bounded-space online best-fit over bins in a bitset keyed by free space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import tokens as T
from rollcall.llm.common import documents, i64, rebatched
from rollcall.storage import materialize

CAPACITY, SEPARATOR = 2048, 0
#: Bins that are open at most; pieces of a run, which is placed longest first; pieces that a task packs.
OPEN_BINS, RUN, GROUP = 1024, 4096, 1 << 17


class Bins:
    """At most `limit` open bins of one capacity. The bitset has bit f set while some open bin has f free places."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.next = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _push(self, free: int, number: int) -> None:
        self.by_free[free].append(number)
        self.bits |= 1 << free
        self.open += 1

    def _pop(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the open bin with the least free space that suffices, or a new one."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            number = self._pop(free)
        else:
            free, number = self.capacity, self.next
            self.next += 1
        if free > length:
            self._push(free - length, number)
            if self.open > self.limit:  # the fullest closes first
                self._pop((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - free


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, separator: int, with_ids: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            rows, which = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(T.encode(text or "", path), np.uint32(separator)).astype("<u4")
                first = len(ids) % capacity or capacity
                at = piece = 0
                while at < len(ids):
                    part = ids[at : first if piece == 0 else at + capacity].tobytes()
                    rows.append((piece, at, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                    which.append(k)
                    at += len(part) // 4
                    piece += 1
            c = list(zip(*rows, strict=True))
            arrays = [batch.column(0).take(pa.array(which)), pa.array(c[0], pa.int32()), *(pa.array(x, pa.int64()) for x in c[1:4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(c[4], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return f


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Every document's token ids and a separator, cut into pieces of at most `capacity`; only the first may be shorter."""
    path = path or T.vocabulary_path()
    few = documents(docs).select("doc_id", "text")
    return few.mapInArrow(_pieces(path, capacity, separator, with_ids), PIECES + (", ids binary" if with_ids else ""))


def place_run(bins: Bins, lengths: np.ndarray) -> np.ndarray:
    """(bin, offset) of each of a run's pieces, which are placed longest first; equal ones in their order."""
    out = np.zeros((len(lengths), 2), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        out[i] = bins.place(int(lengths[i]))
    return out


def _pack(capacity: int, limit: int, run: int, length_at: int, names: list[str]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(capacity, limit), TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        count = 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            placed = place_run(bins, np.asarray(rows.column(length_at)))
            held.clear()
            return pa.RecordBatch.from_arrays([*rows.columns, i64(placed[:, 0] + base), i64(placed[:, 1])], names=[*names, "sequence_id", "offset"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:  # runs are of `run` rows, however rows come in batches
                part = batch.slice(at, run - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == run:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    return f


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, run: int = RUN, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a `length`, so that each sequence is gapless and holds at most `capacity`.

    Full pieces are sequences by themselves, numbered where they are read, from -1 down. The others are dealt evenly to
    tasks of about `group` pieces, whatever the input's size. There they arrive in the order of a hash; each run of
    `run` pieces is placed longest first by best fit into at most `open_bins` open bins, the fullest of which closes
    when there is one too many. Memory is bounded by a run and the open bins.
    """
    short = parts.where(F.col("length") < capacity)
    tasks = max(1, -(-short.count() // group))
    # sequence numbers come from the partition's, so neither dealing nor order may depend on which attempt of a task
    # runs: Spark sorts rows before it deals them evenly, and ties in the order below are equal rows
    order = F.xxhash64(*parts.columns)
    dealt = short.repartition(tasks).sortWithinPartitions(order, "doc_id", "piece", "start", "ids_crc32")
    names = parts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    packed = dealt.mapInArrow(_pack(capacity, open_bins, run, names.index("length"), names), f"{schema}, sequence_id long, offset long")
    whole = parts.where(F.col("length") >= capacity)
    whole = whole.withColumn("sequence_id", F.lit(-1).cast("long") - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    docs: doc_id, text; other columns are ignored. Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    (ids, little-endian unsigned 32-bit,) sequence_id, offset. Null and empty texts are a lone separator. Rows with
    null or repeated doc_id are packed like others. An empty table gives no rows.
    """
    assert capacity > 0
    return pack(materialize(pieces(docs, path, capacity, separator, with_ids), "pieces"), capacity)
