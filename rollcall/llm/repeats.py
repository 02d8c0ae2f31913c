"""Repeated substrings: what exact substring removal over words (Rabin-Karp) and over bytes (suffix sorting) share.

Every window of N symbols holds an anchor: the smallest hash among its k-grams. Equal windows have equal anchors at
equal offsets, so a window whose anchor occurs once cannot repeat. Anchors are counted first (a fiftieth of all
positions); a filter of bounded size tells the second scan which windows are worth sending. Windows with the same anchor
lie side by side and travel as one block. Copies of a block are combined before the shuffle, and only blocks that
differ from another block of their anchor need their windows compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import codes as C
from rollcall.llm.common import binaries, bits_of, documents, i64, may_hold, rebatched
from rollcall.storage import materialize


@dataclass(frozen=True)
class Plan:
    """unit: word or byte; window: symbols; gram: symbols of an anchor; filter_bits: log2 of the broadcast filters' bits, by default from the count of keys."""

    unit: str
    window: int
    gram: int
    filter_bits: int | None = None


@dataclass
class Runs:
    """Maximal runs of windows with one anchor, over one stretch of symbols."""

    doc: np.ndarray  # row in the batch
    first: np.ndarray  # first window, as a place in the stretch
    count: np.ndarray  # windows
    at: np.ndarray  # the anchor, as a place in the stretch
    key: np.ndarray  # the anchor's hash
    base: np.ndarray  # what to add to a place in the stretch for one in the document
    symbols: np.ndarray
    raw: np.ndarray

    def body(self, plan: Plan, hit: np.ndarray) -> np.ndarray:
        """Digests of the content, words or bytes, of some blocks."""
        return C.digests(self.symbols if plan.unit == "word" else self.raw, self.first[hit], self.first[hit] + self.count[hit] + plan.window - 1)


def stretches(column: pa.Array, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, offsets, rows, base, bytes) with at most about a million symbols each; longer documents overlap by a window less one."""
    raw, offsets = C.utf8(column)
    step = C.BLOCK
    for i, j in C.blocks(offsets):
        part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if plan.unit == "word":
            starts, ends, offs = C.word_spans(part, offs)
            symbols = C.word_codes(part, starts, ends)
        else:
            symbols = None
        if offs[-1] <= 2 * step:
            yield (C.TABLE[part] if symbols is None else symbols), offs, np.arange(i, j), np.zeros(j - i, np.int64), part
            continue
        for a in range(0, max(int(offs[-1]) - plan.window + 1, 1), step):  # one long document
            b = min(int(offs[-1]), a + step + plan.window - 1)
            piece = C.TABLE[part[a:b]] if symbols is None else symbols[a:b]
            yield piece, np.array([0, b - a]), np.array([i]), np.array([a]), part[a:b] if symbols is None else part


def runs(column: pa.Array, plan: Plan) -> Iterator[Runs]:
    for symbols, offs, rows, base, raw in stretches(column, plan):
        counts = np.maximum(np.diff(offs) - plan.window + 1, 0)
        if not counts.sum():
            continue
        grams = C.windows(symbols, plan.gram)
        begin = C.ragged(offs[:-1], counts)
        at = C.sliding_argmin(grams, plan.window - plan.gram + 1)[begin]
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        size = np.diff(np.append(new, len(at)))
        which = np.repeat(np.arange(len(rows)), counts)[new]
        yield Runs(rows[which], begin[new], size, at[new], grams[at[new]], base[which] - offs[which], symbols, raw)


def _anchors(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            keys, docs = [], []
            ids = batch.column(0)
            for r in runs(batch.column(1), plan):
                keys.append(r.key)
                docs.append(r.doc)
            if not keys:
                continue
            key, doc = np.concatenate(keys), np.concatenate(docs)
            known = ~np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            big = np.iinfo(np.int64)
            low = np.minimum.reduceat(np.where(known[doc], ids[doc], big.max), new)
            high = np.maximum.reduceat(np.where(known[doc], ids[doc], big.min), new)
            yield pa.RecordBatch.from_arrays([i64(key[new]), i64(low), i64(high), i64(np.diff(np.append(new, len(key))))], names=["a", "low", "high", "c"])

    return f


def _blocks(plan: Plan, bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Where the blocks are whose anchor the filter may hold."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            for r in runs(batch.column(1), plan):
                hit = np.flatnonzero(may_hold(bits.value, r.key))
                if not len(hit):
                    continue
                first, count = r.first[hit], r.count[hit]
                body = r.body(plan, hit)
                doc = pa.array(r.doc[hit])
                yield pa.RecordBatch.from_arrays(
                    [i64(r.key[hit]), i64(r.at[hit] - first), i64(count), i64(body[:, 0]), i64(body[:, 1]), batch.column(0).take(doc), batch.column(2).take(doc), i64(first + r.base[hit])],
                    names=[*BLOCK, "doc_id", "text_key", "start"],
                )

    return f


def _payloads(plan: Plan, bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is in the blocks that the filter may hold, once for each batch: the bytes, or the hash of every word window."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            for r in runs(batch.column(0), plan):
                hit = np.flatnonzero(may_hold(bits.value, r.key))
                if not len(hit):
                    continue
                body = r.body(plan, hit)
                once = np.unique(body, axis=0, return_index=True)[1]
                hit, body = hit[once], body[once]
                first, count = r.first[hit], r.count[hit]
                if plan.unit == "word":
                    payload = binaries(C.tuples(r.symbols, plan.window).view(np.uint8), first * 8, (first + count) * 8)
                else:
                    payload = binaries(r.raw, first, first + count + plan.window - 1)
                yield pa.RecordBatch.from_arrays([i64(r.key[hit]), i64(r.at[hit] - first), i64(count), i64(body[:, 0]), i64(body[:, 1]), payload], names=[*BLOCK, "payload"])

    return f


#: A block: its anchor's hash, symbols before the anchor, windows, and 128 bits of BLAKE2 of its content.
BLOCK = ["a", "d", "n", "body", "body2"]
BLOCK_SCHEMA = "a long, d long, n long, body long, body2 long"


def occurrences(docs: DataFrame, plan: Plan, repeated: str) -> DataFrame:
    """Every block of windows whose anchor satisfies `repeated`, an expression over low, high (doc_id) and c (occurrences)."""
    spark = docs.sparkSession
    few = documents(docs)
    anchors = few.select("doc_id", "text").mapInArrow(_anchors(plan), "a long, low long, high long, c long")
    again = anchors.groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("c").alias("c")).where(repeated)
    bits = spark.sparkContext.broadcast(bits_of(materialize(again.select("a"), "again"), "a", plan.filter_bits))
    return materialize(few.mapInArrow(_blocks(plan, bits), f"{BLOCK_SCHEMA}, doc_id long, text_key long, start long"), "blocks")


def variants(docs: DataFrame, plan: Plan, blocks: DataFrame) -> DataFrame:
    """Blocks whose anchor has other blocks too, with their payload; only their windows may repeat beyond the block's own copies."""
    # written, so that an anchor with very many blocks can be split in the join
    anchors = materialize(blocks.groupBy("a").agg(F.count("*").alias("of_anchor")).where("of_anchor > 1"), "anchors")
    several = materialize(blocks.join(anchors, "a"), "variants")
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(anchors, "a", plan.filter_bits))
    payload = documents(docs).select("text").mapInArrow(_payloads(plan, bits), f"{BLOCK_SCHEMA}, payload binary")
    return several.join(payload.groupBy(*BLOCK).agg(F.first("payload").alias("payload")), BLOCK)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal intervals of a union of [start, end); touching ones become one. Rows of two columns."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], axis=1)


def _span_list(row: pa.Scalar) -> np.ndarray | None:
    if not row.is_valid or not len(row):
        return None
    v = row.values
    return merged(np.stack([np.asarray(v.field("s")), np.asarray(v.field("e"))], axis=1))


REMOVED = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def finish(docs: DataFrame, spans: DataFrame, digest: Callable[[str | None, list[list[int]]], tuple], kinds: list[tuple[str, pa.DataType, str]], filter_bits: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of docs named in carry, and the digest of every text and its merged intervals.

    spans: doc_id, text_key, s, e. Texts that a filter of bounded size rules out are settled where they are read; only the
    others are shuffled to meet their intervals. kinds: name, Arrow type and Spark type of the digest's columns, which
    are kept apart from carried columns of the same name until the end.
    """
    few = documents(docs, F.struct(F.lit(True).alias("row"), *(F.col(f"`{c}`") for c in carry)).alias("carried"))
    each = materialize(spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")  # a set: equal rows have equal spans
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(each.select("text_key"), "text_key", filter_bits))
    names, types = [f"out_{k[0]}" for k in kinds], [k[1] for k in kinds]

    def columns(rows: list[tuple | None]) -> list[pa.Array]:
        return [pa.array([None if r is None else r[i] for r in rows], t) for i, t in enumerate(types)]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            hit = may_hold(bits.value, np.asarray(batch.column(2)).view(np.uint64)).tolist()
            texts = batch.column(1).to_pylist()
            rows = [None if h else digest(t, []) for t, h in zip(texts, hit, strict=True)]
            left = pa.array([t if h else None for t, h in zip(texts, hit, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), left, batch.column(2), batch.column(3), pa.array(hit, pa.bool_()), *columns(rows)], names=["doc_id", "text", "text_key", "carried", "open", *names])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            rows = []
            for text, span in zip(batch.column(1), batch.column(2), strict=True):
                span = _span_list(span)
                rows.append(digest(text.as_py(), [] if span is None else span.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *columns(rows)], names=["doc_id", "carried", *names])

    schema = ", ".join(f"{n} {k[2]}" for n, k in zip(names, kinds, strict=True))
    carried = f"carried {few.schema['carried'].dataType.simpleString()}"
    part = materialize(few.mapInArrow(settle, f"doc_id long, text string, text_key long, {carried}, open boolean, {schema}"), "settled")
    each = each.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "spans")
    todo = part.where("open").select("doc_id", "text", "text_key", "carried")
    todo = todo.join(each, todo.doc_id.eqNullSafe(each["_d"]) & (todo.text_key == each["_k"]), "left").select("doc_id", "text", "spans", "carried")
    out = part.where("not open").select("doc_id", "carried", *names).unionByName(todo.mapInArrow(close, f"doc_id long, {carried}, {schema}"))
    return out.select("doc_id", *(F.col(f"carried.`{c}`").alias(c) for c in carry), *(F.col(n).alias(k[0]) for n, k in zip(names, kinds, strict=True)))
