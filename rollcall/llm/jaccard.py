"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, each pair verified once.

Components need only the links that join them, so copies never meet in all pairs: equal shingle sets fall together first,
every prefix shingle then links its documents to the smallest of them, and only documents that these links leave in
different components are compared further. Numbers of links, where they are asked for, come from the intersections of
all different sets of each component, which no link leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm import codes as C
from rollcall.llm.common import bits_of, documents, fetched, i64, may_hold, rebatched
from rollcall.operators.graph import connected_components
from rollcall.storage import materialize

NGRAM, PERCENT = 5, 80
#: log2 of the counters that tell very frequent shingles, and of the slots for those whose documents were counted exactly.
#: Both tables have a fixed size, so they may be broadcast; when they fill up, fewer shingles are told apart.
SKETCH_BITS, HOT_BITS = 18, 22
#: Shingles at the rare end of more than so many documents are put behind rarer ones.
HOT = 8
#: Parts of the hash space whose shingles the suffix filter counts.
PARTS = 256
#: Documents of one block of a group; every two blocks of a group meet in a task.
GROUP = 512


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, hashes, offsets): the distinct shingle hashes of each text, ascending."""
    raw, offsets = C.utf8(column)
    for i, j in C.blocks(offsets):
        part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, offs = C.word_spans(part, offs)
        words = C.word_codes(part, starts, ends, lower=True)
        size = np.diff(offs)
        count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
        begin = C.ragged(offs[:-1], count)
        doc = np.repeat(np.arange(j - i), count)
        h, long = words[begin], np.minimum(size, n)[doc]
        for k in range(1, n):
            go = np.flatnonzero(long > k)
            h[go] = C.join(h[go], words[begin[go] + k])
        edge = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            h[a:b].sort()
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
        yield i, j, h, np.searchsorted(doc, np.arange(j - i + 1))


def _frequencies(n: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in rebatched(batches):
            for _, _, h, _ in shingle_sets(batch.column(0), n):
                counts += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([i64(at), i64(counts[at])], names=["slot", "n"])

    return f


def grade(n: np.ndarray) -> np.ndarray:
    """0 to 255, growing with the logarithm of a count."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(n, 0) + 1))).astype(np.uint8)


def frequency_classes(docs: DataFrame, n: int) -> np.ndarray:
    """For each slot of the sketch how frequent its most frequent shingle may be, beyond what slots hold anyway; over all documents."""
    slots = docs.select("text").mapInArrow(_frequencies(n), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.float64)
    slot, n_slot = fetched(slots)
    counts[slot] = n_slot
    usual = np.median(counts)
    return grade(counts - usual - 6 * np.sqrt(usual + 1))


@dataclass
class Order:
    """A total order of shingles, rare ones first; any order gives the same links, a good one gives fewer candidates."""

    sketch: np.ndarray
    hot: np.ndarray

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Shingles as numbers in this order: the grade of their frequency, then 56 bits of the hash."""
        known = np.maximum(self.sketch[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], self.hot[(h & np.uint64((1 << HOT_BITS) - 1)).astype(np.int64)])
        return (known.astype(np.uint64) << np.uint64(56)) | (h & np.uint64((1 << 56) - 1))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets that reach the threshold share one of their first so many shingles."""
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def _first(key: np.ndarray, offs: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest `take` keys of each text, ascending, and their places in the whole."""
    key = key.copy()
    edge = offs.tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        key[a:b].sort()
    return key[C.ragged(offs[:-1], take)], np.concatenate([[0], np.cumsum(take)])


def _rare_ends(n: int, percent: int, order):
    """The shingles that are, or may become, part of a prefix, with how many texts of the batch have them there."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            found = []
            for _, _, h, offs in shingle_sets(batch.column(0), n):
                size = np.diff(offs)
                found.append(_first(order.value.keys(h), offs, np.minimum(size, prefix_length(size, percent) * 3 // 2))[0])
            key, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([i64(key), i64(count)], names=["token", "n"])

    return f


def rare_first(docs: DataFrame, n: int, percent: int, hot: int = HOT) -> Order:
    """Order by a sketch of all shingles, then, at the rare end that it gives, by exact counts of documents."""
    spark = docs.sparkSession
    order = Order(frequency_classes(docs, n), np.zeros(1 << HOT_BITS, dtype=np.uint8))
    ends = docs.select("text").mapInArrow(_rare_ends(n, percent, spark.sparkContext.broadcast(order)), "token long, n long")
    often = ends.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    slots = often.groupBy(F.col("token").bitwiseAND(F.lit((1 << HOT_BITS) - 1)).alias("slot")).agg(F.max("n").alias("n"))
    slot, most = fetched(slots)
    order.hot[slot] = grade(most)
    return order


DIGEST = "doc_id long, n_shingles long, s1 long, s2 long, parts binary, prefix array<long>"


def _digests(n: int, percent: int, order):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            for i, j, h, offs in shingle_sets(batch.column(1), n):
                size = np.diff(offs)
                doc = np.repeat(np.arange(j - i), size)
                both = C.digests(h, offs[:-1], offs[1:]).T
                parts = np.bincount(doc * PARTS + (C.mix(h) >> np.uint64(56)).astype(np.int64), minlength=(j - i) * PARTS)
                parts = np.minimum(parts, 255).astype(np.uint8)  # capped counts differ by less, so the filter stays safe
                key, ends = _first(order.value.keys(h), offs, prefix_length(size, percent))
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), i64(key))
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), j - i, [None, pa.py_buffer(parts)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), i64(size), i64(both[0]), i64(both[1]), blob, prefix], names=["doc_id", "n_shingles", "s1", "s2", "parts", "prefix"])

    return f


def _postings(bits):
    """Prefix shingles that the filter may hold: doc, n, pos, token."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            lists = batch.column(2)
            token = np.asarray(lists.flatten()).view(np.uint64)
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            hit = np.flatnonzero(may_hold(bits.value, token))
            row = pa.array(np.repeat(np.arange(len(size)), size)[hit])
            pos = C.ragged(np.zeros(len(size), np.int64), size)[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), i64(pos), i64(token[hit])], names=["doc", "n", "pos", "token"])

    return f


def _sets(n: int, bits):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            ids = np.asarray(batch.column(0).fill_null(0))
            hit = may_hold(bits.value, C.mix(ids.astype(np.uint64))) & ~np.asarray(batch.column(0).is_null())
            if not hit.any():
                continue
            few = batch.filter(pa.array(hit))
            for i, j, h, offs in shingle_sets(few.column(1), n):
                blob = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((offs * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([few.column(0).slice(i, j - i), blob], names=["doc_id", "shingles"])

    return f


def needed(nx: Column, ny: Column, percent: int) -> Column:
    """The least intersection of sets of these sizes that reaches the threshold."""
    return F.ceil(F.lit(percent) * (nx + ny) / F.lit(100 + percent))


def _suffix_filter(percent: int):
    """Drops pairs whose sets differ too much in how many shingles they have in each part of the hash space."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for i in (4, 5))
            both = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            most = both - 2 * -(-percent * both // (100 + percent))
            yield batch.filter(pa.array(np.abs(x - y).sum(axis=1) <= most)).select([0, 1])

    return f


def _verify(percent: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                ok.append(100 * common >= percent * (len(x) + len(y) - common) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["x", "y", "linked"])

    return f


def verified(docs: DataFrame, pairs: DataFrame, digests: DataFrame, n: int, percent: int, filter_bits: int = 23) -> DataFrame:
    """(x, y, linked) for each pair that passes the suffix filter."""
    spark = docs.sparkSession
    parts = digests.select("doc_id", "n_shingles", "parts")
    for side in ("x", "y"):
        pairs = pairs.join(parts.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("parts").alias(f"parts_{side}")), side)
    pairs = materialize(pairs.select("x", "y", "n_x", "n_y", "parts_x", "parts_y").mapInArrow(_suffix_filter(percent), "x long, y long").distinct(), "pairs")
    ids = pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct()
    hashed = ids.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([i64(C.mix(np.asarray(b.column(0)).astype(np.uint64)))], names=["k"]) for b in it), "k long")
    bits = spark.sparkContext.broadcast(bits_of(hashed, "k", filter_bits))
    sets = materialize(documents(docs).select("doc_id", "text").mapInArrow(_sets(n, bits), "doc_id long, shingles binary"), "sets")
    for side in ("x", "y"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    out = pairs.select("x", "y", "set_x", "set_y").mapInArrow(_verify(percent), "x long, y long, linked boolean")
    return materialize(out.groupBy("x", "y").agg(F.max("linked").alias("linked")), "verified")


def _pairs(percent: int):
    """Pairs of different components within sorted groups that share a token and pass the length and suffix filters."""

    def pairs(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        doc, n, c, block = (np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 4, 5, 6))
        if c.min() == c.max():
            return
        size = np.array([len(r[7]) for r in rows])
        _, token = np.unique(np.concatenate([r[7] for r in rows]), return_inverse=True)
        parts = np.frombuffer(b"".join(r[8] for r in rows), np.uint8).reshape(-1, PARTS).astype(np.int16)
        has = np.zeros((len(rows), int(token.max()) + 1), dtype=np.float32)
        has[np.repeat(np.arange(len(rows)), size), token] = 1
        across = rows[0][1] != rows[0][2]
        for i in range(0, len(rows), 64):
            part = slice(i, i + 64)
            ok = (has[part] @ has.T > 0) & (c[part, None] != c[None]) & (100 * np.minimum(n[part, None], n[None]) >= percent * np.maximum(n[part, None], n[None]))
            ok &= (block[part, None] < block[None]) if across else (np.arange(len(rows))[part, None] < np.arange(len(rows))[None])
            x, y = np.nonzero(ok)
            if not len(x):
                continue
            x += i
            for k in range(0, len(x), 8192):
                a, b = x[k : k + 8192], y[k : k + 8192]
                both = n[a] + n[b]
                close = np.abs(parts[a] - parts[b]).sum(axis=1) <= both - 2 * -(-percent * both // (100 + percent))
                yield doc[a[close]], doc[b[close]]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(group: list[tuple]) -> None:
            for a, b in pairs(group):
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))

        def emit() -> pa.RecordBatch:
            both = np.unique(np.concatenate(found), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([i64(both[:, 0]), i64(both[:, 1])], names=["x", "y"])

        held: list[tuple] = []
        found: list[np.ndarray] = []
        for batch in rebatched(batches):
            tokens = batch.column(7)
            flat, offs = np.asarray(tokens.flatten()), np.concatenate([[0], np.cumsum(np.asarray(tokens.value_lengths()))])
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 6, 8)]
            for k, r in enumerate(zip(*columns, strict=True)):
                if held and r[:3] != held[0][:3]:
                    flush(held)
                    held = []
                held.append((*r[:7], flat[offs[k] : offs[k + 1]], r[7]))
            if sum(map(len, found)) > 50_000:
                yield emit()
        flush(held) if held else None
        if found:
            yield emit()

    return f


def apart(rows: DataFrame, percent: int) -> DataFrame:
    """(x, y): candidate pairs of documents of different components that share a prefix shingle.

    rows: r, doc, n, c, tokens, parts, and blocks. Shingles that have the same smallest document r form a group, so that
    documents with many shingles in common meet once rather than for each. A group's documents are split into blocks,
    every two of which meet in a task of bounded size, and pairs are filtered where they are formed.
    """
    r = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    r = r.select("r", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "doc", "n", "c", "block", "tokens", "parts")
    count = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = r.repartition(count, "r", "b1", "b2").sortWithinPartitions("r", "b1", "b2", "doc")
    return dealt.mapInArrow(_pairs(percent), "x long, y long").distinct()


#: Bytes of the dense columns that an intersection of sets is summed up by.
DENSE = 32 << 20


def link_counts(sets: list[np.ndarray], weight: np.ndarray, block: np.ndarray, percent: int, across: bool) -> np.ndarray:
    """For each set the weights of the others that link with it, summed; of those of other blocks only if across."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = np.bincount(token)[token] > 1  # a shingle of one set only is in no intersection
    token, row = np.unique(token[shared], return_inverse=True)[1], row[shared]
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = max(1, DENSE // (4 * len(sets)))
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [low, low + width])
        dense = np.zeros((len(sets), width), dtype=np.float32)
        dense[row[a:b], token[a:b] - low] = 1
        common += dense @ dense.T
    linked = 100 * common >= percent * (n[:, None] + n[None] - common)
    np.fill_diagonal(linked, False)
    if across:
        linked &= block[:, None] != block[None]
    return linked.astype(np.int64) @ weight


def _link_sums(percent: int):
    """Sorted groups of sets, two blocks of a component each, to the weights of each set's links within them."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            weight, block = (np.array([r[k] for r in held], dtype=np.int64) for k in (5, 6))
            sums = link_counts([np.frombuffer(r[7], np.uint64) for r in held], weight, block, percent, held[0][1] != held[0][2])
            s1, s2 = (np.array([r[k] for r in held], dtype=np.int64) for k in (3, 4))
            held.clear()
            return pa.RecordBatch.from_arrays([i64(s1), i64(s2), i64(sums)], names=["s1", "s2", "links"])

        for batch in rebatched(batches):
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r[:3] != held[0][:3]:
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    return f


def _class_links(docs: DataFrame, classes: DataFrame, ngram: int, percent: int) -> DataFrame:
    """(s1, s2, links): how many rows of other sets link with each set that shares its component with another.

    classes: rep, s1, s2, size, component. The sets of a component are dealt into blocks, every two of which meet in a
    task, as in apart().
    """
    spark = docs.sparkSession
    several = classes.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component", F.ceil(F.col("n") / GROUP).cast("int").alias("blocks"))
    members = materialize(classes.join(materialize(several, "several"), "component"), "members")
    hashed = members.select(F.col("rep").alias("doc_id")).distinct().mapInArrow(lambda it: (pa.RecordBatch.from_arrays([i64(C.mix(np.asarray(b.column(0)).astype(np.uint64)))], names=["k"]) for b in it), "k long")
    bits = spark.sparkContext.broadcast(bits_of(materialize(hashed, "ids"), "k"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sets(ngram, bits)(batches):
            both = [C.digests(np.frombuffer(x.as_buffer(), np.uint64), np.zeros(1, np.int64), np.array([len(x.as_buffer()) // 8]))[0] for x in batch.column(1)]
            both = np.array(both, dtype=np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([i64(both[:, 0]), i64(both[:, 1]), batch.column(1)], names=["s1", "s2", "shingles"])

    sets = docs.select("doc_id", "text").mapInArrow(found, "s1 long, s2 long, shingles binary").groupBy("s1", "s2").agg(F.first("shingles").alias("shingles"))
    rows = members.join(sets, ["s1", "s2"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "s1", "s2", F.col("size").alias("weight"), "block", "shingles")
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(count, "component", "b1", "b2").sortWithinPartitions("component", "b1", "b2", "s1", "s2")
    return dealt.mapInArrow(_link_sums(percent), "s1 long, s2 long, links long").groupBy("s1", "s2").agg(F.sum("links").alias("links"))


def _length_filter(a: str, b: str, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def jaccard_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; documents link when 100 * intersection >= percent * union.

    With links also n_links, the rows that a row links with, each counted: those with an equal set and those of other
    sets, found from the intersections of all sets of its component. Its cost grows with the square of the different
    sets of a component. Rows with a null doc_id have none and are none.

    Sets are of `ngram`-word shingles, A-Z lower-cased; a shorter text is one shingle, an empty or null one has none and
    links with nothing. component_id is the smallest doc_id reachable, itself included. One row per input row; rows that
    share a doc_id are one node, linked if any of their texts is; a null doc_id is its own component, null. Columns
    other than doc_id and text are ignored; an empty table gives no rows. Shingles are compared by 64 bits, equal sets
    by 128 bits of BLAKE2.
    """
    spark = docs.sparkSession
    few = documents(docs)
    order = spark.sparkContext.broadcast(rare_first(few, ngram, percent))
    digests = materialize(few.select("doc_id", "text").mapInArrow(_digests(ngram, percent, order), DIGEST), "digests")

    # equal sets: one representative each, the copies' rows are combined before the shuffle
    full = digests.where("n_shingles > 0 and doc_id is not null")
    classes_of = materialize(full.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("size"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts")), "classes")
    copies = full.select("doc_id", "n_shingles", "s1", "s2").join(classes_of.where("rep < last").select("n_shingles", "s1", "s2", "rep"), ["n_shingles", "s1", "s2"]).select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))

    # every prefix shingle links its documents to the smallest of them; those of one document only are left where they are
    tokens = classes_of.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(bits_of(tokens.select("token"), "token", 25))
    postings = materialize(classes_of.select("rep", "n_shingles", "prefix").mapInArrow(_postings(bits), "doc long, n long, pos long, token long"), "postings")
    first = postings.groupBy("token").agg(F.min(F.struct("doc", "n", "pos")).alias("r"), F.max("doc").alias("last")).where("r.doc < last").drop("last")
    shared = materialize(postings.join(first, "token"), "shared")
    overlap = F.lit(1) + F.least("pos", "r.pos") + F.least(F.col("n") - F.col("pos"), F.col("r.n") - F.col("r.pos")) - 1
    star = shared.where("doc <> r.doc").where(_length_filter("n", "r.n", percent)).where(overlap >= needed(F.col("n"), F.col("r.n"), percent))
    star = star.select(F.col("r.doc").alias("x"), F.col("doc").alias("y")).distinct()
    reps = classes_of.select(F.col("rep").alias("doc_id"), "n_shingles", "parts")
    near = verified(docs, star, reps, ngram, percent)
    joined = near.where("linked").select(F.col("x").alias("src"), F.col("y").alias("dst"))

    # what is still apart although it shares a prefix shingle: documents of different components only
    comp = connected_components(joined)
    lists = shared.groupBy(F.col("r.doc").alias("r"), "doc", "n").agg(F.collect_list("token").alias("tokens"))
    placed = materialize(lists.join(comp, lists.doc == comp.node, "left").select("r", "doc", "n", "tokens", F.coalesce("component", "doc").alias("c")), "placed")
    mixed = placed.groupBy("r").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("r", F.ceil(F.col("size") / GROUP).cast("int").alias("blocks"))
    mixed = materialize(mixed, "mixed")  # so that a group of very many documents can be split in the join
    cross = apart(placed.join(mixed, "r").join(reps.select("doc_id", "parts"), F.col("doc") == F.col("doc_id")), percent)
    cross = cross.select("x", "y").join(near.select("x", "y"), ["x", "y"], "left_anti")
    more = verified(docs, cross, reps, ngram, percent).where("linked").select(F.col("x").alias("src"), F.col("y").alias("dst"))

    comp = connected_components(joined.unionByName(more).unionByName(copies))
    out = digests.select("doc_id", "n_shingles", "s1", "s2")
    out = out.join(comp, out.doc_id == comp.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "s1", "s2")
    if not links:
        return out.drop("s1", "s2")
    classes = materialize(classes_of.join(comp, classes_of.rep == comp.node, "left").select("rep", "s1", "s2", "size", F.coalesce("component", "rep").alias("component")), "members")
    found = classes.join(_class_links(few, classes, ngram, percent), ["s1", "s2"], "left").select("s1", "s2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    found = materialize(found.where("links > 0"), "links")
    number = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.join(found, ["s1", "s2"], "left").select("doc_id", "n_shingles", "component_id", number.alias("n_links"))


def keep_one(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay when one document of each group of linked ones is kept, that with the smallest doc_id.

    Of rows that share a doc_id all stay or all go; rows with a null doc_id stay.
    """
    gone = jaccard_components(docs, ngram, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
