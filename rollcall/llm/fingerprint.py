"""Document fingerprints: context-triggered piecewise hashes, compared by edit distance at compatible block sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm import codes as C
from rollcall.llm.common import documents, rebatched

#: Bytes of the rolling window; most characters of a signature; fewest wanted before the block size is halved.
WINDOW, LONGEST, FEWEST = 7, 64, 32
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)


def _signatures(raw: np.ndarray, offs: np.ndarray, sums: np.ndarray, doc: np.ndarray, end: np.ndarray, level: np.ndarray, bits: np.ndarray) -> list[str]:
    """One character for every chunk of each text; chunks end where the rolling hash ends in `bits` ones, and at the text's end."""
    n = len(offs) - 1
    cut = level >= bits[doc]
    d, e = doc[cut], end[cut]
    rank = np.arange(len(d)) - np.searchsorted(d, d)
    d, e = d[rank < LONGEST - 1], e[rank < LONGEST - 1]
    full = np.flatnonzero(np.diff(offs) > 0)
    d, e = np.concatenate([d, full]), np.concatenate([e, offs[1:][full]])
    order = np.lexsort((e, d))
    d, e = d[order], e[order]
    keep = np.ones(len(d), dtype=bool)
    keep[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1])
    d, e = d[keep], e[keep]
    start = offs[d].copy()
    inside = np.flatnonzero(d[1:] == d[:-1]) + 1
    start[inside] = e[inside - 1]
    chars = _ALPHABET[(C.spans(sums, start, e) >> np.uint64(58)).astype(np.int64)].tobytes().decode("ascii")
    at = np.searchsorted(d, np.arange(n + 1)).tolist()
    return [chars[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _levels(roll: np.ndarray) -> np.ndarray:
    """How many ones each hash ends in."""
    zeros = ~roll
    lowest = zeros & (np.uint64(0) - zeros)
    return np.where(lowest == 0, 64, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64))


def _bits(size: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(size, 1) / LONGEST)).clip(0).astype(np.int64)


def _long(raw: np.ndarray) -> str:
    """The fingerprint of one long text, read in pieces: memory is a piece's and a few numbers for each likely chunk."""
    bits = int(_bits(np.array([len(raw)]))[0])
    least, ends, levels = max(bits - 1, 0), [], []
    for a in range(0, len(raw) - WINDOW + 1, C.BLOCK):
        level = _levels(C.windows(C.TABLE[raw[a : a + C.BLOCK + WINDOW - 1]], WINDOW))
        hit = np.flatnonzero(level >= least)
        ends.append(hit + a + WINDOW)
        levels.append(level[hit])
    end, level = np.concatenate(ends), np.concatenate(levels)
    bits = least if (level >= bits).sum() + 1 < FEWEST else bits

    def signature(bits: int) -> str:
        cuts = [0, *end[level >= bits][: LONGEST - 1].tolist()]
        cuts += [len(raw)] if cuts[-1] < len(raw) else []
        out = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            h = 0
            for a in range(s, e, C.BLOCK):
                part = C.TABLE[raw[a : min(e, a + C.BLOCK)]]
                h += int((part * C.powers(len(part))).sum(dtype=np.uint64)) * pow(C.BASE, a - s, 1 << 64)
            out.append(_ALPHABET[int(C.mix(np.array([(h + e - s) % (1 << 64)], dtype=np.uint64))[0]) >> 58])
        return bytes(out).decode("ascii")

    return f"{1 << bits}:{signature(bits)}:{signature(bits + 1)}"


def fingerprints(column: pa.Array) -> list[str]:
    """`block size:signature:signature at twice the block size` of each text; equal texts have equal fingerprints."""
    raw, offsets = C.utf8(column)
    out: list[str] = []
    for i, j in C.blocks(offsets):
        part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        size = np.diff(offs)
        if j == i + 1 and len(part) > 2 * C.BLOCK:
            out.append(_long(part))
            continue
        bits = _bits(size)
        values = C.TABLE[part]
        sums = C.prefix(values)
        roll = C.windows(values, WINDOW)
        doc = np.repeat(np.arange(j - i), size)[: len(roll)]
        least = np.maximum(bits - 1, 0)
        mask = ((np.uint64(1) << least.astype(np.uint64)) - np.uint64(1))[doc]
        end = np.arange(len(roll)) + WINDOW
        hit = np.flatnonzero(((roll & mask) == mask) & (end <= offs[1:][doc]))
        level = _levels(roll[hit])
        doc, end = doc[hit], end[hit]
        few = np.bincount(doc[level >= bits[doc]], minlength=j - i) + 1 < FEWEST
        bits = np.where(few, least, bits)
        one = _signatures(part, offs, sums, doc, end, level, bits)
        two = _signatures(part, offs, sums, doc, end, level, bits + 1)
        out += [f"{1 << b}:{x}:{y}" for b, x, y in zip(bits.tolist(), one, two, strict=True)]
    return out


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the edit distance over the longer signature, at equal block sizes or at one that both have."""
    a, b = F.split(a, ":"), F.split(b, ":")
    size_a, size_b = a[0].cast("long"), b[0].cast("long")

    def near(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longer)

    return (
        F.when((a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]), F.lit(1.0))
        .when(size_a == size_b, F.greatest(near(a[1], b[1]), near(a[2], b[2])))
        .when(size_b == 2 * size_a, near(a[2], b[1]))
        .when(size_a == 2 * size_b, near(a[1], b[2]))
        .otherwise(F.lit(0.0))
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every document. Null texts are empty; one row per input row, none for an empty table."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            n = pa.array([len(t or "") for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(fingerprints(batch.column(1)))], names=["doc_id", "n_chars", "fingerprint"])

    return documents(docs).select("doc_id", "text").mapInArrow(f, "doc_id long, n_chars long, fingerprint string")


def _deal(bounds: list[int], parts: int, lowest: int | None):
    """The part that each document belongs to; the first of a part also goes, as a look-ahead, to the part before."""
    edges = np.array(bounds, dtype=np.int64)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            null = np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0))
            part = np.where(null, parts - 1, np.searchsorted(edges, ids, side="right"))
            rows, to, ahead = [np.arange(len(ids))], [part], [np.zeros(len(ids), bool)]
            for first, target in ((~null & np.isin(ids, edges), part - 1), (~null & (ids == lowest) if lowest is not None else null & False, np.full(len(ids), parts - 1))):
                rows.append(np.flatnonzero(first))
                to.append(target[first])
                ahead.append(np.ones(int(first.sum()), bool))
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int32)), pa.array(np.concatenate(ahead)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["part", "ahead", "doc_id", "text"])

    return f


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts to fingerprints of each document, of its edited text and of the next document."""

    def emit(ids: list, texts: list[str], after: str) -> pa.RecordBatch:
        follow = [*texts[1:], after]
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, follow, strict=True)]
        own = fingerprints(pa.array([*texts, after], pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(own[:-1], pa.string()),
                pa.array(fingerprints(pa.array(edited, pa.large_string())), pa.string()),
                pa.array(own[1:], pa.string()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"],
        )

    at, ids, texts, head = None, [], [], ""
    for batch in rebatched(batches, 500):
        for part, ahead, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if part != at:
                if ids:
                    yield emit(ids, texts, head)
                at, ids, texts, head = part, [], [], text
            if ahead:  # rows that are ahead come after a part's own; the first of them is the next document
                if ids:
                    yield emit(ids, texts, text)
                ids, texts = [], []
            else:
                ids.append(i)
                texts.append(text)
        if len(ids) > 1:
            yield emit(ids[:-1], texts[:-1], texts[-1])
            ids, texts = ids[-1:], texts[-1:]
    if ids:
        yield emit(ids, texts, head)


def compare_edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint each document and a version whose last half is the beginning of the next document.

    Order is by doc_id, then text; rows with null doc_id come last; after the last comes the first. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. Null texts are empty. One row
    per input row; an empty table gives no rows. Texts are shuffled once, into parts bounded by quantiles of doc_id; the
    first document of a part is sent to the part before it too.
    """
    spark = docs.sparkSession
    few = documents(docs).select("doc_id", "text")
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.0))
    row = few.agg(F.min("doc_id").alias("lowest"), F.percentile_approx("doc_id", shares, 10000).alias("q")).first()
    bounds = sorted({q for q in (row.q or []) if q > row.lowest}) if parts > 1 else []
    parts = len(bounds) + 1
    dealt = few.mapInArrow(_deal(bounds, parts, row.lowest), "part int, ahead boolean, doc_id long, text string")
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), F.coalesce("text", F.lit("")))
    out = dealt.mapInArrow(_edit, SCHEMA)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
